import json
import random
import re

import pytest
from pyspark.sql import functions as F

from siftlake.llm import chat, quality, urlfilter
from siftlake.llm.queries import URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


TEXTS = [
    None, "", "  \n\t ", "one two", "a b c d e f g h " * 5, "é\u00a0x " * 25, "l1 x\nl2\nl1 x\n\n\nl2 ", " ".join(f"w{i}" for i in range(300)),
    "#$ | <a> & " * 9, " ".join(f"w{i % 11}" for i in range(60)) + " tail of other words here that do not repeat " * 1, "x " * 7, "x " * 8, "x " * 9,
    "\x1c sep\x1fx \x0b\x0c y", " ".join(f"w{i}" for i in range(50)) + " " + " ".join(f"w{i}" for i in range(12)),
]


def docs(spark, texts=TEXTS):
    rows = [(i if i else None, t, f"s{i % 3}" if i % 5 else None, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept int")


def test_figures(spark):
    got = quality.judge(docs(spark)).collect()
    assert len(got) == len(TEXTS)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for r in got:
        assert tuple(r[n] for n in names) == figures(TEXTS[r.doc_id or 0]), TEXTS[r.doc_id or 0]


def test_bad_hosts_go(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "short"
    rows = [(i, bad if i % 10 else good, "bad") for i in range(200)] + [(1000 + i, good, f"h{i % 20}") for i in range(400)] + [(5000, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "true AS host_failed", "'x' AS host")
    judged = {r.doc_id: r for r in quality.judge(df).collect()}
    assert not judged[0].base_failed and judged[0].host_failed and not judged[0].kept
    assert judged[1000].kept and judged[5000].kept
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.where("host_failed").collect()) == [*range(1000, 1400), 5000]


def test_prior_takes_chance_out(spark):
    """Small hosts that differ by chance only shrink all the way; hosts that differ indeed keep their rates."""
    rng = random.Random(2)
    drawn = [(f"h{k}", 4, sum(rng.random() < 0.2 for _ in range(4))) for k in range(800)]
    apart = [(f"h{k}", 400, 400 if k % 5 == 0 else 0) for k in range(100)]
    for rows, low, high in ((drawn, 30, quality.MOST_WEIGHT), (apart, quality.LEAST_WEIGHT, quality.LEAST_WEIGHT), ([], quality.MOST_WEIGHT, quality.MOST_WEIGHT)):
        mean, weight = quality.prior(spark.createDataFrame(rows, "host string, documents long, failures long"))
        assert low <= weight <= high and (not rows or abs(mean - 0.2) < 0.03)


def test_empty_host_is_no_host(spark):
    good = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(i, "short" if i < 90 else good, "") for i in range(100)], "doc_id long, text string, source string")
    assert {r.doc_id for r in quality.judge(df).where("kept").collect()} == set(range(90, 100)) == {r.doc_id for r in quality.keep_good(df).collect()}


def test_very_long_text(spark):
    rng = random.Random(1)
    text = "\n".join(" ".join(f"w{rng.randrange(50_000)}" for _ in range(20)) for _ in range(10_000)) + " a b c d e f g h" * 3
    df = spark.createDataFrame([(1, text, "h")], "doc_id long, text string, source string")
    r = quality.judge(df).first()
    windows, words = {}, WORD.findall(text)
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    assert (r.n_words, r.n_repeat_words, r.word_chars) == (len(words), len(covered), sum(map(len, words)))


def test_salted_hosts(spark, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_BYTES", -1)
    test_bad_hosts_go(spark)


def test_empty_documents(spark):
    assert quality.judge(docs(spark, [])).count() == 0 and quality.keep_good(docs(spark, [])).count() == 0


def judged_by_hand(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    hits = [(len(h + p), len(h), a, h + p) for h, p, a in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(hits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


URLS = [
    None, "", "no scheme", "http://example.com/en/x?q=1#f", "https://www.EXAMPLE.com/en/", "http://a.www.example.com/en/1", "http://notexample.com/en/",
    "http://x.net/es/", "http://net/fr/", "http://x.net/en/", "http://x.com", "http://x.com/?a", "ftp://é.com/É", "http://a://b.net/es/", "http:///en/",
    "http://" + "a." * 3000 + "com/" + "p/" * 3000, "http://x.net/es/\nline", "http://x.com/", "http://x.com/",
]


@pytest.mark.parametrize("broadcast", [True, False])
def test_urls(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(urlfilter, "BROADCAST_BYTES", -1)
    pages = spark.createDataFrame([(i if i else None, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, rule string, host string")
    rules = spark.createDataFrame([*URL_RULES, URL_RULES[0]], "host string, path string, action string")
    got = urlfilter.judge_urls(pages, rules).collect()
    assert len(got) == len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged_by_hand(URLS[r.page_id or 0])


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("host"), "id").alias("key"))
    words = urlfilter.bloom_words(keys, 128).scalar()
    assert keys.where(urlfilter.in_bloom(words, F.col("key"), 128)).count() == 3000
    other = spark.range(3000).select(F.concat(F.lit("other"), "id").alias("key"))
    assert other.where(urlfilter.in_bloom(words, F.col("key"), 128)).count() < 30


def test_upper_case_rules_and_no_pages(spark):
    rules = spark.createDataFrame([("EXAMPLE.Org", "/A", "block"), (None, "/", "block"), ("b.org", None, "block")], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://x.example.org/Ab"), (2, "http://example.org/a"), (3, "http://b.org")], "page_id long, url string")
    got = urlfilter.judge_urls(pages, rules).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("example.org/A", "block"), (None, "allow"), ("b.org", "block")]
    assert urlfilter.judge_urls(pages.limit(0), rules).count() == 0


def test_hot_urls(spark):
    """A third of the pages without URL, a third with the same one."""
    rows = [(i, (None, "http://x.net/es/1", f"http://h{i}.com/")[i % 3]) for i in range(300)]
    got = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(URL_RULES, "host string, path string, action string"))
    assert sorted((r.page_id, r.rule) for r in got.collect()) == [(i, (None, "net/es/", "com/")[i % 3]) for i in range(300)]


def test_empty_rules(spark):
    pages = spark.createDataFrame([(1, "http://x.com/")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, action string")
    assert urlfilter.judge_urls(pages, rules).first().verdict == "allow"


SCHEMA = "conv_id long, turn long, kind string, role string, content string, call_id string, name string, arguments string"
ADD = {"add": {"type": "object", "required": ["b"], "properties": {"b": {"type": "integer"}}}}


def test_tool_calls(spark):
    items = [
        (1, 0, "message", "user", 'say "hi"\n', None, None, None),
        (1, 1, "result", "tool", "42", "c1", None, None),  # logged before its call
        (1, 2, "call", "assistant", "", "c1", "add", '{"b": 2, "a": {"y": 1, "x": [1, 2]}}'),
        (1, 3, "call", "assistant", None, "c2", "add", '{"a": "text"}'),
        (1, 4, "call", "assistant", None, "c3", "add", "not json"),
        (1, 5, "result", "tool", "orphan", "c9", None, None),
        (2, 0, "message", "user", None, None, None, None), (None, None, "message", "user", "x", None, None, None),
    ]
    df = spark.createDataFrame(items, SCHEMA).selectExpr("*", "7 AS position", "'x' AS message", "1 AS place", "2 AS answered")  # names that clash
    rows = chat.link_calls(df, ADD).orderBy("conv_id", "position").collect()
    assert len(rows) == len(items)
    one = [r for r in rows if r.conv_id == 1]
    assert [(r.position, r.turn) for r in one] == [(0, 0), (1, 2), (2, 1), (3, 3), (4, 4), (5, 5)]
    assert [r.linked for r in one] == [False, True, True, False, False, False]
    assert [r.valid for r in one] == [True, True, True, False, False, True]
    message = json.loads(one[1].message)
    assert message["arguments"] == {"a": {"x": [1, 2], "y": 1}, "b": 2} and '"arguments":{"a":{"x":[1,2],"y":1},"b":2}' in one[1].message
    assert json.loads(one[0].message)["content"] == 'say "hi"\n'
    assert list(message) == sorted(message)


def places_by_hand(items):
    """Kahn's algorithm over calls; calls of circles, and calls that wait for them, keep their turns."""
    calls, backs, needs = {}, {}, {}
    for conv, turn, kind, call, wants in sorted(items, key=lambda r: r[1]):
        if kind == "call" and (conv, call) not in calls:
            calls[conv, call], needs[conv, call] = turn, {(conv, w) for w in wants or []}
        if kind == "result":
            backs.setdefault((conv, call), turn)
    at, left = {}, dict(calls)
    after = lambda p: (p[0], p[1] + 1)
    back = lambda k: max((backs[k], 0), after(at[k])) if k in backs else None
    while ready := [k for k in left if not needs[k] & left.keys()]:
        for k in ready:
            del left[k]
            at[k] = max([(calls[k], 0), *(after(back(w)) for w in needs[k] if w in at and back(w))])
    return at, {k: back(k) for k in at}, left


def test_needs_over_many_levels(spark):
    rng = random.Random(5)
    items = []
    for conv in range(12):
        names = [f"c{k}" for k in range(15)]
        turns = rng.sample(range(60), 30)
        for k, name in enumerate(names):
            wants = rng.sample(names[:k], min(k, rng.randint(0, 2)))
            items.append((conv, turns[k], "call", name, wants))
            if rng.random() < 0.8:
                items.append((conv, turns[15 + k], "result", name, None))
    items += [(99, 2 * k, "call", f"d{k}", [f"d{k + 1}"]) for k in range(30)] + [(99, 2 * k + 1, "result", f"d{k}", None) for k in range(30)]
    items += [(100, 5, "call", "x", ["y"]), (100, 6, "call", "y", ["x"]), (100, 7, "result", "x", None), (100, 8, "result", "y", None)]
    df = spark.createDataFrame(items, "conv_id long, turn long, kind string, call_id string, needs array<string>")
    df = df.selectExpr("*", "'r' AS role", "'t' AS content", "'add' AS name", "'{}' AS arguments")
    at, back, circle = places_by_hand(items)
    assert set(circle) == {(100, "x"), (100, "y")} and max(p[1] for p in at.values()) > 20
    got = chat.call_places(df, "needs").collect()
    found = {(r.conv_id, r.call_id): (tuple(r.call_at), r.result_at and tuple(r.result_at)) for r in got}
    for k in at:
        assert found[k] == (at[k], back[k])
    assert found[100, "x"] == ((5, 0), (7, 0)) and found[100, "y"] == ((6, 0), (8, 0))
    rows = chat.link_calls(df, ADD, "needs").collect()
    position = {(r.conv_id, r.kind, r.call_id): r.position for r in rows}
    for conv, _, kind, call, wants in items:
        if kind == "call" and conv != 100:
            assert position.get((conv, "result", call), 1e9) > position[conv, "call", call]
            for w in wants:
                assert position.get((conv, "result", w), -1) < position[conv, "call", call]


def schema_fits(value, schema):
    """The keywords of ``chat.fits`` over Python values."""
    kinds = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}

    def is_a(name):
        if name in ("integer", "number"):
            return isinstance(value, (int, float)) and not isinstance(value, bool) and (name == "number" or value == int(value))
        return isinstance(value, kinds[name])

    ok = "type" not in schema or any(is_a(t) for t in ([schema["type"]] if isinstance(schema["type"], str) else schema["type"]))
    same = lambda x: json.dumps(x, sort_keys=True) == json.dumps(value, sort_keys=True)
    ok = ok and ("enum" not in schema or any(map(same, schema["enum"]))) and ("const" not in schema or same(schema["const"]))
    if isinstance(value, dict):
        ok = ok and {*schema.get("required", [])} <= value.keys()
        ok = ok and all(schema_fits(value[k], s) for k, s in schema.get("properties", {}).items() if k in value)
        ok = ok and (schema.get("additionalProperties") is not False or value.keys() <= schema.get("properties", {}).keys())
    if isinstance(value, list):
        ok = ok and all(schema_fits(v, schema["items"]) for v in value if "items" in schema)
        ok = ok and schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", 1e9)
    if isinstance(value, str):
        ok = ok and schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", 1e9)
    if is_a("number"):
        ok = ok and schema.get("minimum", -1e99) <= value <= schema.get("maximum", 1e99)
    return bool(ok)


def test_schemas(spark):
    schema = {
        "type": "object", "required": ["q", "it's"], "additionalProperties": False,
        "properties": {
            "q": {"type": "string", "minLength": 1, "maxLength": 5}, "it's": {"type": ["integer", "null"], "minimum": -1, "maximum": 9},
            "x.y": {"type": "number"}, "on": {"type": "boolean"}, "mode": {"enum": ["a", "b", 3, None]},
            "list": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "object", "required": ["k"], "properties": {"k": {"const": 1}}}},
        },
    }
    good = {"q": "abc", "it's": 3}
    cases = [
        good, good | {"it's": None}, good | {"it's": 1.0}, good | {"it's": 1.5}, good | {"it's": 10}, good | {"it's": True}, good | {"q": ""},
        good | {"q": "sechse"}, good | {"x.y": 1}, good | {"x.y": 1.25}, good | {"x.y": 1e30}, good | {"x.y": "1"}, good | {"on": False}, good | {"on": 0},
        good | {"mode": "a"}, good | {"mode": 3}, good | {"mode": None}, good | {"mode": "c"}, good | {"list": []}, good | {"list": [{"k": 1}]},
        good | {"list": [{"k": 1}, {}]}, good | {"list": [{"k": 1, "z": 2}] * 4}, good | {"list": {"k": 1}}, good | {"more": 1}, {"q": "a"}, {"it's": 1}, {},
        [], [good], "text", 3, None, True,
    ]
    rows = [(i, json.dumps(c)) for i, c in enumerate(cases)] + [(1000, "not json"), (1001, None), (1002, "")]
    df = spark.createDataFrame(rows, "i long, arguments string")
    tools = {"tool": schema, "any": {}}
    valid = lambda name: chat.arguments_valid(F.lit(name), F.col("arguments"), tools)
    got = {r.i: (r.a, r.b, r.c) for r in df.select("i", valid("tool").alias("a"), valid("any").alias("b"), valid("none").alias("c")).collect()}
    assert {i: x[0] for i, x in got.items() if i < 1000} == {i: schema_fits(c, schema) for i, c in enumerate(cases)}
    assert all(got[i] == (False, False, False) for i in (1000, 1001, 1002)) and all(x[1:] == (True, False) for i, x in got.items() if i < 1000)
    with pytest.raises(ValueError, match="pattern"):
        chat.fits(F.col("v"), {"pattern": "x"})


def test_conversations(spark):
    long_ = "word " * 200_000
    rows = [(1, 0, "user", "a b"), (1, 1, "assistant", None), (1, 2, "system", "s"), (None, 0, "user", ""), (None, 1, "assistant", ""), (1, 0, "user", "a b"), (3, None, "user", "x")]
    rows += [(2, k, "user" if k % 2 == 0 else "assistant", long_ if k == 7 else f"t{k}") for k in range(3000)]  # a very long conversation
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS call_id", "2 AS kind")
    out = chat.link_calls(chat.conversation_items(df), chat.REPLY_SCHEMA).collect()
    assert len(out) == len(rows) and sum(r.linked for r in out if r.conv_id == 1) == 3 and all(r.valid for r in out)
    assert [r.call_id for r in out if r.conv_id in (None, 3)] == [None, None, None] and not any(r.linked for r in out if r.conv_id in (None, 3))
    assert all(r.position == r.turn for r in out if r.conv_id == 2) and {r.position for r in out if r.conv_id == 1} == {0, 1, 2, 3}
    assert json.loads(next(r.message for r in out if r.conv_id == 2 and r.turn == 7))["content"] == long_
    assert chat.link_calls(chat.conversation_items(df.limit(0)), chat.REPLY_SCHEMA).count() == 0
