import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlake.sources import dumps, large
from siftlake.sources import parsers as p


def machine(text):
    """A character at a time."""
    rows, row, cell, quoted, i = [], [], "", False, 0
    while i < len(text):
        c = text[i]
        if c == '"':
            if quoted and text[i + 1 : i + 2] == '"':
                cell += '"'
                i += 1
            else:
                quoted = not quoted
        elif c == "\r":
            pass
        elif c in ",\n" and not quoted:
            row.append(cell)
            cell = ""
            if c == "\n":
                rows.append(row)
                row = []
        else:
            cell += c
        i += 1
    if cell or row:
        rows.append([*row, cell])
    return rows


@given(st.text(alphabet='ab",\n\r ', max_size=30))
@settings(max_examples=500, deadline=None)
def test_csv_machine(text):
    assert p.parse_csv(text) == machine(text)


def test_csv_cases():
    assert p.parse_csv('a,"b,c"\n\n1,"x""y"\r\nlast') == [["a", "b,c"], [""], ["1", 'x"y'], ["last"]]
    assert p.parse_csv('a,"open\nrest') == [["a", "open\nrest"]]


def test_json_cases():
    assert p.parse_json('[{"b":1,"a":{"x":null}},{"c":[1,"t"]}]') == [["a.x", "b", "c"], ["", "1", ""], ["", "", "[1, t]"]]
    assert p.parse_json("[[1,true],[null]]") == [["1", "true"], [""]]
    assert p.parse_json('["x",2]') == [["x"], ["2"]]
    assert p.parse_json('{"b":{"z":1,"a":"q"},"a":false}') == [["false", "q", "1"]]
    assert p.parse_json("[]") == [] and p.parse_json("7") == [["7"]]


def test_xml_and_lines():
    assert p.parse_xml('<?xml?><a k="1"> t </a><b></b>tail<c>u</c>') == [['a k="1"', "t"], ["c", "u"]]
    with pytest.raises(ValueError):
        p.parse_xml("plain")
    assert p.parse_csv_line('a,"b ""c""",') == ["a", 'b "c"', ""]
    for bad in ('a"b', '"open', '"x"y'):
        with pytest.raises(ValueError):
            p.parse_csv_line(bad)
    assert p.json_line({"b": "x", "a": [1]}) == ["a:[1]", 'b:"x"']
    assert p.parse_json_array('[{"a":1}, {"b":"}"}]') == [["a:1"], ['b:"}"']]


def test_load_dump(spark, tmp_path):
    (tmp_path / "a.csv").write_text("email,pw\nx@y.org,1\nz@y.org\n")
    (tmp_path / "b.yaml").write_text("a: 1")
    (tmp_path / "c.csv").write_bytes(b"\x00\x01\x02")
    (tmp_path / "d.csv").write_bytes(b"")
    rows = dumps.load_dump(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.yaml", f"{tmp_path}/c.csv", f"{tmp_path}/d.csv"]).cache()
    assert [r.error for r in rows.where("error IS NOT NULL").orderBy("file_seq").collect()] == ["unsupported format", "binary content"]
    heads, data = dumps.split_header(rows)
    assert heads.first().header == ["email", "pw"] and data.count() == 2
    cells = dumps.long_cells(data).orderBy("row_idx", "col_idx").collect()
    assert [(r.row_idx, r.col_name, r.value) for r in cells] == [(1, "email", "x@y.org"), (1, "pw", "1"), (2, "email", "z@y.org")]


def test_safety_and_compression(spark):
    data = [b"plain", b"", b"\x7fELFx", b"MZxx", b"a\x00b", b"\x01\x02ab", b"\xff\xfeok"]
    df = spark.createDataFrame([(bytearray(d),) for d in data], "c binary").select(dumps.file_safety(F.col("c")).alias("s"))
    got = [(r.s.is_safe, r.s.is_binary, r.s.confidence) for r in df.collect()]
    assert got == [(True, False, 0), (False, False, 0), (False, True, 99), (False, True, 98), (False, True, 95), (False, True, 50), (True, False, 40)]
    df = spark.createDataFrame([(bytearray(b"PK\x03\x04"), "x.ZIP")], "c binary, p string").select(dumps.compression(F.col("c"), F.col("p")).alias("k"))
    assert tuple(df.first().k) == ("zip", "zip")


def test_nesting(spark):
    assert spark.range(1).select(dumps.check_nesting(F.lit(3))).first()[0]
    with pytest.raises(Exception, match="nesting"):
        spark.range(1).select(dumps.check_nesting(F.col("id") + 4)).collect()


def dump_texts(n=60):
    rng = random.Random(3)
    parts = ["a", "bc", ",", "\n", "\r\n", '"', '""', '"x,\ny"', "é", " ", "long cell " * 3]
    for _ in range(n):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        yield text if text.endswith("z") else text + "z"  # the last cell is never empty
    yield from ["", "plain,1\nrow,2\n", '"' + "q\n" * 40 + '",after\nnext,row\n', "x\n" * 30, 'a,"open\n' + "rest\n" * 20 + "z"]


def test_large_csv_equals_whole_files(spark, tmp_path):
    """Splits of a few bytes: rows cross borders, whole splits lie within quotes."""
    texts = [*dump_texts()]
    for k, t in enumerate(texts):
        (tmp_path / f"f{k:03d}.csv").write_bytes(t.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for few in (large.BROADCAST_SPLITS, 0):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "23")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        old, large.BROADCAST_SPLITS = large.BROADCAST_SPLITS, few
        try:
            rows = large.read_rows(spark, str(tmp_path)).collect()
        finally:
            large.BROADCAST_SPLITS = old
            for k, v in before.items():
                spark.conf.set(k, v)
        got = {}
        for r in rows:
            got.setdefault(int(r.path[-7:-4]), {})[r.row_idx] = r.cells
        for k, t in enumerate(texts):
            assert [got.get(k, {})[i] for i in range(len(got.get(k, {})))] == p.parse_csv(t), t


def test_large_files_in_a_dump(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dumps, "LARGE", 20)
    (tmp_path / "a.csv").write_text('email,pw\nx@y.org,"1\n2"\nz@y.org,3\n')
    (tmp_path / "b.tsv").write_text('k\tv "\n1\tlonger than the rest\r\n')
    (tmp_path / "c.csv").write_text("small,1\n")
    (tmp_path / "d.json").write_text('[{"a": "a long document stays whole"}]')
    rows = dumps.load_dump(spark, [f"{tmp_path}/{n}" for n in ("a.csv", "b.tsv", "c.csv", "d.json")]).orderBy("file_seq", "row_idx").collect()
    assert [(r.file_seq, r.row_idx, r.cells) for r in rows] == [
        (0, 0, ["email", "pw"]), (0, 1, ["x@y.org", "1\n2"]), (0, 2, ["z@y.org", "3"]), (1, 0, ["k", 'v "']), (1, 1, ["1", "longer than the rest"]),
        (2, 0, ["small", "1"]), (3, 0, ["a"]), (3, 1, ["a long document stays whole"]),
    ]
    assert all(len(r.file_id) == 64 and r.error is None for r in rows) and len({r.file_id for r in rows}) == 4


def test_adapters(spark, tmp_path):
    (tmp_path / "a.semi").write_text("x;y\n1;2\n")
    p.register("semi", lambda t: [line.split(";") for line in t.splitlines()])
    assert [r.cells for r in dumps.load_dump(spark, f"{tmp_path}/a.semi").orderBy("row_idx").collect()] == [["x", "y"], ["1", "2"]]
    with pytest.raises(ValueError, match="extension"):
        p.register("A b", str.split)
