"""The set form of the event log against rows taken one by one."""

import hashlib
import random
from collections import Counter

from siftlake.operators import events

HEADER = ["email", "mail2", "password", "secret"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def one_by_one(rows, history):
    seen_a, seen_c, seen_p, seen_r = (set(history[k]) for k in ("a", "c", "p", "r"))
    out = Counter()
    for i, cells in rows:
        if len(cells) != len(HEADER):
            out[("malformed_row", i, None, None, None)] += 1
            continue
        addresses, credentials = [sha(c) for c in cells[:2]], [sha(c) for c in cells[2:]]
        for a in addresses:
            new = a not in seen_a
            if new:
                out[("new_address", i, a, None, None)] += 1
                out[("address_hash", i, a, None, None)] += 1
                seen_a.add(a)
            for c in credentials:
                if c not in seen_c:
                    out[("credential_hash", i, None, c, None)] += 1
                    seen_c.add(c)
                if (a, c) not in seen_p:
                    seen_p.add((a, c))
                    out[("addr_cred", i, a, c, None)] += 1
                    if not new:
                        out[("known_address_new_credential", i, a, c, None)] += 1
        h = sha("|".join(cells))
        out[("row" if h not in seen_r else "duplicate_row", i, None, None, h)] += 1
        seen_r.add(h)
    return out


def test_random_dumps(spark):
    rng = random.Random(5)
    for _ in range(4):
        rows = []
        for i in range(60):
            cells = [f"a{rng.randrange(8)}@x.org", f"a{rng.randrange(8)}@x.org", f"p{rng.randrange(5)}", f"p{rng.randrange(5)}"]
            rows.append((i, cells if rng.random() > 0.1 else cells[:3]))
        old = {"a": {sha("a1@x.org")}, "c": {sha("p1")}, "p": {(sha("a1@x.org"), sha("p1"))}, "r": {sha("|".join(rows[0][1]))}}
        df = spark.createDataFrame([(0, "f", i, c, HEADER) for i, c in rows], "file_seq long, file_id string, row_idx long, cells array<string>, header array<string>")
        history = {
            "addresses": spark.createDataFrame([(x,) for x in old["a"]], "address_hash string"),
            "credentials": spark.createDataFrame([(x,) for x in old["c"]], "credential_hash string"),
            "pairs": spark.createDataFrame([*old["p"]], "address_hash string, credential_hash string"),
            "rows": spark.createDataFrame([(x,) for x in old["r"]], "row_hash string"),
        }
        log = events.event_log(df, history).collect()
        assert Counter((r.event_type, r.row_idx, r.address_hash, r.credential_hash, r.row_hash) for r in log) == one_by_one(rows, old)


def test_headerless_and_hashed_only(spark):
    rows = [(0, "f", 0, ["5f4dcc3b5aa765d61d8327deb882cf99:pass"], None), (0, "f", 1, ["x@y.org"], None), (0, "f", 2, ["a" * 32], ["credential"])]
    df = spark.createDataFrame(rows, "file_seq long, file_id string, row_idx long, cells array<string>, header array<string>")
    log = events.event_log(df).collect()
    assert [r.row_idx for r in log if r.event_type == "hashed_credentials_only"] == [2]
    assert [r.row_idx for r in log if r.event_type == "new_address"] == [1]
