"""The event log of a dump as sets: first-seen addresses, credentials, pairs and rows against a history.

The rules speak of rows in order; here every "not seen before" is an anti join with the history and a first occurrence
by ``(file_seq, row_idx, col_idx)`` within a key. First occurrences are partially combined minima, so that an address or
a password that holds a third of all rows is reduced before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.hashing import is_credential_hash, row_hash, sha256
from siftlake.functions.text import normalize_row
from siftlake.scratch import written

ADDRESS_HEADER = "mail|email|addr|address"
CREDENTIAL_HEADER = "pass|pwd|password|credential|secret"
EVENT_COLUMNS = ["event_type", "file_id", "file_seq", "row_idx", "address_hash", "credential_hash", "row_hash", "fields"]


def extract(rows: DataFrame, normalized: bool = False) -> DataFrame:
    """Rows with ``cells`` normalised and ``addresses, credentials`` (arrays of ``col, hash``), ``hashed``, ``malformed``.

    ``rows``: ``file_seq, file_id, row_idx, cells, header``.
    """
    # The arity needs no normalised cells: filters on it stay below the Arrow function instead of repeating it.
    rows = rows.withColumn("malformed", F.coalesce(F.size("cells") != F.size("header"), F.lit(False)))
    cells = rows if normalized else rows.withColumn("cells", normalize_row(F.col("cells")))
    named = F.transform("cells", lambda c, i: F.struct(i.alias("col"), c.alias("value"), F.lower(F.get("header", i)).alias("name")))

    def pick(header_rule: str, plain) -> Column:
        wanted = lambda c: F.when(F.col("header").isNull(), plain(c["value"])).otherwise(F.coalesce(c["name"].rlike(header_rule), F.lit(False)))
        return F.filter("named", wanted)

    hashes = lambda xs: F.transform(xs, lambda c: F.struct(c["col"].alias("col"), sha256(c["value"]).alias("hash")))
    out = cells.withColumn("named", named)
    address = pick(ADDRESS_HEADER, lambda v: v.contains("@"))
    credential = pick(CREDENTIAL_HEADER, lambda v: v.contains(":") | v.contains("pass"))
    return out.withColumns({
        "addresses": hashes(address), "credentials": hashes(credential),
        "hashed": F.exists(credential, lambda c: is_credential_hash(c["value"])),
        "row_hash": row_hash(F.col("cells")),
    }).drop("named")


def first_seen(occurrences: DataFrame, key: list[str], seen: DataFrame | None, order: list[str]) -> DataFrame:
    """The first occurrence of each key that ``seen`` lacks: ``key`` and ``at`` (a struct of ``order``)."""
    first = occurrences.groupBy(*key).agg(F.min(F.struct(*order)).alias("at"))
    return first if seen is None else first.join(seen.select(*key).distinct(), key, "left_anti")


def event_log(rows: DataFrame, history: dict[str, DataFrame] | None = None, normalized: bool = False) -> DataFrame:
    """All events of ``rows`` as ``EVENT_COLUMNS``.

    ``history`` may hold ``addresses(address_hash)``, ``credentials(credential_hash)``, ``pairs(address_hash,
    credential_hash)`` and ``rows(row_hash)``.
    """
    history = history or {}
    where = ["file_seq", "file_id", "row_idx"]
    ext = written(extract(rows, normalized).drop("header"), "extracted")  # read by every branch below

    def events(df: DataFrame, kind: str, **cols: Column) -> DataFrame:
        given = {c: cols.get(c, F.lit(None).cast("string")) for c in ("address_hash", "credential_hash", "row_hash")}
        fields = cols.get("fields", F.lit(None).cast("array<string>"))
        return df.select(
            F.lit(kind).alias("event_type"), "file_id", "file_seq", "row_idx", *[v.alias(k) for k, v in given.items()], fields.alias("fields")
        )

    malformed = ext.where("malformed")
    hashed_only = ext.where("NOT malformed AND hashed AND size(credentials) > 0 AND size(addresses) = 0")
    good = ext.where("NOT malformed AND NOT (hashed AND size(credentials) > 0 AND size(addresses) = 0)")

    occ = good.select(*where, F.explode("addresses").alias("a"), "credentials")
    occ = occ.select(*where, F.col("a.hash").alias("address_hash"), F.col("a.col").alias("acol"), "credentials")
    order = ["file_seq", "row_idx", "acol", "file_id"]
    new_address = first_seen(occ, ["address_hash"], history.get("addresses"), order)
    pairs = occ.select(*where, "address_hash", "acol", F.explode("credentials").alias("c"))
    pairs = pairs.select(*where, "address_hash", "acol", F.col("c.hash").alias("credential_hash"), F.col("c.col").alias("ccol"))
    porder = ["file_seq", "row_idx", "acol", "ccol", "file_id"]
    new_pair = first_seen(pairs, ["address_hash", "credential_hash"], history.get("pairs"), porder)
    new_credential = first_seen(pairs, ["credential_hash"], history.get("credentials"), porder)

    at = lambda df: df.withColumns({c: F.col(f"at.{c}") for c in where})
    new_address, new_credential = at(new_address), at(new_credential)
    born = new_address.select("address_hash", F.col("at").alias("born"))
    known = at(new_pair.join(born, "address_hash", "left"))
    same = F.struct("at.file_seq", "at.row_idx", "at.acol", "at.file_id").eqNullSafe(F.col("born"))

    first_row = first_seen(good, ["row_hash"], history.get("rows"), where)
    first_row = first_row.select("row_hash", *[F.col(f"at.{c}").alias(c) for c in where], F.lit(True).alias("fresh"))
    marked = good.join(first_row, ["row_hash", *where], "left")
    tags = F.concat(
        "cells", F.transform("addresses", lambda a: F.concat(F.lit("addr_sha256:"), a["hash"])),
        F.transform("credentials", lambda c: F.concat(F.lit("cred_sha256:"), c["hash"])),
    )
    col = F.col
    parts = [
        events(malformed, "malformed_row", fields=F.array(F.array_join("cells", ","))),
        events(hashed_only, "hashed_credentials_only", fields=F.array(F.concat(F.lit("cred_count:"), F.size("credentials")))),
        events(new_address, "new_address", address_hash=col("address_hash")),
        events(new_address, "address_hash", address_hash=col("address_hash")),
        events(new_credential, "credential_hash", credential_hash=col("credential_hash")),
        events(known, "addr_cred", address_hash=col("address_hash"), credential_hash=col("credential_hash")),
        events(known.where(~same), "known_address_new_credential", address_hash=col("address_hash"), credential_hash=col("credential_hash")),
        events(marked.where("fresh IS NULL"), "duplicate_row", row_hash=col("row_hash")),
        events(marked.where("fresh"), "row", row_hash=col("row_hash"), fields=tags),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def file_events(files: DataFrame) -> DataFrame:
    """F-01: one event with both digests for each file."""
    return files.select(
        F.lit("file_hash").alias("event_type"), "file_id", F.array(F.concat(F.lit("md5:"), "md5"), F.concat(F.lit("sha256:"), "file_id")).alias("fields")
    )


def history_of(events: DataFrame) -> dict[str, DataFrame]:
    """The history that ``event_log`` needs, from earlier events."""
    return {
        "addresses": events.where("event_type = 'address_hash'").select("address_hash"),
        "credentials": events.where("event_type = 'credential_hash'").select("credential_hash"),
        "pairs": events.where("event_type = 'addr_cred'").select("address_hash", "credential_hash"),
        "rows": events.where("event_type = 'row'").select("row_hash"),
    }
