"""Merkle fixity audit of WARC replicas, in DataFrame operations.

Records lie in files, each at an ordered range of offsets. A record's leaf hashes its bytes; the tree above it joins
FANOUT neighbouring slots at a time, and hashes both what they hold and the offset ranges they cover. An audit compares
the replicas' roots first and then, level by level, only the children of branches that differ, down to the records.

* A file has at most FILE_SLOTS slots, so that no group grows with the input; rows that repeat a slot are combined by
  sums, before the shuffle, and count as one leaf.
* The records' bytes are hashed where they are read; digests, lengths and offsets are all that is shuffled.
* Each tree is built once, from the leaves up, and every level is written; an audit joins roots, and then the children
  of the branches that differ only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gramloom.llm._shared import written

FILE_SLOTS, FANOUT = 1024, 32
#: Where the eighths of a digest of 64 hex digits begin; records of one slot add up in each.
PARTS = range(1, 65, 8)


def record(pages: DataFrame) -> Column:
    """A page as a WARC response record; nulls count as empty."""
    url, body = (F.coalesce(F.col(c), F.lit("")) for c in ("url", "html"))
    lines = [
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    ]
    return F.concat(*lines)


def leaves(records: DataFrame, file_slots: int = FILE_SLOTS) -> DataFrame:
    """From rows of slot (long) and record (string or binary): file_no, slot, offset, length, content of each slot.

    Slots number the records through all files, in order; a file holds file_slots of them. A null slot stands before
    all others. Several records of one slot lie side by side, and their order doesn't matter. A null record is empty; a very
    long one is hashed where it is read. Other columns are ignored, and an empty table has no leaves.
    """
    hashed = records.select(F.coalesce("slot", F.lit(-(2**62))).alias("slot"), F.octet_length("record").cast("long").alias("n"), F.sha2("record", 256).alias("h"))
    part = lambda a: F.sum(F.conv(F.substring("h", a, 8), 16, 10).cast("long"))
    merged = hashed.groupBy("slot").agg(F.sum("n").alias("length"), F.count("*").alias("_k"), *(part(a).alias(f"_{a}") for a in PARTS))
    own = merged.select(F.expr(f"slot - pmod(slot, {file_slots})").alias("_first"), "slot", "length", F.sha2(F.concat_ws("|", "_k", *(f"_{a}" for a in PARTS)), 256).alias("content"))
    before = Window.partitionBy("_first").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return own.select(
        (F.col("_first") / file_slots).cast("long").alias("file_no"),
        "slot",
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"),
        "length",
        "content",
    )


def _tree(leaf: DataFrame, fanout: int, file_slots: int, name: str) -> list[DataFrame]:
    """file_no, node, up (the node above) and digest of each level, from the leaves (written) to the roots of the files."""
    place = F.expr(f"pmod(slot, {file_slots})")
    out = [leaf.select("file_no", place.alias("node"), F.expr(f"pmod(slot, {file_slots}) div {fanout}").alias("up"), F.sha2(F.concat_ws("|", "slot", "offset", "length", "content"), 256).alias("digest"))]
    width = file_slots
    while width > 1:
        width = -(-width // fanout)
        kids = F.array_sort(F.collect_list(F.struct("node", "digest")))  # fanout of them at most
        up = out[-1].groupBy("file_no", "up").agg(kids.alias("_kids"))
        text = F.array_join(F.transform("_kids", lambda x: F.concat_ws(":", x["node"], x["digest"])), "|")
        out.append(written(up.select("file_no", F.col("up").alias("node"), F.expr(f"up div {fanout}").alias("up"), F.sha2(text, 256).alias("digest")), f"{name}-level"))
    return out


def audit(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT, file_slots: int = FILE_SLOTS) -> DataFrame:
    """What differs between two sets of leaves, one row per slot: file_no, slot, status, and offset and length in both (-1 where absent).

    status: corrupt (other bytes), missing (not in the replica), extra (only there), moved (same bytes, other offset).
    Sets that agree, and empty ones, give no rows.
    """
    sides = {"primary": written(primary, "primary-leaves"), "replica": written(replica, "replica-leaves")}
    trees = {name: _tree(leaf, fanout, file_slots, name) for name, leaf in sides.items()}
    bad = None  # the branches that differ, one level up
    for h in range(len(trees["primary"]) - 1, 0, -1):
        level = {}
        for name in sides:
            nodes = trees[name][h]
            nodes = nodes if bad is None else nodes.join(bad, ["file_no", "up"], "left_semi")
            level[name] = nodes.select("file_no", "node", F.col("digest").alias(name))
        both = level["primary"].join(level["replica"], ["file_no", "node"], "full_outer")
        differing = both.filter(~F.col("primary").eqNullSafe(F.col("replica")))
        bad = written(differing.select("file_no", F.col("node").alias("up")), "bad")
    found = []
    for name, leaf in sides.items():
        own = leaf.withColumn("up", F.expr(f"pmod(slot, {file_slots}) div {fanout}"))
        own = own.join(bad, ["file_no", "up"], "left_semi") if bad is not None else own
        found.append(own.select("file_no", "slot", *(F.col(c).alias(f"{name}_{c}") for c in ("offset", "length", "content"))))
    both = found[0].join(found[1], ["file_no", "slot"], "full_outer")
    status = (
        F.when(F.col("replica_content").isNull(), "missing")
        .when(F.col("primary_content").isNull(), "extra")
        .when(F.col("primary_content") != F.col("replica_content"), "corrupt")
        .when(F.col("primary_offset") != F.col("replica_offset"), "moved")
    )
    out = both.withColumn("status", status).filter("status is not null")
    places = ("primary_offset", "primary_length", "replica_offset", "replica_length")
    return out.select("file_no", "slot", "status", *(F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in places))
