"""Near-duplicate classes by DartMinHash signatures and banded joins.

Signatures. A document is a set of word shingles, each an element with a weight. Darts are thrown, by hashes alone, at
the plane of weight times rank, one per unit of area on average: the region of an element between 0 and its weight
gets the same darts in every document. Each dart also has a coordinate of the signature by hash, and the dart of least
rank stays for each coordinate. As only darts below a rank of about K ln K / total weight are ever made, a signature
costs O(elements + K log K). Two documents share a coordinate with a probability of their weighted Jaccard similarity.

Classes. Documents with the same words in the same order are one node. Nodes that share a band of coordinates meet in
a bucket. Nobody lists a bucket's pairs: all members are first compared with its pivot, the node that meets most
others in all of its buckets (so that the original is compared with each of its copies). A bucket is done when its
members are in one class. In the few others, the members outside the pivot's class still have to be compared with
those of other classes. What a join's condition can rule out there is never emitted: pairs that the sizes of their
sets forbid, or the triangle inequality of the Jaccard distance as seen from the pivot, or whose signatures, at four
bits a coordinate, agree in far fewer places than two documents of the least similarity would. The pairs left are
compared on their whole sets of 64-bit shingle hashes, which are made in a second pass for the documents that met
others only, and only confirmed pairs link nodes. Copies are told by SHA-256.

A pair of similarity 0.8 shares no band with a probability of (1 - 0.8**6)**40 = 5e-6, and its signatures agree in too
few places with one of 1.3e-5 (4.2 standard deviations).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.llm._shared import U64, fresh, given_back, mix, slices, small_batches, span_hashes, text_of, utf8, word_bytes, word_spans, written

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 6
#: Coordinates of a signature: the bands take the first BANDS * ROWS, estimates use all.
K = 480
#: Sixteen coordinates of four bits make a long.
WORDS = K // 16

#: Ranks are counted in units of 2**-50; the first cell of ranks ends at 2**-6, each further one is as wide as all before it.
_UNITS, _FIRST = 50, -6
_EMPTY = U64(2**64 - 1)


@lru_cache(256)
def _poisson(area: float) -> np.ndarray:
    """The distribution function of the number of darts in a region."""
    top = int(area + 12 * math.sqrt(area) + 16)
    return np.cumsum([math.exp(k * math.log(area) - area - math.lgamma(k + 1)) for k in range(top)])


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> U64(11)).astype(np.float64) * 2.0**-53


def dart_signatures(element: np.ndarray, row: np.ndarray, weight: np.ndarray | None, rows: int, k: int = K) -> np.ndarray:
    """rows x k signature values (ranks of the earliest darts). element: 64-bit hashes; row: ascending; weight: over 0,
    or None for 1 each. A row without elements keeps the largest value everywhere."""
    out = np.full(rows * k, _EMPTY)
    total = np.bincount(row, weight, rows)
    base = mix(element.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(1))
    # cells each row needs: up to the rank at which k ln k + 2k darts are expected
    reach = np.where(total > 0, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300), 0)
    cells = np.where(total > 0, np.maximum(0, np.ceil(np.log2(np.maximum(reach, 1e-300)) - _FIRST)), -1).astype(np.int64) + 1
    done = np.zeros(rows, np.int64)
    open_rows = total > 0
    while open_rows.any():
        cells[done > 0] = done[done > 0] + 1
        for c in range(int(cells[open_rows].max())):
            live = np.flatnonzero(((cells > c) & (done <= c) & open_rows)[row])
            if len(live):
                _throw(out, base[live], row[live], None if weight is None else weight[live], c, k)
        done = np.where(open_rows, cells, done)
        # coordinates that no dart has hit yet: 2 * the ranks for those rows
        open_rows = open_rows & (out.reshape(rows, k) == _EMPTY).any(1)
    return out.reshape(rows, k)


def _throw(out: np.ndarray, base: np.ndarray, row: np.ndarray, weight: np.ndarray | None, c: int, k: int) -> None:
    """The darts of one cell of ranks, for all cells of weights: [0, 1), [1, 2), [2, 4), ..."""
    bits = _UNITS + _FIRST + max(0, c - 1)  # the cell is 2**bits units wide
    low = U64(0 if c == 0 else 1 << bits)
    v, live = 0, np.arange(len(base))
    while len(live):
        wide = 1.0 if v == 0 else 2.0 ** (v - 1)
        seed = mix(base[live] ^ U64((c * 4096 + v) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        cdf = _poisson(wide * 2.0 ** (bits - _UNITS))
        u = _unit(seed)
        hit = np.flatnonzero(u >= cdf[0])
        n = np.searchsorted(cdf, u[hit], "right")
        at = np.repeat(hit, n)
        order = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        dart = mix(seed[at] + (order.astype(U64) + U64(1)) * U64(0xA0761D6478BD642F))
        if weight is not None:
            place = (0.0 if v == 0 else wide) + wide * _unit(mix(dart ^ U64(0x589965CC75374CC3)))
            keep = place < weight[live[at]]
            dart, at = dart[keep], at[keep]
        slot = row[live[at]] * k + ((dart >> U64(32)) * U64(k) >> U64(32)).astype(np.int64)
        np.minimum.at(out, slot, low + (mix(dart ^ U64(0xE7037ED1A0B428DB)) >> U64(64 - bits)))
        if weight is None:
            return
        v += 1
        live = live[weight[live] > 2.0 ** (v - 1)]


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """rows x bands hashes, each of `rows` coordinates."""
    out = np.zeros((len(signatures), bands), U64)
    for i in range(rows):
        out = mix(out ^ signatures[:, i : bands * rows : rows]) + U64(i + 1)
    return mix(out + np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def packed_sketch(signatures: np.ndarray) -> np.ndarray:
    """rows x WORDS longs: four bits of each coordinate."""
    four = (mix(signatures) & U64(15)).reshape(len(signatures), WORDS, 16)
    return (four << (np.arange(16, dtype=U64) * U64(4))).sum(2, dtype=U64)


def _least_agreeing(similarity: float) -> int:
    """Two documents of this similarity agree in fewer of K coordinates with a probability of 1.3e-5."""
    p = similarity + (1 - similarity) / 16
    return int(K * (p - 4.2 * math.sqrt(p * (1 - p) / K)))


def _agreeing(a: str, b: str) -> Column:
    """The number of coordinates in which two packed sketches (arrays of longs) agree."""

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    return F.lit(K) - F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda n, d: n + d)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of each distinct shingle, in that order.

    A row of fewer words than `size` has one shingle of them all; one without a word has none.
    """
    start, end, first = word_spans(data, offsets)
    word = span_hashes(data, start, end)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(word), dtype=np.int64) - np.repeat(first[:-1], count)
    # shingles that begin at each word; a short row's only one ends with its last word
    last = np.minimum(np.arange(len(word)) + size, first[1:][owner] if len(word) else 0)
    whole = (last - np.arange(len(word)) == size) | ((place == 0) & (count[owner] < size))
    value = np.zeros(len(word), U64)
    padded = np.concatenate([word, np.zeros(size, U64)])
    for i in range(size):
        inside = np.arange(len(word)) + i < last
        value = np.where(inside, mix(value * U64(0xFF51AFD7ED558CCD) + padded[i : i + len(word)] + U64(i)), value)
    owner, value = owner[whole], value[whole]
    order = np.argsort((owner.astype(U64) << U64(44)) | (value >> U64(20)))
    row, sorted_ = owner[order], value[order]
    if len(row) and ((row[1:] == row[:-1]) & (sorted_[1:] < sorted_[:-1])).any():  # they differ in their lowest bits only
        order = np.lexsort((value, owner))
        row, sorted_ = owner[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (sorted_[1:] != sorted_[:-1]) | (row[1:] != row[:-1])
    return row[keep], sorted_[keep]


def copy_digests(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The SHA-256 of each row's words, one blank between two; of the row itself, marked, if it has no word."""
    plain, raw = np.where(word_bytes(data)[0], data, np.uint8(32)).tobytes(), data.tobytes()
    out = []
    for a, b in pairwise(offsets.tolist()):
        words = plain[a:b].split()
        out.append(hashlib.sha256(b" ".join(words) if words else b"\0" + raw[a:b]).digest())
    return out


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.lower(text).alias("text"), F.unhex(F.sha2(text, 256)).alias("text_key"))


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, copy (a digest of the sequence of words), n (shingles), bands and sketch of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 19):
            texts = utf8(part.column("text"))
            row, value = shingles(*texts)
            n = np.bincount(row, minlength=part.num_rows)
            signatures = dart_signatures(value, row, None, part.num_rows)
            full = n > 0
            keys = band_keys(signatures).view(np.int64)
            edges = np.concatenate([[0], np.cumsum(full * BANDS)])
            bands = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(keys[full].reshape(-1)))
            sketches = pa.FixedSizeListArray.from_arrays(pa.array(packed_sketch(signatures).view(np.int64).reshape(-1)), WORDS).cast(pa.list_(pa.int64()))
            copy = pa.array(copy_digests(*texts), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), copy, pa.array(n, pa.int32()), bands, sketches], ["doc_id", "text_key", "copy", "n", "bands", "sketch"])

    own = _own(docs, id_col, text_col)
    return small_batches(own).mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text_key binary, copy binary, n int, bands array<long>, sketch array<long>")


#: Documents that may be broadcast to pick their texts for sets of shingles (some 100 bytes each); checked each time.
PICKED = 500_000


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node and shingles of the wanted documents (written: node, doc_id, text_key); a row that repeats may tell its set again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            row, value = shingles(*utf8(part.column("text")))
            edges = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(value.view(np.int64)))], ["node", "shingles"])

    own = _own(docs, id_col, text_col).withColumnRenamed("doc_id", "_id")
    few = F.broadcast(wanted) if wanted.count() <= PICKED else wanted
    found = own.join(few, (own["text_key"] == few["text_key"]) & own["_id"].eqNullSafe(few["doc_id"]))
    return small_batches(found.select("node", "text")).mapInArrow(run, "node long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) of each node of the edges (a, b), which no driver ever holds.

    In each round a node takes the least label of its neighbours, and then its label's label, until nothing changes.
    Labels of nodes with very many links, and of labels that very many nodes have, are broadcast (see given_back).
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "links")
    links = both.count()
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"), F.count("*").alias("degree")).select("node", F.least("node", "b").alias("label"), "degree"), "labels")
    nodes = labels.count()
    while True:
        reached = given_back(both, labels.withColumnRenamed("node", "b"), ["b"], "degree", total=links)
        near = reached.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = written(labels.join(near, "node").select("node", "degree", F.least("label", "near").alias("new"), F.col("label").alias("old")), "steps")
        used = step.groupBy("new").agg(F.count("*").alias("users"))
        jump = written(used.join(labels.select(F.col("node").alias("new"), F.col("label").alias("further")), "new"), "jumps")
        step = given_back(step, jump, ["new"], "users", total=nodes)
        step = written(step.select("node", F.least("new", "further").alias("label"), "degree", (F.least("new", "further") != F.col("old")).alias("moved")), "labels")
        labels = step.select("node", "label", "degree")
        if step.filter("moved").isEmpty():
            return labels.select("node", "label")


#: Pairs that one copy of a much-compared document's set serves.
PAIRS_A_PLACE = 1000


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with their exact similarity j; both are written tables.

    The sets of the nodes a go to the nodes b. One b with very many pairs is dealt out: its set goes to one place for
    each PAIRS_A_PLACE of its pairs.
    """
    load = written(pairs.groupBy("b").agg(F.count("*").alias("_load")), "loads")
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"))
    places = F.floor(F.col("_load") / PAIRS_A_PLACE).cast("int")
    dealt = given_back(pairs.select("a", "b"), load, ["b"], "_load").withColumn("_place", F.pmod(F.xxhash64("a"), places + 1).cast("int"))
    there = load.select("b", F.explode(F.sequence(F.lit(0), places)).alias("_place")).join(side("b"), "b")
    both = dealt.select("a", "b", "_place").join(side("a"), "a").join(there, ["b", "_place"])
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.select("a", "b", (shared / (F.size("s_a") + F.size("s_b") - shared)).alias("j")).distinct()


def _fits(a: str, b: str, similarity: float):
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the least id of the class), class_size, kept (one row of each class:
    the one with the least id), _row and text_key (a number for the row, and the SHA-256 of its text).

    Two documents are linked when the Jaccard similarity of their sets of five-word shingles (letter case and
    punctuation aside) is at least `similarity`, or when their words are the same; a class is what links connect.
    A document of fewer than five words has one shingle; one without a word (null, empty, punctuation only) is linked
    to those with the same text only, null counting as empty. Rows that repeat are copies. An empty table gives no rows.
    A very long text is one set of shingles, which one task holds (8 bytes a word). Columns of docs are not in the way.
    """
    seen = written(sketch(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "sketches")
    copies = seen.groupBy("copy").agg(F.min("_row").alias("node"), F.count("*").alias("copies")).filter("copies > 1")
    copies = written(copies, "copies")
    own_rows = given_back(seen.select("_row", "doc_id", "text_key", "n", "bands", "copy"), copies, ["copy"], "copies").withColumn("node", F.coalesce("node", "_row"))
    bands = F.when(F.col("_row") == F.col("node"), F.col("bands"))
    rows = written(own_rows.select("_row", "doc_id", "text_key", "node", "n", bands.alias("bands")), "nodes")
    single = rows.filter("_row = node")

    every = single.select("node", "n", F.posexplode("bands").alias("band", "key"))
    met = every.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    member = written(given_back(every, written(met, "buckets"), ["key"], "members").filter("members is not null"), "members")
    central = member.groupBy("node").agg(F.sum("members").alias("met"))
    # met first, then the node itself, as one number pair that max_by can order
    order = F.struct("met", "node")
    pivot = member.join(central, "node").groupBy("key").agg(F.max_by("node", order).alias("pivot"), F.max_by("n", order).alias("n_pivot"), F.count("*").alias("members"))
    pivot = written(pivot, "pivots")
    total = member.count()
    placed = written(given_back(member.drop("members"), pivot, ["key"], "members", total=total), "placed")

    first = placed.filter((F.col("node") != F.col("pivot")) & _fits("n", "n_pivot", similarity)).select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    met_nodes = placed.select("node").distinct().join(single.select("node", "doc_id", "text_key"), "node")
    sets = written(shingle_sets(docs, written(met_nodes, "wanted"), id_col, text_col), "sets")
    compared = written(_confirmed(written(first, "pairs"), sets), "compared")
    links = compared.filter(F.col("j") >= similarity).select("a", "b")
    labels = components(links)

    own = placed.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    own = own.join(compared.withColumnsRenamed({"a": "node", "b": "pivot"}), ["node", "pivot"], "left")
    own = own.withColumn("j", F.when(F.col("node") == F.col("pivot"), 1.0).otherwise(F.col("j")))
    at = pivot.groupBy("pivot").agg(F.sum("members").alias("_met")).join(labels.select(F.col("node").alias("pivot"), F.col("label").alias("at")), "pivot")
    own = given_back(own, written(at, "pivot-labels"), ["pivot"], "_met", total=total).withColumn("at", F.coalesce("at", "pivot"))
    own = written(own.select("key", "band", "node", "n", "label", "at", "j"), "labelled")
    mixed = own.groupBy("key").agg(F.max(F.col("label") != F.col("at")).alias("_mixed"), F.count("*").alias("members")).filter("_mixed")
    open_ = given_back(own, written(mixed, "mixed"), ["key"], "members", total=total).filter("_mixed").drop("_mixed", "members")
    more = written(_left_over(written(open_, "open"), seen, sets, similarity), "compared")
    later = more.filter(F.col("j") >= similarity).select("a", "b")
    if not later.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).filter("a <> b").union(later))

    sized = labels.join(copies.select("node", "copies"), "node", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    named = given_back(rows.select("_row", "doc_id", "text_key", "node"), written(sized, "labels"), ["node"], "copies")
    named = written(named.select("_row", "doc_id", "text_key", F.coalesce("label", "node").alias("label")), "classes")
    sizes = named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.coalesce(F.min_by("_row", "doc_id"), F.min("_row")).alias("_stays"))
    told = given_back(named, written(sizes.filter("class_size > 1"), "sizes"), ["label"], "class_size")
    alone = F.col("class_size").isNull()
    return told.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.when(alone, True).otherwise(F.col("_row") == F.col("_stays")).alias("kept"),
        "_row",
        "text_key",
    )


def _left_over(open_: DataFrame, seen: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Exact similarities of the pairs of different classes that buckets of several classes leave possible."""
    cell = open_.join(seen.select(F.col("_row").alias("node"), "sketch", "bands"), "node")
    own = ("node", "n", "label", "j", "sketch", "bands")
    # Sets of one class of size or of neighbouring ones can be similar: that parts a large bucket.
    size = F.floor(F.log("n") / -math.log(similarity)).cast("int")
    a = cell.filter("label <> at").select("key", "band", size.alias("size"), *(F.col(c).alias(f"{c}_a") for c in own))
    near = F.explode(F.array(*(size + k for k in (-1, 0, 1))))
    b = cell.select("key", near.alias("size"), (F.col("label") == F.col("at")).alias("inner"), *(F.col(c).alias(f"{c}_b") for c in own))
    possible = (F.col("label_a") != F.col("label_b")) & _fits("n_a", "n_b", similarity) & (F.col("inner") | (F.col("node_a") < F.col("node_b")))
    possible = possible & F.coalesce(F.abs(F.col("j_a") - F.col("j_b")) <= 1 - similarity + 1e-9, F.lit(True))
    possible = possible & (_agreeing("sketch_a", "sketch_b") >= _least_agreeing(similarity))
    # A pair is told once, in the first band that it shares.
    before = [F.slice(c, F.lit(1), F.col("band")) for c in ("bands_a", "bands_b")]
    possible = possible & ~F.exists(F.zip_with(*before, lambda x, y: x == y), lambda same: same)
    pairs = a.join(b, ["key", "size"]).filter(possible).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    return _confirmed(written(pairs, "pairs"), sets)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near copies of a row that stays, with all their columns. Of rows that repeat an id and
    a text one stays at most."""
    named = lambda c: F.concat_ws("", F.col(c).isNull().cast("string"), F.col(c).cast("string"))  # no id is another one than "null"
    key = fresh(docs, "_id", "_key")
    stay = near_classes(docs, id_col, text_col).filter("kept").select(named("doc_id").alias(key[0]), F.col("text_key").alias(key[1]))
    own = docs.withColumn(key[0], named(id_col)).withColumn(key[1], F.unhex(F.sha2(text_of(text_col), 256)))
    return own.join(stay, key, "left_semi").dropDuplicates(key).drop(*key)
