"""N-gram Jaccard join by T-occurrence search: components of documents whose sets of word n-grams overlap enough.

Sets. A document is its set of distinct three-word shingles (64-bit hashes). Documents with equal sets are one node.

Which may link. The shingles of two linked sets of sizes up to m differ in H = floor((1 - t) 2 m / (1 + t)) places at
most. Parts of all shingles by hash, H + 2 of them, therefore hold two parts at least in which both sets are equal. A
node is listed under the digests of its parts, for its class of sizes and, near the upper end of that, for the next
class; a part of at most one shingle is listed only if the node has two such parts (of a pair's two equal parts one has
more, or both nodes have two such parts). Nodes that share an entry belong to one cluster; no link leaves a cluster.

Search. Clusters are laid out in blocks of BLOCK shingles, smaller ones together; a cluster of several blocks is
searched by pairs of blocks. Within a task each shingle has an inverted list. A query, a node of n shingles, can link
with those in T = ceil(t n) of its lists or more. DivideSkip puts its L longest lists aside, merges the short ones (one
sort stands for the heap: it brings the same lists together), keeps candidates that come up T - L times for the sizes
at hand, and probes the long lists for these by bisection. Nodes that few comparisons link beforehand (with the most
central nodes) are not searched against each other; a task tells no more links than it has nodes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm._shared import U64, given_back, mix, quoted, slices, small_batches, span_hashes, text_of, utf8, written
from gramloom.llm.near_dup import components
from gramloom.operators.counts import prefix_sums

SHINGLE = 3
#: The least similarity, as a fraction of whole numbers.
SIMILARITY = (90, 100)
#: Shingles of a block.
BLOCK = 1 << 20
#: Sizes of a class end at this multiple of where they begin.
WIDTH = 1.3
#: DivideSkip's parameter: L = T / (MU log2(longest list) + 1).
MU = 0.0085
#: List entries, or probes, that one numpy pass holds.
PASS = 1 << 20

_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with A-Z in lower case; start and end of each word (what white space ends); the first word of each row."""
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = _WORD[low]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(begin)
    return low, start, np.flatnonzero(end) + 1, np.searchsorted(start, offsets)


def shingles(low: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, in that order; a row of fewer words has one of them all."""
    word, count = span_hashes(low, start, end), np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(word))
    left = first[1:][owner] - at if len(word) else at
    value = np.zeros(len(word), U64)
    for i in range(size):
        more = np.flatnonzero(left > i)
        value[more] = mix(value[more] * U64(0x9E6C63D0876A9A75) + word[more + i] + U64(i + 1))
    whole = (left >= size) | ((count[owner] < size) & (at == first[:-1][owner])) if len(word) else left > 0
    owner, value = owner[whole], value[whole]
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return owner[keep], value[keep]


@lru_cache(8)
def size_classes(similarity: tuple[int, int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the classes of sizes up to `most` begin, and the number of parts of each (0: only equal sets link)."""
    a, b = similarity
    begins = [1]
    while begins[-1] <= most:
        begins.append(max(begins[-1] + 1, math.ceil(begins[-1] * max(WIDTH, b / a))))
    begins.append(math.ceil(begins[-1] * max(WIDTH, b / a)))
    differ = [2 * (x - 1) * (b - a) // (a + b) for x in begins[1:]]
    return np.array(begins[:-1]), np.array([d + 2 if d else 0 for d in differ])


def part_keys(row: np.ndarray, value: np.ndarray, n: np.ndarray, similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Row and digest of each part under which a set is listed."""
    a, b = similarity
    begins, parts = size_classes(similarity, 1 << max(4, int(n.max(initial=1)).bit_length() + 1))
    own = np.searchsorted(begins, n, "right") - 1
    out = []
    for ahead in (0, 1):
        k = np.maximum(own + ahead, 0)
        live = n > 0
        if ahead:  # could a larger set of the next class link with it?
            live = live & (n * b // a >= begins[np.minimum(k, len(begins) - 1)])
        p = np.where(live, parts[np.minimum(k, len(parts) - 1)], 0)
        base = np.cumsum(p) - p
        some = np.flatnonzero(p[row] > 0)
        r, v = row[some], value[some]
        at = base[r] + ((mix(v + U64(0x2545F4914F6CDD1D)) >> U64(32)) * p[r].astype(U64) >> U64(32)).astype(np.int64)
        size = np.bincount(at, minlength=int(p.sum()))
        digest = np.zeros(len(size), U64)
        np.add.at(digest, at, mix(v ^ U64(0x6A09E667F3BCC909)))
        owner = np.repeat(np.arange(len(n)), p)
        number = np.arange(len(size)) - base[owner]
        thin = size <= 1
        keep = ~thin | (np.bincount(owner[thin], minlength=len(n))[owner] >= 2)
        key = mix(digest + mix((k[owner] * (1 << 40) + number + 1).astype(U64)))
        out.append((owner[keep], key[keep]))
    owner, key = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(owner, kind="stable")
    return owner[order], key[order]


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(quoted(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("text_key"))


def listed(docs: DataFrame, id_col: str, text_col: str, size: int, similarity: tuple[int, int]) -> DataFrame:
    """doc_id, text_key, n (shingles), same (equal sets have it equal; null without a word) and parts of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            low, start, end, first = words_of(*utf8(part.column("text")))
            row, value = shingles(low, start, end, first, size)
            n = np.bincount(row, minlength=part.num_rows)
            owner, key = part_keys(row, value, n, similarity)
            sums = np.zeros((2, part.num_rows), U64)
            for k, salt in enumerate((0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B)):
                np.add.at(sums[k], row, mix(value ^ U64(salt)))
            same = [a.tobytes() + b.tobytes() if m else None for a, b, m in zip(*sums, n.tolist(), strict=True)]
            for i in np.flatnonzero(n == 1).tolist():  # one shingle: by its words, for short texts are many
                spans = range(first[i], min(first[i] + size, first[i + 1]))
                same[i] = hashlib.sha256(b" ".join(low[start[w] : end[w]].tobytes() for w in spans)).digest()
            edges = np.searchsorted(owner, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(key.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(n), pa.array(same, pa.binary()), lists], ["doc_id", "text_key", "n", "same", "parts"])

    own = _own(docs, id_col, text_col)
    return small_batches(own).mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text_key binary, n long, same binary, parts array<long>")


#: Documents that may be broadcast to pick their texts (some 100 bytes each); checked each time.
PICKED = 500_000


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """node and shingles of the wanted (written: node, doc_id, text_key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            row, value = shingles(*words_of(*utf8(part.column("text"))), size)
            edges = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(value.view(np.int64)))], ["node", "shingles"])

    own = _own(docs, id_col, text_col).withColumnRenamed("doc_id", "_id")
    few = F.broadcast(wanted) if wanted.count() <= PICKED else wanted
    found = own.join(few, (own["text_key"] == few["text_key"]) & own["_id"].eqNullSafe(few["doc_id"]))
    told = small_batches(found.select("node", "text")).mapInArrow(run, "node long, shingles array<long>")
    return told.groupBy("node").agg(F.first("shingles").alias("shingles"))  # a repeated row tells it again


class Forest:
    """Which of n nodes are linked; links are those that joined two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return int(x)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            one, two = self.find(x), self.find(y)
            if one != two:
                self.root[max(one, two)] = min(one, two)
                self.links.append((x, y))

    def labels(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return self.root
            self.root = up


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start .. start + length - 1 of each, one after the other."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


class Lists:
    """The nodes of a task and the inverted lists of their shingles."""

    def __init__(self, value: np.ndarray, offsets: np.ndarray, similarity: tuple[int, int]):
        self.a, self.b = similarity
        self.first, self.n = offsets[:-1], np.diff(offsets)
        self.count = len(self.n)
        _, self.token = np.unique(value, return_inverse=True)
        owner = np.repeat(np.arange(self.count), self.n)
        self.size = np.bincount(self.token, minlength=1)
        self.start = np.cumsum(self.size) - self.size
        order = np.argsort(self.token, kind="stable")
        self.post = owner[order]  # each list in the order of nodes
        self.spot = self.token[order] * self.count + self.post  # ascending: for bisection
        self.forest = Forest(self.count)

    def needed(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The least overlap with which sets of n and m shingles link."""
        return -(-self.a * (n + m) // (self.a + self.b))

    def central(self) -> None:
        """Link nodes with each of 64, from those whose lists are longest on average to those whose are shortest."""
        mean = np.add.reduceat(self.size[self.token], self.first) / self.n
        for node in np.argsort(-mean, kind="stable")[:: max(1, self.count // 64)][:64].tolist():
            mark = np.zeros(len(self.size), bool)
            mark[self.token[self.first[node] : self.first[node] + self.n[node]]] = True
            near = np.flatnonzero(np.add.reduceat(mark[self.token].astype(np.int64), self.first) >= self.needed(self.n, self.n[node]))
            self.forest.link(np.full(len(near), node), near)

    def search(self, side: np.ndarray, across: bool) -> list[tuple[int, int]]:
        """Links that connect all nodes that links connect; across: only links between the two sides have to be found."""
        if self.count > 200:
            self.central()
        label = self.forest.labels()
        largest = np.bincount(label).argmax()
        asks = np.flatnonzero((label != largest) | (np.bincount(label)[largest] == 1))
        asking = np.zeros(self.count, bool)
        asking[asks] = True
        length = self.size[self.token]
        by_length = np.lexsort((length, np.repeat(np.arange(self.count), self.n)))  # each node's lists, shortest first
        least = -(-self.a * self.n // self.b)
        longest = length[by_length[self.first + self.n - 1]]
        aside = np.minimum(least - 1, (least / (MU * np.log2(np.maximum(longest, 2)) + 1)).astype(np.int64))
        short = self.n - aside
        own = _runs(self.first[asks], short[asks])
        load = np.add.reduceat(length[by_length[own]], np.cumsum(short[asks]) - short[asks]) if len(asks) else asks
        chunk = np.cumsum(load) // PASS
        for c in np.unique(chunk):
            self._chunk(asks[chunk == c], by_length, short, aside, asking, side, across)
        return self.forest.links

    def _chunk(self, asks: np.ndarray, by_length: np.ndarray, short: np.ndarray, aside: np.ndarray, asking: np.ndarray, side: np.ndarray, across: bool) -> None:
        token = self.token[by_length[_runs(self.first[asks], short[asks])]]
        who = np.repeat(np.repeat(asks, short[asks]), self.size[token])
        other = self.post[_runs(self.start[token], self.size[token])]
        label = self.forest.labels()
        ok = (label[who] != label[other]) & (~asking[other] | (other < who))
        ok &= (self.n[who] * self.a <= self.n[other] * self.b) & (self.n[other] * self.a <= self.n[who] * self.b)
        if across:
            ok &= side[who] != side[other]
        pair, times = np.unique(who[ok] * self.count + other[ok], return_counts=True)
        who, other = pair // self.count, pair % self.count
        need = self.needed(self.n[who], self.n[other])
        open_ = times + aside[who] >= need
        who, other, times, need = who[open_], other[open_], times[open_], need[open_]
        group = np.cumsum(aside[who]) // PASS
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            label = self.forest.labels()
            at = at[label[who[at]] != label[other[at]]]
            w, o = who[at], other[at]
            lists = self.token[by_length[_runs(self.first[w] + short[w], aside[w])]]
            key = lists * self.count + np.repeat(o, aside[w])
            spot = np.minimum(np.searchsorted(self.spot, key), len(self.spot) - 1)
            hits = np.bincount(np.repeat(np.arange(len(at)), aside[w]), self.spot[spot] == key, len(at)).astype(np.int64)
            good = times[at] + hits >= need[at]
            self.forest.link(w[good], o[good])


def _linked(group: pa.Table, similarity: tuple[int, int]) -> pa.Table:
    lists = group.column("shingles").combine_chunks()
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    value = np.asarray(lists.values)[offsets[0] : offsets[-1]].view(U64)
    node, block = (np.asarray(group.column(c)) for c in ("node", "block"))
    links = Lists(value, offsets - offsets[0], similarity).search(block, bool((block != block[0]).any()))
    a, b = (np.array([x[k] for x in links], np.int64) for k in (0, 1))
    return pa.table({"a": node[a], "b": node[b]})


def _tasks(members: DataFrame, block: int, similarity: tuple[int, int]) -> DataFrame:
    """node, block, low, high: the pairs of blocks in which each node (node, label, n) is searched."""
    placed = prefix_sums(members, ["label", "n", "node"], "n", "_from", "_to")
    placed = written(placed.select("node", "label", "n", F.floor(F.col("_from") / block).alias("block")), "blocks")
    spans = placed.groupBy("label", "block").agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"))
    spans = written(spans, "spans")
    wide = spans.groupBy("label").agg(F.count("*").alias("_blocks")).filter("_blocks > 1").select("label")
    wide = written(spans.join(wide, "label", "left_semi").withColumnRenamed("block", "other"), "wide")
    a, b = similarity
    fits = (F.col("n_max") * b >= F.col("n") * a) & (F.col("n") * b >= F.col("n_min") * a)
    each = placed.join(wide, "label", "left").filter(F.col("other").isNull() | fits)
    other = F.coalesce("other", "block")
    return each.select("node", "block", F.least("block", other).alias("low"), F.greatest("block", other).alias("high"))


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id (the least id that links reach, its own included) of each row of docs.

    Two rows link when b * intersection >= a * union of their sets of distinct shingles of `size` words (A-Z in lower
    case, words ended by white space), with similarity (a, b). A row of fewer words has one shingle; one without a word
    (null, empty, white space only) has none and links with nothing. Equal sets are one node, so that copies and
    repeated rows are never paired. A null id stands behind all others: a component has it only if it has no other. An
    empty table gives no rows. A very long text is one set, held by one task (8 bytes a shingle). Other columns are not
    looked at. Nothing is capped: a cluster of m blocks costs up to m * (m + 1) / 2 searches of two blocks.
    """
    seen = written(listed(docs, id_col, text_col, size, similarity).withColumn("_row", F.monotonically_increasing_id()), "listed")
    copies = seen.filter("same is not null").groupBy("same").agg(F.min("_row").alias("node"), F.count("*").alias("copies")).filter("copies > 1")
    copies = written(copies, "copies")
    rows = given_back(seen.drop("parts"), copies, ["same"], "copies").withColumn("node", F.coalesce("node", "_row"))
    rows = written(rows.select("_row", "doc_id", "text_key", "node", "n", F.xxhash64("same").alias("set")), "rows")

    # Copies list the same parts: an entry counts if two different sets have it. (Two sets of one hash share a cluster.)
    every = seen.filter("n > 0").select(F.xxhash64("same").alias("node"), F.explode("parts").alias("key"))
    hubs = every.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("_top"), F.count("*").alias("met"))
    hubs = written(hubs.filter("hub <> _top").drop("_top"), "hubs")
    met = written(given_back(every, hubs, ["key"], "met").filter("hub IS NOT NULL").select("node", "hub").distinct(), "met")
    # A node's first hub stands for it in its other entries: one edge a node, and those between hubs.
    first = met.groupBy("node").agg(F.min("hub").alias("a"))
    between = met.join(first, "node").filter("a <> hub").select("a", F.col("hub").alias("b"))
    clusters = components(first.filter("node <> a").select("a", F.col("node").alias("b")).union(between).distinct())
    single = rows.filter("_row = node AND n > 0").select("node", "set", "n", "doc_id", "text_key")
    members = written(clusters.withColumnRenamed("node", "set").join(single, "set").drop("set"), "members")

    sets = _sets(docs, members.select("node", "doc_id", "text_key"), id_col, text_col, size)
    searched = sets.join(_tasks(members.select("node", "label", "n"), block, similarity), "node").select("node", "block", "low", "high", "shingles")
    links = searched.groupBy("low", "high").applyInArrow(lambda group: _linked(group, similarity), "a long, b long")
    labels = components(written(links, "pairs"))

    sized = labels.join(copies.select("node", "copies"), "node", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    named = given_back(rows.select("doc_id", "node", "n"), written(sized, "labels"), ["node"], "copies")
    named = written(named.select("doc_id", "n", F.coalesce("label", "node").alias("label")), "named")
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("_size")).filter("_size > 1")
    told = given_back(named, written(least, "least"), ["label"], "_size")
    return told.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
