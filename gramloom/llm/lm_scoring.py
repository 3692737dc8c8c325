"""Cross-entropy difference: each document's loss under a target model less its loss under a background model.

Both are bigram models over one vocabulary, alike in all but their corpus. Words are those of
_shared.word_spans, in lower case; the vocabulary is every word of all documents. Words and pairs of words are told
apart by 64-bit hashes, and each of them has counts of its own, however many there are.

    p(w)   = (c(w) + 1) / (N + V)                  V: the distinct words of all documents
    p(w|h) = (c(hw) + MU p(w)) / (c(h) + MU)       h: the word before, or the document's begin

A document is scored by models that have not seen it: its own words and pairs are taken out of the counts of its side,
so that a document of the target doesn't look like the target because it is known by heart.

The two are matched in size as well: the background is every document that is not in the target, and its counts are
weighed by the target's words over its own (up or down), so that smoothing weighs as much in the one as in the other.
(That is what a sample of the target's size has on average, but every document counts.)

No table of all n-grams is ever joined to tokens, or held in one place. Documents are dealt out to blocks of some
BLOCK bytes of text. A block sends its distinct n-grams with its own counts to the buckets of their hashes, a bucket
adds up what all blocks have sent, and sends the totals back, in the order in which each block has asked. So a block
learns the counts of its own n-grams only, an n-gram costs one entry of a block however often it occurs there, and no
n-gram is hot. Blocks and buckets grow in number with the input, not in size. A first pass counts texts and words.
The target's ids are broadcast if there are MARKS at most; more are joined by their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm._shared import U64, mix, slices, small_batches, span_hashes, text_of, utf8, word_spans

MU = 16.0
#: Ids of target documents that may be broadcast (8 bytes each, some 100 MB as Spark's hash table); checked each time.
MARKS = 4_000_000
#: Bytes of text of a block (a longer document is a block of its own size); least number of buckets; blocks a bucket.
BLOCK, BUCKETS, BLOCKS_A_BUCKET = 8 << 20, 512, 2
#: Distinct words that a task of the first pass holds before it hands them on.
HELD = 1 << 20
_BEGIN = U64(0x243F6A8885A308D3)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, of its predecessor, and of the two as a pair; and the first word of each row (one more than rows)."""
    start, end, first = word_spans(data, offsets)
    word = span_hashes(data, start, end)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    begins = first[:-1][np.diff(first) > 0]
    before[begins] = _BEGIN
    return word, before, mix(before * U64(0x9FB21C651E98DF25) + word), first


def _block_ids(n_blocks: int):
    """By the number of the row, so that equal rows are dealt out as well. Both passes number the same scan; should the
    rows come in another order, a block misses what it asked for, and that is an error."""
    return F.pmod(F.xxhash64("_row"), F.lit(n_blocks)).cast("int")


def _added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts (two columns)."""
    keys, which = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
    n = np.concatenate([x[1] for x in found])
    return keys, np.stack([np.bincount(which, n[:, k], len(keys)) for k in (0, 1)], 1).astype(np.int64)


def corpus_size(marked: DataFrame) -> tuple[int, int, int, int]:
    """Distinct words, words, words of the target, and bytes of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list = []
        size = 0

        def told() -> pa.RecordBatch:
            keys, n = _added(found)
            columns = [pa.array([None, *keys.view(np.int64).tolist()], pa.int64()), *(pa.array(np.append(0, n[:, k])) for k in (0, 1)), pa.array(np.append(size, np.zeros(len(keys), np.int64)))]
            return pa.RecordBatch.from_arrays(columns, ["word", "n", "n_target", "size"])

        for part in slices(batches):
            data, offsets = utf8(part.column("text"))
            start, end, first = word_spans(data, offsets)
            target = np.repeat(np.asarray(part.column("mark").to_numpy(zero_copy_only=False), bool), np.diff(first))
            found.append(_added([(span_hashes(data, start, end), np.stack([np.ones(len(target)), target], 1))]))
            size += len(data)
            if len(found) > 16:
                found = [_added(found)]
                if len(found[0][0]) > HELD:
                    yield told()
                    found, size = [], 0
        if found:
            yield told()

    words = small_batches(marked).mapInArrow(run, "word long, n long, n_target long, size long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", "n_target", "size")))
    return tuple(x or 0 for x in words.agg(F.count("word"), F.sum("n"), F.sum("n_target"), F.sum("size")).first())


class Block:
    """The tokens of a block, as places in the sorted array of its distinct n-grams' keys."""

    def __init__(self, table: pa.Table):
        parts = list(slices(table.to_batches()))
        seen = [tokens(*utf8(x.column("text"))) for x in parts]
        self.sizes = np.concatenate([np.diff(x[3]) for x in seen])
        self.parts = parts
        kinds, self.at = [], []
        for k, salt in enumerate((0x2D358DCCAA6C78A5, 0x8BB84B93962EACC9, 0)):
            # words, words as predecessors and pairs are keys of one space; pairs are mixed already
            keys, which = np.unique(np.concatenate([x[k] for x in seen]), return_inverse=True)
            kinds.append(mix(keys ^ U64(salt)) if salt else keys)
            self.at.append(which)
        self.keys, place = np.unique(np.concatenate(kinds), return_inverse=True)
        edges = np.cumsum([0, *map(len, kinds)])
        self.at = [place[lo:hi][which] for lo, hi, which in zip(edges, edges[1:], self.at, strict=False)]

    def counts(self) -> np.ndarray:
        marks = np.concatenate([np.asarray(x.column("mark").to_numpy(zero_copy_only=False), bool) for x in self.parts])
        target = np.repeat(marks, self.sizes)
        return np.stack([sum(np.bincount(at[some], minlength=len(self.keys)) for at in self.at) for some in (slice(None), target)], 1)


def _times(row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each entry's value stands in its row."""
    _, which, times = np.unique(row * (int(at.max(initial=0)) + 1) + at, return_inverse=True, return_counts=True)
    return times[which]


def planes(*values: np.ndarray) -> bytes:
    """Numbers of 64 bits as their lowest bytes, then their second bytes and so on: zeros stand together and compress."""
    return b"".join(np.ascontiguousarray(v.astype(U64).view(np.uint8).reshape(-1, 8).T).tobytes() for v in values)


def unplaned(data: bytes, columns: int) -> list[np.ndarray]:
    return [np.ascontiguousarray(x.T).view(U64).reshape(-1) for x in np.frombuffer(data, np.uint8).reshape(columns, 8, -1)]


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, target_bits and background_bits (a token), score (their difference:
    the lower, the more like the target), gain_share (the share of tokens that the target model predicts better).

    The target is the rows of docs whose id is in target_ids (one column, of distinct ids), the background all others.
    An empty side is a model without counts: all words are equally likely. A text without a word (null, empty) has 0
    everywhere. Rows that repeat each get their row, and ties keep their equal scores; other columns are ignored; an
    empty table gives no rows. A very long text is a block of its own, which one task holds.
    """
    own = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), F.lower(text_of(text_col)).alias("text"))
    marks = target_ids.toDF("doc_id").withColumn("mark", F.lit(True))
    marks = F.broadcast(marks) if target_ids.count() <= MARKS else marks
    marked = own.join(marks, "doc_id", "left").select("_row", "doc_id", F.coalesce("mark", F.lit(False)).alias("mark"), "text")
    words, n, n_target, size = corpus_size(marked.drop("_row"))
    vocabulary = max(1, words)
    weight = 1.0 if n == n_target or not n_target else n_target / (n - n_target)
    blocks = max(1, -(-size // BLOCK))
    bits = (max(BUCKETS, blocks // BLOCKS_A_BUCKET) - 1).bit_length()
    low = U64(64 - bits)
    located = marked.withColumn("block", _block_ids(blocks)).drop("_row")

    def asks(key: tuple, table: pa.Table) -> pa.Table:
        block = Block(table)
        counts = block.counts()
        edges = np.searchsorted(block.keys >> low, np.arange((1 << bits) + 1, dtype=U64))
        some = np.flatnonzero(np.diff(edges))
        step = np.diff(block.keys, prepend=U64(0))
        step[edges[some]] = block.keys[edges[some]]
        sent = [planes(step[lo:hi], counts[lo:hi, 0], counts[lo:hi, 1]) for lo, hi in zip(edges[some], edges[some + 1], strict=True)]
        return pa.table([pa.array([key[0].as_py()] * len(some), pa.int32()), pa.array(some.astype(np.int32)), pa.array(sent, pa.binary())], ["block", "bucket", "sent"])

    def totals(table: pa.Table) -> pa.Table:
        asked = [unplaned(x.as_py(), 3) for x in table.column("sent")]
        edges = np.cumsum([0, *(len(x[0]) for x in asked)])
        _, which = np.unique(np.concatenate([np.cumsum(x[0]) for x in asked]), return_inverse=True)
        # sums are whole numbers under 2**53
        sums = [np.bincount(which, np.concatenate([x[k] for x in asked]))[which] for k in (1, 2)]
        sent = [planes(*(x[lo:hi] for x in sums)) for lo, hi in zip(edges, edges[1:], strict=False)]
        return pa.table([table.column("block"), table.column("bucket"), pa.array(sent, pa.binary())], ["block", "bucket", "sent"])

    def scores(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(texts)
        told = [unplaned(x.as_py(), 2) for x in answers.sort_by("bucket").column("sent")]
        known = [np.concatenate([np.zeros(0, U64), *(x[k] for x in told)]).astype(np.float64) for k in (1, 0)]
        if len(known[0]) != len(block.keys):
            raise RuntimeError("a block has other n-grams than it had when it asked: the documents changed between two passes")
        means = []
        edges = np.cumsum([0, *(x.num_rows for x in block.parts)])
        firsts = np.concatenate([[0], np.cumsum(block.sizes)])
        for part, lo, hi in zip(block.parts, edges, edges[1:], strict=False):
            span, sizes = slice(firsts[lo], firsts[hi]), block.sizes[lo:hi]
            rows = hi - lo
            row = np.repeat(np.arange(rows), sizes)
            mark = np.asarray(part.column("mark").to_numpy(zero_copy_only=False), bool)
            places = [at[span] for at in block.at]
            own = [_times(row, at) for at in places]
            loss = []
            for c, total, mine in ((known[0], n_target, mark), (known[1] - known[0], n - n_target, ~mark)):
                scale = 1.0 if c is known[0] else weight
                word, before, pair = ((c[at] - np.where(mine[row], x, 0)) * scale for at, x in zip(places, own, strict=True))
                left = (total - np.where(mine, sizes, 0)) * scale
                loss.append(np.log2(before + MU) - np.log2(pair + MU * (word + 1) / (left[row] + vocabulary)))
            means.append([np.bincount(row, x, rows) / np.maximum(sizes, 1) for x in (*loss, loss[0] - loss[1], loss[0] < loss[1])])
        mean = [np.concatenate(x) for x in zip(*means, strict=True)]
        ids = pa.concat_arrays([x.column("doc_id") for x in block.parts])
        return pa.table([ids, pa.array(block.sizes, pa.int64()), *map(pa.array, mean)], ["doc_id", "n_tokens", "target_bits", "background_bits", "score", "gain_share"])

    sent = "block int, bucket int, sent binary"
    answers = small_batches(located).groupBy("block").applyInArrow(asks, sent).groupBy("bucket").applyInArrow(totals, sent)
    kind = own.schema["doc_id"].dataType.simpleString()
    both = located.groupBy("block").cogroup(answers.groupBy("block"))
    return both.applyInArrow(scores, f"doc_id {kind}, n_tokens long, target_bits double, background_bits double, score double, gain_share double")
