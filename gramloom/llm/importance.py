"""Importance resampling towards a target distribution, with features counted by distinct lines.

Features are the runs of n_min to n_max words of a text, hashed into buckets by CRC-32. A newline parts words, so a text
is cut into lines there: the features of each distinct line are made once and count as often as the line occurs, and only
runs of words that cross a line's end are made text by text. Two tables of counts give each bucket its gain, the
logarithm of its probability in the target over that in the corpus; a text's weight is the sum of its features' gains.
Weights with Gumbel noise from a hash of the id are ranked: the highest are a sample without replacement.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm._shared import given_back, quoted, slices, small_batches, text_of, utf8, written
from gramloom.operators.counts import row_ids

N_MIN, N_MAX, BUCKETS, SEED = 1, 1, 10_000, 2024
LEAST_WORDS, PERCENT = 20, 10

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


@lru_cache(1)
def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


def crc_on(crc: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 values, carried on over data[start : start + length] of each."""
    state, table = crc ^ np.uint32(0xFFFFFFFF), _crc_table()
    live, k = np.flatnonzero((length > 0) & (length <= LONG_WORD)), 0
    while len(live):
        state[live] = table[(state[live] ^ data[start[live] + k]) & 255] ^ (state[live] >> np.uint32(8))
        k += 1
        live = live[length[live] > k]
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = zlib.crc32(data[start[i] : start[i] + length[i]].tobytes(), int(crc[i]))
    return out


def features(data: np.ndarray, offsets: np.ndarray, n_min: int, n_max: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and whether it crosses a line's end, of each feature, by rows; and the number of words of each row."""
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = _WORD[low]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(begin)
    length = np.flatnonzero(end) + 1 - start
    first = np.searchsorted(start, offsets)
    words = np.diff(first)
    row = np.repeat(np.arange(len(words)), words)
    line = np.cumsum(low == 10)[start] if len(start) else start
    left = first[1:][row] - np.arange(len(start)) if len(start) else start  # words from this one to the row's end
    at, crc = np.arange(len(start)), np.zeros(len(start), np.uint32)
    found = []
    for n in range(1, n_max + 1):
        at = at[left[at] >= n]
        if n > 1:  # one blank, and the next word
            crc[at] = crc_on(crc[at], np.full(1, 32, np.uint8), np.zeros(len(at), np.int64), np.ones(len(at), np.int64))
        crc[at] = crc_on(crc[at], low, start[at + n - 1], length[at + n - 1])
        if n >= n_min:
            found.append((row[at], (crc[at] % np.uint32(buckets)).astype(np.int32), line[at] != line[at + n - 1]))
    rows, bucket, crossing = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(rows, kind="stable")
    return rows[order], bucket[order], crossing[order], words


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), pa.array(values))


class Counted:
    """A table's features: `lines` (key, n: how often the line occurs, words, buckets), `texts` (_row, doc_id, keys,
    crossing: the buckets of features that cross a line's end). Both are written tables."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n_min: int, n_max: int, buckets: int):
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                keys = [[hashlib.md5(x).digest() for x in t.as_py().encode().split(b"\n")] for t in part.column("text")]
                crossing = pa.array([[]] * part.num_rows, pa.list_(pa.int32()))
                if n_max > 1:
                    row, bucket, over, _ = features(*utf8(part.column("text")), n_min, n_max, buckets)
                    crossing = _lists(row[over], bucket[over], part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys, pa.list_(pa.binary())), crossing], ["doc_id", "keys", "crossing"])

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "line"):
                row, bucket, _, words = features(*utf8(part.column("line")), n_min, n_max, buckets)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("n"), pa.array(words.astype(np.int64)), _lists(row, bucket, part.num_rows)], ["key", "n", "words", "buckets"])

        own = docs.select(quoted(id_col).alias("doc_id"), text_of(text_col).alias("text"))
        kind = own.schema["doc_id"].dataType.simpleString()
        texts = small_batches(own).mapInArrow(cut, f"doc_id {kind}, keys array<binary>, crossing array<int>")
        self.texts = written(texts.withColumn("_row", F.monotonically_increasing_id()), "texts")
        lines = own.select(F.explode(F.split("text", "\n")).alias("line")).groupBy("line").agg(F.count("*").alias("n"))
        keyed = lines.select(F.unhex(F.md5("line")).alias("key"), "n", "line")
        self.lines = written(keyed.mapInArrow(made, "key binary, n long, words long, buckets array<int>"), "lines")

    def counts(self) -> DataFrame:
        """bucket and n: the occurrences of its features."""
        own = self.lines.select("n", F.explode("buckets").alias("bucket"))
        across = self.texts.select(F.lit(1).cast("long").alias("n"), F.explode("crossing").alias("bucket"))
        return own.unionByName(across).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, in thousandths, from two tables of Counted.counts; one row a bucket comes to the driver."""
    both = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full").fillna(0, ["s", "t"])
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(both, "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    x = {c: F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t")}
    ratio = (x["t"] + 1) * (x["all_s"] + buckets) / ((x["s"] + 1) * (x["all_t"] + buckets))
    told = every.crossJoin(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))  # one row
    out = [0] * buckets
    for r in told.collect():  # `buckets` rows, a parameter
        out[r["bucket"]] = r["gain"]
    return out


def weights(counted: Counted, gain: list[int]) -> DataFrame:
    """_row, doc_id, words, n_features, weight of each text."""
    table = np.array(gain, np.int64)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lists = part.column("buckets")
            ends = np.asarray(lists.offsets, dtype=np.int64)
            run = np.concatenate([[0], np.cumsum(table[np.asarray(lists.values)])]) if len(lists.values) else np.zeros(1, np.int64)
            cols = [c for c in part.schema.names if c != "buckets"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in cols), pa.array(np.diff(ends)), pa.array(run[ends[1:]] - run[ends[:-1]])], [*cols, "n_features", "weight"])

    told = "n_features long, weight long"
    lines = written(small_batches(counted.lines).mapInArrow(weighed, f"key binary, n long, words long, {told}"), "weights")
    kind = counted.texts.schema["doc_id"].dataType.simpleString()
    across = small_batches(counted.texts.select("_row", "doc_id", F.lit(0).cast("long").alias("words"), F.col("crossing").alias("buckets"))).mapInArrow(weighed, f"_row long, doc_id {kind}, words long, {told}")
    held = written(counted.texts.select("_row", "doc_id", F.explode("keys").alias("key")).groupBy("_row", "doc_id", "key").agg(F.count("*").alias("times")), "held")
    found = given_back(held, lines, ["key"], "n", total=held.count())
    each = found.select("_row", "doc_id", *((F.col("times") * F.col(c)).alias(c) for c in ("words", "n_features", "weight")))
    return each.unionByName(across).groupBy("_row", "doc_id").agg(*(F.sum(c).alias(c) for c in ("words", "n_features", "weight")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", n_min: int = N_MIN, n_max: int = N_MAX, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs; rank numbers the drawn ones from 1, others have null.

    Drawn are floor(percent * N / 100) of the N texts of at least `least_words` words, by score, then id. A null text is
    empty: no features, weight 0. Repeated rows each count, are each told and can each be drawn (rows that are equal in
    score and id are ranked in any order); a null id is drawn like others, with the noise of an empty id, and comes first
    in a tie. Empty tables give no rows; an empty target makes all buckets as likely. A very long line or text is one
    row of its own; a task holds its features. Other columns are not looked at.
    """
    if not 1 <= n_min <= n_max:
        raise ValueError("1 <= n_min <= n_max is asked for")
    counted = Counted(docs, id_col, text_col, n_min, n_max, buckets)
    goal = Counted(target.withColumn("_none", F.lit(0)), "_none", target_text_col, n_min, n_max, buckets)
    gain = gains(written(counted.counts(), "counts"), written(goal.counts(), "counts"), buckets)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    score = F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(u)))
    scored = written(weights(counted, gain).withColumn("score", score), "scores")
    able = scored.filter(F.col("words") >= least_words)
    most = able.count() * percent // 100
    ranked = row_ids(able.select("_row", "doc_id", "n_features", "weight", "score", (-F.col("score")).alias("_down")), ["_down", "doc_id", "_row"], "rank")
    out = ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= most, F.col("rank")).alias("rank"))
    rest = scored.filter(F.col("words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return out.unionByName(rest)
