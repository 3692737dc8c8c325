"""Helpers that several operators share: tables, slices of Arrow batches, word hashes, tables of numbers."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.sources.store import saved

U64 = np.uint64
#: Text bytes that one numpy pass looks at; a longer single document is a pass of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null counted as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with _1, _2 and so on behind it where df has a column of that name (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    return [next(x for x in (name, *(f"{name}_{k}" for k in range(1, len(taken) + 2))) if x.lower() not in taken) for name in names]


def quoted(column: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the folder that all executors share, and read again: lineage ends here."""
    return saved(df, name)


#: Rows of an Arrow batch, for rows that hold whole documents or pages.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, once its session sends rows to Python in batches of BATCH_ROWS; a number that someone has set stays."""
    name, usual = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if df.sparkSession.conf.get(name, usual) == usual:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


#: A group that holds more than this share of all rows is hot: there are fewer than HOT such groups.
HOT = 1000


def given_back(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, broadcastable: Column | None = None, total: int | None = None) -> DataFrame:
    """rows, with the columns of the group that each belongs to; nulls where it has none.

    groups: one row per key, with the group's number of rows; a table that can be read several times. The few hot
    groups, whose rows would all meet in one task, are broadcast (fewer than HOT rows; `broadcastable` keeps out those
    with very long keys), and only the rest is joined by a shuffle. total: the number of rows, if it is known.
    """
    hot = F.col(size) * HOT > (rows.count() if total is None else total)
    hot = hot & broadcastable if broadcastable is not None else hot
    few = groups.filter(hot)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(groups.filter(~hot), keys, "left")
    return rows.join(F.broadcast(few), keys).unionByName(rest)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about `most` bytes of `column`, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        group = np.cumsum(size) // most
        edges = np.flatnonzero(np.diff(group)) + 1
        for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            yield batch.slice(lo, hi - lo)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and each row's offset in them (one more than rows)."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "").cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer over 64-bit values: each input bit changes about half of the output bits."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


#: Spans of more bytes are hashed one by one.
LONG_SPAN = 64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as a number, zeros behind the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    out = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    return out if sys.byteorder == "little" else out.astype(U64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes start..end of each span; equal bytes, equal hash, wherever they stand."""
    length, eight = end - start, eights(data)
    out = mix(mix(length.astype(U64) * U64(0x9E3779B97F4A7C15)) + (eight[start] & _MASK[np.minimum(length, 8)]))
    at, k = np.flatnonzero((length > 8) & (length <= LONG_SPAN)), 8
    while len(at):
        out[at] = mix(out[at] * U64(0xD6E8FEB86659FD93) + (eight[start[at] + k] & _MASK[np.minimum(length[at] - k, 8)]))
        k += 8
        at = at[length[at] > k]
    raw = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(length > LONG_SPAN).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]])
    return out


def same_spans(data: np.ndarray, start: np.ndarray, length: np.ndarray, other: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether data[start : start + length] has the bytes of other[at : at + length], for each span."""
    out = np.ones(len(start), bool)
    one, two = eights(data), eights(other)
    live, k = np.arange(len(start)), 0
    while len(live):
        out[live] &= ((one[start[live] + k] ^ two[at[live] + k]) & _MASK[np.minimum(length[live] - k, 8)]) == 0
        k += 8
        live = live[length[live] > k]
    return out


class NumberTable:
    """64-bit numbers to values (0 and more, int64), by open addressing in arrays; an unknown number has -1."""

    def __init__(self, most: int):
        self.bits = max(10, (4 * most).bit_length())
        self.keys = np.zeros(1 << self.bits, U64)
        self.values = np.full(1 << self.bits, -1, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> U64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct numbers that are not there yet."""
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.values[slot] < 0)
            _, winner = np.unique(slot[free], return_index=True)
            put = free[winner]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.values[slot]
        more = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(more):
            slot[more] = (slot[more] + 1) & ((1 << self.bits) - 1)
            out[more] = self.values[slot[more]]
            more = more[(out[more] >= 0) & (self.keys[slot[more]] != keys[more])]
        return out


class Pool:
    """Numbers one after the other, in an array that doubles when it is full."""

    def __init__(self, kind: type):
        self.all, self.size = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> int:
        """Where they begin."""
        begin, self.size = self.size, self.size + len(more)
        if self.size + 8 > len(self.all):
            self.all = np.concatenate([self.all, np.zeros(self.size + 8, self.all.dtype)])
        self.all[begin : self.size] = more
        return begin


_WORD = np.zeros(256, bool)
_WORD[np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = True
#: Scripts written without blanks between words (Thai, Lao, Myanmar, Khmer, kana, Han): first and last code point.
UNSPACED = [(0x0E00, 0x0E7F), (0x0E80, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)]


@lru_cache(1)
def _word_kinds() -> np.ndarray:
    """Of each code point: 0 stands between words, 1 is part of one (letters, marks and numbers), 2 is a word by itself."""
    out = np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)), np.uint8, 0x110000)
    for low, high in UNSPACED:
        out[low : high + 1] *= 2
    return out


def word_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each byte of UTF-8 is part of a word; and begin and end of the characters that are words by themselves.

    Bytes that are no UTF-8 stand between words.
    """
    inside = _WORD[data]
    at = np.flatnonzero(data >= 0xC0)
    if not len(at):
        return inside, at, at
    lead = data[at]
    wide = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)  # further bytes
    point = (lead & np.array([0, 0x1F, 0x0F, 0x07], np.uint8)[wide]).astype(np.int64)
    good = at + wide < len(data)
    for k in (1, 2, 3):
        more = np.flatnonzero((wide >= k) & good)
        byte = data[at[more] + k]
        good[more] = (byte & 0xC0) == 0x80
        point[more] = point[more] << 6 | (byte & 0x3F)
    good &= point < 0x110000
    at, wide, kind = at[good], wide[good], _word_kinds()[point[good]]
    for k in range(4):
        inside[at[(wide >= k) & (kind > 0)] + k] = True
    alone = kind == 2
    return inside, at[alone], (at + wide + 1)[alone]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of the first word of each row (one more than rows).

    A word is a run of letters, marks and numbers, as Unicode has them; each such character of a script written without
    blanks is a word by itself. Rows never share one.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside, alone, behind = word_bytes(data)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = np.concatenate([offsets, alone, behind])
    edge = edge[(edge > 0) & (edge < len(data))]
    begin[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def gathered(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """pool[start : start + length] of each row, one after the other."""
    if not len(start):
        return pool[:0]
    before = np.cumsum(length) - length
    return pool[np.repeat(start - before, length) + np.arange(before[-1] + length[-1])]
