"""Byte-level BPE encoding and decoding.

Pretokens that a worker meets for the first time are encoded together: by length they go into padded matrices, one
row each. In each round every row merges its leftmost pair of least rank, the row closes the gap, and rows without a
pair leave the matrix. Ranks of pairs come from a hash table with linear probing. A pretoken of over MATRIX_WIDEST
bytes, for which a round over the whole row would be dear, keeps its pairs in a heap instead; the merges are the same.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm._shared import NumberTable, gathered, slices, small_batches, text_of, utf8
from gramloom.llm.pretoken import Encoder

#: Widest matrix, in bytes of a pretoken, and most cells of one matrix.
MATRIX_WIDEST, MATRIX_CELLS = 512, 1 << 20
NONE = np.int32(2**31 - 1)


class Vocabulary:
    """A rank file: ids are ranks, and each pair of ids whose bytes together are a token merges to it."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        if max(self.ids.values()) >= 1 << 16:
            raise ValueError("ids of 16 bits are asked for")
        pairs: dict[int, int] = {}
        get = self.ids.get
        for token, rank in self.ids.items():
            for k in range(1, len(token)):
                if (a := get(token[:k])) is not None and (b := get(token[k:])) is not None:
                    pairs[a << 16 | b] = rank
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.pairs = NumberTable(len(pairs))
        self.pairs.put(np.fromiter(pairs.keys(), np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs)))
        size = max(self.ids.values()) + 1
        tokens = [b""] * size
        for token, i in self.ids.items():
            tokens[i] = token
        self.bytes_of, self.bytes_at, self.bytes_len = self._pool(tokens)
        self.digits_of, self.digits_at, self.digits_len = self._pool([b"%d," % i for i in range(size)])

    @staticmethod
    def _pool(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(length) - length, length

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE if it doesn't merge; ids below 0 stand for nothing."""
        out = np.full(left.shape, NONE, np.int32)
        both = np.flatnonzero((left >= 0) & (right >= 0))
        rank = self.pairs.get((left.ravel()[both].astype(np.int64) << 16 | right.ravel()[both]).astype(np.uint64))
        out.reshape(-1)[both] = np.where(rank < 0, NONE, rank)
        return out

    def encode(self, tokens: list[bytes]) -> list[list[int] | np.ndarray]:
        """The ids of each pretoken; one that is itself a token is that token."""
        out: list = [None] * len(tokens)
        buckets: dict[int, list[int]] = {}
        for i, token in enumerate(tokens):
            if (whole := self.ids.get(token)) is not None:
                out[i] = [whole]
            elif len(token) > MATRIX_WIDEST:
                out[i] = self._encode_long(token)
            else:
                n = len(token)
                buckets.setdefault(n if n <= 16 else -(-n // 8) * 8 if n <= 64 else 1 << (n - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            step = max(1, MATRIX_CELLS // width)
            for k in range(0, len(members), step):
                self._encode_matrix(tokens, members[k : k + step], width, out)
        return out

    def _encode_matrix(self, tokens: list[bytes], members: list[int], width: int, out: list) -> None:
        length = np.array([len(tokens[i]) for i in members])
        ids = np.full((len(members), width), -1, np.int32)
        ids[np.arange(width) < length[:, None]] = self.byte_ids[np.frombuffer(b"".join(tokens[i] for i in members), np.uint8)]
        rank = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        row = np.array(members)
        while True:
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(row), np.int64)
            least = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), NONE)
            done = least == NONE
            for i, x, n in zip(row[done].tolist(), ids[done], length[done].tolist(), strict=True):
                out[i] = x[:n].copy()
            keep = ~done
            if not keep.any():
                return
            ids, rank, row, at, least = ids[keep], rank[keep], row[keep], at[keep], least[keep]
            length = length[keep] - 1
            each = np.arange(len(row))
            ids[each, at] = least
            column = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)
            column = np.arange(rank.shape[1] - 1)
            rank = np.take_along_axis(rank, column + (column >= at[:, None]), 1)
            for side in (at - 1, at):  # the pairs that the new token takes part in
                ok = np.flatnonzero((side >= 0) & (side < rank.shape[1]))
                rank[ok, side[ok]] = self.pair_ranks(ids[ok, side[ok]], ids[ok, side[ok] + 1])

    def _encode_long(self, token: bytes) -> list[int]:
        ids = self.byte_ids[np.frombuffer(token, np.uint8)]
        rank = self.pair_ranks(ids[:-1], ids[1:])
        heap = [(int(r), i) for i, r in enumerate(rank) if r != NONE]
        heapq.heapify(heap)
        ids = ids.tolist()
        n = len(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        current = {i: r for r, i in heap}

        def renew(i: int) -> None:
            r = int(self.pair_ranks(np.array([ids[i]]), np.array([ids[after[i]]]))[0]) if after[i] < n else NONE
            if r != NONE:
                current[i] = r
                heapq.heappush(heap, (r, i))
            else:
                current.pop(i, None)

        while heap:
            r, i = heapq.heappop(heap)
            if current.get(i) != r:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = r, -1, after[j]
            current.pop(j, None)
            if after[j] < n:
                before[after[j]] = i
            renew(i)
            if before[i] >= 0:
                renew(before[i])
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and each id's number of bytes."""
        return gathered(self.bytes_of, self.bytes_at[ids], self.bytes_len[ids]), self.bytes_len[ids]

    def decimals(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids as decimal numbers with a comma behind each, and each number's length with its comma."""
        return gathered(self.digits_of, self.digits_at[ids], self.digits_len[ids]), self.digits_len[ids]


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(vocabulary(path).encode)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each row; a null or empty text has none. path: a rank file that each executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for part in slices(batches):
            ids, rows = encode(*utf8(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    own = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return small_batches(own).mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and data (binary) of each row of ids; null counts as no ids. An id that the vocabulary lacks fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for part in batches:
            for k in range(0, part.num_rows, 256):
                some = part.slice(k, 256)
                lists = some.column("ids").to_pylist()
                data = [words.decode(np.array(x or [], np.int64))[0].tobytes() for x in lists]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    own = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return small_batches(own).mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, data binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: its text encoded, and the ids decoded again.

    Null and empty texts have no ids; both digests are then those of no bytes. Rows that repeat each get their
    row. Other columns are ignored. An empty table gives no rows. No shuffle; a task holds one slice of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, encode = vocabulary(path), encoder(path)

        def digests(data: np.ndarray, length: np.ndarray, rows: np.ndarray, behind: int) -> list[str]:
            edges = np.concatenate([[0], np.cumsum(length)])[rows].tolist()
            view = memoryview(data)
            return [hashlib.sha256(view[a : max(a, b - behind)]).hexdigest() for a, b in zip(edges, edges[1:], strict=False)]

        for part in slices(batches):
            ids, rows = encode(*utf8(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(rows), pa.int64()), pa.array(digests(*words.decimals(ids), rows, 1)), pa.array(digests(*words.decode(ids), rows, 0))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    own = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return small_batches(own).mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
