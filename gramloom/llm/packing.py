"""Best-fit packing of documents into sequences of at most `capacity` tokens.

Documents become pieces (only one that is longer than a sequence is cut, into whole sequences behind a shorter first
piece), and pieces of all lengths are dealt out evenly to groups of bounded size. In each group, best-fit decreasing
puts piece after piece, the longest first, into the open sequence with the least room that still holds it. A segment
tree over the remaining capacities finds that sequence in a logarithmic number of steps. As each group has thousands
of sequences and only its last ones stay part empty, splitting costs a sequence or so per group.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm._shared import slices, small_batches, text_of, utf8, written
from gramloom.llm.pretoken import Encoder

CAPACITY = 2048
#: Tokens and pieces of a group at most, on average: the bound of what one task packs at once.
GROUP_TOKENS, GROUP_PIECES = 64_000_000, 200_000
#: Pretokens that the tokenizer gets at a time.
SOME = 1024


@lru_cache(4)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks keep the cores busy; threads of its own would only wait for them
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(4)
def _encoder(path: str) -> Encoder:
    tokenizer = _tokenizer(path)

    def encode(tokens: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        for k in range(0, len(tokens), SOME):  # the library's results are many times as large as the ids in them
            out += [x.ids for x in tokenizer.encode_batch_fast([t.decode() for t in tokens[k : k + SOME]], add_special_tokens=False)]
        return out

    return Encoder(encode)


def encode_column(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts as the library gives them, and each text's offset in them (one more than texts).

    The library looks for the strings of added tokens before it splits a text: a text that holds one goes to it whole.
    """
    ids, rows = _encoder(path)(*utf8(column))
    names = [x.content for x in _tokenizer(path).get_added_tokens_decoder().values()]
    held = [np.asarray(pc.match_substring(column, x)) for x in names if x]
    special = np.flatnonzero(np.any(held, 0)) if held else []
    if not len(special):
        return ids, rows
    parts = [ids[a:b] for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
    for i in special:
        parts[i] = np.array(_tokenizer(path).encode(column[int(i)].as_py(), add_special_tokens=False).ids, np.int32)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def piece_edges(n: int, capacity: int = CAPACITY) -> list[int]:
    """Where the pieces of a document of n tokens begin, and n."""
    first = n % capacity or min(n, capacity)
    return [0, *range(first, n + 1, capacity)] if n else [0, 0]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; path: a tokenizer file that each executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, rows = encode_column(part.column("text"), path)
            out: list[list[int]] = [[], [], [], [], []]
            for i, (a, b) in enumerate(zip(rows.tolist(), rows[1:].tolist(), strict=False)):
                own = np.append(ids[a:b], end_id).astype("<u4")
                edges = piece_edges(len(own), capacity)
                for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                    for column, value in zip(out, (i, k, lo, hi - lo, zlib.crc32(own[lo:hi])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    own = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return small_batches(own).mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """Open sequences by remaining capacity. Leaf r of the tree tells whether a sequence with r free tokens is open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        node = self.size + room
        while node and not self.tree[node]:
            self.tree[node] = True
            node >>= 1

    def tightest(self, need: int) -> int:
        """The least room of an open sequence that is at least need, or -1."""
        tree, node = self.tree, self.size + need
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):  # up, until something lies to the right
                node >>= 1
            if node <= 1:
                return -1
            node += 1
            while node < self.size:  # down to its leftmost leaf
                node = 2 * node if tree[2 * node] else 2 * node + 1
        return node - self.size

    def take(self, room: int) -> int:
        number = self.bins[room].pop()
        if not self.bins[room]:
            tree, node = self.tree, self.size + room
            tree[node] = False
            while node > 1 and not tree[node ^ 1]:
                node >>= 1
                tree[node] = False
        return number


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The sequence (from 0) of each piece and its place there; of equal lengths the earlier piece comes first."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened, room_left = 0, OpenBins(capacity)
    for i, need in zip(order.tolist(), lengths[order].tolist(), strict=True):
        room = room_left.tightest(need)
        if room < 0:
            number, room = opened, capacity
            opened += 1
        else:
            number = room_left.take(room)
        sequence[i], offset[i] = number, capacity - room
        if room > need:
            room_left.put(room - need, number)
    return sequence, offset


def pack(cut: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces with sequence_id and offset. cut is a written table with _row, a number for each of its rows; it is read
    twice, for the number of groups depends on its size."""
    n, tokens = cut.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    groups = max(1, -(-tokens // group_tokens), -(-n // group_pieces))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")])
        sequence, offset = best_fit_decreasing(table.column("length").to_numpy(), capacity)
        group = table.column("_group").to_numpy()
        out = table.drop_columns(["_group"])
        return out.append_column("sequence_id", pa.array(group * (1 << 40) + sequence)).append_column("offset", pa.array(offset))

    # A hash of the row's number deals rows out evenly, whatever their lengths and however many are equal.
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups))).drop("_row")
    kind = cut.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("_group").applyInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each text (null: empty) is encoded, and the end id 0 is put behind it, so that even an empty text is a piece of
    one token. A text that holds a special token's string gets that token's id, as from the library. Rows that repeat
    are packed as often as they occur. Other columns are ignored. An empty table gives no rows. A very long text is cut
    into as many pieces as it needs; one task holds it whole.
    """
    cut = pieces(docs, path, capacity, 0, id_col, text_col).withColumn("_row", F.monotonically_increasing_id())
    return pack(written(cut, "pieces"), capacity)
