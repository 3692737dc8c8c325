"""Split texts into pretokens and map each to its ids, a slice of an Arrow column at a time.

The split follows the pattern 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?O+|S+(?!\\S)|S+ over letters, numbers, white space
and others. It is done on arrays of character classes: a token begins where the class changes; the last blank
before a word belongs to the word if it is a space, else it stands alone; an apostrophe at the begin of a token may
form a contraction with the letters behind it.

A distinct pretoken is encoded once per Python worker: texts look their pretokens up by a 64-bit hash, and compare bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

from gramloom.llm._shared import LONG_SPAN, NumberTable, Pool, gathered, same_spans, span_hashes

LETTER, NUMBER, OTHER, SPACE = range(4)
#: What follows the apostrophe of a contraction.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, as the tokenizer library's own tables have it: what its pattern of one class keeps
    of a string of all code points."""
    import tiktoken

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        own = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        for k in range(0, len(points), 1 << 16):
            found = bytes(own.encode_ordinary("".join(map(chr, points[k : k + (1 << 16)]))))
            out[np.frombuffer(found.decode().encode("utf-32-le"), np.uint32)] = kind
    return out


def pretoken_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end (in bytes) of each pretoken, and the number of the first pretoken of each row (one more than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    rows = np.searchsorted(lead, offsets)
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n + 4, bool)  # of its row; what lies behind the end counts as other rows
    first[rows[rows < n]] = True
    first[n:] = True
    begin = first[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]

    after = np.flatnonzero(begin & (kind != SPACE) & ~first[:n])
    after = after[kind[after - 1] == SPACE]
    begin[after - 1] = True
    begin[after[points[after - 1] == 32]] = False

    mark = np.flatnonzero(begin & (points == 39))
    if len(mark):
        ahead = np.concatenate([points, np.zeros(4, np.uint32)])
        for letters in CONTRACTIONS:
            hit = mark
            for j, c in enumerate(letters, 1):
                hit = hit[(ahead[hit + j] == ord(c)) & ~first[hit + j]]
            begin[hit + 1] = False
            end = hit + 1 + len(letters)
            begin[end[end < n]] = True
    at = np.flatnonzero(begin)
    start = lead[at]
    return start, np.append(start[1:], len(data)), np.searchsorted(at, rows)


class Encoder:
    """Ids of texts, given a function from distinct pretokens (bytes) to their ids.

    Pretokens of up to LONG_SPAN bytes are remembered by a 64-bit hash, and a hit counts only if its bytes are the same:
    what shares a hash with another, and what is longer, is encoded anew in each slice. The memory is bounded: it
    starts anew beyond `most` pretokens.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int] | np.ndarray]], most: int = 400_000):
        self.encode, self.most = encode, most
        self.forget()

    def forget(self) -> None:
        self.table, self.known = NumberTable(self.most), 0
        self.bytes, self.ids = Pool(np.uint8), Pool(np.int32)
        self.at, self.length, self.start, self.count = (Pool(np.int64) for _ in range(4))

    def learn(self, keys: np.ndarray, tokens: list[bytes]) -> None:
        ids = self.encode(tokens)
        for lengths, begins, pool, items in ((self.length, self.at, self.bytes, [np.frombuffer(t, np.uint8) for t in tokens]), (self.count, self.start, self.ids, ids)):
            n = np.fromiter(map(len, items), np.int64, len(items))
            begins.add(pool.add(np.concatenate(items)) + np.cumsum(n) - n)
            lengths.add(n)
        self.table.put(keys, np.arange(self.known, self.known + len(keys)))
        self.known += len(keys)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and each row's offset in them (one more than rows)."""
        start, end, rows = pretoken_spans(data, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        raw = memoryview(np.ascontiguousarray(data))
        cut = lambda at: [bytes(raw[a:b]) for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        length = end - start
        short = np.flatnonzero(length <= LONG_SPAN)
        keys = span_hashes(data, start[short], end[short])
        entry = self.table.get(keys)
        new = np.flatnonzero(entry < 0)
        if len(new):
            fresh, first = np.unique(keys[new], return_index=True)
            if self.known + len(fresh) > self.most:
                self.forget()
                fresh, first = np.unique(keys, return_index=True)
                new = np.arange(len(keys))
            for k in range(0, len(fresh), self.most):
                if k:
                    self.forget()
                self.learn(fresh[k : k + self.most], cut(short[new[first[k : k + self.most]]]))
            entry = self.table.get(keys)
        there = np.flatnonzero(entry >= 0)
        there = there[self.length.all[entry[there]] == length[short[there]]]
        there = there[same_spans(data, start[short[there]], length[short[there]], self.bytes.all[: self.bytes.size], self.at.all[entry[there]])]
        begin, count = np.zeros(len(start), np.int64), np.full(len(start), -1, np.int64)
        begin[short[there]], count[short[there]] = self.start.all[entry[there]], self.count.all[entry[there]]
        pool, rest = self.ids.all[: self.ids.size], np.flatnonzero(count < 0)
        if len(rest):
            own: dict[bytes, int] = {}
            which = np.array([own.setdefault(x, len(own)) for x in cut(rest)])
            ids = self.encode(list(own))
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            begin[rest], count[rest] = (len(pool) + np.cumsum(n) - n)[which], n[which]
            pool = np.concatenate([pool, *(np.asarray(x, np.int32) for x in ids)])
        edges = np.concatenate([[0], np.cumsum(count)])
        return gathered(pool, begin, count), edges[rows]
