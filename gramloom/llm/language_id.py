"""Language identification by prediction by partial matching (PPM, escape method C, with exclusion).

Each language has a context tree over bytes of order 0 to 3 with frozen counts. The code length of a byte follows
from its three predecessors: the longest known context that has the byte gives it n / (N + D), and each longer
context on the way costs an escape of D / (N + D), where N counts the context's symbols, D its distinct ones, and
symbols of the context escaped from are excluded. Below order 0 all remaining bytes are equally likely. So a text's
exact code length is a sum over its four-byte windows, and each distinct window is worked out once.

The trees are learned from all documents that have a language and are not held out, and the limits from all that are
held out. The windows are counted in Spark, one row per language and distinct window. Up to MODEL_ROWS such rows the
trees are broadcast and scoring is one pass over the texts without a shuffle. More are taken in parts by the two bytes
before a window's last: all contexts of two and three bytes lie in one part, the counts of up to two bytes go with each,
and a text's code length is the sum over the parts. A pass over the texts holds one part at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.llm._shared import U64, NumberTable, fresh, slices, small_batches, utf8, written

#: Rows of counts (a language and a window each) that a worker's trees are made of at most; more are taken in parts.
MODEL_ROWS = 1 << 22
#: Rows of an Arrow batch of counts.
COUNT_ROWS = 1 << 17
#: For a caller who asks for a sample: bytes that are expected at most, of one language and of all together.
LANGUAGE_BYTES, ALL_BYTES = 64 << 20, 256 << 20
#: Code lengths (8 bytes each) that a worker keeps ready, of all languages.
CELLS = 1 << 23
ORDER = 3
UNKNOWN = "und"
#: A document whose best language needs more bits a byte than that language's limit is in none of the learned ones. The
#: limit is the mean of documents that the trees were not fitted on, and DEVIATIONS times the deviation for a text of n
#: bytes, sqrt(spread / min(n, LONG)): by Chebyshev under one clean document in a hundred, whatever their distribution.
DEVIATIONS, LONG = 10.0, 1000
#: A spread from fewer documents than FEW gives way to that of all languages together, which is LEAST_SPREAD at least.
FEW, LEAST_SPREAD = 30, 4.0
#: The limit where too few documents are left to fit one.
REJECT_BITS = 7.0


def held_out(id_col: str = "doc_id", modulus: int = 4, remainder: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def windows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the number that it and its three predecessors make; before a row's first byte stand line feeds."""
    rows = len(offsets) - 1
    out = np.full(len(data) + ORDER * rows, 10, np.uint32)
    at = np.arange(len(data)) + np.repeat(ORDER * np.arange(1, rows + 1), np.diff(offsets))
    out[at] = data
    return (out[at - 3] << np.uint32(24)) | (out[at - 2] << np.uint32(16)) | (out[at - 1] << np.uint32(8)) | out[at]


class ContextTree:
    """The frozen counts of one language, as sorted arrays for each order. `short`, where the windows are those of a part
    only: the last two bytes of all windows, and their counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, short: tuple[np.ndarray, np.ndarray] | None = None):
        self.symbols: list[tuple[np.ndarray, np.ndarray]] = []  # by order: context and symbol, count
        self.contexts: list[tuple[np.ndarray, ...]] = []  # by order: context, N, D, and the shorter context's N without its symbols
        for order in range(ORDER + 1):
            own, weight = short if short and order < 2 else (grams, counts)
            keys, which = np.unique(own & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
            n = np.bincount(which, weight, len(keys)).astype(np.int64)
            self.symbols.append((keys, n))
            context, first = np.unique(keys >> np.uint32(8), return_index=True)
            total = np.add.reduceat(n, first) if len(first) else n
            distinct = np.diff(np.append(first, len(keys)))
            left = np.zeros(len(context), np.int64)
            if order:
                shorter, m = self.symbols[order - 1]
                there = m[np.searchsorted(shorter, keys & np.uint32((1 << 8 * order) - 1))]
                _, whole, _ = self._context(order - 1, context & np.uint32((1 << 8 * (order - 1)) - 1))
                left = whole - np.add.reduceat(there, first) if len(first) else left
            self.contexts.append((context, total, distinct, left))

    def _find(self, keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def _context(self, order: int, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, known = self._find(self.contexts[order][0], context)
        return at, np.where(known, self.contexts[order][1][at], 0), known

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """The code length of each window's last byte after the three before it."""
        out = np.zeros(len(grams))
        todo = np.arange(len(grams))
        without_n = without_d = None  # of the context that is next, when a longer one has been escaped from
        for order in range(ORDER, -1, -1):
            if not len(todo):
                return out
            if not len(self.contexts[order][0]):
                continue
            gram = grams[todo] & np.uint32((1 << 8 * (order + 1)) - 1)
            at, total, known = self._context(order, gram >> np.uint32(8))
            _, _, distinct, left = (x[at] for x in self.contexts[order])
            distinct = np.where(known, distinct, 0)
            n_here, d_here = total, distinct
            if without_n is not None:
                n_here = np.where(without_n >= 0, without_n, total)
                d_here = np.where(without_n >= 0, distinct - without_d, distinct)
            spot, has = self._find(self.symbols[order][0], gram)
            count = np.where(has, self.symbols[order][1][spot], 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = np.log2(n_here + d_here) - np.log2(count)
                escape = np.where(d_here > 0, np.log2(n_here + d_here) - np.log2(d_here), 0.0)
            out[todo] += np.where(has, hit, escape)
            rest = ~has
            todo = todo[rest]
            without_n = np.where(known[rest], left[rest], -1)
            without_d = distinct[rest]
        seen = len(self.symbols[0][0])
        out[todo] += np.log2(max(1, 256 - seen))
        return out


class Languages:
    """The trees of all languages, and the code lengths of the windows that they know, up to CELLS numbers: beyond that
    those of the most frequent windows. What is not in the table is worked out from the trees, to the same bits.

    within: first and last number of the two bytes before the last of the windows that are here, and `short` the counts of
    the last two bytes of all windows."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], short: dict[str, tuple[np.ndarray, np.ndarray]] | None = None, within: tuple[int, int] | None = None):
        self.names, self.within = sorted(counts), within
        self.trees = [ContextTree(*counts[x], short and short[x]) for x in self.names]
        if not self.names:
            return
        grams, which = np.unique(np.concatenate([counts[x][0] for x in self.names]), return_inverse=True)
        often = np.bincount(which, np.concatenate([counts[x][1] for x in self.names]), len(grams))
        grams = grams[np.argsort(-often, kind="stable")[: CELLS // len(self.names)]]
        self.place = NumberTable(len(grams) // 2)  # half full at most
        self.place.put(grams.astype(U64), np.arange(len(grams)))
        self.costs = self._bits(grams)

    def _bits(self, grams: np.ndarray) -> np.ndarray:
        return np.stack([t.bits(grams) for t in self.trees], 1)

    def costs_of(self, grams: np.ndarray) -> np.ndarray:
        """Bits of each window (rows) in each language (columns)."""
        place = self.place.get(grams.astype(U64))
        out = self.costs[place]
        miss = np.flatnonzero(place < 0)
        if len(miss):
            fresh, which = np.unique(grams[miss], return_inverse=True)
            out[miss] = self._bits(fresh)[which]
        return out

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each row (rows) in each language (columns); of a part, those of its own windows."""
        out = np.zeros((len(offsets) - 1, len(self.names)))
        full = np.flatnonzero(np.diff(offsets))
        if len(full) and self.names:
            grams = windows(data, offsets)
            if self.within is None:
                out[full] = np.add.reduceat(self.costs_of(grams), offsets[full], axis=0, dtype=np.float64)
                return out
            before = middle(grams)
            here = np.flatnonzero((before >= self.within[0]) & (before <= self.within[1]))
            row, costs = np.searchsorted(offsets, here, "right") - 1, self.costs_of(grams[here])
            for k in range(len(self.names)):
                out[:, k] = np.bincount(row, costs[:, k], len(out))
        return out


class Parts:
    """Counts of more than MODEL_ROWS rows: the table (lang, gram, n), the counts of the last two bytes, and of each part
    the first and last number of the two bytes before a window's last. A part holds MODEL_ROWS rows at most, or the
    windows of one such number (65 536 a language)."""

    def __init__(self, counts: DataFrame):
        self.counts = counts
        self.short = _by_language(counts.groupBy("lang", (F.col("gram") % 65536).alias("gram")).agg(F.sum("n").alias("n")))
        self.names = sorted(self.short)
        sizes = sorted(counts.groupBy(_middle().alias("at")).count().collect())  # 65 536 rows at most
        first, held = [0], 0  # the ranges leave no number out: a text may have windows that no language has
        for at, n in sizes:
            if held and held + n > MODEL_ROWS:
                first.append(at)
                held = 0
            held += n
        self.within = [(x, y - 1) for x, y in zip(first, [*first[1:], 65536], strict=True)]

    def part(self, within: tuple[int, int]) -> Languages:
        own = _by_language(self.counts.filter(_middle().between(*within)))
        none = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return Languages({x: own.get(x, none) for x in self.names}, self.short, within)


def middle(grams: np.ndarray) -> np.ndarray:
    """The number of the two bytes before each window's last."""
    return (grams >> np.uint32(8)) & np.uint32(0xFFFF)


def _middle() -> Column:
    return F.expr("CAST(gram DIV 256 % 65536 AS INT)")


def _by_language(counts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Windows and counts of each language, in order."""
    rows = counts.select("lang", "gram", "n").toArrow()
    lang = rows.column("lang").combine_chunks().dictionary_encode()
    names, which = lang.dictionary.to_pylist(), lang.indices.to_numpy()
    grams, n = rows.column("gram").to_numpy().astype(np.uint32), rows.column("n").to_numpy()
    order = np.lexsort((grams, which))
    edges = np.searchsorted(which[order], np.arange(len(names) + 1))
    own = [order[lo:hi] for lo, hi in zip(edges, edges[1:], strict=False)]
    return {name: (grams[x], n[x]) for name, x in zip(names, own, strict=True)}


def _sample(known: DataFrame, per_language: int) -> tuple[DataFrame, list[str]]:
    """lang and text of some of the known documents (doc_id, text, lang), by a hash of their numbers in the table, and the
    languages. The share keeps the sample bounded whatever ids and texts repeat."""
    sizes = known.groupBy("lang").agg(F.count("*"), F.sum(F.octet_length("text"))).collect()  # one row per language
    most = min(LANGUAGE_BYTES, ALL_BYTES // max(1, len(sizes)))
    share = [(name, min(1.0, per_language / n, most / max(1, size))) for name, n, size in sizes]
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) / float(1 << 20)
    shares = known.sparkSession.createDataFrame(share, "lang string, share double")
    return known.withColumn("_place", place).join(F.broadcast(shares), "lang").filter("_place < share").select("lang", "text"), [x[0] for x in share]


def _known(docs: DataFrame, held: bool, per_language: int | None, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang and text of the documents that have both and are held out or not: of all, or of a sample if one is asked for."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (held_out(id_col) == held))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return known if per_language is None else _sample(known, per_language)[0]


def learn(docs: DataFrame, per_language: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages | Parts:
    """Count the windows of all documents that have a language and a text and are not held out (per_language: of about so
    many of each language)."""
    known = _known(docs, False, per_language, id_col, text_col, lang_col).select("lang", F.lower("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list] = {}
        for part in slices(batches):
            names = np.array(part.column("lang").to_pylist(), object)
            for name in set(names):
                some = part.filter(pa.array(names == name))
                own.setdefault(name, []).append(np.unique(windows(*utf8(some.column("text"))), return_counts=True))
                if len(own[name]) > 16:
                    own[name] = [_merged(own[name])]
        for name, found in own.items():
            grams, n = _merged(found)
            for k in range(0, len(grams), COUNT_ROWS):
                some = slice(k, k + COUNT_ROWS)
                arrays = [pa.array([name] * len(grams[some]), pa.string()), pa.array(grams[some].astype(np.int64)), pa.array(n[some].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "gram", "n"])

    counts = small_batches(known).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "language-windows")
    return Parts(counts) if counts.count() > MODEL_ROWS else Languages(_by_language(counts))


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, which = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
    return grams, np.bincount(which, np.concatenate([x[1] for x in found]), len(grams)).astype(np.int64)


def _code_lengths(rows: DataFrame, row: str, lowered: str, bits: str, parts: Parts) -> DataFrame:
    """rows with the bits in each language, summed over the parts, each of which passes over the texts by itself."""
    found = None
    for k, within in enumerate(parts.within):
        shared = rows.sparkSession.sparkContext.broadcast(parts.part(within))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some in slices(batches, lowered, 1 << 19):
                own = shared.value.code_lengths(*utf8(some.column(lowered)))  # noqa: B023  (written below, in the same round)
                yield pa.RecordBatch.from_arrays([some.column(row), pa.array(list(own), pa.list_(pa.float64()))], [row, bits])

        own = written(rows.select(row, lowered).mapInArrow(run, f"{row} long, {bits} array<double>"), "language-part").withColumn("part", F.lit(k))
        shared.destroy()
        found = own if found is None else found.unionByName(own)
    none = F.array_repeat(F.lit(0.0), len(parts.names))
    added = F.aggregate(F.array_sort(F.collect_list(F.struct("part", bits))), none, lambda x, y: F.zip_with(x, y[bits], lambda a, b: a + b))
    return rows.join(found.groupBy(row).agg(added.alias(bits)), row).drop(row)


def predict(docs: DataFrame, languages: Languages | Parts, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs with lang_pred, score (the best language's posterior among all) and bits_per_byte.

    A text that is null or has no letter is `und`, with score 0 and no bits; so are all texts if no language was
    learned. Of languages with equal code lengths the first by name wins. Case does not matter. A very long text is scored
    whole, by one task. The three come last;
    one whose name docs has already is called lang_pred_1 or the like.
    """
    lowered, row, known_bits, *results = fresh(docs, "_text", "_row", "_bits", "lang_pred", "score", "bits_per_byte")
    fields, names = list(docs.columns), languages.names
    ready = docs.withColumn(lowered, F.when(F.col(text_col).rlike(r"\p{L}"), F.lower(text_col)))
    in_parts = isinstance(languages, Parts)
    if in_parts:
        rows = written(ready.withColumn(row, F.monotonically_increasing_id()), "language-rows")
        ready = _code_lengths(small_batches(rows), row, lowered, known_bits, languages)
    shared = docs.sparkSession.sparkContext.broadcast(None if in_parts else languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, lowered, 1 << 19):
            data, offsets = utf8(part.column(lowered))
            bits = part.column(known_bits).flatten().to_numpy().reshape(-1, len(names)) if in_parts else shared.value.code_lengths(data, offsets)
            size = np.diff(offsets)
            no = (size == 0) | (not names)
            if names:
                best = bits.argmin(1)
                least = bits[np.arange(len(bits)), best]
                score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                lang = np.array(names, object)[best]
            else:
                least, score, lang = np.zeros(len(size)), np.zeros(len(size)), np.full(len(size), UNKNOWN, object)
            lang[no] = UNKNOWN
            rate = np.where(no, 0.0, least / np.maximum(size, 1))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in fields), pa.array(lang, pa.string()), pa.array(np.where(no, 0.0, score)), pa.array(rate, mask=no)], [*fields, *results]
            )

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType(list(docs.schema.fields)).add(results[0], StringType()).add(results[1], DoubleType()).add(results[2], DoubleType())
    return small_batches(ready).mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, bits_per_byte. An empty table gives no rows."""
    known = learn(docs, per_language, id_col, text_col, lang_col)
    own = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return predict(own, known).drop("text")


def limits(docs: DataFrame, languages: Languages | Parts, per_language: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[float, float]]:
    """Mean of the bits a byte, and spread, of each language that held-out documents show enough of: all of those whose
    language is known and found (per_language: about so many of each)."""
    sample = _known(docs, True, per_language, id_col, text_col, lang_col)
    rate, weight = F.col("bits_per_byte"), F.least(F.octet_length(F.lower("text")), F.lit(LONG)).cast("double")
    sums = predict(sample, languages).filter("lang = lang_pred").groupBy("lang").agg(F.count("*"), F.sum(weight), F.sum(weight * rate), F.sum(weight * rate * rate))
    found = {name: (n, x / w, xx - x * x / w) for name, n, w, x, xx in sums.collect()}  # one row per language
    total = sum(n for n, *_ in found.values())
    if total < FEW:
        return {}
    pooled = sum(squares for *_, squares in found.values()) / total
    return {name: (mean, max(LEAST_SPREAD, squares / n if n >= FEW else pooled)) for name, (n, mean, squares) in found.items()}


def accepted(docs: DataFrame, reject_bits: float = REJECT_BITS) -> DataFrame:
    """The rows of docs in a learned language: with a letter, and no more bits a byte than the best language's limit
    (reject_bits where none could be fitted)."""
    known = learn(docs)
    scored = predict(docs, known)
    lang, posterior, rate = scored.columns[-3:]
    limit = F.lit(reject_bits)
    for name, (mean, spread) in limits(docs, known).items():
        size = F.greatest(F.least(F.octet_length(F.lower("text")), F.lit(LONG)), F.lit(1))
        limit = F.when(F.col(lang) == name, mean + DEVIATIONS * F.sqrt(spread / size)).otherwise(limit)
    return scored.filter((F.col(lang) != UNKNOWN) & (F.col(rate) <= limit)).drop(lang, posterior, rate)
