"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels.

A document is a bag of sentences. A sentence's probability is logistic in the evidence that it holds: words and word
beginnings (4 and 5 bytes), hashed to BUCKETS, that are over-represented in toxic documents. A sentence without any
evidence counts as harmless, and the document's probability is 1 - (1 - LEAK) * product of (1 - sentence's), so that
its length alone does not raise it. Training maximises the likelihood of the document labels, through the noisy-or,
and the sentence scores then tell where the offence is.

Fit: all labelled documents that are not held out. Evidence is chosen from document frequencies counted in Spark. Of the
chosen features in sentences, equal bags of a label are counted as one. Bags with up to PLACES pieces of evidence come to the
driver, where the weights are fitted; of more, each round's gradient is summed in Spark. Scoring is one pass over the
texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.llm._shared import fresh, slices, small_batches, span_hashes, text_of, utf8, word_spans, written

#: Labelled documents whose ids are broadcast at most; more are joined by a shuffle.
FEW_IDS = 1_000_000
#: Pieces of evidence (and bags) that the driver fits on at most; more stay in Spark.
PLACES = 1 << 21
BUCKETS = 1 << 20
LEAK = 0.01
#: Evidence: in so many toxic documents, log odds over this, and so many standard errors over 0.
LEAST_DOCS, LEAST_ODDS, LEAST_Z = 3, 2.0, 3.0
ROUNDS, RATE, DECAY = 200, 0.1, 1e-3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True
#: Full stops, question and exclamation marks of other scripts (CJK, Devanagari, Arabic).
MARKS = ["。", "！", "？", "।", "؟"]


def sentence_ends(data: np.ndarray) -> np.ndarray:
    """Whether a sentence ends at each byte of UTF-8 (at the last of a mark of several)."""
    out = _ENDS[data]
    lead = np.flatnonzero(data >= 0xC0)
    for mark in map(str.encode, MARKS if len(lead) else []):
        at = lead[lead + len(mark) <= len(data)]
        for k, byte in enumerate(mark):
            at = at[data[at + k] == byte]
        out[at + len(mark) - 1] = True
    return out


def held_out(id_col: str = "doc_id", modulus: int = 5, remainder: int = 0) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, row, sentence (numbered through all rows) and first byte of each feature occurrence."""
    data = _LOWER[data]
    start, end, first = word_spans(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    ends = np.concatenate([[0], np.cumsum(sentence_ends(data))])
    sentence = ends[start] + row
    found = [span_hashes(data, start, end) ^ np.uint64(0x51)]
    which = [np.arange(len(start))]
    for k in (4, 5):
        long = np.flatnonzero(end - start > k)
        found.append(span_hashes(data, start[long], start[long] + k) ^ np.uint64(k << 8))
        which.append(long)
    at = np.concatenate(which)
    return (np.concatenate(found) >> np.uint64(44)).astype(np.int64) & (BUCKETS - 1), row[at], sentence[at], start[at]


class NoisyOr:
    """Weights of the evidence and a bias."""

    def __init__(self, bucket: np.ndarray, weight: np.ndarray, bias: float):
        self.bucket, self.weight, self.bias = bucket, weight, bias

    def table(self) -> np.ndarray:
        out = np.full(BUCKETS, np.nan, np.float32)
        out[self.bucket] = self.weight
        return out

    def score(self, table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each row's probability; and of each sentence with evidence its row, first byte of evidence, and probability."""
        bucket, row, sentence, at = features(data, offsets)
        some = np.flatnonzero(~np.isnan(table[bucket]))
        bucket, row, sentence, at = (x[some] for x in (bucket, row, sentence, at))
        # each feature counts once in a sentence
        _, keep = np.unique(sentence * BUCKETS + bucket, return_index=True)
        bucket, row, sentence, at = (x[keep] for x in (bucket, row, sentence, at))
        _, group, which = np.unique(sentence, return_index=True, return_inverse=True)
        z = self.bias + np.bincount(which, table[bucket], len(group))
        harm = np.logaddexp(0, z)
        rows = row[group]
        total = np.bincount(rows, harm, len(offsets) - 1)
        return 1 - (1 - LEAK) * np.exp(-total), [rows, at[group], 1 / (1 + np.exp(-z))]


class Bags:
    """Distinct bags: label, number of documents, and of each piece of evidence its place and its sentence (in order)."""

    def __init__(self, rows: pa.RecordBatch | pa.Table):
        columns = (rows.column(c) for c in ("toxic", "n", "feature", "sentence"))
        toxic, n, feature, sentence = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns)
        self.toxic, self.n = toxic.to_numpy(zero_copy_only=False) > 0, n.to_numpy(zero_copy_only=False).astype(float)
        self.feature = feature.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sentence = sentence.flatten().to_numpy(zero_copy_only=False)
        bag = np.repeat(np.arange(len(self.n)), pc.list_value_length(feature).to_numpy(zero_copy_only=False))
        new = np.ones(len(bag), bool)
        new[1:] = (bag[1:] != bag[:-1]) | (sentence[1:] != sentence[:-1])
        self.which, self.owner = np.cumsum(new) - 1, bag[new]

    def pull(self, x: np.ndarray) -> np.ndarray:
        """The gradient of the loss by the weights and, last, the bias: summed over documents."""
        z = x[-1] + np.bincount(self.which, x[self.feature], len(self.owner))
        total = np.bincount(self.owner, np.logaddexp(0, z), len(self.n)) - np.log1p(-LEAK)
        push = self.n * np.where(self.toxic, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0)  # of the loss, by total
        dz = push[self.owner] / (1 + np.exp(-z))
        return np.append(np.bincount(self.feature, dz[self.which], len(x) - 1), dz.sum())


def pulled(bags: DataFrame, x: np.ndarray) -> np.ndarray:
    """The same gradient, summed in Spark over a table of bags."""
    shared = bags.sparkSession.sparkContext.broadcast(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros(len(shared.value))
        for part in batches:
            g += Bags(part).pull(shared.value)
        some = np.flatnonzero(g)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(g[some])], ["at", "g"])

    rows = bags.mapInArrow(run, "at long, g double").groupBy("at").agg(F.sum("g").alias("g")).toArrow()  # BUCKETS rows and one at most
    shared.destroy()
    out = np.zeros(len(x))
    out[rows.column("at").to_numpy()] = rows.column("g").to_numpy()
    return out


def fit(pull: Callable[[np.ndarray], np.ndarray], documents: int, bucket: np.ndarray, weight: np.ndarray) -> NoisyOr:
    """pull: gives the gradient, summed over so many documents. weight: where to begin."""
    x = np.append(weight, -2.0)
    m, v = np.zeros(len(x)), np.zeros(len(x))
    for t in range(1, ROUNDS + 1):
        g = pull(x) / max(1, documents) + DECAY * x / max(1, len(x))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return NoisyOr(bucket, x[:-1].astype(np.float32), float(x[-1]))


def bag_of(sentence: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Evidence of a document, in the order of its sentences, as a bag: features and sentences, the latter in the order of
    what they hold and numbered from 0, so that documents with the same evidence have the same bag."""
    parts = sorted(x.tolist() for x in np.split(feature, np.flatnonzero(np.diff(sentence)) + 1)) if len(feature) else []
    return np.array([f for x in parts for f in x], np.int32), np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in parts])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> NoisyOr:
    """Fit on all labelled documents that are not held out. A document with several labels counts as toxic if one says so."""
    own = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}  # one row per label
    if not sizes.get(1) or not sizes.get(0):
        return NoisyOr(np.zeros(0, np.int64), np.zeros(0, np.float32), -2.0)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    marks = F.broadcast(own) if sum(sizes.values()) <= FEW_IDS else own
    known = written(texts.join(marks, "doc_id").select("toxic", "text"), "toxicity-known")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int64)
        for part in slices(batches):
            bucket, row, _, _ = features(*utf8(part.column("text")))
            toxic = np.asarray(part.column("toxic").to_numpy(zero_copy_only=False)) > 0
            once = np.unique(row * BUCKETS + bucket)
            for k in (0, 1):
                seen[k] += np.bincount(once[toxic[once // BUCKETS] == k] % BUCKETS, minlength=BUCKETS)
        some = np.flatnonzero(seen.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[0, some]), pa.array(seen[1, some])], ["bucket", "clean", "toxic"])

    counted = small_batches(known).mapInArrow(frequencies, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = counted.filter(F.col("toxic") >= LEAST_DOCS).toArrow()  # BUCKETS rows at most
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    clean, toxic = (found.column(c).to_numpy() + 0.5 for c in ("clean", "toxic"))
    odds = np.log(toxic / (total.get(1, 0) + 1)) - np.log(clean / (total.get(0, 0) + 1))
    good = (odds > LEAST_ODDS) & (odds > LEAST_Z * np.sqrt(1 / toxic + 1 / clean))
    bucket = found.column("bucket").to_numpy()[good]
    order = np.argsort(bucket)
    bucket, start = bucket[order], odds[good][order]

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            b, row, sentence, _ = features(*utf8(part.column("text")))
            at = np.minimum(np.searchsorted(bucket, b), max(0, len(bucket) - 1))
            hit = np.flatnonzero(bucket[at] == b) if len(bucket) else np.zeros(0, np.int64)
            key = np.unique(np.stack([row[hit], sentence[hit], at[hit]], 1), axis=0)
            edges = np.searchsorted(key[:, 0], np.arange(part.num_rows + 1))
            bags = [bag_of(key[lo:hi, 1], key[lo:hi, 2]) for lo, hi in zip(edges, edges[1:], strict=False)]
            lists = [pa.array([x[k] for x in bags], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(part.column("toxic").to_numpy(zero_copy_only=False), pa.int32()), *lists], ["toxic", "feature", "sentence"])

    bags = small_batches(known).mapInArrow(evidence, "toxic int, feature array<int>, sentence array<int>")
    bags = written(bags.groupBy("toxic", "feature", "sentence").agg(F.count("*").alias("n")), "toxicity-bags")
    documents, places = bags.agg(F.sum("n"), F.sum(F.size("feature") + 1)).first()
    if (places or 0) > PLACES:
        return fit(lambda x: pulled(bags, x), documents, bucket, start)
    own = Bags(bags.sort("toxic", "feature", "sentence").toArrow())  # in an order, so that sums come out the same each time
    return fit(own.pull, documents or 0, bucket, start)


def score(docs: DataFrame, model: NoisyOr, text_col: str = "text") -> DataFrame:
    """The columns of docs with score, predicted (score >= 0.5) and offending: the sentences of 0.5 and more as structs
    of the first byte of their evidence in the text's UTF-8, and their score. A null or empty text scores LEAK. The three
    come last; one whose name docs has already is called score_1 or the like."""
    results = fresh(docs, "score", "predicted", "offending")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = list(docs.columns)
    offence = pa.struct([("at", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        weights = own.table()
        for part in slices(batches, text_col):
            data, offsets = utf8(part.column(text_col))
            p, (row, at, each) = own.score(weights, data, offsets)
            bad = np.flatnonzero(each >= 0.5)
            spans = [[] for _ in range(part.num_rows)]
            for r, a, e in zip(row[bad].tolist(), (at[bad] - offsets[row[bad]]).tolist(), each[bad].tolist(), strict=True):
                spans[r].append({"at": a, "score": e})
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in fields), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(offence))], [*fields, *results])

    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

    spans = ArrayType(StructType().add("at", LongType()).add("score", DoubleType()))
    return small_batches(docs).mapInArrow(run, StructType(list(docs.schema.fields)).add(results[0], DoubleType()).add(results[1], IntegerType()).add(results[2], spans))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, offending. Without labels of both kinds all score LEAK."""
    model = learn(docs, labels, id_col, text_col)
    own = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return score(own, model).drop("text")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs with a score under 0.5."""
    scored = score(docs, learn(docs, labels))
    results = scored.columns[-3:]
    return scored.filter(F.col(results[1]) == 0).drop(*results)
