"""Operators on small tables: nulls, empty and long texts, ties and repeats, empty tables, clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gramloom.llm import bpe, exact_dedup, fixity, html_text, language_id, lm_scoring, media, near_dup, packing, toxicity
from gramloom.llm._shared import utf8
from gramloom.llm.queries import vocabulary_file

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice("abcde") for _ in range(n))


def awkward():
    long_ = " ".join(prose(k, 500) for k in range(20))
    rows = [(1, None), (2, ""), (3, "!!! ..."), (4, "one two"), (5, prose(5)), (5, prose(5)), (6, prose(5).upper()), (7, long_), (8, "ü ß 漢字 😀 <|endoftext|>"), (None, prose(9)), (10, "x" * 3000)]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    # a column of the same name as one of the operators' own
    return spark.createDataFrame(awkward(), SCHEMA).withColumn("kept", F.lit("mine")).withColumn("bands", F.lit(1))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(docs, none):
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == 11
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    same = next(g for g in by.values() if len(g) == 3)
    assert {r["keep_id"] for r in same} == {6} and sum(r["kept"] for r in same) == 1 and {r["group_size"] for r in same} == {3}
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in empty) == [(1, 2, False), (2, 2, True)]
    assert exact_dedup.exact_groups(none).count() == 0
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 8


def test_exact_keeps_one_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a", "x", "s", 1)] * 4, SCHEMA)
    assert [r["kept"] for r in exact_dedup.exact_groups(df).collect()].count(True) == 1
    assert exact_dedup.keep_one(df).count() == 1


def test_chunks_cover_the_text(spark):
    texts = [prose(1, 4000), "漢字かな交じり文" * 2000, "a" * 9999, "line\n" * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exact_dedup.chunks(F.col("t")).alias("c"))
    for r in df.collect():
        assert "".join(r["c"]) == r["t"] and max(map(len, r["c"])) <= exact_dedup.CHUNK_MOST
    # an insertion near the front leaves most later chunks alone
    base = prose(3, 6000)
    one, two = ({*r[0]} for r in spark.createDataFrame([(base,), ("new words " + base,)], "t string").select(exact_dedup.chunks(F.col("t"))).collect())
    assert len(one & two) > 0.8 * len(one)


def brute_classes(rows, least=0.8):
    import re

    sets, copies = {}, {}
    for k, (_, text) in enumerate(rows):
        w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        copies[k] = tuple(w) or (text or "",)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if copies[a] == copies[b] or (both and both >= least * (len(sets[a]) + len(sets[b]) - both)):
                parent[find(a)] = find(b)
    return [find(k) for k in range(len(rows))]


def test_near(docs, none, spark):
    got = near_dup.near_classes(docs)
    rows = got.collect()
    assert len(rows) == 11 and near_dup.near_classes(none).count() == 0
    assert {r["class_id"] for r in rows if r["doc_id"] in (5, 6)} == {5}
    assert {r["class_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 8


def test_rows_without_an_id_stay_apart(spark):
    rows = [(None, prose(1), "en", "s", 1), (None, prose(2), "en", "s", 1), (3, prose(3), "en", "s", 1), (3, prose(4), "en", "s", 1)]
    for keep in (near_dup.keep_one, exact_dedup.keep_one):
        assert keep(spark.createDataFrame(rows + rows, SCHEMA)).count() == 4


def test_near_equals_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for family in range(12):  # hubs with edited copies, chains of edits, and a passage in all
        base = prose(family, 150).split()
        rows.append(base)
        last = base
        for k in range(12):
            copy = list(base if k % 2 else last)
            for _ in range(rng.randint(1, 5)):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.random())
            rows.append(copy)
            last = copy
    passage = prose(99, 60).split()
    rows = [(k, " ".join(w + passage if k % 3 == 0 else w)) for k, w in enumerate(rows)]
    want = brute_classes(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    least = {}
    for k, c in enumerate(want):
        least[c] = min(least.get(c, k), k)
    assert got == {k: least[c] for k, c in enumerate(want)}


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    element, row, weight, true = [], [], [], []
    for r in range(150):
        ids, w = np.arange(40, dtype=np.uint64) + np.uint64(1000 * r), rng.uniform(0.1, 9, 40)
        v = w * rng.uniform(0.4, 1.6, 40)
        for k, x in enumerate((w, v)):
            element.append(ids)
            row.append(np.full(40, 2 * r + k))
            weight.append(x)
        true.append(np.minimum(w, v).sum() / np.maximum(w, v).sum())
    s = near_dup.dart_signatures(*map(np.concatenate, (element, row, weight)), 300)
    assert abs((s[::2] == s[1::2]).mean() - np.mean(true)) < 0.01
    one = near_dup.dart_signatures(np.arange(50, dtype=np.uint64), np.zeros(50, np.int64), None, 1)
    two = near_dup.dart_signatures(np.arange(50, dtype=np.uint64), np.zeros(50, np.int64), np.ones(50), 1)
    assert (one == two).all()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + k, 1001 + k) for k in range(40)]
    edges = [e for e in edges if e[0] != e[1]]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_bpe(docs, none):
    import base64

    import public_tokenizers
    import tiktoken

    path = vocabulary_file("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t, *_ in awkward():
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(docs, path).collect()), key=str) == sorted(want, key=str)
    assert bpe.round_trip(none, path).count() == 0
    ids = bpe.encode_texts(docs, path)
    back = bpe.decode_ids(ids, path).collect()
    assert sorted(bytes(r["data"]) for r in back) == sorted((t or "").encode() for _, t, *_ in awkward())


def test_bpe_fuzz():
    import base64

    import public_tokenizers
    import tiktoken

    path = vocabulary_file("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcsStTdmlvre ''  \n\t\r!?.,0129²½éßЖ漢 ́　😀_") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["ab" * 400, "!" * 700 + "a'ses'll've 's", "z" * 600]
    texts += ["".join(chr(rng.choice([0x558, 0xA7CE, 0x11DE0, 0x10D40, 0x3000, 0x1F600, 0x85, 65, 32])) for _ in range(9)) for _ in range(200)]
    ids, rows = bpe.Encoder(bpe.vocabulary(path).encode, most=2000)(*utf8(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(rows, rows[1:], strict=False)] == [library.encode_ordinary(t) for t in texts]


def thue_morse(n):
    """A word of n letters and its complement, which collide under every polynomial hash modulo 2**64 when n is 1024 or more."""
    one = "".join("ab"[k.bit_count() % 2] for k in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("one_slice", [True, False])
def test_texts_that_share_a_hash(spark, monkeypatch, one_slice):
    """Words of one weak hash, and then all short pretokens under one and the same hash: bytes decide."""
    from tokenizers import Tokenizer

    import gramloom.llm.pretoken as pretoken

    texts = [w for n in (1024, 2048, 4096) for w in thue_morse(n)] + ["one two", "six ten", "one ten"]
    path = vocabulary_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for weak in (False, True):
        if weak:
            monkeypatch.setattr(pretoken, "span_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
        encode = bpe.Encoder(packing._encoder(path).encode)
        for some in [texts] if one_slice else [[t] for t in texts]:
            ids, rows = encode(*utf8(pa.array(some)))
            assert [ids[a:b].tolist() for a, b in zip(rows, rows[1:], strict=False)] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_distinct_texts_survive_near_dedup(spark):
    one, two = thue_morse(2048)
    rows = [(1, one), (2, two), (3, one.translate(str.maketrans("ab", "!?"))), (4, two.translate(str.maketrans("ab", "!?"))), (5, "alpha beta"), (6, "beta alpha")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_dup.keep_one(df).count() == 6
    assert exact_dedup.keep_one(df).count() == 6


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = vocabulary_file("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)  # untouched: a special token's string in a text is that token
    got = packing.pack_documents(docs, path).collect()
    pieces = []
    for i, t, *_ in awkward():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, n in enumerate(np.diff(packing.piece_edges(len(ids)))):
            pieces.append((i, k, at, int(n), zlib.crc32(ids[at : at + n])))
            at += int(n)
        assert at == len(ids)
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(pieces, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(none, path).count() == 0


@pytest.mark.parametrize("n", [1, 2047, 2048, 2049, 4096, 5000])
def test_piece_edges(n):
    sizes = np.diff(packing.piece_edges(n))
    assert sizes.sum() == n and (sizes[1:] == 2048).all() and 1 <= sizes[0] <= 2048


def test_best_fit_equals_a_scan():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2049, 600)
    sequence, offset = packing.best_fit_decreasing(lengths)
    left: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in left if r >= lengths[i]]
        if fits:
            left[left.index(min(fits))] -= int(lengths[i])
        else:
            left.append(2048 - int(lengths[i]))
    assert sequence.max() + 1 == len(left)
    used = np.bincount(sequence, lengths)
    assert sorted(2048 - used) == sorted(left)


def test_media(docs, none):
    got = {(r["doc_id"], r["n_bytes"]): r for r in media.features(media.store(docs)).collect()}
    for i, t, *_ in awkward():
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i, len(raw)]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.features(media.store(none)).count() == 0


def test_sniffing(spark):
    payload = bytes(range(256)) * 2
    forms = {kind: make(payload) for kind, make, _ in media.STORES}
    for kind, data in forms.items():
        assert media.sniff(data) == (kind, len(data), [])
        assert media.READ[kind](data) == payload
        assert media.sniff(data[:-1])[0] == media.UNKNOWN
        kinds = media.sniff(b"RIFF BM junk " + data + b" .snd PK\x03\x04")
        assert kinds == (media.UNKNOWN, 0, [(kind, 13, len(data))])
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    assert media.sniff(gif)[:2] == ("image/gif", len(gif))
    inside = media.STORES[1][1](gif + bytes(64 - len(gif) % 64))
    assert media.sniff(inside)[2] == [("image/gif", 44, len(gif))]
    df = spark.createDataFrame([(1, bytearray(gif), "image/png"), (2, None, None), (3, bytearray(), "image/gif"), (4, bytearray(gif), "image/gif")], "doc_id long, media binary, declared string")
    got = {r["doc_id"]: (r["media_type"], r["corrected"]) for r in media.inspect(df).collect()}
    assert got == {1: ("image/gif", True), 2: (media.UNKNOWN, False), 3: (media.UNKNOWN, True), 4: ("image/gif", False)}


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><header><h1>Head &amp; line</h1></header><p>First <b>bold</b>word<br>next &eacute;&#233;.</p><p>Two.<p>Three</p><!-- <p>no</p> --><aside>Related things here</aside></article>
<div id="comments"><p>I liked this very much, thank you for it.</p></div><form><input><label>Mail</label></form><footer>Imprint</footer></body></html>"""


def test_html(spark):
    assert html_text.main_text(PAGE) == "Head & line First boldword next éé. Two. Three"
    df = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 5), (3, "u", "", 5), (4, "u", "<p>" * 5000, 5)], "page_id long, url string, html string, words int")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "words", "text", "n_chars"]
    assert sorted((r["page_id"], r["n_chars"]) for r in got.collect()) == [(1, 46), (1, 46), (2, 0), (3, 0), (4, 0)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_fixity(spark, none):
    rng = random.Random(0)
    rows = [(k, f"record {k} " * rng.randint(1, 9)) for k in range(5000)] + [(None, "no slot"), (7, "again"), (8, None)]
    other = [(k, t) for k, t in rows if k != 4000]
    other = [(k, "x" + t[1:]) if k in (5, 2047, 2048, 4999) else (k, t) for k, t in other] + [(9000, "extra")]
    frame = lambda r: fixity.leaves(spark.createDataFrame(r, "slot long, record string"))
    got = fixity.audit(frame(rows), frame(other)).collect()
    found = {}
    for r in got:
        found.setdefault(r["status"], set()).add(r["slot"])
    assert found["corrupt"] == {5, 2047, 2048, 4999} and found["missing"] == {4000} and found["extra"] == {9000}
    assert found["moved"] == {k for k in range(4001, 4096)}
    assert fixity.audit(frame(rows), frame(rows)).count() == 0
    assert fixity.audit(frame([]), frame([])).count() == 0


def test_code_lengths_are_those_of_a_distribution():
    rng = random.Random(3)
    text = "".join(rng.choice("abcab ") for _ in range(400))
    data, offsets = utf8(pa.array([text]))
    grams, n = np.unique(language_id.windows(data, offsets), return_counts=True)
    tree = language_id.ContextTree(grams, n)
    for context in (b"abc", b"zzz", b"a b", b"\n\n\n", b"zza"):
        g = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint32)
        assert abs(np.exp2(-tree.bits(g)).sum() - 1) < 1e-9, context
    known = language_id.Languages({"x": (grams, n)})
    assert np.allclose(known.code_lengths(data, offsets)[0, 0], tree.bits(language_id.windows(data, offsets)).sum(), rtol=1e-5)


def ppm_bits(counts, context, symbol):
    """PPM-C with exclusion by the book: dictionaries of contexts, from the longest to the empty one."""
    import math
    from collections import Counter

    bits, gone = 0.0, set()
    for order in range(3, -1, -1):
        c = context[3 - order :]
        here = Counter()
        for g, n in counts.items():
            if g[3 - order : 3] == c:
                here[g[3]] += n
        live = {s: n for s, n in here.items() if s not in gone}
        total, distinct = sum(live.values()), len(live)
        if symbol in live:
            return bits - math.log2(live[symbol] / (total + distinct))
        if distinct:
            bits -= math.log2(distinct / (total + distinct))
        gone |= set(here)
    return bits + math.log2(256 - len(gone))


def test_code_lengths_equal_brute_force(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice("abca bé") for _ in range(300)).encode()
    data, offsets = utf8(pa.array([text.decode()]))
    grams, n = np.unique(language_id.windows(data, offsets), return_counts=True)
    counts = {int(g).to_bytes(4, "big"): int(k) for g, k in zip(grams, n, strict=True)}
    other = ("zz abcab xa" + "".join(rng.choice("abcaz é") for _ in range(60))).encode()
    padded = b"\n\n\n" + other
    want = sum(ppm_bits(counts, padded[k : k + 3], padded[k + 3]) for k in range(len(other)))
    for cells in (language_id.CELLS, 20):  # all windows ready, and twenty
        monkeypatch.setattr(language_id, "CELLS", cells)
        got = language_id.Languages({"x": (grams, n)}).code_lengths(*utf8(pa.array([other.decode()])))[0, 0]
        assert abs(got - want) < 1e-8


def test_noisy_or_equals_brute_force():
    import math

    texts = ["One villain here. Nothing there! Two villains and a rotter.", "", "calm words only", "villain villain villain", "Rotter? rotter.\nrotter"]
    data, offsets = utf8(pa.array(texts))
    bucket = lambda w: int(toxicity.features(*utf8(pa.array([w])))[0][0])
    weights = {bucket("villain"): 2.5, bucket("rotter"): 1.5}
    order = np.array(sorted(weights))
    model = toxicity.NoisyOr(order, np.array([weights[int(b)] for b in order], np.float32), -1.0)
    got, _ = model.score(model.table(), data, offsets)
    import re

    for text, p in zip(texts, got, strict=True):
        clean = 1 - toxicity.LEAK
        for sentence in re.split(r"[.!?\n]", text.lower()):
            z = sum(weights[bucket(w)] for w in ("villain", "rotter") if w in re.findall("[a-z]+", sentence))
            clean *= 1 - 1 / (1 + math.exp(-(z - 1.0))) if z else 1
        assert abs(p - (1 - clean)) < 1e-6


def test_language_id(docs, none, spark):
    got = language_id.identify(docs).collect()
    assert len(got) == 11
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert language_id.identify(none).count() == 0
    nothing = spark.createDataFrame([(1, "abc", None, "s", 3)], SCHEMA)
    assert language_id.identify(nothing).first()["lang_pred"] == "und"


def test_toxicity(docs, none, spark):
    labels = spark.createDataFrame([(1, 0, 0), (5, 1, 1), (5, 1, 0), (7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.classify(none, labels).count() == 0 and toxicity.classify(docs, labels.limit(0)).count() == 11


def test_toxicity_finds_sentences(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        parts = [prose(1000 * k + j, 8) for j in range(6)]
        if bad:
            parts[k % 6] += " " + rng.choice(["villain", "rotter"])
        rows.append((k, ". ".join(parts) + "."))
        labels.append((k, 1, int(bad)))
    docs_, labels_ = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs_, labels_).collect()}
    out = [k for k in range(400) if got[k]["held_out"]]
    assert sum(got[k]["predicted"] == int(k % 4 == 0) for k in out) > 0.97 * len(out)
    for k in out:
        if got[k]["predicted"] and k % 4 == 0:
            text = rows[k][1]
            wanted = text[: max(text.find("villain"), text.find("rotter"))].count(".")
            assert any(text[: s["at"]].count(".") == wanted for s in got[k]["offending"])
    assert toxicity.accepted(docs_, labels_).columns == docs_.columns


def test_lm_scoring(docs, none, spark):
    import math
    import re
    from collections import Counter

    ids = spark.createDataFrame([(5,), (7,)], "doc_id long")
    got = lm_scoring.cross_entropy_difference(docs, ids).collect()
    assert len(got) == 11 and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert lm_scoring.cross_entropy_difference(none, ids).count() == 0
    # brute force with dictionaries over the ids of words and pairs, which a few share
    tables = []
    ids_of = {k: [x.tolist() for x in lm_scoring.tokens(*utf8(pa.array([(t or "").lower()])))[:3]] for k, (_, t, *_) in enumerate(awkward())}
    for chosen in (lambda i: i in (5, 7), lambda i: i not in (5, 7)):
        word, before, pair = Counter(), Counter(), Counter()
        for k, (i, *_) in enumerate(awkward()):
            if chosen(i):
                for counter, x in zip((word, before, pair), ids_of[k], strict=True):
                    counter.update(x)
        tables.append((word, before, pair, sum(word.values())))

    def bits(table, w, h, hw):
        word, before, pair, n = table
        x = min(1.0, tables[0][3] / tables[1][3]) if table is tables[1] else 1.0
        p = (x * word[w] + 1) / (x * n + lm_scoring.WORDS)
        return -math.log2((x * pair[hw] + lm_scoring.MU * p) / (x * before[h] + lm_scoring.MU))

    for k, (i, t, *_) in enumerate(awkward()):
        each = list(zip(*ids_of[k], strict=True))
        assert len(each) == len(re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").lower().encode()))
        if each and i in (4, 7, 8):
            want = sum(bits(tables[0], *x) - bits(tables[1], *x) for x in each) / len(each)
            assert abs(next(r["score"] for r in got if r["doc_id"] == i) - want) < 1e-9


def test_media_ends_are_scanned_once():
    import struct
    import time

    name = b"a.txt"
    local = b"PK\x03\x04" + bytes(22) + struct.pack("<HH", len(name), 0) + name + b"text"
    central = b"PK\x01\x02" + bytes(42) + name
    archive = local + central + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(central), len(local), 0)
    assert media.sniff(b"xx" + archive) == (media.UNKNOWN, 0, [("application/zip", 2, len(archive))])
    assert media.sniff(b"%PDF-1.4 startxref 0 %%EOF")[0] == "application/pdf" and media.sniff(b"startxref %PDF-1.4 %%EOF")[2] == []
    began = time.perf_counter()
    for magic in (b"PK\x03\x04", b"%PDF-"):
        media.sniff(magic * 100_000)
    assert time.perf_counter() - began < 5


def test_media_forms(docs):
    for r in media.features(media.store(docs)).collect():
        stored = next(make for kind, make, _ in media.STORES if r["feature"].startswith(kind))
        i, t = next((i, t) for i, t, *_ in awkward() if i == r["doc_id"] and len((t or "").encode()) == r["n_bytes"])
        raw = (t or "").encode()
        data = stored(raw + bytes(-len(raw) % 64 if raw else 64))
        assert (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())


def test_one_chunk_in_every_document(spark):
    passage = prose(7, 3000)
    rows = [(k, f"{prose(k, 40)} {passage}" if k % 10 else passage.upper()) for k in range(400)]
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k, r in got.items() if r["group_size"] == 40} == set(range(0, 400, 10)) and all(got[k]["keep_id"] == (390 if k % 10 == 0 else k) for k in got)
