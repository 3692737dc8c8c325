"""Words and sentences in any script, against a plain reading of each character."""

import random
import unicodedata

import numpy as np
import pytest

from gramloom.llm import near_dup, toxicity
from gramloom.llm._shared import UNSPACED, word_spans

TEXTS = ["", "a", "Été à Zürich, naïve", "“one” — two\u00a0three\u3000four…five", "今天天气很好。我们去公园！", "ภาษาไทย สวัสดี", "हिन्दी में। नमस्ते", "x漢y 字1 カタカナ 한국어", "😀 ok 👍🏽", "нет, да؟ مرحبا", "ü" * 200, "\U00020000\U0001F600a"]


def plain_words(text):
    out, run = [], ""
    for c in text:
        word = unicodedata.category(c)[0] in "LMN"
        alone = word and any(a <= ord(c) <= b for a, b in UNSPACED)
        if run and (alone or not word):
            out.append(run)
            run = ""
        if alone:
            out.append(c)
        elif word:
            run += c
    return out + [run] * bool(run)


def packed(texts):
    raw = [t.encode() if isinstance(t, str) else t for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def spans(texts):
    data, offsets = packed(texts)
    start, end, first = word_spans(data, offsets)
    found = [data[a:b].tobytes() for a, b in zip(start, end, strict=True)]
    return [found[a:b] for a, b in zip(first, first[1:], strict=False)]


def test_words_equal_a_plain_reading():
    rng = random.Random(3)
    letters = "ab1 .,é“”—\u00a0漢字。カไทยक्षم😀"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(500)]
    assert [[w.decode() for w in own] for own in spans(texts)] == [plain_words(t) for t in texts]


def test_broken_bytes_stand_between_words():
    assert spans([b"a\xffb", b"\xe6\xbc", b"c\x80d\xf0", b"e\xc3"]) == [[b"a", b"b"], [], [b"c", b"d"], [b"e"]]


def test_sentence_ends():
    data, _ = packed(["a. 好。吗？नमस्ते। क؟ b。"[:-1] + "。"])
    text = data.tobytes().decode()
    places = np.flatnonzero(toxicity.sentence_ends(data)).tolist()
    assert places == [len(text[: i + 1].encode()) - 1 for i, c in enumerate(text) if c in ".。？।؟"]


@pytest.mark.parametrize("kind", ["han", "typography"])
def test_near_copies(spark, kind):
    """A copy with one changed character, or with other blanks and quotes, is found; another text is not."""
    rng = random.Random(5)
    if kind == "han":
        one, other = ("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200)) for _ in range(2))
        copy = one[:100] + "，" + one[101:]
    else:
        one, other = (" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)) for _ in range(2))
        copy = "“" + one.replace(" ", "\u00a0", 20).replace(" ", " — ", 20) + "”"
    docs = spark.createDataFrame([(1, one), (2, copy), (3, other)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dup.near_classes(docs).collect()} == {1: 1, 2: 1, 3: 3}
