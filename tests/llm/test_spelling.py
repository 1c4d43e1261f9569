import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from filecover.llm import spelling
from filecover.llm.spelling import PositionIndex, counted_words, spelling_variants

from .conftest import COLUMNS, lowered, rows_of, sample_texts


def near(a, b):
    """Exactly one letter inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_of(rows, least_length=5, least_count=3, divisor=97):
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if divisor and h % divisor == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def expected(words, ratio=2):
    forms, nears = {}, {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        nears[w] = len(others)
        best = min(others, key=lambda o: (-words[o], o.encode()), default=None)
        if best and words[best] >= ratio * n:
            forms[w] = best
    out = Counter()
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out[w, forms.get(w), root, n, nears[w], words.get(forms.get(w))] += 1
    return out


def variants(seed=4, letters="abcé", n=260):
    """Texts of words that are often one edit apart, with chains of ever more frequent ones."""
    draw = random.Random(seed)
    stems = ["".join(draw.choice(letters) for _ in range(draw.randint(5, 9))) for _ in range(40)]
    words = []
    for stem in stems:
        words += [stem] * draw.choice([3, 7, 20, 60])
        for _ in range(draw.randint(0, 6)):
            at = draw.randrange(len(stem))
            words += [stem[:at] + draw.choice(["", draw.choice(letters), stem[at] + draw.choice(letters)]) + stem[at + 1 :]] * draw.choice([1, 2, 3, 9])
    draw.shuffle(words)
    return [" ".join(words[i : i + n]) for i in range(0, len(words), n)]


def test_index_against_all_pairs():
    draw = random.Random(1)
    for _ in range(20):
        words = sorted({"".join(draw.choice("abcé") for _ in range(draw.randint(1, 7))) for _ in range(draw.randint(1, 150))})
        index = PositionIndex(words)
        until = [draw.choice([1 << 30, draw.randint(0, len(w))]) for w in words]
        left, right = index.near(np.arange(len(words)), np.array(until))
        want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b) and (until[i] > len(a) or a[: until[i]] != b[: until[i]])}
        assert set(zip(left.tolist(), right.tolist(), strict=True)) == want


@pytest.mark.parametrize(("limit", "index"), [(2048, 4096), (3, 8)])
def test_against_all_pairs(spark, monkeypatch, limit, index):
    """Also with keys that are split down to single places, and indexes smaller than a group."""
    monkeypatch.setattr(spelling, "INDEX", index)
    rows = rows_of(variants())
    got = spelling_variants(spark.createDataFrame(rows, COLUMNS).repartition(4), limit=limit, divisor=7)
    want = expected(words_of(rows, divisor=7))
    assert Counter(map(tuple, got.collect())) == want
    assert any(root != form for _, form, root, *_ in want if form)  # a chain


def test_odd_texts(sample, nothing):
    rows, docs = sample
    got = spelling_variants(docs, least_length=2, least_count=1, divisor=3)
    assert Counter(map(tuple, got.collect())) == expected(words_of(rows, 2, 1, 3))
    assert spelling_variants(nothing).count() == 0
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    with pytest.raises(ValueError, match="ratio"):
        spelling_variants(docs, ratio=1)


def test_very_long_words_and_letters_at_the_edges(spark):
    long = "ab" * 9000
    texts = [f"{long} {long}x ÀÿÀÿÀ À×÷ÿÀ Āword wordĀword X{long}", long, f"{long[:-1]} ÀÿÀÿÀÿ abcde ABCDE aBcDf", ""] * 3
    rows = rows_of(texts)
    docs = spark.createDataFrame(rows, COLUMNS)
    assert {tuple(r) for r in counted_words(docs, divisor=0).collect()} == set(words_of(rows, divisor=0).items())
    assert Counter(map(tuple, spelling_variants(docs, divisor=0).collect())) == expected(words_of(rows, divisor=0))
