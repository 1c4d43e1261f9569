import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from filecover.llm import suffix_dedup as module
from filecover.llm.suffix_dedup import suffix_dedup, without_repeats
from filecover.llm.suffix_sort import suffix_array

from .conftest import COLUMNS, rows_of


def removed(rows, least):
    """Per row, which bytes go."""
    places = {}
    for doc, text, *_ in rows:
        data = (text or "").encode()
        own = -(1 << 63) if doc is None else doc
        for i in range(len(data) - least + 1):
            key = data[i : i + least]
            places[key] = min(places.get(key, (own, i)), (own, i))
    out = []
    for doc, text, *_ in rows:
        data = (text or "").encode()
        own = -(1 << 63) if doc is None else doc
        gone = bytearray(len(data))
        for i in range(len(data) - least + 1):
            if places[data[i : i + least]] < (own, i):
                gone[i : i + least] = b"\1" * least
        out.append(gone)
    return out


def expected(rows, least):
    out = []
    for (doc, text, *_), gone in zip(rows, removed(rows, least), strict=True):
        data = (text or "").encode()
        spans, at = [], 0
        while at < len(data):
            end = at
            while end < len(data) and gone[end]:
                end += 1
            if end > at:
                spans.append((at, end))
            at = max(end, at + 1)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((doc, len(data), sum(gone), tuple(spans), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def answered(frame):
    rows = frame.collect()
    return Counter((r[0], r[1], r[2], tuple(map(tuple, r[3])), hashlib.sha256(r[4]).hexdigest()) for r in rows)


@pytest.mark.parametrize("least", [100, 32, 17])
def test_against_all_windows(sample, least):
    rows, docs = sample
    assert answered(suffix_dedup(docs, least)) == expected(rows, least)


def test_frequent_anchors_and_small_shares(spark, monkeypatch):
    """A line that many texts hold, dealt window by window, and shares of few symbols."""
    monkeypatch.setattr(module, "FREQUENT", 5)
    monkeypatch.setattr(module, "SORTED_AT_ONCE", 500)
    monkeypatch.setattr(module, "TEXT_AT_ONCE", 3000)
    monkeypatch.setattr(module, "RUNS_AT_ONCE", 2000)
    draw = random.Random(1)
    line = "".join(draw.choice("abcdefgh ") for _ in range(70))
    texts = []
    for _ in range(40):
        own = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randint(0, 60))) for _ in range(3)]
        texts.append(line.join(own) if draw.random() < 0.8 else draw.choice(texts or ["aaa"]))
    texts += ["a" * 400, "b" + "a" * 300, "abc" * 100]
    rows = rows_of(texts)
    got = suffix_dedup(spark.createDataFrame(rows, COLUMNS).repartition(3), 48)
    assert answered(got) == expected(rows, 48)


def test_rows_keep_whole_characters(sample):
    rows, docs = sample
    got = Counter((r.doc_id, r.text, r.source) for r in without_repeats(docs, 40).collect())
    want = Counter()
    for (doc, text, _, source, *_), gone in zip(rows, removed(rows, 40), strict=True):
        left, at = "", 0
        for c in text or "":
            size = len(c.encode())
            left += "" if all(gone[at : at + size]) else c
            at += size
        if left or not text:
            want[doc, None if text is None else left, source] += 1
    assert got == want


def test_no_rows(nothing):
    assert suffix_dedup(nothing).count() == 0 and without_repeats(nothing).columns == nothing.columns
    with pytest.raises(ValueError):
        suffix_dedup(nothing, 8)


def test_suffix_order():
    draw = random.Random(3)
    for _ in range(400):
        s = [draw.randint(1, draw.choice([1, 2, 4, 300])) for _ in range(draw.randint(0, 60))]
        assert suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
