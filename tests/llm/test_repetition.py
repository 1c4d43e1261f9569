import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from filecover.llm.repetition import keep_good, maximal_spans, repetition, suffix_repeats

from .conftest import words


def windows_twice(tokens, k):
    found = defaultdict(list)
    for i in range(len(tokens) - k + 1):
        found[tuple(tokens[i : i + k])].append(i)
    held = set()
    for places in found.values():
        if len(places) > 1:
            for i in places:
                held.update(range(i, i + k))
    return len(held)


def longest(tokens):
    k = 1
    while windows_twice(tokens, k):
        k += 1
    return k - 1


def judged(text, least, share, most):
    tokens = words(text)
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    repeated = windows_twice(tokens, 8)
    failed = len(tokens) < 20 or 100 * repeated > 30 * len(tokens)
    covered = windows_twice(tokens, least)
    top = longest(tokens)
    top = top if top >= least else 0
    kept = not failed and covered <= share * len(tokens) and top <= most
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(tokens), sum(map(len, tokens)), symbols, again, repeated, failed, kept, covered, top


@pytest.mark.parametrize(("least", "share", "most"), [(6, 0.3, 100), (3, 0.1, 5), (11, 0.5, 40)])
def test_against_all_windows(sample, least, share, most):
    rows, docs = sample
    got = Counter(tuple(r)[:10] for r in repetition(docs, least, share, most).collect())
    assert got == Counter((r[0], *judged(r[1], least, share, most)) for r in rows)


def test_lengths_of_repeats():
    draw = np.random.default_rng(2)
    for _ in range(200):
        n, least = int(draw.integers(0, 50)), int(draw.integers(1, 5))
        ids, doc = draw.integers(0, 3, n), np.sort(draw.integers(0, 3, n))
        got = suffix_repeats(ids, doc, least)
        for i in range(n):
            best = 0
            for j in range(n):
                k = 0
                while i != j and max(i, j) + k < n and doc[i] == doc[j] == doc[i + k] == doc[j + k] and ids[i + k] == ids[j + k]:
                    k += 1
                best = max(best, k)
            assert got[i] == (best if best >= least else 0)


def test_spans_are_maximal():
    starts, lengths = maximal_spans(np.array([3, 2, 1, 0, 3, 2, 1]), np.zeros(7, int))
    assert starts.tolist() == [0, 4] and lengths.tolist() == [3, 3]


def test_rows_pass_whole(sample, nothing):
    rows, docs = sample
    assert Counter(map(tuple, keep_good(docs).collect())) == Counter(r for r in rows if judged(r[1], 6, 0.3, 100)[6])
    assert repetition(nothing).count() == 0 and keep_good(nothing).columns == nothing.columns
