import random
from collections import Counter

import numpy as np
import pytest

from filecover.llm import near_dedup
from filecover.llm.near_dedup import least_matches, near_duplicates, one_of_each

from .conftest import COLUMNS, lowered, rows_of, sample_texts, words


def shingles(text, k):
    w = words(lowered(text))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def expected(rows, k, percent):
    """(id, size) -> component by comparing all pairs."""
    sets = [(r[0], shingles(r[1], k)) for r in rows]
    lead = list(range(len(sets)))

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                lead[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i, (doc, own) in enumerate(sets):
        members = [sets[j][0] for j in range(len(sets)) if find(j) == find(i) and sets[j][0] is not None]
        least = min(members, default=None) if own else doc
        out.append((doc, len(own), least, doc == least))
    return Counter(out)


@pytest.mark.parametrize(("k", "percent"), [(4, 80), (5, 80), (2, 90)])
def test_against_all_pairs(sample, k, percent):
    rows, docs = sample
    got = Counter(map(tuple, near_duplicates(docs, width=k, percent=percent).collect()))
    assert got == expected(rows, k, percent)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Copies that differ so much that only some are linked; blocks smaller than the group."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    draw = random.Random(3)
    base = [f"w{draw.randint(0, 10**6)}" for _ in range(150)]
    texts = [" ".join(base)] * 40
    for _ in range(90):
        own = list(base)
        for at in draw.sample(range(150), draw.randint(1, 12)):
            own[at] = f"e{draw.randint(0, 10**6)}"
        texts.append(" ".join(own))
    draw.shuffle(texts)
    rows = rows_of(texts)
    got = near_duplicates(spark.createDataFrame(rows, COLUMNS).repartition(4), width=4)
    assert Counter(map(tuple, got.collect())) == expected(rows, 4, 80)


def test_bound_of_the_posterior():
    """The fewest matches to go on have at least the chosen chance of a similarity of 0.8; one fewer has less."""
    draw = np.random.default_rng(0)
    for _, n, m in least_matches(72, 36, 0.8, 1e-3):
        assert (draw.beta(m + 1, n - m + 1, 400_000) >= 0.8).mean() >= 0.7e-3
        assert (draw.beta(m, n - m + 2, 400_000) >= 0.8).mean() < 1.3e-3


def test_one_row_of_each(sample, nothing):
    rows, docs = sample
    kept = {d for d, _, _, k in expected(rows, 5, 80) if k}
    got = one_of_each(docs).collect()
    assert Counter(map(tuple, got)) == Counter({r for r in rows if r[0] in kept or (r[0] is None and r[1] is None)})
    assert near_duplicates(nothing).count() == 0 and one_of_each(nothing).columns == nothing.columns


def test_fixture_has_groups():
    sizes = Counter(shingles(t, 4) for t in sample_texts())
    assert max(sizes.values()) > 1


def test_kept_rows_stay_out_of_python(sample):
    """The last pass, over all columns, gives Python ids only."""
    plan = one_of_each(sample[1])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan
