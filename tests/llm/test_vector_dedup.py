import math
import random
from collections import Counter

import numpy as np
import pytest

from filecover.llm import vector_dedup
from filecover.llm.vector_dedup import fitted, near_vectors, one_of_each_vector, unit_rows

COLUMNS = "vec_id bigint, embedding array<float>, label int, h1 string, home int, n int, cell string"
ODD = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] + [1.0] * 7, [float("inf")] + [0.0] * 7]


def rows_of(vectors, first=0):
    return [(first + i, None if x is None else [None if c is None else float(np.float32(c)) for c in x], i % 3, "h", 1, 2, "c") for i, x in enumerate(vectors)]


def sample_vectors(seed=1, dims=8):
    """Apart, in a dense group, in chains of neighbours that are linked only step by step, copied, and scaled."""
    draw = np.random.default_rng(seed)
    apart = draw.normal(size=(150, dims))
    centre = draw.normal(size=dims)
    dense = centre + 0.12 * draw.normal(size=(60, dims)) * np.linalg.norm(centre) / math.sqrt(dims)
    u, v = np.linalg.qr(draw.normal(size=(dims, 2)))[0].T
    chain = [math.cos(t) * u + math.sin(t) * v for t in np.arange(0, 2.4, 0.3)]
    found = [*apart, *dense, *chain, *apart[:9], *(3.5 * apart[9:18]), *([dense[0]] * 20)]
    return [x.tolist() for x in found]


def usable(x):
    return x is not None and len(x) > 0 and all(c is not None and math.isfinite(c) for c in x) and any(x)


def expected(rows, threshold=0.9):
    dims = max([len(r[1]) for r in rows if usable(r[1])], default=1)
    units = {}
    for i, r in enumerate(rows):
        if usable(r[1]):
            x = np.array([*r[1], *[0.0] * (dims - len(r[1]))])
            units[i] = x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max())
    links = {i: {j for j in units if j != i and (rows[i][1] == rows[j][1] or units[i] @ units[j] >= threshold)} for i in units}
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None) if i in units else r[0]
        out.append((r[0], len(links.get(i, ())), least, r[0] == least))
    return Counter(out)


def result(df):
    return Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


@pytest.mark.parametrize("threshold", [0.9, 0.7])
def test_against_all_pairs(spark, monkeypatch, threshold):
    """Many small cells and blocks, so that links cross cells and blocks; nothing may be lost."""
    for name, value in (("CELL", 8), ("HOMES", 8), ("MEMBERS", 16), ("AT_ONCE", 64)):
        monkeypatch.setattr(vector_dedup, name, value)
    vectors = sample_vectors()
    random.Random(2).shuffle(vectors)
    rows = rows_of(vectors + ODD) + [(None, vectors[0], 1, "h", 1, 2, "c"), (5, vectors[5], 1, "h", 1, 2, "c"), (7, vectors[40], 1, "h", 1, 2, "c")]
    rows.append((900, [1.0, 2.0], 1, "h", 1, 2, "c"))  # shorter
    got = result(near_vectors(spark.createDataFrame(rows, COLUMNS).repartition(4), threshold))
    assert got == expected(spark.createDataFrame(rows, COLUMNS).collect(), threshold)
    assert max(n for _, n, _, _ in got) > 20


def test_one_cell_and_large_numbers(spark):
    rows = [(1, [1e300, 1e300]), (2, [1.0, 1.0]), (3, [1e-300, 0.0]), (4, [0.0, -5.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    assert result(near_vectors(df)) == Counter([(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)])


def test_unknown_ids_and_empty_tables(spark):
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.01]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert result(near_vectors(df)) == Counter([(None, 1, None, True), (None, 1, None, True), (None, 0, None, True)])
    assert near_vectors(df.where("false")).count() == 0
    assert result(near_vectors(spark.createDataFrame([(3, None)], df.schema))) == Counter([(3, 0, 3, True)])
    with pytest.raises(ValueError, match="threshold"):
        near_vectors(df, 0.0)


def test_one_vector_of_each_group_stays(spark):
    rows = rows_of(sample_vectors(3) + ODD)
    df = spark.createDataFrame(rows, COLUMNS)
    kept = {i for i, _, _, k in expected(df.collect()) if k}
    got = one_of_each_vector(df)
    assert got.columns == df.columns and {r.vec_id for r in got.collect()} == kept


def test_centres_separate_groups(spark):
    """Spherical k-means: centres of length 1, each group nearest to a centre of its own."""
    draw = np.random.default_rng(0)
    directions = np.linalg.qr(draw.normal(size=(6, 6)))[0]
    rows = [(i, (directions[i % 6] * (1 + i % 5) + 0.05 * draw.normal(size=6)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    classes = vector_dedup._classes(df.selectExpr("vec_id", "true as usable", "xxhash64(embedding) as h1", "xxhash64(1, embedding) as h2", "embedding as vector"))
    centres = fitted(classes, 300, 6, 24)
    assert np.allclose(np.linalg.norm(centres, axis=1), 1)
    packed = classes.select("vector").toArrow().column("vector").combine_chunks()
    assert ((unit_rows(packed, 6) @ centres.T).max(axis=1) > 0.97).mean() > 0.9


def test_vectors_without_clusters_visit_few_cells(spark):
    """Each visits most cells, so cells are large: rows dealt stay below a few times the input (2,600 vectors visited 5 cells of 512)."""
    draw = np.random.default_rng(4)
    df = spark.createDataFrame([(i, draw.normal(size=16).tolist()) for i in range(2600)], "vec_id bigint, embedding array<double>")
    classes = vector_dedup._classes(df.selectExpr("vec_id", "true as usable", "xxhash64(embedding) as h1", "xxhash64(1, embedding) as h2", "embedding as vector"))
    k = max(1, 2600 // vector_dedup.CELL)
    placed = vector_dedup._placed(classes, fitted(classes, 2600, 16, k), 16, 0.9)
    assert placed.selectExpr("sum(1 + size(visits)) as n").first().n <= 2 * 2600


@pytest.mark.parametrize("at_once", [1 << 18, 64])
def test_pairs_close_to_the_threshold(monkeypatch, at_once):
    """What single precision leaves is decided in double precision: cosines a billionth above and below."""
    monkeypatch.setattr(vector_dedup, "AT_ONCE", at_once)
    draw = np.random.default_rng(6)
    x = draw.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside = draw.normal(size=x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = np.where(np.arange(300) % 2, 0.9 + 1e-9, 0.9 - 1e-9)[:, None]
    y = cosine * x + np.sqrt(1 - cosine**2) * aside
    got = {(i, j) for a, b in vector_dedup._products(x, y, 0.9) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(i, i) for i in range(1, 300, 2)}
