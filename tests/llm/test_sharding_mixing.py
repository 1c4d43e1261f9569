import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from filecover.llm.mixing import WEIGHTS, mix, mixed_rows
from filecover.llm.sharding import feistel_shards, op2_feistel_shards, permuted

from .conftest import COLUMNS, words


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 97, 1000, 4099])
def test_permutation(spark, n):
    rows = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), 3).alias("to"))
    assert sorted(r.to for r in rows.collect()) == list(range(n))


def test_shards(sample, nothing):
    rows, docs = sample
    got = feistel_shards(docs, 7).collect()
    text = lambda r: (r[1] or "").encode()
    assert Counter(tuple(r)[:3] for r in got) == Counter((r[0], len(text(r)) + 8, zlib.crc32(text(r))) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = feistel_shards(docs.repartition(2), 7).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert Counter(map(tuple, feistel_shards(docs, 7, seed=1).collect())) != Counter(map(tuple, got))
    assert feistel_shards(nothing).count() == 0


def test_a_row_that_is_a_third_of_all(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id) as doc_id", "'same' as text")
    assert feistel_shards(rows, 10).groupBy("shard").count().where("count != 300").count() == 0


def test_no_python(spark):
    for name in ("op2_feistel_shards", "op7_mixing"):
        from filecover.llm.queries import QUERIES

        frame = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert not re.search("Python|Arrow|Pandas", frame._jdf.queryExecution().toString())
    assert op2_feistel_shards(spark, "/root/testdata/sf0.001").dtypes[3:] == [("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]


def wanted(sizes, share, most):
    """Targets by sharing out again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        given = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: most * sizes[s] for s in free if given[s] >= most * sizes[s]}
        if not over:
            return fixed | given
        fixed |= over


@pytest.mark.parametrize(("share", "most"), [(1.5, 2.0), (0.4, 2.0), (1.9, 2.0), (0.05, 1.0)])
def test_mix(sample, nothing, share, most):
    rows, docs = sample
    got = mix(docs, share, most).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((r[0], r[3], len(words(r[1]))) for r in rows)
    targets = wanted(sizes, share, most)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= most * r["size"] and r.passes == (-(-r.taken // r["size"]) if r["size"] else 0)
        taken[r.source] += r.taken
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 1
    assert Counter(map(tuple, mix(docs.repartition(3), share, most).collect())) == Counter(map(tuple, got))
    assert mix(nothing).count() == 0


def test_rows_of_the_mix(spark, nothing):
    texts = [f"one  two\tthree{i}\nfour five six, seven " for i in range(30)] + ["", None]
    rows = [(i, t, "en", f"s{i % 3}", 0, "k", "s", 1, 1, "x", "r") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, COLUMNS)
    planned = {r.doc_id: r for r in mix(docs.withColumn("doc_id", F.xxhash64("doc_id", "text"))).collect()}
    keys = {r.doc_id: r.k for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k")).collect()}
    got = defaultdict(list)
    for r in mixed_rows(docs).collect():
        got[r.doc_id].append(r.text)
    for i, text in enumerate(texts):
        plan = planned[keys[i]]
        held = sorted(got.get(i, []), key=len, reverse=True)
        assert len(held) == plan.passes and sum(len(words(t)) for t in held) == plan.taken
        assert all(text.startswith(t) for t in held) and all(t == text for t in held[:-1])
    assert mixed_rows(docs).columns == docs.columns and mixed_rows(nothing).count() == 0


def test_repeated_rows_of_the_mix(spark, monkeypatch):
    """Equal rows, equal texts in two sources and under two languages: each source's budget is met to the word."""
    from filecover.llm import mixing

    monkeypatch.setattr(mixing, "TOGETHER", 2)
    texts = [" ".join(f"w{i}x{k}" for k in range(i % 9 + 2)) for i in range(12)]
    rows = [(i, t, "en", f"s{i % 2}", 0, "k", "s", 1, 1, "x", "r") for i, t in enumerate(texts)]
    rows += [rows[3]] * 9 + [rows[4]] * 4 + [(*rows[3][:2], "de", *rows[3][3:])] * 3 + [(*rows[5][:3], "s0", *rows[5][4:])] * 2 + [(None, "no id", "en", None, 0, "k", "s", 1, 1, "x", "r")] * 3
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    for share in (0.5, 1.5, 1.9):
        plan = mix(docs, share).collect()
        sizes, taken, given = defaultdict(int), defaultdict(int), defaultdict(int)
        for r in rows:
            sizes[r[3]] += len(words(r[1]))
        for r in plan:
            taken[r.source] += r.taken
        got = mixed_rows(docs, share=share).collect()
        for r in got:
            given[r.source] += len(words(r.text))
            assert any(t.startswith(r.text) and r.doc_id == i and r.source == s and r.lang == lang for i, t, lang, s, *_ in rows)
        targets = wanted(sizes, share, 2.0)
        assert dict(given) == {s: n for s, n in taken.items() if n}
        assert all(abs(given[s] - t) <= 1 for s, t in targets.items())
        # No row more often than twice its number, none of several equal ones left out where the whole source is taken.
        times = Counter((r.doc_id, r.lang, r.source) for r in got)
        number = Counter((r[0], r[2], r[3]) for r in rows)
        assert all(times[k] <= 2 * number[k] for k in times)
        assert Counter(map(tuple, mixed_rows(docs.repartition(5), share=share).collect())) == Counter(map(tuple, got))


def test_one_row_five_times(spark):
    rows = [(1, "a b c d e f g", "en", "s", 0, "k", "s", 1, 1, "x", "r")] * 5 + [(2, "h i j k l m n", "en", "s", 0, "k", "s", 1, 1, "x", "r")]
    got = mixed_rows(spark.createDataFrame(rows, COLUMNS), share=0.5).collect()
    assert sum(len(words(r.text)) for r in got) == 21
