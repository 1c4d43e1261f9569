import random

import pytest
from pyspark.sql import functions as F

from filecover.operators.deal import deal_by_work, parts_by_work


def shares(rows, parts):
    dealt = parts_by_work(rows, ["path"], F.col("size"), parts)
    return {r["part"]: (r["work"], r["n"]) for r in dealt.groupBy("part").agg(F.sum("size").alias("work"), F.count("*").alias("n")).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_no_task_has_much_more_than_its_share(spark, seed):
    """Sizes over six orders of magnitude: at most twice the mean, or one file."""
    draw = random.Random(seed)
    sizes = [int(10 ** draw.uniform(0, 6)) for _ in range(3000)] + [10**7] * draw.choice([0, 2])
    rows = spark.createDataFrame([(f"p{i}", s) for i, s in enumerate(sizes)], "path string, size bigint").repartition(5)
    for parts in (3, 16):
        got = shares(rows, parts)
        mean = sum(sizes) / parts
        assert sum(n for _, n in got.values()) == len(sizes) and set(got) <= set(range(2 * parts))
        assert all(n == 1 or work <= 2 * mean for work, n in got.values())


def test_odd_work(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 0), ("c", None)], "path string, size bigint")
    assert sum(n for _, n in shares(rows, 4).values()) == 3
    assert shares(rows.where("false"), 4) == {}
    one = spark.createDataFrame([("a", 5)], "path string, size bigint")
    assert shares(one, 4) == {4: (5, 1)}


def test_partitions_are_the_parts(spark):
    rows = spark.range(1000).selectExpr("concat('p', id) as path", "id % 100 as size")
    dealt = deal_by_work(rows, ["path"], F.col("size"), 4)
    assert dealt.columns == ["path", "size"] and dealt.rdd.getNumPartitions() == 8
    work = [r["w"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("size").alias("w")).collect()]
    assert sum(work) == 49_500 and max(work) <= 2 * 49_500 / 4
