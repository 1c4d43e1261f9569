"""Hot keys: results stay whole, and no task gets a hot key to itself."""

import re

import pytest
from pyspark.sql import functions as F

from filecover.operators.audit import Destination, audit
from filecover.operators.fingerprint import candidates, duplicate_pairs
from filecover.operators.skew import SALT, Spread, hot_keys, skew_join


def hot_table(spark, n=30_000):
    """A third of the rows share one key; the others have keys of their own."""
    return spark.range(n).select(
        F.concat(F.lit("f/"), F.col("id").cast("string"), F.lit("/same.txt")).alias("path"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 100).cast("bigint").alias("size"),
        F.lit(1_700_000_000.0).alias("mtime"),
    )


def test_hot_keys_are_few_and_proportional(spark):
    hot = hot_keys(hot_table(spark), ["size"]).collect()
    assert [tuple(r) for r in hot] == [(7, 342)]


def test_no_rows_no_hot_keys(spark):
    empty = hot_table(spark).where("size < 0")
    assert hot_keys(empty, ["size"]).count() == 0
    assert skew_join(empty, hot_table(spark).select("size").distinct(), ["size"], "inner", by=["path"]).count() == 0


def test_small_tables_take_the_same_path(spark):
    few = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "size bigint, path string")
    assert sorted(map(tuple, hot_keys(few, ["size"]).collect())) == [(1, 2), (2, 1)]  # no more pieces than rows
    assert skew_join(few, few.select("size").distinct(), ["size"], "inner", by=["path"]).count() == 3


def test_rows_of_a_hot_key_are_dealt_out(spark):
    rows = hot_table(spark)
    spread = Spread(rows, ["size"])
    largest = spread.deal(rows, ["path"]).groupBy("size", SALT).count().agg(F.max("count")).first()[0]
    assert largest < 80
    # The other side grows by the number of pieces, not by a factor.
    assert spread.replicate(rows.select("size").distinct()).count() < 20_001 + 400


def test_unknown_keys_are_dealt_out_too(spark):
    rows = spark.range(5000).selectExpr("concat('p', id) as path", "if(id % 2 = 0, null, id) as size")
    assert Spread(rows, ["size"]).deal(rows, ["path"]).groupBy("size", SALT).count().agg(F.max("count")).first()[0] < 60


def test_skew_join_is_an_ordinary_join(spark):
    rows = hot_table(spark)
    few = rows.select("size").distinct().where("size = 7 or size % 2 = 0").withColumn("note", F.lit("x"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = skew_join(rows, few, ["size"], how, by=["path"])
        want = rows.join(few, "size", how)
        assert got.count() == want.count()
        assert got.select(*sorted(want.columns)).exceptAll(want.select(*sorted(want.columns))).count() == 0


def test_sides_of_unlike_types(spark):
    rows = hot_table(spark)
    few = rows.where("size = 7").select(F.col("size").cast("int").alias("size")).distinct()
    assert skew_join(rows, few, ["size"], "inner", by=["path"]).count() == 10_000


def test_audit_of_many_equal_files(spark):
    source = hot_table(spark).where("size = 7")
    copy = source.limit(1).withColumn("path", F.lit("copy/same.txt"))
    result = audit(source, [Destination("d", copy)])
    assert result.totals.first()["matched"] == 10_000
    assert result.missing.count() == 0
    assert result.matches.where("dest_path = 'copy/same.txt'").count() == 10_000


def test_candidates_and_pairs_stay_linear(spark):
    rows = hot_table(spark)
    assert candidates(rows).count() == 10_000
    prints = rows.select(
        "path", "size", F.md5(F.col("size").cast("string")).alias("fingerprint"),
        F.lit("md5").alias("algo"), F.lit(0).cast("bigint").alias("sample_size"),
    )
    pairs = duplicate_pairs(prints)
    assert pairs.count() == 9_999 and pairs.select("path_a").distinct().count() == 1


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are for tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(frame):
    return frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_plans_have_no_cross_join_and_few_shuffles(spark, tmp_path, no_broadcast):
    hot_table(spark).write.parquet(str(tmp_path / "m"))
    files = spark.read.parquet(str(tmp_path / "m"))
    result = audit(files, [Destination("a", files), Destination("b", files)], min_size=5)
    for frame in (result.matches, result.missing, result.totals, result.coverage):
        plan = plan_of(frame)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert "GreaterThanOrEqual(size,5)" in plan
        assert plan.count("SortMergeJoin") == 0


def test_roll_ups_match_once(spark, tmp_path, no_broadcast):
    from filecover.operators.audit import missing_folders

    hot_table(spark).write.parquet(str(tmp_path / "m"))
    files = spark.read.parquet(str(tmp_path / "m"))
    half = files.where("size % 2 = 0")
    result = audit(files, [Destination("a", half), Destination("b", half)])
    assert _windows(result.missing) == 1 and _windows(result.totals) == 1
    # Counts and names come from one exchange of the matching pass. Names are limited before they are shuffled, counts aggregated.
    folders = missing_folders(result.folders)
    folders.collect()
    tree = re.split(r"^\+- == Initial Plan ==", folders._jdf.queryExecution().executedPlan().toString(), flags=re.M)[0]
    assert len(re.findall(r"[+:]- Exchange hashpartitioning\([^\n]*__salt", tree)) == 1 and "ReusedExchange" in tree
    ranked = tree[tree.index("WindowGroupLimit") :]
    assert "Final" in ranked.split("\n")[0] and re.search(r"Exchange hashpartitioning\(folder.*?WindowGroupLimit[^\n]*Partial", ranked, re.S)
    assert "partial_count" in tree


def _windows(frame):
    return len(re.findall(r"^\(\d+\) Window", plan_of(frame), re.M))


def test_largest_task_of_a_hot_key(spark):
    """A third of the source shares name, size and time; no partition of the matching pass has more than a small part."""
    source = hot_table(spark)
    tagged = audit(source, [Destination("d", source.limit(1))]).tagged
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        placed = tagged.select("found", F.spark_partition_id().alias("p")).where(F.size("found") < 2)
        rows = placed.groupBy("p").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows < 3 * 30_000 / 64
