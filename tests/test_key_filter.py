import re

import pytest
from pyspark.sql import functions as F

from filecover.operators.audit import Destination, audit
from filecover.operators.key_filter import key_filter, may_hold

from test_skew import plan_of

KEYS = ["size", "bn"]


def rows(spark, n, step=1):
    return spark.range(0, n * step, step).selectExpr("id as size", "concat('f', id % 7) as bn")


def test_no_partner_is_lost_and_few_others_stay(spark):
    found = key_filter(rows(spark, 3000, 100), KEYS, 1 << 20)
    kept = may_hold(rows(spark, 300_000), found, KEYS, 1 << 20)
    assert kept.columns == ["size", "bn"]
    assert kept.join(rows(spark, 3000, 100), KEYS).count() == 3000
    assert kept.count() < 3000 + 300_000 * 3000 / (1 << 20) * 1.5


def test_size_of_what_is_broadcast(spark):
    found = key_filter(rows(spark, 200_000), KEYS, 1 << 16)
    assert found.count() == 2  # however many keys
    assert may_hold(rows(spark, 1000), found, KEYS, 1 << 16).count() == 1000  # a full filter lets everything pass
    for bits in (1000, 1 << 31):
        with pytest.raises(ValueError, match="bits"):
            key_filter(rows(spark, 1), KEYS, bits)


def test_empty_and_unknown_keys(spark):
    some = spark.createDataFrame([(None, "a"), (1, None), (None, None), (2, "b")], "size bigint, bn string")
    assert may_hold(some, key_filter(some, KEYS), KEYS).count() == 4
    assert may_hold(some, key_filter(some.where("false"), KEYS), KEYS).count() == 0


def files(spark, folder, n, step):
    return spark.range(0, n, step).selectExpr(f"concat('{folder}/', id % 50, '/img', id, '.jpg') as path", "id % 5000 as size", "double(1700000000 + id) as mtime")


def test_destination_rows_without_a_partner_are_not_shuffled(spark, tmp_path):
    """The destination has fifty times the rows of the source; under a tenth of them get to the first exchange."""
    files(spark, "a", 60_000, 1).write.parquet(str(tmp_path / "dest"))
    dest, source = spark.read.parquet(str(tmp_path / "dest")), files(spark, "s", 60_000, 50)
    pruned = audit(source, [Destination("d", dest)])
    whole = audit(source, [Destination("d", dest)], prune=False)
    assert pruned._dest_rows.count() < dest.count() / 10 < whole._dest_rows.count()
    got = lambda a: sorted(map(tuple, a.matches.select("path", "dest_path").collect()))
    assert got(pruned) == got(whole) and len(got(pruned)) == 1200
    plan = plan_of(pruned.keys)
    tree = plan[: plan.index("(1)")]
    # From the scan of the destination upwards, the filter stands before any exchange.
    assert re.search(r"BroadcastHashJoin", tree) and tree.index("BroadcastHashJoin") > tree.index("Exchange")


def test_sizes_of_another_type(spark):
    source = spark.createDataFrame([("a/x.jpg", 7, 5.0)], "path string, size int, mtime double")
    dest = spark.createDataFrame([("b/x.jpg", 7, 5.0)], "path string, size bigint, mtime double")
    assert audit(source, [Destination("d", dest)]).matches.count() == 1
    assert audit(dest, [Destination("d", source)]).matches.select(F.col("dest_path")).first()[0] == "a/x.jpg"


def test_words_stand_in_order_without_lookups(spark):
    """Blocks with few, many and all of their words; the words of a block came from a search in a map apiece before."""
    from filecover.operators.key_filter import WORDS, _place, key_filter

    bits = 64 * WORDS * 4
    rows = spark.range(5).union(spark.range(200_000).where("id % 7 = 0"))
    found = key_filter(rows, ["id"], bits)
    want = {}
    for row in rows.select(_place(["id"], bits).alias("at")).distinct().collect():
        block = want.setdefault(row.at // (64 * WORDS), [0] * WORDS)
        block[row.at // 64 % WORDS] |= 1 << row.at % 64
    got = {r[0]: [w % (1 << 64) for w in r[1]] for r in found.collect()}
    assert got == want
    one = key_filter(spark.range(1), ["id"], bits).collect()
    assert len(one) == 1 and len(one[0][1]) == WORDS and sum(w != 0 for w in one[0][1]) == 1
    assert "map_from_entries" not in found._jdf.queryExecution().analyzed().toString()
