"""Scans stored by match key: the same matches, and no shuffle of a destination."""

import random

import pytest

from filecover.operators.audit import Destination, audit, scan_index
from filecover.operators.key_index import KEY, STRETCH, index_sizes
from filecover.schemas import INDEX
from filecover.sources.bucketed import read_bucketed, write_bucketed
from filecover.workspace import Workspace

from test_audit import DAY, by_all_pairs, outcome, random_files
from test_skew import hot_table, no_broadcast, plan_of  # noqa: F401


def stored(spark, tmp_path, name, rows, exif=None, buckets=4):
    write_bucketed(scan_index(rows, exif), f"{tmp_path}/{name}", KEY, buckets)
    return read_bucketed(spark, f"{tmp_path}/{name}", INDEX, KEY, buckets)


@pytest.mark.parametrize("seed", range(3))
def test_against_the_rule(spark, manifest, tmp_path, seed):
    rng = random.Random(seed)
    window = [0, 2, 128][seed]
    spread = [20, 3 * STRETCH, 4 * STRETCH][seed]  # rows beside the edge of a stretch included
    source = random_files(rng, "s", 60, 8, 2, spread)
    dests = [(f"d{i}", "label", random_files(rng, f"d{i}_", rng.choice([9, 90]), 8, 2, spread)) for i in range(3)]
    given = [Destination(n, manifest(rows), index=stored(spark, tmp_path, n, manifest(rows))) for n, _, rows in dests]
    result = audit(manifest(source), given, window=window)
    assert result.by_index
    assert outcome(result) == by_all_pairs(source, dests, window)
    assert [r["found"] for r in result.tagged.collect()] and result.totals.first()["total_files"] == len(source)


def test_when_an_index_serves(spark, manifest, tmp_path):
    files = manifest([("a.jpg", 1, DAY)])
    dest = Destination("d", files, index=stored(spark, tmp_path, "d", files))
    assert audit(files, [dest]).by_index
    for dests, options in (([dest], {"window": 129}), ([dest], {"mtime_match": False}), ([dest, Destination("e", files)], {})):
        result = audit(files, dests, **options)
        assert not result.by_index and result.totals.first()["matched"] == 1
    assert audit(files, [dest], min_size=2).totals.first()["total_files"] == 0
    assert read_bucketed(spark, f"{tmp_path}/nothing", INDEX, KEY, 4) is None


def test_hot_key(spark, tmp_path):
    """A third of the source under one key: the rows are dealt out, and all of them match."""
    source = hot_table(spark)
    copy = source.where("size = 7").limit(1).selectExpr("'copy/same.txt' as path", "size", "mtime")
    result = audit(source, [Destination("d", copy, index=stored(spark, tmp_path, "d", copy))])
    assert result.totals.first()["matched"] == 10_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        from pyspark.sql import functions as F

        placed = result.tagged.where("size = 7").select("path", F.size("found"), F.spark_partition_id().alias("p"))
        assert placed.groupBy("p").count().agg(F.max("count")).first()[0] < 6000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_row_has_no_more_entries_than_seconds(spark, tmp_path):
    many = spark.range(5000).selectExpr("concat('d', id, '/same.jpg') as path", "bigint(7) as size", f"double({DAY} + id % 700) as mtime")
    index = scan_index(many)
    assert index.selectExpr("max(size(files))").first()[0] <= STRETCH
    assert index.selectExpr("sum(n)").first()[0] == 5000
    assert [tuple(r) for r in index_sizes([index]).collect()] == [(7, 5000)]


def test_audit_of_two_stored_scans(spark, tree, tmp_path, no_broadcast):  # noqa: F811
    """In a session that knows nothing of the tables yet, the destination is read bucketed and not exchanged."""
    files = {f"a/{i}.jpg": (b"x" * (i + 1), DAY + i) for i in range(30)}
    card, disk = tree("card", files), tree("disk", {f"old/{i}.JPG": (b"x" * (i + 1), DAY + i) for i in range(0, 30, 2)})
    work = Workspace.at(spark, str(tmp_path / "store"), buckets=4)
    work.scan(card, "card")
    work.scan(disk, "disk")
    other = Workspace.at(spark.newSession(), str(tmp_path / "store"), buckets=4)
    with other.audit("card", ["disk"]) as done:
        assert done.totals.first()["matched"] == 15 and done.matches.count() == 15
    dest = Destination("disk", other.store.files(2), index=other.store.index(2))
    plan = plan_of(audit(other.store.files(1), [dest]).matches)
    assert "Bucketed: true" in plan
    # Right of the merge join of common rows, the destination's scan has a sort above it and no exchange.
    lines = plan[: plan.index("\n\n\n")].split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    joins = [i for i, line in enumerate(lines) if "SortMergeJoin" in line and "LeftOuter" in line]
    sides = []
    for i in joins:
        end = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(lines[i])), len(lines))
        below = range(i + 1, end)
        right = max(j for j in below if depth(lines[j]) == depth(lines[i + 1]))
        sides.append([lines[j] for j in below if j >= right and "filecover_" in lines[j] or j >= right and "Exchange" in lines[j]])
    assert any(len(side) == 1 and "filecover_" in side[0] for side in sides), "\n".join(lines)
    assert work.store.index(99) is None
    assert Workspace.at(spark, str(tmp_path / "store"), buckets=8).store.index(2) is None
