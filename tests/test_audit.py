import random

import pytest

from filecover.operators.audit import (
    Destination,
    audit,
    locations,
    missing_folders,
    per_dest_of_folders,
    totals_of_folders,
)
from filecover.operators.rollup import by_folder

HOUR = 3600
DAY = 1_700_000_000


def outcome(result):
    matches = {(r["path"], r["dest"]): r["dest_path"] for r in result.matches.collect()}
    return matches, {r["path"] for r in result.missing.collect()}


def test_time_takes_part(manifest):
    source = manifest([("DCIM/100/IMG_0412.MP4", 100, DAY)])
    other = [Destination("b", manifest([("OldShoot/IMG_0412.MP4", 100, DAY + HOUR)]))]
    assert outcome(audit(source, other)) == ({}, {"DCIM/100/IMG_0412.MP4"})
    assert outcome(audit(source, other, mtime_match=False))[1] == set()


def test_only_the_older_is_backed_up(manifest):
    source = manifest([("shoot_a/IMG_0001.jpg", 9, DAY + HOUR), ("shoot_b/IMG_0001.jpg", 9, DAY)])
    result = audit(source, [Destination("b", manifest([("x/IMG_0001.jpg", 9, DAY + 1)]))])
    assert outcome(result)[1] == {"shoot_a/IMG_0001.jpg"}


def test_two_destinations_each_cover_part(manifest):
    source = manifest([("a.jpg", 1, DAY), ("b.jpg", 2, DAY), ("c.jpg", 3, DAY)])
    dests = [
        Destination("one", manifest([("A.JPG", 1, DAY)])),
        Destination("two", manifest([("b.jpg", 2, DAY), ("z/c.jpg", 3, DAY + 2)])),
        Destination("none", manifest([("._c.jpg", 3, DAY)])),
    ]
    result = audit(source, dests)
    assert [(r["dest"], r["matched"]) for r in result.per_dest.orderBy("ord").collect()] == [
        ("one", 1), ("two", 2), ("none", 0),
    ]
    totals = result.totals.first()
    assert (totals["total_files"], totals["total_bytes"], totals["matched"], totals["missing"]) == (3, 6, 3, 0)
    assert totals["percent"] == 100.0


def test_empty_source(manifest):
    empty = manifest([("a", 1, 0)]).where("false")
    totals = audit(empty, [Destination("one", empty)]).totals.first()
    assert tuple(totals) == (0, 0, 0, 0, 0, 0.0)


def test_exclude_and_min_size_reach_the_right_sides(manifest):
    source = manifest([("a.jpg", 10, DAY), ("tmp/a.jpg", 10, DAY), ("b.jpg", 3, DAY)])
    copies = manifest([("tmp/a.jpg", 10, DAY), ("b.jpg", 3, DAY)])
    stored = audit(source, [Destination("s", copies)], exclude="^tmp/", min_size=5)
    assert outcome(stored) == ({("a.jpg", "s"): "tmp/a.jpg"}, set())
    listed = audit(source, [Destination("s", copies, "path")], exclude="^tmp/", min_size=5)
    assert outcome(listed) == ({}, {"a.jpg"})


def test_destination_inside_the_source(manifest):
    files = manifest([("x/a.jpg", 10, DAY), ("card/a.jpg", 10, DAY)])
    source = manifest([("a.jpg", 10, DAY)])
    result = audit(source, [Destination("d", files, "path", "/mnt")], source_root="/mnt/card")
    assert outcome(result) == ({("a.jpg", "d"): "x/a.jpg"}, set())
    assert outcome(audit(source, [Destination("d", files, "path", "/mnt")], source_root="/mnt"))[0] == {}


def test_refusals(manifest):
    files = manifest([("a", 1, 0)])
    for dests in ([], [Destination("x", files), Destination("x", files)]):
        with pytest.raises(ValueError):
            audit(files, dests)
    with pytest.raises(ValueError):
        by_folder(files, order="date")


def test_every_destination_row_counts(manifest):
    """The only copy is the last of a hundred times as many files as the source has."""
    source = manifest([("a.jpg", 1, DAY), ("b.jpg", 2, DAY)])
    copies = manifest([*[(f"b/other{i:03d}.jpg", 5, DAY) for i in range(199)], ("z/b.jpg", 2, DAY)])
    both = [Destination("one", copies, "path"), Destination("two", copies, "path")]
    assert [r["matched"] for r in audit(source, both).per_dest.orderBy("ord").collect()] == [1, 1]


def random_files(rng, folder, n, names, sizes, spread):
    rows = {}
    for _ in range(n):
        path = f"{folder}{rng.randrange(4)}/{'IMG' if rng.random() < 0.5 else 'img'}{rng.randrange(names)}.jpg"
        rows[path] = (path, rng.randrange(sizes), DAY + rng.randrange(spread))
    return list(rows.values())


def by_all_pairs(source, dests, window):
    """The rule as it reads: of a destination's rows of equal size and name, near in time, the earliest and first."""
    base = lambda path: path.rsplit("/", 1)[-1].lower()
    matches = {}
    for path, size, at in source:
        for name, _, rows in dests:
            near = [(t if window is not None else 0, p) for p, n, t in rows
                    if (n, base(p)) == (size, base(path)) and (window is None or abs(t - at) <= window)]
            if near:
                matches[path, name] = min(near)[1]
    return matches, {p for p, _, _ in source} - {p for p, _ in matches}


@pytest.mark.parametrize("seed", range(6))
def test_against_the_rule(manifest, seed):
    rng = random.Random(seed)
    window = rng.choice([0, 1, 2, 7, None])
    source = random_files(rng, "s", 40, 12, 2, 20)
    dests = [
        (f"d{i}", rng.choice(["path", "label"]), random_files(rng, f"d{i}_", rng.choice([5, 60]), 12, 2, 20))
        for i in range(3)
    ]
    options = {"mtime_match": window is not None, "window": window or 0}
    want = by_all_pairs(source, dests, window)
    given = [Destination(n, manifest(rows), kind) for n, kind, rows in dests]
    exact = audit(manifest(source), given, **options)
    matches, missing = outcome(exact)
    assert (matches, missing) == want
    totals = exact.totals.first()
    assert totals["matched"] + totals["missing"] == totals["total_files"] == len(source)
    assert totals["missing"] == len(missing)
    found = {r["path"]: [x["dest"] for x in r["found"]] for r in locations(exact.tagged, given).collect()}
    assert found == {p: sorted(d for q, d in matches if q == p) for p, _ in matches}


def test_by_folder(manifest):
    rows = [(f"b/{i}.jpg", 1, 0) for i in range(7)] + [("top.jpg", 50, 0), ("a/x.jpg", 2, 0)]
    got = [tuple(r) for r in by_folder(manifest(rows)).collect()]
    assert got == [
        ("(root)", 1, 50, ["top.jpg"], 0),
        ("a", 1, 2, ["a/x.jpg"], 0),
        ("b", 7, 7, [f"b/{i}.jpg" for i in range(5)], 2),
    ]
    assert [r["folder"] for r in by_folder(manifest(rows), order="bytes").collect()] == ["(root)", "b", "a"]


def test_folder_counts_hold_every_roll_up(manifest):
    source = manifest([*[(f"b/{i}.jpg", i, DAY) for i in range(1, 10)], ("top.jpg", 50, DAY)])
    dests = [Destination("one", manifest([("x/2.jpg", 2, DAY)])), Destination("two", manifest([("x/2.jpg", 2, DAY), ("top.jpg", 50, DAY)]))]
    result = audit(source, dests)
    assert totals_of_folders(result.folders).first() == result.totals.first()
    rows = lambda f: sorted(map(tuple, f.collect()))
    assert rows(per_dest_of_folders(result.folders, dests)) == rows(result.per_dest)
    want = by_folder(result.missing, sort=False)
    assert rows(missing_folders(result.folders)) == rows(want.select("folder", "files", "bytes", "sample", "more"))


def test_wide_window_is_no_slower(manifest, spark):
    """20,000 equal names over a day: two hours of reach take about as long as two seconds."""
    import time

    files = spark.range(20_000).selectExpr("concat('d', id, '/same.jpg') as path", "7 as size", f"{DAY} + id * 4 as mtime").cache()
    files.count()

    def seconds(window):
        start = time.perf_counter()
        audit(files, [Destination("d", files)], window=window).matches.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds(2)
    narrow, wide = (min(seconds(w) for _ in range(2)) for w in (2, 7200))
    assert wide < 1.5 * narrow + 1


def test_copy_outcome_has_one_row_per_planned_file(spark):
    """Paths listed twice (two spellings of a name), and two runs with other destinations."""
    from filecover.operators.copy_plan import copy_outcome

    plan = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (1, "c", 5), (2, "a", 5), (1, "d", None)], "run_id bigint, path string, size bigint")
    listed = [(1, "a", 5), (1, "a", 6), (1, "b", 6), (1, "b", 7), (2, "a", 5), (2, "a", 5), (1, "d", 3)]
    got = copy_outcome(plan, spark.createDataFrame(listed, "run_id bigint, path string, size bigint"))
    assert sorted((r["run_id"], r["path"], r["outcome"], r["reason"]) for r in got.collect()) == [
        (1, "a", "succeeded", None), (1, "b", "failed", "size differs on destination"), (1, "c", "failed", "not on destination"),
        (1, "d", "failed", "size differs on destination"), (2, "a", "succeeded", None),
    ]
    one = copy_outcome(plan.where("run_id = 1"), spark.createDataFrame([("a", 5), ("a", 9)], "path string, size bigint"))
    assert [r["outcome"] for r in one.orderBy("path").collect()] == ["succeeded", "failed", "failed", "failed"]
