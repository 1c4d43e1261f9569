import random
from datetime import datetime, timedelta

import pytest

from filecover.operators import history
from filecover.operators.history import audit_changes, numbered_runs

RUNS = "id bigint, source_ident string, ran_at timestamp"
MISSING = "run_id bigint, source_path string, size bigint"


def made(seed, n=60):
    """Runs of a few sources, several a day, some at the same time; paths that come and go, with sizes of their own."""
    draw = random.Random(seed)
    day = datetime(2024, 1, 1)
    runs = [(i, draw.choice(["a", "a", "b", "c"]), day + timedelta(hours=draw.randrange(0, 200, 5))) for i in range(1, n + 1)]
    missing = [(i, f"p{k}", draw.randrange(5)) for i, *_ in runs for k in range(6) if draw.random() < (0.5 if k else 0.95)]
    return runs, missing


def expected(runs, missing):
    lists = {}
    for run, path, size in missing:
        lists.setdefault(run, {})[path] = size
    out = []
    for source in {s for _, s, _ in runs}:
        order = sorted((at, i) for i, s, at in runs if s == source)
        for (_, before), (_, now) in zip(order, order[1:]):
            old, new = lists.get(before, {}), lists.get(now, {})
            out += [(now, p, new[p], "newly_missing") for p in new.keys() - old.keys()]
            out += [(now, p, old[p], "newly_covered") for p in old.keys() - new.keys()]
    return sorted(out)


@pytest.mark.parametrize(("seed", "block"), [(1, 1024), (2, 1024), (3, 4), (4, 2), (5, 3)])
def test_changes_over_the_whole_history(spark, monkeypatch, seed, block):
    """Blocks of a few runs too, so that islands cross their edges."""
    monkeypatch.setattr(history, "BLOCK", block)
    runs, missing = made(seed)
    got = audit_changes(spark.createDataFrame(runs, RUNS), spark.createDataFrame(missing, MISSING))
    assert sorted(map(tuple, got.collect())) == expected(runs, missing)


def test_numbers(spark):
    runs, _ = made(9, 30)
    got = {r["run_id"]: (r["no"], r["next_id"]) for r in numbered_runs(spark.createDataFrame(runs, RUNS)).collect()}
    for source in "abc":
        order = [i for _, i in sorted((at, i) for i, s, at in runs if s == source)]
        assert [got[i] for i in order] == [(k + 1, order[k + 1] if k + 1 < len(order) else None) for k in range(len(order))]


def test_no_history(spark):
    none = spark.createDataFrame([], MISSING)
    assert audit_changes(spark.createDataFrame([], RUNS), none).count() == 0
    one = spark.createDataFrame([(1, "a", datetime(2024, 1, 1))], RUNS)
    assert audit_changes(one, spark.createDataFrame([(1, "p", 1), (7, "q", 1)], MISSING)).count() == 0


def test_missing_rows_are_shuffled_for_their_run_and_their_path(spark, tmp_path):
    from test_skew import plan_of

    runs, missing = made(1)
    spark.createDataFrame(missing, MISSING).write.parquet(str(tmp_path / "m"))
    plan = plan_of(audit_changes(spark.createDataFrame(runs, RUNS), spark.read.parquet(str(tmp_path / "m"))))
    tree = plan[: plan.index("\n\n\n")].split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(tree) if "Scan parquet" in line)
    level, above = depth(tree[at]), []
    for line in reversed(tree[:at]):
        if depth(line) < level:
            above.append(line)
            level = depth(line)
    assert sum("Exchange" in line for line in above) <= 2
