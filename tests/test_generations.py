import os

import pytest

from filecover.sources import generations, store
from filecover.workspace import Workspace


def table(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def test_the_newest_complete_one_counts(spark, tmp_path):
    uri = str(tmp_path / "t")
    assert generations.current(spark, uri) is None
    generations.replace(spark, uri, table(spark, 1))
    first = generations.current(spark, uri)
    generations.replace(spark, uri, spark.read.parquet(first).unionByName(table(spark, 2)))
    second = generations.current(spark, uri)
    assert sorted(r.v for r in spark.read.parquet(second).collect()) == [1, 2]
    # A writer that failed: no mark of success.
    os.makedirs(f"{uri}/gen-00000003")
    assert generations.current(spark, uri) == second
    generations.replace(spark, uri, table(spark, 5))
    assert generations.current(spark, uri).endswith("gen-00000004")
    # The one before stays for its readers; older and broken ones are gone.
    assert sorted(os.listdir(uri)) == ["gen-00000002", "gen-00000004"]

    with pytest.raises(Exception, match="boom|raise_error|USER_RAISED"):
        generations.replace(spark, uri, table(spark, 9).selectExpr("int(raise_error('boom')) as v"))
    assert [r.v for r in spark.read.parquet(generations.current(spark, uri)).collect()] == [5]


def test_ten_hash_jobs_leave_one_generation_to_read(spark, tree, tmp_path):
    root = tree("card", {"a": b"abc", "b": b"abc", "c": b"xyz"})
    work = Workspace.at(spark, str(tmp_path / "store"), buckets=2)
    work.scan(root, "card")
    for job in range(10):
        rows = spark.createDataFrame([(p, 3, f"{p}{job}") for p in "abc"], "path string, size bigint, fingerprint string")
        work.store.save_hashes(rows, 1, "md5", job % 3)
    hashes = work.store.hashes(1)
    folders = {os.path.basename(os.path.dirname(f)) for f in hashes.inputFiles()}
    assert len(folders) == 1 and len(os.listdir(tmp_path / "store" / "hashes" / "scan_id=1")) == 2
    # A row per path, algorithm and sample size, the newest.
    assert hashes.count() == 9 and hashes.select("path", "algo", "sample_size").distinct().count() == 9
    assert {r["fingerprint"] for r in hashes.where("sample_size = 0").collect()} <= {f"{p}{j}" for p in "abc" for j in (0, 3, 6, 9)}
    assert work.hash("card", sample_size=1, algo="md5")["hashed"] == 0


def test_registries_are_gathered(spark, tree, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "REGISTRY_FILES", 3)
    root = tree("card", {"a": b"1"})
    work = Workspace.at(spark, str(tmp_path / "store"), buckets=2)
    for _ in range(5):
        work.scan(root, "card")
    assert [r["id"] for r in work.store.scans.orderBy("id").collect()] == list(range(1, 6))
    assert len(work.store.scans.inputFiles()) <= 3
    assert work.store.latest("card")["id"] == 5


def test_a_listing_that_breaks_keeps_what_it_read(spark, tree, tmp_path, monkeypatch):
    """The first level is read, the second fails: rows and their number are stored, the scan stays unfinished."""
    from filecover.sources import listing

    root = tree("card", {"top.jpg": b"12", "a/one": b"1", "b/two": b"2"})
    work = Workspace.at(spark, str(tmp_path / "store"), buckets=2)
    whole = listing.list_level

    def breaking(batches, *args):
        def checked():
            for batch in batches:
                if batch.num_rows and batch.column("raw")[0].as_py():
                    raise OSError(5, "input/output error")
                yield batch

        return whole(checked(), *args)

    with monkeypatch.context() as broken:
        broken.setattr(listing, "list_level", breaking)
        with pytest.raises(Exception, match="input/output error"):
            work.scan(root, "card")
    row = work.store.scans.first()
    assert (row["label"], row["finished_at"], row["file_count"]) == ("card", None, 1)
    assert [r["path"] for r in work.store.files(row["id"]).collect()] == ["top.jpg"]
    assert work.store.latest("card") is None
    work.scan(root, "card")
    assert work.store.latest("card")["file_count"] == 3
