"""The jobs of a user, on real trees and stored tables."""

import pytest
from test_sources import jpeg

from filecover.workspace import Workspace

T = 1_700_000_000


@pytest.fixture
def work(spark, tmp_path):
    return Workspace.at(spark, str(tmp_path / "store"))


def test_scan_audit_report_and_copy_plan(work, tree, tmp_path):
    shot = jpeg("SONY", "A", "2026:04:28 17:21:41")
    card = tree("card", {"a/1.jpg": (shot, T), "a/2.mp4": (b"22", T), "b/3.jpg": (b"333", T), "._x": b"x"})
    disk = tree("disk", {"old/1.JPG": (shot, T + 2), "other": (b"9", T)})
    loose = tree("loose", {"2.mp4": (b"22", T)})
    assert work.scan(card, "card\x07", exif=True) == 1
    assert work.scan(disk, exif=True, drive_type="hdd") == 2
    assert {r["label"]: r["file_count"] for r in work.labels().collect()} == {"card": 3, "disk": 2}

    done = work.audit("card", ["disk", loose], min_size="1")
    row, missing = work.stored_audit(done.run_id)
    assert (row["total_files"], row["matched_count"], row["missing_count"], row["missing_bytes"]) == (3, 2, 1, 3)
    assert row["per_dest_match"] == {"disk": 1, loose: 1}
    assert [s["kind"] for s in row["dest_specs"]] == ["label", "path"]
    assert [tuple(r) for r in missing.collect()] == [("b/3.jpg", 3, "3 B")]
    assert {r["path"]: r["kind"] for r in done.evidence.collect()} == {"a/1.jpg": "strong", "a/2.mp4": "weak"}
    assert done.totals.first()["percent"] == pytest.approx(200 / 3)
    done.write_report(str(tmp_path / "report"))
    sections = {r["section"]: r["count"] for r in work.spark.read.json(str(tmp_path / "report")).groupBy("section").count().collect()}
    assert sections == {"totals": 1, "dest": 2, "folder": 1, "missing": 1, "match": 2, "evidence": 2}

    with pytest.raises(ValueError, match="several destinations"):
        work.copy_plan(done.run_id)
    with pytest.raises(ValueError, match="no such destination"):
        work.copy_plan(done.run_id, "tape")
    with pytest.raises(ValueError, match="no audit run"):
        work.copy_plan(99)
    plan = [tuple(r) for r in work.copy_plan(done.run_id, "disk").collect()]
    assert plan == [(1, "b/3.jpg", 3, f"{card}/b/3.jpg", f"{disk}/b/3.jpg")]
    assert work.copy_plan(done.run_id, loose).first()["dest_path"] == f"{loose}/b/3.jpg"

    scans, audits = work.status()
    assert [r["state"] for r in scans.collect()] == ["done", "done"]
    assert audits.first()["destinations"] == f"disk, {loose}"


def test_source_equals_destination(work, tree):
    root = tree("card", {"a": b"1"})
    work.scan(root, "card")
    run = work.audit("card", [root]).run_id
    # The destination is the source itself, so nothing there counts as a copy.
    assert work.stored_audit(run)[0]["matched_count"] == 0
    with pytest.raises(ValueError, match="the same"):
        work.copy_plan(run)


def test_targets(work, tree, monkeypatch, tmp_path):
    root = tree("card", {"a": b"1"})
    work.scan(root, "card")
    assert work.resolve("card").kind == "label"
    assert work.resolve(root).kind == "path"
    tree("plain", {"a": b"1"})
    monkeypatch.chdir(tmp_path)
    assert work.resolve("plain").kind == "path"
    for ident in ("nothing", "/no/such/place"):
        with pytest.raises(ValueError):
            work.resolve(ident)
    with pytest.raises(ValueError):
        work.audit("card", [])


def test_incomplete_scan_is_never_used(work, tree, monkeypatch):
    root = tree("card", {"a": b"1"})
    work.scan(root, "card")
    assert work.scan(root, "card", incremental=True) == 2
    row = work.store.latest("card")
    assert (row["id"], row["scan_mode"], row["parent_scan_id"]) == (2, "incremental", 1)

    def fail(*_):
        raise RuntimeError("listing broke")

    with monkeypatch.context() as broken:
        broken.setattr(type(work.store), "_append_files", fail)
        with pytest.raises(RuntimeError):
            work.scan(root, "card")
    assert work.store.scans.where("id = 3").first()["finished_at"] is None
    assert work.store.latest("card")["id"] == 2
    assert work.store.latest("card", "full")["id"] == 1


def test_hash_resume_and_duplicates(work, tree):
    root = tree("card", {"a": b"abc", "b": b"abc", "c": b"longer text"})
    work.scan(root, "card")
    first = work.hash("card")
    assert (first["candidates"], first["skipped"], first["hashed"], first["bytes_read"]) == (2, 0, 2, 6)
    again = work.hash("card")
    assert (again["hashed"], again["skipped"]) == (0, 2)
    assert work.hash("card", only_collisions=False, sample_size=2)["bytes_read"] == 6
    assert work.hash("card", resume=False)["hashed"] == 2
    pairs = {(r["path_a"], r["path_b"], r["sample_size"], r["confidence"]) for r in work.duplicates("card").collect()}
    assert pairs == {("a", "b", 0, "certain"), ("a", "b", 2, "tentative")}
    with pytest.raises(ValueError):
        work.hash("nobody")


def test_compare(work, tree):
    work.scan(tree("a", {"same": b"1", "x": b"12", "only": b"123"}), "a")
    work.scan(tree("b", {"same": b"1", "x": b"1", "more": b"1234"}), "b")
    states = {r["path"]: r["state"] for r in work.compare("a", "b").collect()}
    assert states == {"same": "match", "x": "differ", "only": "only_a", "more": "only_b"}
    assert {r["path"] for r in work.compare("a", "b", min_size=2).collect()} == {"x", "only", "more"}
    for a, b in (("a", "a"), ("a", "nobody")):
        with pytest.raises(ValueError):
            work.compare(a, b)
