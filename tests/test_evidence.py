import pytest
from pyspark.sql import functions as F

from filecover.operators.audit import Destination, audit
from filecover.operators.evidence import classify, combine, conflicts, evidence, evidence_counts, pair_evidence

KEY = "struct<taken_at:bigint,camera_make:string,camera_model:string>"
T = 1_700_000_000
CASES = [
    (None, (T, "SONY", "A"), "weak"),
    ((T, "SONY", "A"), None, "weak"),
    ((T, "SONY", "A"), (T + 5, " sony ", "a"), "strong"),
    ((T, "SONY", "A"), (T + 6, "SONY", "A"), "conflict"),
    ((T, "SONY", "A"), (T, "GoPro", "A"), "conflict"),
    ((T, "SONY", "A"), (T, "SONY", "B"), "conflict"),
    ((T, None, ""), (T, "GoPro", "B"), "strong"),
    ((None, "SONY", "A"), (T, "SONY", "A"), "weak"),
    ((None, "SONY", None), (None, "GoPro", None), "conflict"),
]


def test_pairs(spark):
    rows = spark.createDataFrame([(i, s, d) for i, (s, d, _) in enumerate(CASES)], f"i int, s {KEY}, d {KEY}")
    kinds = rows.orderBy("i").select(classify(F.col("s"), F.col("d"))).collect()
    assert [r[0] for r in kinds] == [k for _, _, k in CASES]


@pytest.mark.parametrize("kinds, want", [
    (["strong", "conflict"], "strong"),
    (["conflict", "conflict"], "conflict"),
    (["weak", "conflict"], "weak"),
    ([], "weak"),
])
def test_combined(spark, kinds, want):
    rows = spark.createDataFrame([(k,) for k in kinds], "kind string")
    assert rows.agg(combine(F.col("kind"))).first()[0] == want


def test_evidence_never_moves_a_file(spark, manifest):
    """Two sources share name, size and time, one is the file backed up."""
    source = manifest([("a/1.jpg", 9, T), ("b/1.jpg", 9, T), ("c.mp4", 5, T), ("gone.jpg", 1, T)])
    result = audit(source, [Destination("d", manifest([("x/1.jpg", 9, T), ("c.mp4", 5, T)]))])
    fields = "taken_at bigint, camera_make string, camera_model string"
    source_exif = spark.createDataFrame([("a/1.jpg", T, "SONY", None), ("b/1.jpg", T, "GoPro", None)], f"path string, {fields}")
    dest_exif = spark.createDataFrame([("d", "x/1.jpg", T, "SONY", None)], f"dest string, path string, {fields}")
    kinds = evidence(pair_evidence(result.matches_with_exif(dest_exif), source_exif))
    assert {r["path"]: r["kind"] for r in kinds.collect()} == {"a/1.jpg": "strong", "b/1.jpg": "conflict", "c.mp4": "weak"}
    assert {r["kind"]: r["files"] for r in evidence_counts(kinds).collect()} == {"strong": 1, "weak": 1, "conflict": 1}
    assert [r["path"] for r in result.missing.collect()] == ["gone.jpg"]


def test_evidence_makes_its_scans_once(spark):
    """Matching and metadata read written scans: each derived its own from the lines before."""
    from filecover.plans import queries

    sf = "/root/testdata/sf0.001"
    for query in (queries.evidence, queries.evidence_conflicts):
        read = query(spark, sf).inputFiles()
        assert read and not any("lineitem" in file for file in read)


def test_copies_of_a_path_are_sorted_by_hash(spark):
    """Paths begin alike, and labels are the same: sorts that start with them compare whole strings."""
    import re

    from filecover.operators.dedup import unique_files

    rows = spark.createDataFrame([("a", "p", 2, 1), ("a", "p", 1, 9), ("b", "p", 3, 3), ("a", None, 1, 1), ("a", None, None, 5)], "label string, path string, size long, mtime long")
    found = unique_files(rows, ["label"])
    assert found.columns == ["label", "path", "size", "mtime"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("a", "p", 1, 9), ("b", "p", 3, 3), ("a", None, None, 5)], key=str)
    plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    leading = re.findall(r"Sort \[(\w+)", plan)
    assert leading and not {"label", "path"} & set(leading)


def test_conflicts_are_made_once_and_then_sorted(spark):
    """A sort samples what it deals out: everything below it, the joins too, ran twice before."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def kind(i):
        made.add(1)
        return ("conflict", "weak", "strong")[i % 3]

    path = F.format_string("%08x.jpg", F.hash("id"))
    rows = spark.range(3000).groupBy("id").agg(F.count("*").alias("n")).select(path.alias("path"), kind(F.col("id") + F.col("n")).alias("kind"))
    plain = rows.where("kind = 'conflict'").select("path")
    want = sorted(r["path"] for r in plain.collect())
    made.value = 0
    assert [r["path"] for r in conflicts(rows).collect()] == want
    assert made.value == 3000


def test_evidence_writes_its_scans_side_by_side(spark, monkeypatch):
    """Each scan is only written once all three are about to be; one after the other, the first waits in vain."""
    from threading import Barrier

    from filecover import scratch
    from filecover.plans import queries

    sf, at_once, made = "/root/testdata/sf0.001", Barrier(len(queries.CARD_SCANS)), scratch.new_folder

    def new_folder(session, purpose):
        at_once.wait(timeout=60)
        return made(session, purpose)

    want = sorted(r["path"] for r in queries.evidence_conflicts(spark, sf).collect())
    monkeypatch.setattr(scratch, "new_folder", new_folder)
    assert [r["path"] for r in queries.evidence_conflicts(spark, sf).collect()] == want
