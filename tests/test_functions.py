import pytest
from pyspark.sql import functions as F

from filecover.functions import capture, paths, shares, sizes
from filecover.operators.filters import drop_metadata, exclude_matching, outside_root


@pytest.fixture
def apply(spark):
    def run(function, values, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]

    return run


SIZE_TEXTS = ["1K", "1KB", "8M", "1.5G", "2T", " 100k ", "0", "7b", "abc", "100Z", "", "1.K", "-1"]
SIZE_VALUES = [1024, 1024, 8 << 20, 1610612736, 2 << 40, 102400, 0, 7] + [None] * 5


def test_parse_size(apply):
    assert apply(sizes.parse_size, SIZE_TEXTS) == SIZE_VALUES
    for text, value in zip(SIZE_TEXTS, SIZE_VALUES):
        if value is None:
            with pytest.raises(ValueError):
                sizes.parse_size_text(text)
        else:
            assert sizes.parse_size_text(text) == value
    assert sizes.parse_size_text(12) == 12


def test_human_size(apply):
    values = [0, 1023, 1024, 1280, 1 << 20, (1 << 30) * 5 // 4, 1 << 50, 1 << 60]
    want = ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.0 MB", "1.2 GB", "1.0 PB", "1.0 EB"]
    assert apply(sizes.human_size, values, "bigint") == want


def test_names_and_folders(apply):
    values = ["a/B/İÉ.JPG", "plain", "x/ΣΑΣ", "a//b", "d/"]
    assert apply(paths.base_name_lower, values) == [v.rsplit("/", 1)[-1].lower() for v in values]
    assert apply(paths.parent_folder, values) == ["a/B", "(root)", "x", "a", "d"]


def test_whole_seconds(apply):
    assert apply(paths.whole_seconds, [1.9, -1.9, None, 0.0], "double") == [1, -1, 0, 0]


def test_nfc(apply):
    import unicodedata

    values = ["café/a", "ascii", "café", None, "가가"]
    assert apply(paths.nfc, values) == [v and unicodedata.normalize("NFC", v) for v in values]


def test_wants_exif(apply):
    yes = ["a.jpg", "A/b.JPEG", "x.y.jpe", "a/..b.jpg"]
    no = [".jpg", "a/.jpeg", "a.jpgx", "jpg", "a.jpg/b", "a.png", "a.jpg\n"]
    assert apply(paths.wants_exif, yes + no) == [True] * len(yes) + [False] * len(no)


def test_labels(apply):
    raw = "my\x07 disk​  1 \n"
    assert apply(paths.clean_label, [raw]) == ["my disk 1"] == [paths.clean_label_text(raw)]
    assert paths.default_label("/mnt/photos/") == "photos"
    assert paths.default_label("/") == "/"


def test_capture_text(apply):
    assert apply(capture.clean_text, ["   ", "\x00\x00", " SONY \x00", None]) == [None, None, "SONY", None]
    dates = ["2026:04:28 17:21:41", " 2026:04:28 17:21:41 ", "not-a-real-timestamp", "", None, "2026:13:01 00:00:00"]
    assert apply(capture.taken_at, dates) == [1777396901, 1777396901, None, None, None, None]


def test_percent(spark):
    row = spark.sql("select 0 as z, 3 as m, 4 as n").select(
        shares.percent(F.col("m"), F.col("n")), shares.percent(F.col("z"), F.col("z"))
    )
    assert tuple(row.first()) == (75.0, 0.0)


def test_metadata_filter(manifest):
    kept = ["real.jpg", "a/x.DS_Store", "a/.Trashesx/b", "Thumbs.db/inner.jpg", "desktop.INI"]
    dropped = [
        "._real.jpg", "a/.DS_Store", "Thumbs.db", ".Trashes/a", "a/$RECYCLE.BIN/b/c", "System Volume Information/x",
        "a/.fseventsd", "q/.VolumeIcon.icns",
    ]
    files = manifest([(p, 1, 0) for p in kept + dropped])
    assert {r["path"] for r in drop_metadata(files).collect()} == set(kept)


def test_exclude(manifest):
    files = manifest([("a/thumb_1.jpg", 1, 0), ("a/1.jpg", 1, 0)])
    assert exclude_matching(files, "").count() == 2
    assert [r["path"] for r in exclude_matching(files, r"thumb_\d").collect()] == ["a/1.jpg"]
    assert [r["path"] for r in exclude_matching(files, r"(?P<n>_)1\.jpg\Z").collect()] == ["a/1.jpg"]
    for refused in ("(", r"(a)(?(1)b|c)"):
        with pytest.raises(ValueError, match="regular expression|counterpart"):
            exclude_matching(files, refused)


def test_outside_root(manifest):
    files = manifest([("/m/a", 1, 0), ("/m/a/b", 1, 0), ("/m/ab", 1, 0)])
    assert [r["path"] for r in outside_root(files, F.col("path"), "/m/a/").collect()] == ["/m/ab"]


def test_nfc_works_in_bounded_pieces(spark):
    """Names of 6 MB in one batch, nulls among them; registered queries bound batches whatever the session allows."""
    import unicodedata

    import __spark_entry__ as driver
    from filecover.session import BATCH_BYTES, SETTINGS

    names = spark.range(3000).coalesce(1).selectExpr("id", "if(id % 7 = 0, null, concat(id, repeat('e\u0301', 700))) as v")
    got = names.select("v", paths.nfc(F.col("v")).alias("n")).collect()
    assert len(got) == 3000 and all(r.n == (r.v and unicodedata.normalize("NFC", r.v)) for r in got)
    spark.conf.set(BATCH_BYTES, "64m")
    assert driver.queries()["nfc_paths"](spark, "/root/testdata/sf0.001").count() and spark.conf.get(BATCH_BYTES) == SETTINGS[BATCH_BYTES]
