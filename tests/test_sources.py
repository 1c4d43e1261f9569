import errno
import inspect
import os
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from filecover.sources.exif import read_exif
from filecover.sources.file_hash import hash_files
from filecover.sources.listing import entries_below, list_level, read_listing
from filecover.sources.lsl import read_lsl
from filecover.sources.manifest import read_manifest


def paths(frame):
    return sorted(r["path"] for r in frame.collect())


FILES = {
    "a/one.jpg": (b"12345", 1_600_000_000),
    "a/b/c/.hidden": b"x",
    "a/._one.jpg": b"x",
    ".Trashes/gone": b"x",
    "a/.DS_Store": b"x",
    "_under/two": b"xy",
    "top": b"",
    "a/café.txt": b"nfd",
}
KEPT = ["_under/two", "a/b/c/.hidden", "a/café.txt", "a/one.jpg", "top"]


def test_listing(spark, tree):
    root = tree("r", FILES)
    listed = read_listing(spark, root)
    assert paths(listed) == KEPT
    rows = {r["path"]: r for r in listed.collect()}
    assert rows["a/one.jpg"]["size"] == 5 and rows["a/one.jpg"]["mtime"] == 1_600_000_000.0
    assert rows["a/one.jpg"]["path_raw"] is None
    assert rows["a/café.txt"]["path_raw"] == "a/café.txt"


def test_listing_deals_out_one_heavy_branch(spark, tree):
    root = tree("r", {f"only/branch/d{i}/f": b"x" for i in range(40)})
    listed = read_listing(spark, root)
    assert listed.count() == 40
    # The level of the forty directories was read by all tasks.
    last = listed.select(F.input_file_name().alias("f")).where("f like '%/3/part%'").distinct()
    assert last.count() == 4


def test_listing_hands_on_batches(tree):
    root = tree("r", {f"f{i}": b"" for i in range(50)})
    entries = entries_below(root, "", True, None)
    assert next(entries)[1].startswith("f") and inspect.isgenerator(entries)


def failing(code):
    def fail(*_, **__):
        raise OSError(code, os.strerror(code))

    return fail


def test_listing_fails_loudly(tree, monkeypatch):
    root = tree("r", {"a/one": b"1"})
    monkeypatch.setattr(os, "scandir", failing(errno.EIO))
    with pytest.raises(OSError):
        list(entries_below(root, "a", True, None))
    monkeypatch.setattr(os, "scandir", failing(errno.EACCES))
    assert list(entries_below(root, "a", True, None)) == []
    with pytest.raises(OSError):  # not even the root may be read
        list(entries_below(root, "", True, None))


def test_a_worker_without_the_mount_fails(spark, tree):
    root = tree("r", {"a/one": b"1"})
    with pytest.raises(NotADirectoryError):
        next(list_level(iter(()), f"{root}/gone", True, None))
    files = read_listing(spark, root)
    for job in (hash_files(files, f"{root}/gone"), read_exif(files.withColumn("path", F.lit("a.jpg")), f"{root}/gone")):
        with pytest.raises(PySparkException):
            job.collect()


def test_links(spark, tree, tmp_path):
    root = tree("r", {"a/one": b"1"})
    os.symlink(f"{root}/a/one", f"{root}/linked_file")
    os.symlink(f"{root}/a", f"{root}/linked_dir")
    assert paths(read_listing(spark, root)) == ["a/one", "linked_file"]
    assert paths(read_listing(spark, root, links="false")) == ["a/one"]
    with pytest.raises(Exception, match="not a directory"):
        read_listing(spark, f"{root}/nothing").collect()


def test_listing_never_enters_the_source(spark, tree, tmp_path):
    root = tree("disk", {"card/a": b"1", "b": b"2"})
    assert paths(read_listing(spark, root, skip_root=f"{root}/card")) == ["b"]
    os.symlink(f"{root}/card", tmp_path / "back")
    assert paths(read_listing(spark, str(tmp_path / "back"), skip_root=f"{root}/card")) == []


LISTING = """\
       12 2020-01-01 00:00:00.500000000 a/with  two blanks .jpg

bad line
        x 2020-01-01 00:00:00.000000000 nosize
        7 yesterday noon nodate
        7 2020-01-01 00:00:00.000000000 System Volume Information/x
        7 2020-01-01 00:00:00.000000000
"""


def test_lsl(spark, tmp_path):
    (tmp_path / "list.txt").write_text(LISTING)
    rows = [tuple(r) for r in read_lsl(spark, str(tmp_path / "list.txt")).orderBy("path").collect()]
    assert rows == [("a/with  two blanks .jpg", None, 12, 1577836800.5), ("nodate", None, 7, 0.0)]


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, 1, 2.5)], "path string, path_raw string, size bigint, mtime double")
    for kind in ("parquet", "csv", "json"):
        writer = rows.write.option("header", True)
        getattr(writer, kind)(str(tmp_path / kind))
        assert [tuple(r) for r in read_manifest(spark, str(tmp_path / kind), kind).collect()] == [("a", None, 1, 2.5)]
    with pytest.raises(ValueError):
        read_manifest(spark, "x", "xml")


def test_tables_in_both_spellings(spark, tmp_path):
    (tmp_path / "m.csv").write_text("path;path_raw;size;mtime\ncafe\u0301.jpg;;5;1.0\n")
    got = read_manifest(spark, str(tmp_path / "m.csv"), "csv", sep=";").first()
    assert tuple(got) == ("caf\u00e9.jpg", "cafe\u0301.jpg", 5, 1.0)
    kept = spark.createDataFrame([("e\u0301", "given", 1, 2.0)], "path string, path_raw string, size bigint, mtime double")
    kept.write.parquet(str(tmp_path / "p"))
    assert tuple(read_manifest(spark, str(tmp_path / "p"), "parquet").first())[:2] == ("\u00e9", "given")
    with pytest.raises(ValueError, match="no option"):
        read_manifest(spark, str(tmp_path / "p"), "parquet", sep=";")


def test_hashes(spark, tree):
    import hashlib

    import xxhash

    root = tree("r", {"a": b"same head, one", "b": b"same head, two", "c": b""})
    files = read_listing(spark, root).unionByName(
        spark.createDataFrame([("gone", None, 3, 0.0)], "path string, path_raw string, size bigint, mtime double")
    )

    def digests(**options):
        return {r["path"]: r["fingerprint"] for r in hash_files(files, root, **options).collect()}

    assert digests(algo="md5") == {p: hashlib.md5(open(f"{root}/{p}", "rb").read()).hexdigest() for p in "abc"}
    assert digests()["a"] == xxhash.xxh64(b"same head, one").hexdigest()
    heads = digests(sample_size=8)
    assert heads["a"] == heads["b"] == xxhash.xxh64(b"same hea").hexdigest() != digests()["a"]
    with pytest.raises(ValueError):
        digests(algo="sha1")


def jpeg(make=None, model=None, date=None, order="<", before=b""):
    """A minimal JPEG whose APP1 segment holds the given texts."""
    sub = [(0x9003, date.encode() + b"\0")] if date is not None else []
    main = [(t, v.encode() + b"\0") for t, v in ((0x010F, make), (0x0110, model)) if v is not None]
    n_main = len(main) + bool(sub)
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    main_size, sub_size = 2 + 12 * n_main + 4, (2 + 12 * len(sub) + 4) if sub else 0
    heap_at, heap = 8 + main_size + sub_size, b""

    def entry(tag, value):
        nonlocal heap
        if len(value) <= 4:
            return struct.pack(order + "HHI", tag, 2, len(value)) + value.ljust(4, b"\0")
        heap += value
        return struct.pack(order + "HHII", tag, 2, len(value), heap_at + len(heap) - len(value))

    first = struct.pack(order + "H", n_main) + b"".join(entry(t, v) for t, v in main)
    if sub:
        first += struct.pack(order + "HHII", 0x8769, 4, 1, 8 + main_size)
    first += b"\0\0\0\0"
    second = struct.pack(order + "H", 1) + b"".join(entry(t, v) for t, v in sub) + b"\0\0\0\0" if sub else b""
    block = b"Exif\0\0" + head + first + second + heap
    return b"\xff\xd8" + before + b"\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xda\0\2pixels\xff\xd9"


APP0 = b"\xff\xe0\x00\x10JFIF\0\1\1\0\0\1\0\1\0\0"


def test_exif(spark, tree):
    taken, text = 1_572_768_359, "2019:11:03 08:05:59"
    whole = jpeg("Leica", "Q2", text)
    root = tree("r", {
        "whole.jpg": whole,
        "other_order.JPEG": jpeg("Leica", "Q2", text, order=">", before=APP0),
        "no_date.jpg": jpeg("Leica", "Q2"),
        "date_alone.jpg": jpeg(date=text),
        "nothing_left.jpg": jpeg(" \t", "\0"),
        "odd_date.jpe": jpeg("Ricoh", date="yesterday at noon"),
        "no_exif.jpg": b"\xff\xd8" + APP0 + b"\xff\xda\0\2pixels\xff\xd9",
        "not_looked_at.tif": whole,
        "nil.jpg": b"",
        "letters.jpg": b"GIF89a but not really",
        "segment_of_0.jpg": b"\xff\xd8\xff\xe1\0\0" + b"Exif\0\0" * 40,
        "segment_of_1.jpg": b"\xff\xd8\xff\xe0\0\1" + whole,
        "long_segment.jpg": b"\xff\xd8\xff\xe1\xff\xffExif\0\0II",
        **{f"front_{n}.jpg": whole[:n] for n in (1, 3, 5, 11, 17, 23, 31, 44)},
    })
    rows = {r["path"]: tuple(r)[1:] for r in read_exif(read_listing(spark, root), root).collect()}
    assert rows == {
        "whole.jpg": (taken, "Leica", "Q2"),
        "other_order.JPEG": (taken, "Leica", "Q2"),
        "no_date.jpg": (None, "Leica", "Q2"),
        "date_alone.jpg": (taken, None, None),
        "odd_date.jpe": (None, "Ricoh", None),
    }


def test_names_that_are_not_utf8(spark, tree):
    import hashlib

    from filecover.sources.listing import unescaped

    root = tree("r", {"a/one": b"1"})
    for name in (b"caf\xe9.txt", b"a/na\xefve/deep/\xff\xfe", b"e\xea\xcc\x81"):
        at = os.path.join(os.fsencode(root), name)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as f:
            f.write(name)
    files = read_listing(spark, root).cache()
    names = {os.fsencode(unescaped(r["path_raw"] or r["path"])) for r in files.collect()}
    assert names == {b"a/one", b"caf\xe9.txt", b"a/na\xefve/deep/\xff\xfe", b"e\xea\xcc\x81"}
    hashes = {r["fingerprint"] for r in hash_files(files, root, algo="md5").collect()}
    assert hashes == {hashlib.md5(x).hexdigest() for x in (names - {b"a/one"}) | {b"1"}}
