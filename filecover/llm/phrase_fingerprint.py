"""Lempel-Ziv phrase fingerprints: how well two texts would compress together.

A text is parsed into phrases: each is the longest one seen before plus one character. The hashes of
the distinct phrases are a set, and its `size` least hashes are the fingerprint. The share of the least
hashes of both together that both hold estimates the likeness of the phrase sets, which is high where
one text's dictionary serves the other.

Each text is also compared with its successor in descending id order and with its edited text (its end replaced by the
successor's beginning). Texts are dealt into ranges of ids, whose bounds come from the id column alone. A bound
is an id that occurs, so the row after a range's last is known beforehand: it goes to both ranges. A range is
parsed in order, one text at a time; the front of a text and of its edited text is parsed once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bounds, shuffle_parts, texts

#: Hashes in a fingerprint, 32 bits each.
SIZE = 64
UNKNOWN = -(1 << 63)
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def parse(text: str, start: int, end: int, seen: set[str]) -> tuple[int, list[str]]:
    """Parse text[start:end] into phrases not in `seen`, which takes them up. Where the unfinished last phrase starts."""
    new: list[str] = []
    take, add = new.append, seen.add
    length = 4
    while True:
        # All fronts of a phrase were seen before it, so the first new one is found from any guess: that of the last phrase.
        stop = start + length
        if stop > end:
            stop = end
            if text[start:end] in seen or start == end:
                break
        if text[start:stop] in seen:
            stop += 1
            while stop <= end and text[start:stop] in seen:
                stop += 1
            if stop > end:
                break
        else:
            while stop - 1 > start and text[start : stop - 1] not in seen:
                stop -= 1
        phrase = text[start:stop]
        add(phrase)
        take(phrase)
        length = stop - start
        start = stop
    return start, new


def hashed(phrases: list[str]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return (np.fromiter(map(digest, phrases), np.uint64, len(phrases)) >> np.uint64(32)).astype(np.uint32)


def least(*parts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The `size` least distinct hashes, in order."""
    return np.unique(np.concatenate(parts))[:size]


def likeness(left: np.ndarray, right: np.ndarray, size: int = SIZE) -> float:
    """Share of the `size` least hashes of both together that both hold; 1 for two empty texts."""
    both = np.concatenate([left, right])
    both.sort()
    twice = both[1:][both[1:] == both[:-1]]
    union = len(both) - len(twice)
    if not union:
        return 1.0
    if union > size:
        limit = np.unique(both)[size - 1]
        twice = twice[twice <= limit]
    return len(twice) / min(union, size)


class Parsed:
    """A text with its fingerprint, and its parse as far as its edited text shares it."""

    def __init__(self, text: str, size: int):
        self.text, self.size = text, size
        self.keep = len(text) - len(text) // 2
        self.seen: set[str] = set()
        self.open, front = parse(text, 0, self.keep, self.seen)
        self.front = hashed(front)
        _, rest = parse(text, self.open, len(text), self.seen.copy())
        self.print = least(self.front, hashed(rest), size=size)

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        text = self.text[: self.keep] + following[: len(self.text) - self.keep]
        _, rest = parse(text, self.open, len(text), self.seen)  # the set isn't needed again
        return text, least(self.front, hashed(rest), size=self.size)


def fingerprint(text: str, size: int = SIZE) -> np.ndarray:
    return Parsed(text, size).print


def _hex(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def _compared(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order; the guests at its end only serve as the last one's successor."""
    before: tuple | None = None
    rows: list[tuple] = []
    finished = False
    for batch in batches:
        for doc_id, guest, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "guest", "text")), strict=True):
            if finished or (guest and before is None):
                continue
            parsed = Parsed(text or "", size)
            if before is not None:
                rows.append(_row(*before, parsed))
            before = (doc_id, parsed)
            finished = guest
            if len(rows) == 1000:
                yield _batch(rows)
                rows = []
    if rows:
        yield _batch(rows)


def _row(doc_id: int | None, own: Parsed, following: Parsed) -> tuple:
    text, edited = own.edited(following.text)
    sha = hashlib.sha256(text.encode()).hexdigest()
    near = likeness(own.print, edited, own.size), likeness(own.print, following.print, own.size)
    return doc_id, len(own.text), sha, _hex(own.print), _hex(edited), *near


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def phrase_fingerprints(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: see SCHEMA. Fingerprints are hex, 8 digits a hash.

    A null text is empty; an empty one has no phrases, and is wholly like another empty one only. Unknown ids come
    last in the order, rows of one id in the order of their texts. The last row's successor is the first; a lone
    row follows itself. No rows: no rows.
    """
    rows = texts(docs, id_col, text_col)
    bounds = id_bounds(rows, shuffle_parts(docs.sparkSession))
    top = rows.agg(F.max("doc_id").alias("top")).first()["top"]
    top = UNKNOWN if top is None else top

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pc.fill_null(batch.column("doc_id"), UNKNOWN).to_numpy(zero_copy_only=False)
            part = np.searchsorted(bounds, ids)
            bound = np.nonzero((part < len(bounds)) & (bounds[np.minimum(part, len(bounds) - 1)] == ids) if len(bounds) else ids != ids)[0]
            first = np.nonzero(ids == top)[0]
            take = np.concatenate([np.arange(len(ids)), bound, first])
            to = np.concatenate([part, part[bound] + 1, np.zeros(len(first), np.int64)]).astype(np.int32)
            guest = pa.array(np.arange(len(take)) >= len(ids))
            picked = pa.array(take)
            yield pa.RecordBatch.from_arrays(
                [pa.array(to), batch.column("doc_id").take(picked), guest, batch.column("text").take(picked)],
                names=["part", "doc_id", "guest", "text"],
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _compared(batches, size)

    placed = rows.mapInArrow(place, "part int, doc_id long, guest boolean, text string").repartitionById(len(bounds) + 1, F.col("part"))
    ordered = placed.sortWithinPartitions("guest", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.mapInArrow(compare, SCHEMA)


def op5_phrase_fingerprints(spark, sf_dir: str) -> DataFrame:
    return phrase_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
