"""Quality rule on repetition inside a text, from suffix arrays over its words.

Each task sorts the suffixes of many texts together: prefix doubling on ranks that start with
the row, so suffixes of different texts never tie, and only suffixes that still tie are sorted
again. The ranks of each doubling are kept, and the longest common prefix of neighbours in
suffix order is read from them by halving. A repeat at word i is as long as the larger prefix it
shares with either neighbour (its LCP interval); a repeat that the one starting a word earlier
doesn't contain is a maximal one. Their spans are united.

Null text counts as no words. Repeated rows are judged one by one. Only the id and the text are
read. There is no shuffle: a text is judged by the task that reads it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import Words, large, slices, texts

#: Bytes of texts whose suffixes are sorted together.
SLICE = 1 << 20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_covered_words long, longest_repeat long, spans array<struct<start: int, words: int>>"
)
_ARROW = pa.schema([
    *((n, pa.int64()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_covered_words", pa.int64()), ("longest_repeat", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))),
])


def suffix_repeats(ids: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Per word: words of the longest string from here that the same text holds elsewhere too; under `least`, 0."""
    n = len(ids)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    end = np.searchsorted(doc, doc, side="right")  # where each word's text ends
    key = doc.astype(np.int64) * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], np.diff(key[order]) != 0])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, step = [rank], 1
    while True:
        tied = ~(new & np.append(new[1:], True))  # suffix-array slots in groups of two or more
        slots = np.nonzero(tied)[0]
        if not len(slots):
            break
        at = order[slots]
        after = at + step
        second = np.where(after < end[at], rank[np.minimum(after, n - 1)] + 1, 0)
        sub = np.lexsort((second, rank[at]))
        at, second = at[sub], second[sub]
        order[slots] = at
        same = np.concatenate([[False], (rank[at][1:] == rank[at][:-1]) & (second[1:] == second[:-1])])
        new[slots] = ~same
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(same, 0, slots))
        levels.append(rank)
        step *= 2
        if step >= least and not same.any():
            break
    # Neighbours that share at least `least` words share the largest power of two below it.
    low = min(int(least).bit_length() - 1, len(levels) - 1)
    left, right = order[:-1], order[1:]
    close = levels[low][left] == levels[low][right]
    left, right = left[close], right[close]
    common = np.zeros(len(left), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        inside = (a < end[left]) & (b < end[right])
        ranks = levels[j]
        equal = inside & (ranks[np.minimum(a, n - 1)] == ranks[np.minimum(b, n - 1)])
        common += np.where(equal, 1 << j, 0)
    common[common < least] = 0
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    return longest


def maximal_spans(longest: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the repeats that the one from the word before doesn't contain."""
    before = np.where(np.concatenate([[False], doc[1:] == doc[:-1]]), np.concatenate([[0], longest[:-1]]), 0)
    starts = np.nonzero((longest > 0) & (longest >= before))[0]
    return starts, longest[starts]


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    edges = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def _per_row(flags: np.ndarray, start: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[start[1:]] - sums[start[:-1]]


def _repeated_lines(text: pa.Array) -> np.ndarray:
    """Per text, lines with a word that equal an earlier line."""
    parts = pc.split_pattern(text, "\n")
    per = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    real = pc.not_equal(pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)), 0).to_numpy(zero_copy_only=False)
    line = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(per)), per)
    used = real[line] if len(line) else np.zeros(0, bool)
    line, row = line[used], row[used]
    once = np.unique(row * (len(real) + 1) + line) // (len(real) + 1)
    return np.bincount(row, minlength=len(per)) - np.bincount(once, minlength=len(per))


def _judged(batch: pa.RecordBatch, least: int, max_covered: float, max_longest: int) -> pa.RecordBatch:
    text = large(batch.column("text"))
    rows = len(text)
    words = Words(text)
    size = pc.utf8_length(words.vocab).to_numpy(zero_copy_only=False).astype(np.int64)
    letters = _per_row(size[words.ids] if len(words.ids) else np.zeros(0, np.int64), words.start)
    raw = np.frombuffer(b"".join(t.encode() for t in text.to_pylist()), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))])
    symbols = _per_row(SYMBOLS[raw], bounds)

    found = suffix_repeats(words.ids, words.doc, min(least, 8))
    eight = np.where(found >= 8, found, 0)
    total = len(found)
    repeated = _per_row(_covered(np.nonzero(eight)[0], eight[eight > 0], total), words.start)
    longest = np.where(found >= least, found, 0)
    starts, lengths = maximal_spans(longest, words.doc)
    covered = _per_row(_covered(starts, lengths, total), words.start)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, words.doc[starts], lengths)

    failed = (words.n < 20) | (100 * repeated > 30 * words.n)
    kept = ~failed & (covered <= max_covered * words.n) & (top <= max_longest)
    per_span = np.concatenate([[0], np.cumsum(np.bincount(words.doc[starts], minlength=rows))]).astype(np.int32)
    spans = pa.StructArray.from_arrays(
        [pa.array((starts - words.start[words.doc[starts]]).astype(np.int32)), pa.array(lengths.astype(np.int32))],
        fields=list(_ARROW.field("spans").type.value_type),
    )
    columns = [words.n, letters, symbols, _repeated_lines(text), repeated, failed, kept, covered, top]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), *(pa.array(c) for c in columns), pa.ListArray.from_arrays(pa.array(per_span), spans)],
        schema=_ARROW,
    )


def repetition(
    docs: DataFrame,
    min_words: int = 6,
    max_covered: float = 0.3,
    max_longest: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Judge each text: one row per row of `docs`, with its maximal repeated spans (in words).

    Repeats of `min_words` words or more count. A text is kept if it passes the base rules, such
    repeats cover at most `max_covered` of its words, and none is longer than `max_longest` words.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE):
            yield _judged(part, min_words, max_covered, max_longest)

    return texts(docs, id_col, text_col).mapInArrow(judge, SCHEMA)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text is kept by `repetition` with these limits."""
    judged = {"min_words": 6, "max_covered": 0.3, "max_longest": 100} | limits

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE, text_col):
            own = pa.RecordBatch.from_arrays([part.column(id_col), part.column(text_col)], names=["doc_id", "text"])
            verdict = _judged(own, judged["min_words"], judged["max_covered"], judged["max_longest"])
            yield part.filter(verdict.column("kept"))

    return docs.mapInArrow(keep, docs.schema)


def op1_suffix_repetition(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repetition(docs).drop("n_covered_words", "longest_repeat", "spans")
