"""Spelling variants: words within one inserted, deleted or replaced letter, from a bit-sliced position index.

An index holds, for each position and letter, the set of its words with that letter there, one bit per word. A word is looked up
letter by letter; after each letter four sets say which words agree so far without an error, or with one letter
replaced, left out or added. The last two are compared at positions shifted by one. All are updated by a few ands and ors of whole machine words, and
all words of an index are looked up together.

What is put into one index shares a key. Two words that are one edit apart, the shorter of m letters, agree before the edit's place p (the length of
their common beginning) and behind it. The places 0 to m are cut into intervals; the key of [lo, hi) is the first lo letters and the last m - hi, so
every near pair shares the key of the interval that holds its p, and only there is it counted: elsewhere the words differ
earlier, or agree on the first hi letters. It starts with two halves of the places. A key of more than `LIMIT` words has its interval halved
again; a key of one place leaves one letter open, two in the longer words. So a group is bounded by the alphabet, not by the
vocabulary, and none is cut short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import large, slices, texts, written

#: What is not a letter of a word.
NO_LETTER = r"[^A-Za-z\x{C0}-\x{FF}]+"
#: Words of one key before its interval is halved, words of an index, and words looked up at once.
LIMIT, INDEX, QUERIES = 2048, 4096, 1024
#: Bytes of texts worked on at once.
SLICE = 4 << 20


def _left_out(word: str, at: int) -> str:
    return word[:at] + word[at + 1 :]


def counted_words(docs: DataFrame, least_length: int = 5, least_count: int = 3, divisor: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters, A-Z lowered, of at least `least_length` letters and `least_count` occurrences.

    Where `divisor` divides the crc32 of `<doc_id>:<run>`, letter number crc32 % length of the run is left out. An unknown id is empty there; null
    texts have no words. A divisor of 0 leaves every run as it is.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE):
            runs = pc.split_pattern_regex(pc.ascii_lower(large(part.column("text"))), NO_LETTER)
            flat = runs.flatten()
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(runs).to_numpy(zero_copy_only=False))
            long = pc.greater_equal(pc.utf8_length(flat), least_length)
            row = row[long.to_numpy(zero_copy_only=False)]
            coded = flat.filter(long).dictionary_encode()
            vocab = coded.dictionary.to_pylist()
            ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            totals = np.bincount(ids, minlength=len(vocab))
            changed: dict[str, int] = {}
            if divisor and len(ids):
                pairs, times = np.unique(row * len(vocab) + ids, return_counts=True)
                row, ids = np.divmod(pairs, len(vocab))
                seeds = [zlib.crc32(b"%d:" % i if i is not None else b":") for i in part.column("doc_id").to_pylist()]
                spelt = [w.encode() for w in vocab]
                crc = np.fromiter(map(zlib.crc32, map(spelt.__getitem__, ids.tolist()), map(seeds.__getitem__, row.tolist())), np.uint32, len(ids))
                for k in np.nonzero(crc % divisor == 0)[0].tolist():
                    word = vocab[ids[k]]
                    totals[ids[k]] -= times[k]
                    if len(word) > least_length:
                        other = _left_out(word, int(crc[k]) % len(word))
                        changed[other] = changed.get(other, 0) + int(times[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array([*vocab, *changed], pa.string()), pa.array(np.concatenate([totals, np.fromiter(changed.values(), np.int64, len(changed))]))],
                names=["word", "n"],
            )

    found = texts(docs, id_col, text_col).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class PositionIndex:
    """Bit sets of the words that hold a letter at a position; sets are rows of 64-bit numbers, 64 words each."""

    def __init__(self, words: list[str]):
        self.n = len(words)
        self.lengths = np.fromiter(map(len, words), np.int64, self.n)
        self.starts = np.cumsum(self.lengths) - self.lengths
        alphabet, self.letter = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), return_inverse=True)
        self.letters = len(alphabet)
        word = np.repeat(np.arange(self.n), self.lengths)
        place = np.arange(len(self.letter)) - self.starts[word]
        self.places, self.at = self._sets(place * self.letters + self.letter, word)
        self.sizes, self.of_length = self._sets(self.lengths, np.arange(self.n))

    def _sets(self, value: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values and the words of each; a last set without words for all other values."""
        values, row = np.unique(value, return_inverse=True)
        flags = np.zeros((len(values) + 1, -(-self.n // 64) * 8), np.uint8)
        np.bitwise_or.at(flags, (row, word >> 3), (1 << (word & 7)).astype(np.uint8))
        return values, flags.view(np.uint64)

    @staticmethod
    def _of(values: np.ndarray, sets: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
        return sets[np.where(values[at] == wanted, at, len(values))]

    def near(self, rows: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in `rows`, word) that are exactly one edit apart and don't agree on the first `until` letters.

        `rows` are words of the index itself, `until` a number for each (beyond the word's length: no such condition).
        """
        near = np.zeros((len(rows), self.at.shape[1]), np.uint64)
        alive = np.arange(len(rows))
        exact = np.full_like(near, ~np.uint64(0))
        agreed, replaced, left_out, added = (np.zeros_like(near) for _ in range(4))
        for i in range(int(self.lengths[rows].max(initial=0)) + 1):
            stop = until[alive] == i
            agreed[alive[stop]] = exact[stop]
            ended = self.lengths[rows[alive]] == i
            if ended.any():
                near[alive[ended]] = (
                    (replaced[ended] & self._of(self.sizes, self.of_length, np.full(ended.sum(), i)))
                    | (left_out[ended] & self._of(self.sizes, self.of_length, np.full(ended.sum(), i - 1)))
                    | ((added[ended] | exact[ended]) & self._of(self.sizes, self.of_length, np.full(ended.sum(), i + 1)))
                )
                alive, exact, replaced, left_out, added = (x[~ended] for x in (alive, exact, replaced, left_out, added))
            here = self.letter[self.starts[rows[alive]] + i]
            same, before, after = (self._of(self.places, self.at, (i + d) * self.letters + here) for d in (0, -1, 1))
            # One error: it was made before and this letter agrees at the shifted place, or it is made now.
            replaced = (replaced & same) | (exact & ~same)
            left_out = (left_out & before) | exact
            added = (added | exact) & after
            exact = exact & same
        near &= ~agreed
        return np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, : self.n])


def _key() -> F.Column:
    """m, the interval, and the letters before and behind it."""
    behind = F.greatest(F.col("m") - F.col("hi"), F.lit(0))
    return F.concat_ws(
        "|", "m", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")),
        F.when(behind > 0, F.substring("word", -behind, behind)).otherwise(""),
    )


def _grouped(vocabulary: DataFrame, limit: int) -> DataFrame:
    """(key, hi, m, word, n): the words under each key that more than one word has."""
    length = F.char_length("word")
    rows = vocabulary.select("word", "n", F.explode(F.array(length, length - 1)).alias("m"))
    half = F.floor((F.col("m") + 1) / 2).cast("int")
    both = F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), (F.col("m") + 1).alias("hi")))
    rows = rows.select("word", "n", "m", F.explode(both).alias("places")).select("word", "n", "m", "places.*")
    done = None
    while True:
        keyed = written(rows.withColumn("key", _key()), "keys")
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
        shared = written(keyed.join(written(sizes, "sizes"), "key"), "shared")
        splits = (F.col("held") > limit) & (F.col("hi") - F.col("lo") > 1)
        final = shared.where(~splits).drop("held")
        done = final if done is None else done.unionByName(final)
        hot = shared.where(splits)
        if hot.isEmpty():
            return done
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        both = F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi")))
        rows = hot.select("word", "n", "m", F.explode(both).alias("places")).select("word", "n", "m", "places.*")


def _looked_up(table: pa.Table) -> pa.RecordBatch:
    """Near words of each word of whole groups: how many, and the one of largest count (ties: the first in code-point order)."""
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    hi, m = table.column("hi").to_numpy().astype(np.int64), table.column("m").to_numpy().astype(np.int64)
    group = table.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
    index = PositionIndex(words)
    lefts, rights = [], []
    for start in range(0, len(words), QUERIES):
        rows = np.arange(start, min(start + QUERIES, len(words)))
        # The interval that ends behind the last place has no end to compare.
        left, right = index.near(rows, np.where(hi[rows] > m[rows], 1 << 30, hi[rows]))
        left = rows[left]
        # Under m, one of the two has m letters; where both have one more, they meet under m + 1.
        kept = (group[left] == group[right]) & (np.minimum(index.lengths[left], index.lengths[right]) == m[left])
        lefts.append(left[kept])
        rights.append(right[kept])
    left, right = np.concatenate(lefts), np.concatenate(rights)
    order = np.lexsort((np.array(words, object)[right], -n[right], left)) if len(left) else left
    left, right = left[order], right[order]
    first = np.nonzero(np.diff(left, prepend=-1))[0]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([words[i] for i in left[first].tolist()], pa.string()), pa.array(np.diff([*first.tolist(), len(left)]), pa.int64()),
            pa.array([words[i] for i in right[first].tolist()], pa.string()), pa.array(n[right[first]], pa.int64()),
        ],
        names=["word", "n_near", "best", "best_n"],
    )


def _in_indexes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of key, looked up in indexes of whole groups."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        while held.num_rows > INDEX:
            key = held.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
            starts = np.nonzero(np.diff(key, prepend=-1))[0]
            cut = int(starts[starts <= INDEX][-1]) or (int(starts[1]) if len(starts) > 1 else 0)
            if not cut:
                break  # one group so far: its end is yet to come
            yield _looked_up(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield _looked_up(held)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of each word that has one end. A form is at least twice as frequent, so chains are short and have an end."""
    state = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        above = state.select(F.col("word").alias("root"), F.col("root").alias("above"))
        step = written(state.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return state
        state = step.select("word", "root")


def spelling_variants(
    docs: DataFrame, least_length: int = 5, least_count: int = 3, divisor: int = 97, ratio: int = 2,
    id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
) -> DataFrame:
    """Per word (see counted_words): word, form, root, n, n_near, form_n.

    Two words are near if they are exactly one inserted, deleted or replaced letter apart. A word's form is its near word of
    largest n (ties: the first in code-point order) if that n is at least `ratio` times its own, else null; `root` is where forms end, the word
    itself without one. `ratio` is above 1, so forms make no circle. Null and empty texts and empty tables have no words; repeated rows count each; runs of any length are whole
    words; other columns are not read.
    """
    if ratio <= 1:
        raise ValueError("ratio: above 1")
    vocabulary = written(counted_words(docs, least_length, least_count, divisor, id_col, text_col), "vocabulary")
    grouped = _grouped(vocabulary, limit).select("key", "hi", "m", "word", "n")
    found = written(
        grouped.repartition("key").sortWithinPartitions("key").mapInArrow(_in_indexes, "word string, n_near long, best string, best_n long"), "near"
    )
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top"))
    listed = written(
        vocabulary.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(-F.col("top.less") >= ratio * F.col("n"), F.struct(F.col("top.best").alias("form"), (-F.col("top.less")).alias("form_n"))).alias("f"),
        ).select("word", "n", "n_near", "f.form", "f.form_n"),
        "forms",
    )
    roots = _roots(listed.where("form is not null"))
    return listed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
