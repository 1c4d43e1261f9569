"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

1. Lexicons. Document frequencies of words and of word beginnings (4 to 6 letters) in labelled toxic and clean
   texts; every term that is far likelier in toxic texts, and surely so, joins a lexicon, however rare it is.
   All labelled training rows count; a group of near copies counts once, so a text that is copied often raises no bar for others.
2. Voters. Lexicons by kind and length, split further by hash, say toxic or nothing; others look at how many
   terms a text holds, at its punctuation and capitals, or say clean where no term occurs.
3. Label model. The votes of all training rows, labelled or not, are counted by pattern. Expectation-maximisation
   fits how each voter votes on toxic and on clean texts; voters that depend on one another beyond that are
   joined and modelled together (their correlations), and the fit is repeated. It never sees a label but
   for the share of toxic rows.
4. Classifier. Logistic regression on the terms and measures of at most `FIT_ROWS` training rows (a hash of the id
   selects them), whose targets are the label model's posteriors.

Labels are looked up by id in a mapped table, so texts aren't shuffled but for labelled ones that near-duplicate detection has to verify. The
lexicon is a mapped table too. What the driver holds is bounded: vote patterns (3 to the number of voters at most), and
`FIT_ROWS` sparse rows with the weights of their terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, Words, crc_rest, large, per_worker, slices, texts, written
from .hash_store import HashStore, write_store
from .near_dedup import near_duplicates

#: The least number of toxic training texts that must hold a term; near copies count once.
TERM_TEXTS = 3
#: How much likelier (natural log) a term must be in toxic texts, and how sure that is (log-likelihood ratio).
TERM_ODDS, TERM_SURE = 4.0, 20.0
#: Rows the classifier is fitted on, at most (about: rows are selected by hash).
FIT_ROWS = 50_000
BEGINNINGS = (4, 5, 6)
#: Long terms a worker remembers the hashes of, at most: about 60 MB.
REMEMBERED = 250_000
#: Dependence (nats, given the class) above which two voters are modelled together, and voters per group.
DEPENDENT, GROUP = 0.01, 3
MARKS = " .,;:!?\"'()[]{}<>*_-`~–—‘’“”«»¡¿"
MEASURES = ("any_term", "log_terms", "term_share", "exclaims", "capitals")
VOTERS = (
    "words_a", "words_b", "words_c", "begins_4", "begins_5", "begins_6", "two_terms", "dense", "no_term", "exclaims", "capitals",
)


def term_hash(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term)


def _u64(data: np.ndarray, at: np.ndarray, width: int = 8) -> np.ndarray:
    """The little-endian numbers of `width` bytes at places of `data`."""
    every = np.ndarray((max(0, len(data) - width + 1),), f"<u{width}", data, strides=(1,))
    return every[at].astype(np.uint64)


def _high(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The upper 64 bits of 64-bit products."""
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    a0, a1, b0, b1 = a & low, a >> half, b & low, b >> half
    cross = a1 * b0 + (a0 * b0 >> half)
    return a1 * b1 + (cross >> half) + ((a0 * b1 + (cross & low)) >> half)


def term_hashes(terms: pa.Array) -> np.ndarray:
    """``term_hash`` of each of the large strings. Those of at most 16 bytes, nearly all, are hashed as arrays: XXH3's rules for short inputs."""
    n = len(terms)
    if not n:
        return np.zeros(0, np.uint64)
    _, ends, bytes_ = terms.buffers()
    ends = np.frombuffer(ends, np.int64, n + 1, 8 * terms.offset)
    data = np.frombuffer(bytes_, np.uint8) if bytes_ else np.zeros(0, np.uint8)
    start, size = ends[:-1], ends[1:] - ends[:-1]
    u, out = np.uint64, np.zeros(n, np.uint64)

    few = np.nonzero((size >= 1) & (size <= 3))[0]
    at, length = start[few], size[few]
    first, middle, last = (data[at + k].astype(u) for k in (0, length >> 1, length - 1))
    h = (first << u(16) | middle << u(24) | last | length.astype(u) << u(8)) ^ u(0x87275A9B)
    h = (h ^ h >> u(33)) * FOLD
    h = (h ^ h >> u(29)) * u(0x165667B19E3779F9)
    out[few] = h ^ h >> u(32)

    some = np.nonzero((size >= 4) & (size <= 8))[0]
    at, length = start[some], size[some]
    h = (_u64(data, at, 4) << u(32) | _u64(data, at + length - 4, 4)) ^ u(0xC73AB174C5ECD5A2)
    h = (h ^ (h << u(49) | h >> u(15)) ^ (h << u(24) | h >> u(40))) * u(0x9FB21C651E98DF25)
    h = (h ^ (h >> u(35)) + length.astype(u)) * u(0x9FB21C651E98DF25)
    out[some] = h ^ h >> u(28)

    more = np.nonzero((size >= 9) & (size <= 16))[0]
    at, length = start[more], size[more]
    low, high = _u64(data, at) ^ u(0x6782737BEA4239B9), _u64(data, at + length - 8) ^ u(0xAF56BC3B0996523A)
    h = length.astype(u) + low.byteswap() + high + (low * high ^ _high(low, high))
    h = (h ^ h >> u(37)) * u(0x165667919E3779F9)
    out[more] = h ^ h >> u(32)

    rest = np.nonzero((size == 0) | (size > 16))[0]
    if len(rest):
        out[rest] = per_worker(LongTerms).hashes(terms.take(pa.array(rest)))
    return out


class LongTerms:
    """Hashes of terms of more than 16 bytes a worker has met. Forgets all when full."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashes(self, terms: pa.Array) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known = {}
        words = terms.cast(pa.large_binary()).to_pylist()
        self.known.update((w, term_hash(w)) for w in words if len(w) <= 128 and w not in self.known)
        return np.fromiter((self.known[w] if w in self.known else term_hash(w) for w in words), np.uint64, len(words))


class Terms:
    """Words of a slice without marks, and which texts hold which word.

    `hashes` holds those of a word and of its beginnings (marked by their length) beside one another, `has` which of them there are.
    """

    def __init__(self, text: pa.Array):
        found = Words(pc.utf8_lower(large(text)))
        self.n = found.n
        bare = pc.utf8_trim(found.vocab, MARKS).dictionary_encode()
        words, to = bare.dictionary, bare.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        to = np.where(empty, -1, np.cumsum(~empty) - 1)[to] if len(to) else to
        words = words.filter(pa.array(~empty))
        letters = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        self.has = letters[:, None] > np.array([0, *BEGINNINGS])
        self.hashes = np.zeros(self.has.shape, np.uint64)
        self.hashes[:, 0] = term_hashes(words)
        for k, n in enumerate(BEGINNINGS, 1):
            begins = pc.utf8_slice_codeunits(words.filter(pa.array(self.has[:, k])), 0, n).dictionary_encode()
            marked = pc.binary_join_element_wise(pa.scalar(f"{n}:", pa.large_string()), begins.dictionary, pa.scalar("", pa.large_string()))
            self.hashes[self.has[:, k], k] = term_hashes(marked)[begins.indices.to_numpy(zero_copy_only=False)]
        ids = to[found.ids]
        self.ids, self.doc = ids[ids >= 0], found.doc[ids >= 0]  # places among the words

    def found_in(self, store: HashStore) -> np.ndarray:
        """Which terms are keys of `store`."""
        there = np.zeros_like(self.has)
        there[self.has] = store.find(self.hashes[self.has])[0]
        return there

    def named(self, has: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the terms, in order; and per word the places of its terms there (-1: none), by kind of term. `has`: which terms count."""
        has = self.has if has is None else has
        codes = np.full(has.shape, -1, np.int64)
        hashes, codes[has] = np.unique(self.hashes[has], return_inverse=True)
        return hashes, codes

    def pairs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, place of a term it holds), distinct; words without a place are left out first.

        Words are put in an order in which those of one beginning stand together, longer beginnings within shorter ones, so that
        in a text equal terms are neighbours.
        """
        counts = (codes >= 0).any(axis=1)
        mine = counts[self.ids]
        order = np.lexsort(codes.T[:0:-1])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        doc, word = np.divmod(np.unique(self.doc[mine] * (len(order) + 1) + rank[self.ids[mine]]), len(order) + 1)
        docs, places = [], []
        for of in codes[order[word]].T:
            own, place = doc[of >= 0], of[of >= 0]
            new = np.concatenate([[True], (own[1:] != own[:-1]) | (place[1:] != place[:-1])])[: len(own)]
            docs.append(own[new])
            places.append(place[new])
        return np.concatenate(docs), np.concatenate(places)


@dataclass(frozen=True)
class Lexicon:
    """Hashes of terms, in a table that workers map."""

    store: HashStore

    def hits(self, terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash of a term it holds), distinct and in order; words that are or begin with a term, and bits of the voters of terms, per text."""
        hashes, codes = terms.named(terms.found_in(self.store))
        doc, code = terms.pairs(codes)
        order = np.lexsort((code, doc))
        doc, code = doc[order], code[order]
        hit = (codes >= 0).any(axis=1)
        per_text = np.bincount(terms.doc[hit[terms.ids]], minlength=len(terms.n))
        voters = np.where(codes >= 0, np.arange(codes.shape[1]) + 2, -1)
        word = codes[:, 0] >= 0
        voters[word, 0] = hashes[codes[word, 0]] % np.uint64(3)
        bits = np.where(voters >= 0, 1 << np.maximum(voters, 0), 0).sum(axis=1)
        votes = np.zeros(len(terms.n), np.int64)
        np.bitwise_or.at(votes, terms.doc[hit[terms.ids]], bits[terms.ids[hit[terms.ids]]])
        return doc, hashes[code], per_text, votes


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, toxic) of training rows that have a label: the least id of each text."""
    truth = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
    ids = docs.where(crc_rest("doc_id", 5) != 0).select(
        "doc_id", F.xxhash64("text").alias("hash"), F.coalesce(F.length("text"), F.lit(0)).alias("size")
    )
    known = ids.join(truth.where("toxic is not null"), "doc_id")
    return known.groupBy("hash", "size").agg(F.min(F.struct("doc_id", "toxic")).alias("first")).select(
        F.col("first.doc_id").alias("key"), F.col("first.toxic").alias("toxic")
    )


def _with_labels(rows: DataFrame, labels: HashStore) -> DataFrame:
    """(doc_id, toxic, text) of the rows that have a label, written: several scans follow."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids = pc.fill_null(part.column("doc_id"), -(1 << 63)).to_numpy(zero_copy_only=False)
            there, values, _ = labels.find(ids.astype(np.int64).view(np.uint64))
            chosen = pa.array(np.nonzero(there)[0])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(chosen), pa.array(values[:, 0]).take(chosen), part.column("text").take(chosen)],
                names=["doc_id", "toxic", "text"],
            )

    return written(rows.mapInArrow(pick, "doc_id long, toxic long, text string"), "labelled")


def _near_copies(known: DataFrame) -> tuple[HashStore, dict[int, int]]:
    """The group of each labelled text that has near copies of its label, by id; and per label the groups, single texts included.

    Near copies are texts whose sets of words are alike, in whatever order: the same words are counted in them.
    """
    sides = known.select("doc_id", "toxic").distinct()
    found = near_duplicates(known, width=1, percent=80).groupBy("doc_id").agg(F.min("component_id").alias("group"))
    placed = written(found.join(sides, "doc_id"), "groups")
    sizes = placed.groupBy("toxic", "group").agg(F.count(F.lit(1)).alias("n"))
    groups = {r.toxic: r.n for r in sizes.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    several = placed.join(sizes.where("n > 1"), ["toxic", "group"]).select(F.col("doc_id").alias("key"), "group")
    return write_store(several, "groups"), groups


COUNTS = "term long, toxic long, own long, texts long"


def _counted(batches: Iterator[pa.RecordBatch], groups: HashStore) -> Iterator[pa.RecordBatch]:
    """Texts without near copies that hold a term, by label; and the terms of each group (`own`), again for each slice."""
    held: dict[int, list] = {0: [], 1: []}
    waiting = 0

    def totals() -> Iterator[pa.RecordBatch]:
        for side, parts in held.items():
            if parts:
                terms, back = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
                texts_ = np.bincount(back, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
                yield _counts(terms, side, None, texts_)
            parts.clear()

    for part in slices(batches):
        terms = Terms(part.column("text"))
        toxic = part.column("toxic").to_numpy(zero_copy_only=False)
        there, values, _ = groups.find(part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        hashes, codes = terms.named()
        doc, code = terms.pairs(codes)
        for side in (0, 1):
            mine = toxic[doc] == side
            times = np.bincount(code[mine & ~there[doc]], minlength=len(hashes))
            held[side].append((hashes[times > 0], times[times > 0]))
            waiting += int((times > 0).sum())
            both = mine & there[doc]
            if both.any():
                own, at = np.unique(np.stack([values[doc[both], 0], code[both]]), axis=1)
                yield _counts(hashes[at], side, own, np.ones(len(at), np.int64))
        if waiting > 2_000_000:
            yield from totals()
            waiting = 0
    yield from totals()


def _counts(terms: np.ndarray, side: int, own: np.ndarray | None, texts_: np.ndarray) -> pa.RecordBatch:
    group = pa.nulls(len(terms), pa.int64()) if own is None else pa.array(own)
    return pa.RecordBatch.from_arrays(
        [pa.array(terms.view(np.int64)), pa.array(np.full(len(terms), side, np.int64)), group, pa.array(texts_)],
        names=["term", "toxic", "own", "texts"],
    )


def induce(known: DataFrame) -> Lexicon:
    """The lexicon of labelled texts (doc_id, toxic, text). A group of near copies counts once, for every term that any of them holds."""
    store, groups = _near_copies(known)
    n_toxic, n_clean = groups.get(1, 0), groups.get(0, 0)

    def count(batches):
        yield from _counted(batches, store)

    side = lambda t: F.sum(F.when(F.col("toxic") == t, F.col("texts")).otherwise(0))
    counts = (
        known.mapInArrow(count, COUNTS).groupBy("term", "toxic", "own").agg(F.sum("texts").alias("texts"))
        .withColumn("texts", F.when(F.col("own").isNull(), F.col("texts")).otherwise(1))
        .groupBy("term").agg(side(1).alias("bad"), side(0).alias("good"))
        .where(F.col("bad") >= TERM_TEXTS)
    )
    odds = F.log((F.col("bad") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("good") + 0.5) / (n_clean + 1.0))
    every = float(max(1, n_toxic + n_clean))
    sure = F.lit(0.0)
    with_term = F.col("bad") + F.col("good")
    for n, column in ((n_toxic, F.col("bad")), (n_clean, F.col("good"))):
        for cell, row in ((column, with_term), (n - column, every - with_term)):
            sure += F.when(cell > 0, 2 * cell * F.log(cell * every / (row * float(n)))).otherwise(0.0)
    good = counts.where(odds >= TERM_ODDS).where(sure >= TERM_SURE)
    return Lexicon(write_store(written(good.select(F.col("term").alias("key"), F.col("bad").alias("texts")), "lexicon"), "lexicon"))


def _below(wanted: int, total: int) -> int:
    """The bound below which about `wanted` of `total` 64-bit hashes lie, however many there are."""
    return -(1 << 63) + (wanted << 64) // total


FEATURES = "doc_id long, held_out boolean, terms array<long>, kinds long, n_words long, n_hits long, exclaims double, capitals double"


def _features(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        text = large(part.column("text"))
        terms = Terms(text)
        doc, term, hits, votes = lexicon.hits(terms)
        size = np.maximum(pc.binary_length(text).to_numpy(zero_copy_only=False), 1)
        exclaims = pc.count_substring(text, "!").to_numpy(zero_copy_only=False) / np.maximum(terms.n, 1)
        capitals = pc.count_substring_regex(text, "[A-Z]").to_numpy(zero_copy_only=False) / size
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"), part.column("held_out"), pa.ListArray.from_arrays(pa.array(ends), pa.array(term.view(np.int64))),
                pa.array(votes), pa.array(terms.n), pa.array(hits.astype(np.int64)), pa.array(exclaims.astype(float)), pa.array(capitals.astype(float)),
            ],
            names=["doc_id", "held_out", "terms", "kinds", "n_words", "n_hits", "exclaims", "capitals"],
        )


class Measured:
    """Arrays of a batch of feature rows."""

    def __init__(self, batch: pa.RecordBatch):
        lists = batch.column("terms")
        self.term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        per = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.repeat(np.arange(len(per)), per)
        words, hits, exclaims, capitals = (
            batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_words", "n_hits", "exclaims", "capitals")
        )
        self.measures = np.stack([per > 0, np.log1p(per), np.minimum(hits / np.maximum(words, 1), 1), np.minimum(exclaims, 1), capitals], axis=1)
        votes = np.zeros((len(per), len(VOTERS)), np.int8)
        votes[:, :6] = batch.column("kinds").to_numpy(zero_copy_only=False)[:, None] >> np.arange(6) & 1
        votes[:, 6] = per >= 2
        votes[:, 7] = (hits >= 2) & (hits >= 0.02 * words)
        votes[:, 8] = np.where(per == 0, -1, 0)
        votes[:, 9] = np.where(exclaims > 0.05, 1, 0)
        votes[:, 10] = np.where(capitals > 0.3, 1, 0)
        self.votes = votes


class LabelModel:
    """How groups of voters vote, given the class; fitted without labels."""

    def __init__(self, share: float):
        self.share = min(max(share, 0.01), 0.5)
        self.groups: list[tuple[int, ...]] = [(j,) for j in range(len(VOTERS))]
        self.tables: list[np.ndarray] = []

    @staticmethod
    def _codes(votes: np.ndarray, group: tuple[int, ...]) -> np.ndarray:
        code = np.zeros(len(votes), np.int64)
        for j in group:
            code = code * 3 + votes[:, j] + 1
        return code

    def _maximise(self, votes: np.ndarray, weight: np.ndarray, posterior: np.ndarray) -> None:
        self.tables = []
        for group in self.groups:
            code, cells = self._codes(votes, group), 3 ** len(group)
            sides = [np.bincount(code, weights=weight * p, minlength=cells) + 0.1 for p in (1 - posterior, posterior)]
            self.tables.append(np.stack([s / s.sum() for s in sides]))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance of toxic, per row of votes."""
        odds = np.full(len(votes), np.log(self.share / (1 - self.share)))
        for group, table in zip(self.groups, self.tables, strict=True):
            code = self._codes(votes, group)
            odds += np.log(table[1, code]) - np.log(table[0, code])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def _fit_once(self, votes: np.ndarray, weight: np.ndarray, posterior: np.ndarray, rounds: int = 50) -> np.ndarray:
        for _ in range(rounds):
            self._maximise(votes, weight, posterior)
            after = self.posterior(votes)
            moved = np.abs(after - posterior).max(initial=0)
            posterior = after
            if moved < 1e-6:
                break
        return posterior

    def dependence(self, votes: np.ndarray, weight: np.ndarray, posterior: np.ndarray) -> dict[tuple[int, int], float]:
        """Mutual information of two voters given the class."""
        found = {}
        for pair in combinations(range(len(VOTERS)), 2):
            total = 0.0
            for side in (1 - posterior, posterior):
                joint = np.bincount(self._codes(votes, pair), weights=weight * side, minlength=9).reshape(3, 3)
                if joint.sum() <= 0:
                    continue
                p = joint / joint.sum()
                apart = p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True)
                cells = p > 0
                total += joint.sum() / weight.sum() * float((p[cells] * np.log(p[cells] / apart[cells])).sum())
            found[pair] = total
        return found

    def fit(self, votes: np.ndarray, weight: np.ndarray) -> LabelModel:
        if not len(votes):
            self._maximise(votes, weight, np.zeros(0))
            return self
        start = 1 / (1 + np.exp(-2.0 * votes.sum(axis=1) + np.log((1 - self.share) / self.share) * 0.5))
        posterior = self._fit_once(votes, weight, start)
        of = {j: (j,) for j in range(len(VOTERS))}
        for (a, b), much in sorted(self.dependence(votes, weight, posterior).items(), key=lambda x: -x[1]):
            if much > DEPENDENT and of[a] != of[b] and len(of[a]) + len(of[b]) <= GROUP:
                merged = tuple(sorted(of[a] + of[b]))
                of |= dict.fromkeys(merged, merged)
        self.groups = sorted(set(of.values()))
        self._fit_once(votes, weight, start)
        return self


@dataclass
class Linear:
    """A logistic regression over terms (those of the rows it was fitted on, by hash in order) and measures."""

    bias: float
    hashes: np.ndarray
    terms: np.ndarray
    measures: np.ndarray

    def score(self, rows: Measured) -> np.ndarray:
        if not len(self.hashes) or not len(rows.term):
            return self.at(rows, np.zeros(0, np.int64), np.zeros(0, np.int64))
        place = np.minimum(np.searchsorted(self.hashes, rows.term), len(self.hashes) - 1)
        known = self.hashes[place] == rows.term
        return self.at(rows, rows.row[known], place[known])

    def at(self, rows: Measured, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Scores where the terms at `place` stand in the texts `row`."""
        odds = self.bias + rows.measures @ self.measures
        if len(row):
            odds += np.bincount(row, weights=self.terms[place], minlength=len(odds))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_linear(rows: Measured, target: np.ndarray, share: float, steps: int = 400, rate: float = 0.1) -> Linear:
    """Gradient steps with momentum and running scales; a slight pull of the weights to 0."""
    n = max(1, len(target))
    hashes, place = np.unique(rows.term, return_inverse=True)
    n_terms = len(hashes)
    model = Linear(float(np.log(share / (1 - share))), hashes, np.zeros(n_terms), np.zeros(len(MEASURES)))
    if not len(target):
        return model
    state = [np.zeros((2, size)) for size in (1, n_terms, len(MEASURES))]
    for step in range(1, steps + 1):
        wrong = model.at(rows, rows.row, place) - target
        slopes = [
            np.array([wrong.sum() / n]),
            np.bincount(place, weights=wrong[rows.row], minlength=n_terms) / n + 1e-5 * model.terms,
            rows.measures.T @ wrong / n + 1e-5 * model.measures,
        ]
        moves = []
        for slope, kept in zip(slopes, state, strict=True):
            kept[0] = 0.9 * kept[0] + 0.1 * slope
            kept[1] = 0.999 * kept[1] + 0.001 * slope**2
            moves.append(rate * (kept[0] / (1 - 0.9**step)) / (np.sqrt(kept[1] / (1 - 0.999**step)) + 1e-8))
        model.bias -= float(moves[0][0])
        model.terms -= moves[1]
        model.measures -= moves[2]
    return model


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted, label_model (the posterior of its votes).

    `labels`: doc_id, toxic (0, 1 or null). Rows whose crc32(id as text) leaves 0 modulo 5 are held out: nothing is
    learned from them. A null text is empty; of rows with one text, the least id's label counts. Without
    toxic labels there are no terms, and every text scores low.
    """
    rows = texts(docs, id_col, text_col)
    truth = written(_labelled(rows, labels), "labels")
    n_texts, n_toxic = truth.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = n_toxic / max(1, n_texts)
    lexicon = induce(_with_labels(rows, write_store(truth, "labels")))

    def measure(batches):
        yield from _features(batches, lexicon)

    marked = rows.withColumn("held_out", crc_rest("doc_id", 5) == 0)
    features = written(marked.mapInArrow(measure, FEATURES), "features")
    training = features.where("not held_out")

    def vote(batches):
        for batch in batches:
            votes = Measured(batch).votes
            packed, count = np.unique(votes, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v.tobytes() for v in packed], pa.binary()), pa.array(count.astype(np.int64))], names=["votes", "texts"]
            )

    patterns = training.mapInArrow(vote, "votes binary, texts long").groupBy("votes").agg(F.sum("texts").alias("texts")).collect()
    patterns.sort(key=lambda r: bytes(r.votes))
    votes = np.frombuffer(b"".join(bytes(r.votes) for r in patterns), np.int8).reshape(-1, len(VOTERS))
    weight = np.array([r.texts for r in patterns], float)
    model = LabelModel(share).fit(votes, weight)

    total = int(weight.sum())
    chosen = training.where(F.xxhash64("doc_id") < F.lit(_below(fit_rows, total))) if total > fit_rows else training
    table = chosen.orderBy("doc_id").toArrow().combine_chunks()
    sample = table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)
    measured = Measured(sample)
    linear = fit_linear(measured, model.posterior(measured.votes), model.share)

    def score(batches):
        for batch in batches:
            found = Measured(batch)
            p = linear.score(found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)),
                    pa.array(model.posterior(found.votes)),
                ],
                names=["doc_id", "held_out", "score", "predicted", "label_model"],
            )

    return features.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int, label_model double")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs, labels)
