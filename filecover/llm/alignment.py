"""Alignment of two tokenizers' tokens over the same bytes, by diagonal run skipping.

Both tokenizations of a text are arrays of byte ends. From a place where both end, the arrays are compared at the current shift
between their indexes: stretches of one token to one token are jumped by exponential probing (stretches of doubling
length are compared as bytes; the first that differs is halved until it holds nothing but equal ends). What stops a stretch is an irregular group:
the side that is behind goes on until both end together again, which gives the next shift.

Tokens of frequent stretches of text are remembered by each worker (bounded). A text is cut only between a visible character and a space, where neither tokenizer
looks across; whether that holds is checked on the bytes of whatever is learnt, and a text with a stretch that
fails goes to the libraries whole. Links are written per document, counted over the corpus by pair of ids, and looked up in a
mapped table by a second pass over the written links. That table has a row per pair of ids that occurs: at most the product of
the two vocabularies, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hand_back, per_worker, slices, texts, written
from .hash_store import write_store

#: Stretches a worker remembers, and bytes of texts worked on at once.
REMEMBERED, SLICE = 1_000_000, 1 << 20
#: From one visible character before a space to the next: never cut at other white space.
STRETCH = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*)?|\s+")
#: How the byte-level entries write bytes: printable ones as themselves, the others from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_OF = {chr(b): b for b in _PRINTABLE} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def irregular_groups(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Groups that aren't one token to one: rows (first left, after left, first right, after right).

    `left` and `right` are ascending ends whose last is the same. All other tokens pair off in order.
    """
    a, b = np.ascontiguousarray(left, "<i8"), np.ascontiguousarray(right, "<i8")
    raw_a, raw_b = a.tobytes(), b.tobytes()
    ends_a, ends_b = a.tolist(), b.tolist()
    n = len(ends_a)
    found: list[int] = []
    i, shift = 0, 0  # the right index is i + shift
    while i < n:
        # Jump one-to-one tokens: doubling stretches while they are equal, then halving.
        width = 1
        while raw_a[8 * i : 8 * (i + width)] == raw_b[8 * (i + shift) : 8 * (i + shift + width)]:
            i += width
            if i >= n:
                break
            width *= 2
        while width > 1:
            width >>= 1
            if i < n and raw_a[8 * i : 8 * (i + width)] == raw_b[8 * (i + shift) : 8 * (i + shift + width)]:
                i += width
        if i >= n:
            break
        # An irregular group: the side that is behind goes on.
        j = i + shift
        first, other = i, j
        x, y = ends_a[i], ends_b[j]
        while x != y:
            if x < y:
                i += 1
                x = ends_a[i]
            else:
                j += 1
                y = ends_b[j]
        i, j = i + 1, j + 1
        found += (first, i, other, j)
        shift = j - i
    return np.array(found, np.int64).reshape(-1, 4)


def group_ends(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of either side end a group: as many on both sides."""
    groups = irregular_groups(left, right)
    flags = []
    for n, first, after in ((len(left), 0, 1), (len(right), 2, 3)):
        inside = np.zeros(n + 1, np.int64)  # all tokens of an irregular group but its last
        np.add.at(inside, groups[:, first], 1)
        np.add.at(inside, groups[:, after] - 1, -1)
        flags.append(np.cumsum(inside)[:n] == 0)
    return flags[0], flags[1]


class _Side:
    """A tokenizer's bytes per id, and ids of texts."""

    def __init__(self, entries: list[bytes]):
        self.entries = entries
        self.sizes = np.fromiter(map(len, entries), np.int64, len(entries))

    def bytes_of(self, ids) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))


class ByteLevel(_Side):
    """A byte-level BPE of the tokenizers library; its special tokens' strings are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as src:
            vocab = json.load(src)["model"]["vocab"]
        entries = [b""] * (max([*vocab.values(), *self.tokenizer.get_added_tokens_decoder()]) + 1)
        for token, i in vocab.items():
            entries[i] = bytes(BYTE_OF[c] for c in token)
        super().__init__(entries)

    def encode(self, spaced: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([spaced], add_special_tokens=False)[0].ids


class Pieces(_Side):
    """A sentencepiece model that puts a space before each text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        entries = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            entries.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        super().__init__(entries)

    def encode(self, spaced: str) -> list[int]:
        return self.model.encode(spaced[1:], num_threads=1)


class Aligner:
    """Tokens of texts by both tokenizers. Remembers the ids of stretches."""

    def __init__(self, left_path: str, right_path: str):
        self.sides = (per_worker(ByteLevel, left_path), per_worker(Pieces, right_path))
        # Each id's decimal digits, and what stands behind it: another id of its side, the other side, the next group.
        longest = max(len(s.entries) for s in self.sides)
        self.digits = pa.array([f"{i}{mark}" for i in range(longest) for mark in ",|;"], pa.large_binary())
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.whole: set[int] = set()
        self.held = [(np.zeros(0, np.uint16), np.zeros(1, np.int64))] * 2  # ids, and where each stretch's begin

    def _learn(self, new: list[str]) -> None:
        """Ids of new stretches, learnt as one text where that gives the same."""
        first = len(self.place)
        self.place.update(zip(new, range(first, first + len(new)), strict=True))
        spelt = [s.encode() for s in new]
        cuts = np.cumsum(np.fromiter(map(len, spelt), np.int64, len(new)))
        got = [s.encode("".join(new)) for s in self.sides]
        split = []
        for side, ids in zip(self.sides, got, strict=True):
            ends = np.cumsum(side.sizes[ids])
            at = np.searchsorted(ends, cuts)
            if side.bytes_of(ids) != b"".join(spelt) or (ends[np.minimum(at, len(ends) - 1)] != cuts).any():
                break
            split.append((np.array(ids, np.uint16), at + 1))
        if len(split) < 2:
            if len(new) > 1:  # the stretch that fails is found by halves
                for part in (new[: len(new) // 2], new[len(new) // 2 :]):
                    for s in part:
                        del self.place[s]
                    self.place = dict(self.place)
                self._learn(new[: len(new) // 2])
                self._learn(new[len(new) // 2 :])
                return
            self.whole.add(first)
            split = [(np.zeros(0, np.uint16), np.zeros(1, np.int64))] * 2
        self.held = [
            (np.concatenate([ids, more]), np.concatenate([starts, starts[-1] + ends]))
            for (ids, starts), (more, ends) in zip(self.held, split, strict=True)
        ]

    def tokens(self, text: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per side: the ids of all texts one after the other, and how many each text has. None for texts that the tokens don't spell."""
        found = [STRETCH.findall(f" {t}") if t else [] for t in text]
        if len(self.place) > REMEMBERED:
            self._forget()
        known = self.place
        if new := [s for s in dict.fromkeys(chain.from_iterable(found)) if s not in known]:
            # White space at the end of a text would run into the next stretch: what ends so is learnt by itself.
            alone = [s for s in new if s[-1].isspace()]
            rest = [s for s in new if not s[-1].isspace()]
            for s in ([rest] if rest else []) + [[s] for s in alone]:
                self._learn(s)
        every = list(chain.from_iterable(found))
        place = np.fromiter(map(self.place.__getitem__, every), np.int64, len(every))
        row = np.repeat(np.arange(len(text)), [len(own) for own in found])
        odd = np.zeros(len(text), bool)
        if self.whole:
            odd[row[np.isin(place, list(self.whole))]] = True
            place, row = place[~odd[row]], row[~odd[row]]
        out = []
        for (ids, starts), side in zip(self.held, self.sides, strict=True):
            sizes = starts[place + 1] - starts[place]
            ends = np.cumsum(sizes)
            flat = ids[np.repeat(starts[place] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
            out.append((flat, np.bincount(row, weights=sizes, minlength=len(text)).astype(np.int64)))
        for t in np.nonzero(odd)[0].tolist():
            spaced = f" {text[t]}"
            own = [s.encode(spaced) for s in self.sides]
            if all(s.bytes_of(ids) == spaced.encode() for s, ids in zip(self.sides, own, strict=True)):
                for k, ids in enumerate(own):
                    flat, sizes = out[k]
                    at = int(sizes[:t].sum())
                    sizes[t] = len(ids)
                    out[k] = (np.concatenate([flat[:at], np.array(ids, np.uint16), flat[at:]]), sizes)
        return out

    def aligned(self, text: list[str]) -> dict[str, np.ndarray | list]:
        """Per text: tokens of either side, groups, the digest of the groups, and the pairs of ids that end together."""
        (left, n_left), (right, n_right) = self.tokens(text)
        ends = [np.cumsum(side.sizes[ids]) for side, ids in zip(self.sides, (left, right), strict=True)]
        last_left, last_right = group_ends(*ends)
        pairs = left[last_left].astype(np.uint32) << np.uint32(16) | right[last_right].astype(np.uint32)
        groups = np.add.reduceat(np.append(last_left, False).astype(np.int64), np.cumsum(n_left) - n_left) if len(text) else n_left
        groups = np.where(n_left > 0, groups, 0)
        # Both sides in one sequence, group by group.
        group_left, group_right = (np.cumsum(last) - last for last in (last_left, last_right))
        many_left, many_right = (np.bincount(g, minlength=len(pairs)) for g in (group_left, group_right))
        place_left = np.arange(len(left)) + (np.cumsum(many_right) - many_right)[group_left]
        place_right = np.arange(len(right)) + np.cumsum(many_left)[group_right]
        sequence = np.zeros(len(left) + len(right), np.int64)
        sequence[place_left] = 3 * left.astype(np.int64) + last_left
        sequence[place_right] = 3 * right.astype(np.int64) + 2 * last_right
        written_out = self.digits.take(pa.array(sequence))
        _, offsets, data = written_out.buffers()
        at = np.frombuffer(offsets, np.int64)[: len(sequence) + 1] if len(sequence) else np.zeros(1, np.int64)
        cuts = at[np.concatenate([[0], np.cumsum(n_left + n_right)])].tolist()
        view = memoryview(data) if len(sequence) else memoryview(b"")
        # The last group of a text has no mark behind it.
        digests = [hashlib.sha256(view[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return {"n_a": n_left, "n_b": n_right, "n_groups": groups, "groups_sha256": digests, "pairs": pairs}


def aligned_rows(docs: DataFrame, left_path: str, right_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_a, n_b, n_groups, groups_sha256, and `pairs` (little-endian 32-bit: left id in the upper half, right id in the lower).

    Texts that are null or empty, or that either tokenizer's bytes don't spell, have no tokens.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = per_worker(Aligner, left_path, right_path)
        for part in slices(batches, SLICE):
            found = aligner.aligned(pc.fill_null(part.column("text"), "").to_pylist())
            ends = np.concatenate([[0], np.cumsum(found["n_groups"])]) * 4
            raw = found["pairs"].astype("<u4").tobytes()
            pairs = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(found[c]) for c in ("n_a", "n_b", "n_groups")), pa.array(found["groups_sha256"], pa.string()), pa.array(pairs, pa.binary())],
                names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs"],
            )

    return texts(docs, id_col, text_col).mapInArrow(align, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): links of each pair of ids over all documents; best is 1 where no pair of the right id has more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE, "pairs"):
            pairs, n = np.unique(np.frombuffer(b"".join(part.column("pairs").to_pylist()), "<u4"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

    totals = written(aligned.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    right = F.col("pair").bitwiseAND(0xFFFF)
    most = totals.groupBy(right.alias("right")).agg(F.max("n").alias("most"))
    return totals.withColumn("right", right).join(most, "right").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def token_alignment(docs: DataFrame, left_path: str, right_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A and B encode the text with a space before it, without special tokens (their strings are plain text). Offsets where tokens of both end cut
    them into groups; the two tokens that end together there are a link. The count of a pair of ids is its number of links over all
    rows: count_sum adds it up over a row's links, and n_best counts links whose count is the highest of their B id. `groups_sha256` digests
    `a1,a2|b1;a3|b2,b3`. Texts that are null or empty, or that the tokens of A or B don't spell byte by byte, have no tokens: zeros, and '' as digest.
    Rows of repeated or unknown ids are rows of their own. An empty table gives no rows.
    """
    rows = written(aligned_rows(docs, left_path, right_path, id_col, text_col), "aligned")
    counts = pair_counts(rows)
    store = write_store(counts.select(F.col("pair").alias("key"), "n", "best"), "counts")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE, "pairs"):
            links = part.column("n_groups").to_numpy()
            pairs = np.frombuffer(b"".join(part.column("pairs").to_pylist()), "<u4")
            _, values, _ = store.find(pairs.astype(np.uint64))
            before = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(values, axis=0)])
            ends = np.cumsum(links)
            per = before[ends] - before[ends - links]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_groups")), pa.array(per[:, 1]), pa.array(per[:, 0]), part.column("groups_sha256")],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )
        hand_back()

    return rows.mapInArrow(summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
