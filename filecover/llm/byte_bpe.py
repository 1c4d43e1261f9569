"""Byte-level BPE encoding and decoding with an automaton over the vocabulary.

Bytes are mapped to Latin-1 characters, so that pyahocorasick finds every vocabulary entry in a
piece of text in one pass. From the longest entry at each byte the encoder goes forward,
and back to shorter entries where two neighbours could not stand side by side after merging. Whether
two entries can is found once by merging the two alone, and remembered. Each byte is left at most
once for good, so a piece takes linear time however long it is.

Texts are split by the pattern first, and each distinct piece is encoded once per worker while the
memory of pieces (bounded) holds it. Null text counts as empty. There is no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import per_worker, slices, texts

#: Pieces and neighbours a task remembers (beyond, it forgets all and starts anew), and bytes of texts at once.
REMEMBERED = 250_000
SLICE = 1 << 20
#: Rank of two neighbours that never merge.
NEVER = 1 << 40
SCHEMA = "doc_id long, ids binary, decoded binary"


class ByteBPE:
    """The encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        self.pattern = regex.compile(pattern)
        with open(path, "rb") as src:
            rows = (line.split() for line in src if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.rank_of = {token.decode("latin-1"): rank for token, rank in self.ranks.items()}
        self.token_of = {rank: token for token, rank in self.rank_of.items()}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.found = ahocorasick.Automaton()
        for token in self.rank_of:
            self.found.add_word(token, len(token))
        self.found.make_automaton()
        self._shorter: dict[str, str | None] = {}
        self._fits: dict[tuple[str, str], bool] = {}
        self._pieces: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The merges one by one, lowest rank first: for two neighbours only, which are short."""
        parts = list(text)
        rank = self.rank_of.get
        costs = [rank(a + b, NEVER) for a, b in pairwise(parts)]
        while costs and (least := min(costs)) != NEVER:
            at = costs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at < len(costs):
                costs[at] = rank(parts[at] + parts[at + 1], NEVER)
            if at:
                costs[at - 1] = rank(parts[at - 1] + parts[at], NEVER)
        return parts

    def _tried(self, pair: tuple[str, str]) -> bool:
        """Can the two stand side by side after all merges?"""
        if len(self._fits) >= REMEMBERED:
            self._fits.clear()
        known = self._fits[pair] = self.merged(pair[0] + pair[1]) == [*pair]
        return known

    def shorter(self, token: str) -> str | None:
        """The longest entry that is a proper front of this one."""
        if token not in self._shorter:
            fronts = (token[:n] for n in range(len(token) - 1, 0, -1))
            self._shorter[token] = next((f for f in fronts if f in self.rank_of), None)
        return self._shorter[token]

    def encode_bytes(self, text: str) -> list[int]:
        """Ranks of a piece given as Latin-1 characters of its bytes."""
        whole = self.rank_of.get(text)
        if whole is not None:
            return [whole]
        n = len(text)
        longest = [0] * n
        for last, size in self.found.iter(text):
            start = last - size + 1
            if size > longest[start]:
                longest[start] = size
        dead = bytearray(n + 1)  # places from which the rest can't be encoded after what stands before
        fits = self._fits.get
        chosen: list[str] = []
        at = 0
        candidate: str | None = text[: longest[0]]
        while at < n:
            while candidate is not None:
                if not dead[at + len(candidate)]:
                    if not chosen:
                        break
                    fit = fits(pair := (chosen[-1], candidate))
                    if fit or (fit is None and self._tried(pair)):
                        break
                candidate = self.shorter(candidate)
            if candidate is None:
                dead[at] = 1
                candidate = chosen.pop()
                at -= len(candidate)
            else:
                chosen.append(candidate)
                at += len(candidate)
                candidate = text[at : at + longest[at]] if at < n else None
        return [self.rank_of[token] for token in chosen]

    def _piece(self, piece: str) -> bytes:
        if len(self._pieces) >= REMEMBERED:
            self._pieces.clear()
        found = self.encode_bytes(piece.encode().decode("latin-1"))
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= 64:
            self._pieces[piece] = ids
        return ids

    def forget(self) -> None:
        """Pieces of one task are of little use to the next, and the worker lives on."""
        self._pieces.clear()

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        known, make = self._pieces.get, self._piece
        return b"".join([known(p) or make(p) for p in self.pattern.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(path: str, pattern: str) -> ByteBPE:
    """One per worker process."""
    return per_worker(ByteBPE, path, pattern)


def _mapped(docs: DataFrame, path: str, pattern: str, schema: str, columns) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for part in slices(batches, SLICE):
            ids = [bpe.encode(t) if t else b"" for t in part.column("text").to_pylist()]
            yield columns(part.column("doc_id"), ids, (bpe.decode(i) for i in ids))
        bpe.forget()

    return docs.mapInArrow(work, schema)


def byte_bpe(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: its ids (little-endian unsigned 32-bit) and the bytes they decode to.

    `path` is a rank file (base64 token, rank), there on every worker. An empty or null text has no ids.
    """

    def columns(doc_id, ids, decoded):
        return pa.RecordBatch.from_arrays(
            [doc_id, pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"]
        )

    return _mapped(texts(docs, id_col, text_col), path, pattern, SCHEMA, columns)


def byte_bpe_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As `byte_bpe`, with counts and digests in place of the ids and bytes, made where they are."""

    def columns(doc_id, ids, decoded):
        sha = [hashlib.sha256(i).hexdigest() for i in ids]
        back = [hashlib.sha256(d).hexdigest() for d in decoded]
        n = pa.array([len(i) // 4 for i in ids], pa.int64())
        return pa.RecordBatch.from_arrays(
            [doc_id, n, pa.array(sha, pa.string()), pa.array(back, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return _mapped(texts(docs), path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return byte_bpe_digests(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
