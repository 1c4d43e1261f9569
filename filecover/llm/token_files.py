"""Token ids in binary files of bit or byte planes, in ascending order of document id.

A file holds the ids of a range of documents. Ids are cut into blocks of a fixed number; a block is
transposed into its four byte planes or 32 bit planes, each plane is compressed by zstandard, and
planes that are zero throughout take no bytes. An index of blocks stands behind them: any run of ids
is read by unpacking the blocks it touches.

    "FCTOKEN1" | planes of block 0 | planes of block 1 | ... | documents | index | footer
    documents: zstd of doc ids (int64), known flags (uint8), lengths (int64)
    index:     int64 rows: ids in the block, offset, bytes of each plane
    footer:    planes, ids per block, blocks, documents, ids, offset and bytes of documents, offset of the index (int64), "FCTOKEN1"

Documents are range-partitioned by id as packed ids, not as texts; a partition becomes a file
under a new name, and only files of tasks that succeeded get into the manifest, so a task that runs
again leaves no trace in the result. The driver sees one manifest row per file.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import vocabulary
from .common import Words, id_bounds, large, per_worker, read_file, shared_folder, shuffle_parts, slices, texts, write_file

MAGIC = b"FCTOKEN1"
BLOCK = 1 << 16
FOOTER = 8
#: Words a worker remembers the ids of.
REMEMBERED = 1_500_000


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """A block of ids as 4 byte planes or 32 bit planes, least significant first, each compressed; zero planes are empty."""
    cells = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    rows = cells.T if planes == 4 else np.packbits(np.unpackbits(cells, axis=1, bitorder="little").T, axis=1)
    squeeze = zstandard.ZstdCompressor(level=3).compress
    return [squeeze(np.ascontiguousarray(row).tobytes()) if row.any() else b"" for row in rows]


def from_planes(parts: list, n: int) -> np.ndarray:
    """The ids of a block from its planes."""
    width = n if len(parts) == 4 else -(-n // 8)
    expand = zstandard.ZstdDecompressor().decompress
    rows = np.zeros((len(parts), width), np.uint8)
    for row, part in zip(rows, parts, strict=True):
        if len(part):
            row[:] = np.frombuffer(expand(part, max_output_size=width), np.uint8)
    if len(parts) == 4:
        return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)
    bits = np.unpackbits(rows, axis=1)[:, :n]
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").reshape(-1)


class TokenWriter:
    """Collects the compressed blocks of one file."""

    def __init__(self, planes: int = 4, block: int = BLOCK):
        self.planes, self.block = planes, block
        self.parts, self.at, self.index = [MAGIC], len(MAGIC), []
        self.rest: list[np.ndarray] = []
        self.waiting = self.ids = 0
        self.docs: list[np.ndarray] = []
        self.known: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(doc_ids.astype("<i8"))
        self.known.append(known.astype(np.uint8))
        self.lengths.append(lengths.astype("<i8"))
        self.rest.append(ids.astype("<u4"))
        self.waiting += len(ids)
        self.ids += len(ids)
        if self.waiting >= self.block:
            ready = np.concatenate(self.rest)
            whole = len(ready) // self.block * self.block
            for start in range(0, whole, self.block):
                self._put(ready[start : start + self.block])
            self.rest, self.waiting = [ready[whole:]], len(ready) - whole

    def _put(self, ids: np.ndarray) -> None:
        planes = to_planes(ids, self.planes)
        self.index.append([len(ids), self.at, *map(len, planes)])
        self.parts += planes
        self.at += sum(map(len, planes))

    def close(self, uri: str) -> None:
        if self.waiting:
            self._put(np.concatenate(self.rest))
        docs = np.concatenate([np.zeros(0, "<i8"), *self.docs])
        table = zstandard.ZstdCompressor(level=3).compress(
            docs.tobytes() + np.concatenate([np.zeros(0, np.uint8), *self.known]).tobytes()
            + np.concatenate([np.zeros(0, "<i8"), *self.lengths]).tobytes()
        )
        footer = [self.planes, self.block, len(self.index), len(docs), self.ids, self.at, len(table), self.at + len(table)]
        index = np.array(self.index, "<i8").tobytes()
        write_file(uri, [*self.parts, table, index, np.array(footer, "<i8").tobytes(), MAGIC])


class TokenReader:
    """Documents and any run of ids of one file."""

    def __init__(self, uri: str):
        self.data = read_file(uri)
        if bytes(self.data[:8]) != MAGIC or bytes(self.data[-8:]) != MAGIC:
            raise ValueError(f"not a whole token file: {uri}")
        footer = np.frombuffer(bytes(self.data[-8 - 8 * FOOTER : -8]), "<i8")
        self.planes, self.block, blocks, self.n_docs, self.n_ids, at, size, index = map(int, footer)
        raw = np.frombuffer(bytes(self.data[index : index + blocks * (2 + self.planes) * 8]), "<i8")
        self.index = raw.reshape(blocks, 2 + self.planes)
        table = zstandard.ZstdDecompressor().decompress(bytes(self.data[at : at + size]), max_output_size=max(1, 17 * self.n_docs))
        self.doc_ids = np.frombuffer(table, "<i8", self.n_docs)
        self.known = np.frombuffer(table, np.uint8, self.n_docs, 8 * self.n_docs).astype(bool)
        self.lengths = np.frombuffer(table, "<i8", self.n_docs, 9 * self.n_docs)

    def block_ids(self, k: int) -> np.ndarray:
        n, at, *sizes = map(int, self.index[k])
        ends = at + np.cumsum(sizes)
        return from_planes([bytes(self.data[e - s : e]) for e, s in zip(ends.tolist(), sizes, strict=True)], n)

    def ids(self, start: int, end: int) -> np.ndarray:
        first, last = start // self.block, -(-end // self.block)
        blocks = [self.block_ids(k) for k in range(first, last)]
        return np.concatenate([np.zeros(0, "<u4"), *blocks])[start - first * self.block : end - first * self.block]


class WordEncoder:
    """Ids of texts from the tokenizers library, each distinct word encoded once while it is remembered.

    For tokenizers that drop white space and never look across it; ASCII letters are lowered first, as such
    a tokenizer does itself. A mark that ends a clause is taken off the letter before it: the tokenizer
    splits there too, and fewer distinct words remain. A text that may hold one of the tokenizer's added tokens
    (case-sensitive, found before anything is lowered or split) goes to the library whole and as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.added = pc.ascii_lower(pa.array([t.content for t in added], pa.string())).to_pylist()
        self.all_whole = any(t.normalized for t in added)  # looked for in the normalised text, unlike here
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.closes[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int64)

    def _in_one_go(self, plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters alone, as one text: each ends at its only id that ends a word. Nothing if that doesn't hold."""
        found = self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids
        flat = np.array(found, np.uint32)
        ends = np.nonzero(self.closes[flat])[0] + 1 if len(flat) else np.zeros(0, np.int64)
        if len(ends) != len(plain):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return flat, np.diff(ends, prepend=0)

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalpha() and max(w) < "\u0250"]
        words = plain + [w for w in words if not (w.isalpha() and max(w) < "\u0250")]
        flat, sizes = self._in_one_go(plain)
        rest = [e.ids for e in self.tokenizer.encode_batch_fast(words[len(sizes) :], add_special_tokens=False)]
        sizes = np.concatenate([sizes, np.fromiter(map(len, rest), np.int64, len(rest))])
        flat = np.concatenate([flat, np.fromiter((i for ids in rest for i in ids), np.uint32)])
        n = len(self.place)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(words) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + len(words)] = sizes
        self.used += len(flat)
        self.place.update(zip(words, range(n, n + len(words)), strict=True))

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        text = large(text)
        lowered = pc.ascii_lower(text)
        whole = np.full(len(text), self.all_whole)
        for content in self.added:
            whole |= pc.match_substring(lowered, content).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._of_words(lowered)
        flat, per_text = self._of_words(pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), lowered))
        found = self.tokenizer.encode_batch_fast(text.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)
        sizes = np.fromiter((len(e.ids) for e in found), np.int64, len(found))
        at = np.repeat(np.cumsum(per_text)[whole], sizes)
        flat = np.insert(flat, at, np.fromiter((i for e in found for i in e.ids), np.uint32, len(at)))
        per_text[whole] = sizes
        return flat, per_text

    def _of_words(self, lowered: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = Words(pc.replace_substring_regex(lowered, r"([a-z0-9])([.,;:!?])", r"\1 \2"))
        vocab = words.vocab.to_pylist()
        if len(self.place) + len(vocab) > REMEMBERED:
            self._forget()
        if new := [w for w in vocab if w not in self.place]:
            self._learn(new)
        place = np.fromiter(map(self.place.__getitem__, vocab), np.int64, len(vocab))[words.ids]
        sizes = self.sizes[place]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(self.starts[place] - (ends - sizes), sizes) + np.arange(total)
        per_text = np.bincount(words.doc, weights=sizes, minlength=len(lowered)).astype(np.int64)
        return self.flat[take], per_text


def word_encoder(path: str) -> WordEncoder:
    """One per worker process."""
    return per_worker(WordEncoder, path)


@dataclass
class TokenFiles:
    """A written set of files. `manifest`: (uri, first id's place, ids, documents) in order."""

    spark: object
    manifest: list

    def documents(self) -> DataFrame:
        """Per document, read from the files: doc_id, start, n_tokens, ids_crc32 (of little-endian 32-bit ids)."""
        rows = self.spark.createDataFrame(self.manifest, "uri string, start long, n_ids long, n_docs long")

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield from _document_rows(TokenReader(row["uri"]), row["start"])

        dealt = rows.repartition(max(1, len(self.manifest)), "uri")
        return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _document_rows(reader: TokenReader, base: int, docs_at_once: int = 4096) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(reader.lengths)
    for first in range(0, reader.n_docs, docs_at_once):
        last = min(first + docs_at_once, reader.n_docs)
        begin = int(ends[first - 1]) if first else 0
        raw = memoryview(np.ascontiguousarray(reader.ids(begin, int(ends[last - 1]))).view(np.uint8))
        cuts = (ends[first:last] - begin).tolist()
        starts = [0, *cuts[:-1]]
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, cuts, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(reader.doc_ids[first:last], pa.int64(), mask=~reader.known[first:last]),
                pa.array(np.array(starts, np.int64) + begin + base), pa.array(reader.lengths[first:last].astype(np.int64)),
                pa.array(crc, pa.int64()),
            ],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    encoder = word_encoder(path)
    kind = np.dtype("<u2" if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
    for part in slices(batches):
        ids, sizes = encoder.encode(part.column("text"))
        ends = np.cumsum(sizes)
        packed = np.insert(ids.astype(kind), ends, end_id)
        cuts = np.concatenate([[0], np.cumsum(sizes + 1)]) * kind.itemsize
        data = pa.Array.from_buffers(
            pa.large_binary(), len(sizes), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(packed.tobytes())]
        ).cast(pa.binary())
        width = pa.array(np.full(len(sizes), kind.itemsize, np.int32))
        doc_id = part.column("doc_id")
        part_no = np.searchsorted(bounds, pc.fill_null(doc_id, -(1 << 63)).to_numpy(zero_copy_only=False)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(part_no), doc_id, width, data], names=["part", "doc_id", "width", "ids"])


def write_tokens(
    docs: DataFrame, path: str, end_id: int, folder: str | None = None, planes: int = 4, block: int = BLOCK,
    id_col: str = "doc_id", text_col: str = "text",
) -> TokenFiles:
    """Encode `docs`, append `end_id` to each and write them to files in `folder`, in ascending id order.

    `planes`: 4 (byte planes) or 32 (bit planes). A null text is empty: its end id alone. Rows with
    the same id are ordered by their ids' bytes, unknown ids come first. No rows: no files.
    """
    if planes not in (4, 32) or block % 8:
        raise ValueError("planes: 4 or 32; a block is a multiple of 8 ids")
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _encoded(batches, path, end_id, bounds)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        out = TokenWriter(planes, block)
        for batch in batches:
            if not batch.num_rows:
                continue
            known = pc.is_valid(batch.column("doc_id")).to_numpy(zero_copy_only=False)
            width = batch.column("width")[0].as_py()
            packed = batch.column("ids").cast(pa.large_binary())
            sizes = pc.binary_length(packed).to_numpy(zero_copy_only=False) // width
            ids = np.frombuffer(b"".join(packed.to_pylist()), f"<u{width}")
            out.add(pc.fill_null(batch.column("doc_id"), 0).to_numpy(zero_copy_only=False), known, sizes, ids)
        if out.docs:
            uri = f"{folder}/part-{number:06d}-{uuid.uuid4().hex}.tok"
            out.close(uri)
            yield pa.RecordBatch.from_pydict(
                {"part": [number], "uri": [uri], "n_ids": [out.ids], "n_docs": [sum(map(len, out.docs))]}
            )

    rows = texts(docs, id_col, text_col)
    bounds = id_bounds(rows, shuffle_parts(spark))
    packed = rows.mapInArrow(encode, "part int, doc_id long, width int, ids binary")
    ordered = packed.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "ids"
    )
    done = sorted(ordered.mapInArrow(write, "part long, uri string, n_ids long, n_docs long").collect())
    starts = np.concatenate([[0], np.cumsum([r.n_ids for r in done])]).tolist()
    return TokenFiles(spark, [(r.uri, int(s), r.n_ids, r.n_docs) for r, s in zip(done, starts, strict=False)])


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return write_tokens(docs, vocabulary("word_bpe_49k.json"), end_id=2).documents()
