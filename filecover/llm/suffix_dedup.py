"""Removal of repeated byte strings by distributed suffix sorting.

A byte goes if a string of `least` bytes that covers it also starts earlier, in a document of smaller id
or further up in its own. Only a small part of the suffixes can take part in a repeat, and equal strings
must meet in one task without every suffix being shuffled:

1. Anchors. A window of `least` bytes is known by the least hash among the 32-byte strings in it, so equal
   windows have equal anchors. Neighbouring windows with one anchor at one place form a run, 35 windows on average.
   Tasks count anchors, packed, and the partition of an anchor keeps those of two runs or more.
2. Runs of those anchors are cut out of the texts, each distinct one sent once per task with its first place,
   and dealt by anchor. An anchor of very many runs is dealt window by window, by the windows' own hashes, so
   no task gets the runs of a frequent line.
3. Each task sorts the suffixes of its runs by difference cover (suffix_sort): triples of sampled
   suffixes are named, names are sorted by recursion, and the other suffixes are merged in. Neighbours that
   share `least` bytes are the same string; its first place decides which of its windows go.
4. The verdict on each distinct run (its first place, and which of its windows go even there) is looked up by a
   last scan of the texts: later copies of a run go whole.

Texts are shuffled only as distinct runs. Anchors and verdicts lie in mapped arrays in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, MIX, large, mixed, shuffle_parts, slices, texts, written
from .hash_store import HashStore, part_of, write_store
from .suffix_sort import equal_prefixes, suffix_array

#: An anchor of more runs is dealt window by window.
FREQUENT = 4096
#: Bytes of texts whose anchors, and of runs, that a task gathers before it sends them.
TEXT_AT_ONCE, RUNS_AT_ONCE = 48 << 20, 24 << 20
#: Symbols sorted at once; all runs of an anchor are sorted together.
SORTED_AT_ONCE = 1 << 16
#: Bytes of texts looked at together: hashes of so many stay in the processor's cache.
SLICE = 1 << 18
#: Unknown ids come before all others.
UNKNOWN = -(1 << 63)


@dataclass
class Runs:
    """Of a slice: its bytes, where texts start and end, and runs: first window, number of windows, anchor."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray

    def rows(self) -> np.ndarray:
        return np.searchsorted(self.bounds, self.start, side="right") - 1


def _gram_hashes(data: np.ndarray, words: int) -> np.ndarray:
    """A hash of the string of 8 x `words` bytes at each place."""
    raw = data.tobytes()
    eight = np.ndarray((len(data) - 7,), np.dtype("<u8"), raw, strides=(1,)) * MIX
    eight ^= eight >> np.uint64(31)
    n = len(data) - 8 * words + 1
    found = eight[:n] * FOLD
    for k in range(1, words):
        found = (found ^ (found >> np.uint64(29))) * MIX + eight[8 * k : 8 * k + n]
    return mixed(found)


def find_runs(text: pa.Array, least: int) -> Runs:
    text = large(text)
    sizes = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(text) else np.zeros(0, np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < least:
        return Runs(data, bounds, none, none, none.astype(np.uint64))
    words = max(1, least // 24)
    hashes = _gram_hashes(data, words)
    # The upper half of the hash decides, then the place: a run has one place of its anchor.
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    wanted, width = least - 8 * words + 1, 1
    while 2 * width <= wanted:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if wanted > width:
        low = np.minimum(low[: len(low) - (wanted - width)], low[wanted - width :])
    room = np.maximum(sizes - least + 1, 0)  # windows of each text
    edges = np.zeros(len(low) + 1, np.int64)
    some = room > 0
    np.add.at(edges, bounds[:-1][some], 1)
    np.add.at(edges, bounds[:-1][some] + room[some], -1)
    valid = np.cumsum(edges[:-1]) > 0
    opens = np.zeros(len(low), bool)
    opens[bounds[:-1][some]] = True  # texts without bytes between them: the next one's windows start anew
    new = valid & (opens | np.concatenate([[True], (low[1:] != low[:-1]) | ~valid[:-1]]))
    start = np.nonzero(new)[0]
    closes = np.append(start[1:], len(low))
    row = np.searchsorted(bounds, start, side="right") - 1
    windows = np.minimum(closes, bounds[row] + room[row]) - start
    return Runs(data, bounds, start, windows, hashes[(low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)])


def _packed(part: np.ndarray, parts: int, columns: list[np.ndarray], bodies: list[bytes] | None) -> Iterator[pa.RecordBatch]:
    """Rows (part, n, packed): columns of 64-bit values, and the byte strings, of each partition."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for p in range(parts):
        rows = order[cuts[p] : cuts[p + 1]]
        if len(rows):
            head = [np.ascontiguousarray(c[rows].view(np.uint8).reshape(len(rows), 8).T).tobytes() for c in columns]
            body = [bodies[i] for i in rows.tolist()] if bodies is not None else []
            data = squeeze(b"".join(head + body))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([data], pa.binary())], names=["part", "n", "packed"]
            )


def _unpacked(batch: pa.RecordBatch, columns: int) -> Iterator[tuple[list[np.ndarray], bytes]]:
    expand = zstandard.ZstdDecompressor().decompress
    for n, data in zip(batch.column("n").to_pylist(), batch.column("packed").to_pylist(), strict=True):
        raw = expand(data)
        yield [
            np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8 * n * k).reshape(8, n).T).view(np.uint64).reshape(-1)
            for k in range(columns)
        ], raw[8 * n * columns :]


_PACKED = "part int, n long, packed binary"


def _counted_anchors(batches: Iterator[pa.RecordBatch], least: int, parts: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        anchor, count = np.unique(np.concatenate(held), return_counts=True)
        yield from _packed(part_of(anchor, parts), parts, [anchor, count.astype(np.uint64)], None)

    for part in slices(batches, SLICE):
        runs = find_runs(part.column("text"), least)
        held.append(runs.anchor)
        size += len(runs.data)
        if size >= TEXT_AT_ONCE:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [columns for batch in batches for columns, _ in _unpacked(batch, 2)]
    if got:
        anchor, back = np.unique(np.concatenate([c[0] for c in got]), return_inverse=True)
        count = np.bincount(back, weights=np.concatenate([c[1] for c in got]).astype(np.float64)).astype(np.int64)
        twice = count > 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor[twice].view(np.int64)), pa.array(count[twice])], names=["key", "runs"]
        )


class Pieces:
    """The runs of a slice that may repeat, those of frequent anchors window by window."""

    def __init__(self, text: pa.Array, least: int, anchors: HashStore):
        runs = find_runs(text, least)
        there, values, _ = anchors.find(runs.anchor)
        row, start, windows, anchor = (c[there] for c in (runs.rows(), runs.start, runs.windows, runs.anchor))
        frequent = values[there, 0] > FREQUENT
        times = np.where(frequent, windows, 1)
        step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        self.single = np.repeat(frequent, times)
        self.start = np.repeat(start, times) + np.where(self.single, step, 0)
        self.windows = np.where(self.single, 1, np.repeat(windows, times))
        self.row = np.repeat(row, times)
        self.anchor = np.repeat(anchor, times)
        self.offset = self.start - runs.bounds[self.row]
        self.sizes = np.diff(runs.bounds)
        self.bounds, self.data = runs.bounds, runs.data
        raw = memoryview(np.ascontiguousarray(runs.data))
        spans = zip(self.start.tolist(), (self.start + self.windows + least - 1).tolist(), strict=True)
        self.bodies = [bytes(raw[a:b]) for a, b in spans]
        both = b"".join([xxhash.xxh3_128_digest(b) for b in self.bodies])
        pairs = np.frombuffer(both, ">u8").reshape(-1, 2)
        self.key, self.check = pairs[:, 0].astype(np.uint64), pairs[:, 1].astype(np.uint64)
        self.group = np.where(self.single, self.key, self.anchor)  # where equal windows meet


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(batch.column("doc_id"), UNKNOWN).to_numpy(zero_copy_only=False).astype(np.int64)


def _first_of_each(key: np.ndarray, doc: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are first (by id, then place) of their key, and whether a later one follows."""
    order = np.lexsort((offset, doc, key))
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    first = order[new]
    group = np.cumsum(new) - 1
    later = (doc[order] != doc[first][group]) | (offset[order] != offset[first][group])
    return first, np.bincount(group, weights=later, minlength=len(first)) > 0


def _sent_runs(batches: Iterator[pa.RecordBatch], least: int, parts: int, anchors: HashStore) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, list] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        group, doc, offset, more, length = (np.array(c) for c in zip(*held.values(), strict=True))
        group = group.astype(np.uint64)
        columns = [group, doc.astype(np.int64).view(np.uint64), offset.astype(np.uint64), more.astype(np.uint64), length.astype(np.uint64)]
        yield from _packed(part_of(group, parts), parts, columns, list(held))

    for part in slices(batches, SLICE):
        pieces = Pieces(part.column("text"), least, anchors)
        if not len(pieces.start):
            continue
        doc = _ids(part)[pieces.row]
        first, more = _first_of_each(pieces.key ^ pieces.check, doc, pieces.offset)
        for i, repeated in zip(first.tolist(), more.tolist(), strict=True):
            body = pieces.bodies[i]
            place = (int(doc[i]), int(pieces.offset[i]))
            known = held.get(body)
            if known is None:
                held[body] = [int(pieces.group[i]), *place, repeated, len(body)]
                size += len(body)
            else:
                known[3] = known[3] or repeated or (known[1], known[2]) != place
                if place < (known[1], known[2]):
                    known[1:3] = place
        if size >= RUNS_AT_ONCE:
            yield from flush()
            held, size = {}, 0
    if held:
        yield from flush()


def _judged(bodies: list[bytes], doc: np.ndarray, offset: np.ndarray, least: int) -> list[np.ndarray]:
    """Per run, which windows go at its own place: those whose string starts earlier in another run, or in this one."""
    lengths = np.fromiter(map(len, bodies), np.int64, len(bodies))
    data = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    starts = np.cumsum(lengths + 1) - lengths - 1
    run = np.repeat(np.arange(len(bodies)), lengths + 1)
    symbols = data.astype(np.int64) + len(bodies) + 1
    symbols[starts + lengths] = np.arange(1, len(bodies) + 1)  # each run ends with a symbol of its own
    order = suffix_array(symbols)
    inside = order - starts[run[order]]
    order = order[inside <= (lengths - least)[run[order]]]  # places that start a window
    same = equal_prefixes(data, order, least)
    group = np.cumsum(~same) - 1
    shared = np.bincount(group)[group] > 1
    order, group = order[shared], group[shared]
    own_run = run[order]
    own_offset = offset[own_run] + order - starts[own_run]
    by = np.lexsort((own_offset, doc[own_run], group))
    g = group[by]
    new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    first = by[new][np.cumsum(new) - 1]
    later = (doc[own_run[first]] != doc[own_run[by]]) | (own_offset[first] != own_offset[by])
    gone = np.zeros(len(data), bool)
    gone[order[by[later]]] = True
    return [gone[s : s + n - least + 1] for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]


def _verdicts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, list] = {}
    for batch in batches:
        for (group, doc, offset, more, length), raw in _unpacked(batch, 5):
            at = 0
            rows = zip(group.tolist(), doc.view(np.int64).tolist(), offset.tolist(), more.tolist(), length.tolist(), strict=True)
            for g, d, o, m, n in rows:
                body = raw[at : at + n]
                at += n
                known = held.get(body)
                if known is None:
                    held[body] = [g, d, o, bool(m)]
                else:
                    known[3] = known[3] or bool(m) or (known[1], known[2]) != (d, o)
                    if (d, o) < (known[1], known[2]):
                        known[1:3] = d, o
    if not held:
        return
    bodies = list(held)
    group, doc, offset, more = (np.array(c) for c in zip(*held.values(), strict=True))
    held.clear()
    order = np.argsort(group.astype(np.uint64), kind="stable")
    new = np.concatenate([[True], np.diff(group[order].astype(np.uint64)) != 0])
    # A run has its anchor once, so its own windows differ, and one that is alone under its anchor has nothing to be compared with.
    alone = (np.bincount(np.cumsum(new) - 1) == 1)[np.cumsum(new) - 1]
    lone, order, new = order[alone], order[~alone], new[~alone]
    sizes = np.fromiter((len(bodies[i]) + 1 for i in order.tolist()), np.int64, len(order))
    at = np.cumsum(sizes) - sizes
    share = (at[new] // SORTED_AT_ONCE)[np.cumsum(new) - 1]  # groups whole
    none = np.zeros(1, bool)
    shares = [(cut, True) for cut in np.split(order, np.nonzero(np.diff(share))[0] + 1) if len(cut)]
    shares += [(cut, False) for cut in np.array_split(lone, len(lone) // 10_000 + 1) if len(cut)]
    for cut, together in shares:
        own = [bodies[i] for i in cut.tolist()]
        gone = _judged(own, doc[cut].astype(np.int64), offset[cut].astype(np.int64), least) if together else [none] * len(own)
        kept = [k for k, g in enumerate(gone) if more[cut[k]] or g.any()]
        if kept:
            digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(own[k]) for k in kept]), ">u8").reshape(-1, 2)
            rows = cut[kept]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(digests[:, 0].astype(np.uint64).view(np.int64)), pa.array(digests[:, 1].astype(np.uint64).view(np.int64)),
                    pa.array(doc[rows].astype(np.int64)), pa.array(offset[rows].astype(np.int64)),
                    pa.array([_spans(gone[k], least) for k in kept], pa.binary()),
                ],
                names=["key", "check", "doc", "at", "spans"],
            )


def _spans(gone: np.ndarray, least: int) -> bytes:
    """Byte spans covered by the windows that go, as pairs of 64-bit numbers from the run's start."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    return np.stack([edges[::2], edges[1::2] + least - 1], axis=1).astype("<i8").tobytes()


def _marked(batch: pa.RecordBatch, least: int, anchors: HashStore, verdicts: HashStore) -> tuple[Pieces, np.ndarray]:
    """The bytes of a slice that go."""
    pieces = Pieces(batch.column("text"), least, anchors)
    edges = np.zeros(len(pieces.data) + 1, np.int64)
    if len(pieces.start):
        doc = _ids(batch)[pieces.row]
        there, values, spans = verdicts.find(pieces.key)
        there &= values[:, 0].view(np.uint64) == pieces.check
        later = there & ((values[:, 1] < doc) | ((values[:, 1] == doc) & (values[:, 2] < pieces.offset)))
        np.add.at(edges, pieces.start[later], 1)
        np.add.at(edges, (pieces.start + pieces.windows + least - 1)[later], -1)
        for i in np.nonzero(there & ~later)[0].tolist():
            own = np.frombuffer(spans[i], "<i8").reshape(-1, 2) + pieces.start[i]
            np.add.at(edges, own[:, 0], 1)
            np.add.at(edges, own[:, 1], -1)
    return pieces, np.cumsum(edges[:-1]) > 0


def whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """The bytes that go, without those of characters that stay in part."""
    lead = (data & 0xC0) != 0x80
    if not len(data):
        return gone
    first = np.nonzero(lead)[0]
    char = np.cumsum(lead) - 1
    return np.logical_and.reduceat(gone, first)[char] if len(first) else gone


SCHEMA = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept_bytes binary"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _answer(batch: pa.RecordBatch, pieces: Pieces, gone: np.ndarray) -> pa.RecordBatch:
    sums = np.concatenate([[0], np.cumsum(gone)])
    removed = sums[pieces.bounds[1:]] - sums[pieces.bounds[:-1]]
    row_start = np.zeros(len(gone) + 1, bool)
    row_start[pieces.bounds] = True
    before = np.concatenate([[False], gone[:-1]])
    opens = np.nonzero(gone & (~before | row_start[:-1]))[0]
    after = np.concatenate([gone[1:], [False]])
    ends = np.nonzero(gone & (~after | row_start[1:]))[0] + 1
    row = np.searchsorted(pieces.bounds, opens, side="right") - 1
    counts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
    base = pieces.bounds[row]
    spans = pa.StructArray.from_arrays([pa.array(opens - base), pa.array(ends - base)], fields=list(_SPAN))
    stays = pieces.data[~gone].tobytes()
    cuts = np.concatenate([[0], np.cumsum(pieces.sizes - removed)])
    kept = pa.array([stays[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(pieces.sizes), pa.array(removed), pa.ListArray.from_arrays(pa.array(counts), spans), kept],
        names=["doc_id", "n_bytes", "n_removed", "spans", "kept_bytes"],
    )


def _looked_up(rows: DataFrame, least: int) -> tuple[HashStore, HashStore]:
    """Anchors that repeat, and the verdicts on their runs, of rows (doc_id, text)."""
    if least < 16:
        raise ValueError("least: 16 bytes or more")
    parts = shuffle_parts(rows.sparkSession)

    def count(batches):
        yield from _counted_anchors(batches, least, parts)

    def together(packed: DataFrame) -> DataFrame:
        return packed.repartitionById(parts, F.col("part"))

    anchors = write_store(together(rows.mapInArrow(count, _PACKED)).mapInArrow(_repeated_anchors, "key long, runs long"), "anchors")

    def send(batches):
        yield from _sent_runs(batches, least, parts, anchors)

    def judge(batches):
        yield from _verdicts(batches, least)

    found = together(rows.mapInArrow(send, _PACKED)).mapInArrow(judge, "key long, check long, doc long, at long, spans binary")
    return anchors, write_store(written(found, "verdicts"), "verdicts")


def suffix_dedup(
    docs: DataFrame, least: int = 100, characters: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, the spans that go (bytes), and the bytes that stay.

    `characters`: characters of which only a part would go stay whole, so that the rest is valid UTF-8.
    A null text is empty. Rows with the same id and text stand at the same places, so
    neither counts as earlier; unknown ids come before all others. Texts shorter than `least` stay.
    """
    rows = texts(docs, id_col, text_col)
    anchors, verdicts = _looked_up(rows, least)

    def answer(batches):
        for part in slices(batches, SLICE):
            pieces, gone = _marked(part, least, anchors, verdicts)
            yield _answer(part, pieces, whole_characters(pieces.data, gone) if characters else gone)

    return rows.mapInArrow(answer, SCHEMA)


def without_repeats(docs: DataFrame, least: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, without repeated strings (whole characters). Texts of which nothing stays go."""
    anchors, verdicts = _looked_up(texts(docs, id_col, text_col), least)

    def cut(batches):
        for part in slices(batches, SLICE, text_col):
            own = pa.RecordBatch.from_arrays(
                [part.column(id_col).cast(pa.int64()), part.column(text_col).cast(pa.string())], names=["doc_id", "text"]
            )
            pieces, gone = _marked(own, least, anchors, verdicts)
            answer = _answer(own, pieces, whole_characters(pieces.data, gone))
            at = part.schema.get_field_index(text_col)
            left = pc.if_else(pc.is_valid(part.column(at)), answer.column("kept_bytes").cast(pa.string()), pa.scalar(None, pa.string()))
            rest = part.set_column(at, part.schema.field(at), left.cast(part.schema.field(at).type))
            emptied = pc.and_(pc.greater(answer.column("n_removed"), 0), pc.equal(answer.column("n_removed"), answer.column("n_bytes")))
            yield rest.filter(pc.invert(emptied))

    return docs.mapInArrow(cut, docs.schema)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = suffix_dedup(docs, 100)
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256")
    )
