"""MinHash near-duplicates, verified in sequence by Bayesian bounds and then exactly.

1. Each text becomes its set of word shingles (64-bit hashes). Texts with equal sets are one class from
   then on: a digest of the set brings them together after a partial aggregation, so copies cost nothing.
2. A class has `bands` x `rows` minimum hashes of 16 bits. Classes that agree on a band share a bucket.
   First every class is paired with the head of its bucket, the class of most copies (a star: one pair less
   than classes), and links that verify give components. A bucket whose classes are all in one component is
   done. What else stood in a bucket with the same head is a group: its classes are compared block by block in
   tasks, only across components, and a task returns no more links than it takes to join them. So no
   pair that could join components is left out, and no group's pairs become rows.
3. A pair's signatures are compared batch by batch. With m of n hashes equal and a uniform prior, the
   similarity is Beta(m + 1, n - m + 1); a pair is dropped as soon as the posterior probability of
   reaching the threshold falls below `miss`. Survivors are verified on their full sets.
4. Components spread by the least neighbour, with pointer jumping, in written tables.

A pair at the threshold is missed by all bands with probability (1 - s^rows)^bands, 6e-7 as set.
Texts of the classes to verify come from another scan that looks them up in mapped arrays, so only
those texts are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, joined, large, mixed, per_worker, slices, texts, written
from .hash_store import write_store

_FIXED_SEED = 20_240_501
#: Bytes of texts worked on at once.
SLICE = 1 << 20
#: Classes of a group compared in one block, pairs at once, and shingles at once.
BLOCK, PAIRS_AT_ONCE, COLUMNS = 1024, 1 << 17, 2048


def shingle_sets(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text by text and in order, and how many each text has.

    A text of fewer than `width` words has one: its whole sequence. A text without words has none.
    """
    words = Words(pc.ascii_lower(large(text)))
    hashes = words.hashes()[words.ids] if len(words.ids) else np.zeros(0, np.uint64)
    n, starts = words.n, words.start
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        rolled = joined(rolled, hashes[k : k + len(rolled)])
    last = starts[1:] - width  # a text's last shingle starts here
    inside = np.arange(len(rolled)) <= last[words.doc[: len(rolled)]] if len(rolled) else np.zeros(0, bool)
    found, doc = rolled[inside], words.doc[: len(rolled)][inside]
    short = np.nonzero((n > 0) & (n < width))[0]
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short.tolist()):
            own = np.full(1, n[d], np.uint64)
            for h in hashes[starts[d] : starts[d + 1]]:
                own = joined(own, np.array([h]))
            whole[i] = own[0]
        found, doc = np.concatenate([found, whole]), np.concatenate([doc, short])
    order = np.argsort(found)
    order = order[np.argsort(doc[order].astype(np.uint16) if len(n) < 1 << 16 else doc[order], kind="stable")]
    found, doc = found[order], doc[order]
    new = np.concatenate([[True], (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])]) if len(found) else np.zeros(0, bool)
    return found[new], np.bincount(doc[new], minlength=len(n)).astype(np.int64)


def digests(shingles: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that identify a set, whatever the order; 0 for an empty one."""
    starts = np.cumsum(sizes) - sizes
    full = sizes > 0
    out = []
    for salt in (0x1234567, 0x7654321):
        sums = np.zeros(len(sizes), np.uint64)
        if full.any():
            sums[full] = np.add.reduceat(mixed(shingles ^ np.uint64(salt)), starts[full])
        out.append(sums)
    return out[0], out[1]


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(_FIXED_SEED)
    return draw.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, count, np.uint64)


def signatures(shingles: np.ndarray, sizes: np.ndarray, count: int) -> np.ndarray:
    """16 bits of each of `count` minimum hashes per set; zeros for an empty set."""
    found = np.zeros((len(sizes), count), np.uint16)
    full = sizes > 0
    if full.any():
        starts = (np.cumsum(sizes) - sizes)[full]
        for k, (factor, salt) in enumerate(zip(*per_worker(_functions, count), strict=True)):
            least = np.minimum.reduceat((shingles ^ salt) * factor, starts)
            found[full, k] = (mixed(least) >> np.uint64(48)).astype(np.uint16)
    return found


def _classed(batches: Iterator[pa.RecordBatch], width: int, count: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, SLICE):
        shingles, sizes = shingle_sets(part.column("text"), width)
        key, check = digests(shingles, sizes)
        signs = signatures(shingles, sizes, count)
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"), pa.array(sizes), pa.array(key.view(np.int64)), pa.array(check.view(np.int64)),
                pa.array([s.tobytes() for s in signs], pa.binary()),
            ],
            names=["doc_id", "n_shingles", "key", "check", "signature"],
        )


def least_matches(count: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int, int]]:
    """Per batch: its first and last hash, and the fewest matches so far with which a pair goes on.

    P(s >= t) under Beta(m + 1, n - m + 1) is the chance of at most m successes in n + 1 trials of t.
    """
    rows = []
    for end in range(batch, count + batch, batch):
        n = min(end, count)
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        rows.append((end - batch, n, m))
    return rows


def plausible(left: np.ndarray, right: np.ndarray, threshold: float, miss: float, batch: int = 36) -> np.ndarray:
    """Which pairs of signatures (a row each) stand all batches."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for start, end, least in per_worker(least_matches, left.shape[1], batch, threshold, miss):
        matches[alive] += (left[alive, start:end] == right[alive, start:end]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    return alive


def _surviving(pairs: DataFrame, classes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs (a, b) of class keys that their signatures don't rule out."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sides = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sa", "sb")]
                kept = pa.array(plausible(*sides, threshold, miss))
                yield pa.RecordBatch.from_arrays([batch.column("a").take(kept), batch.column("b").take(kept)], names=["a", "b"])

    signs = classes.select("key", "signature")
    both = pairs.join(signs.withColumnsRenamed({"key": "a", "signature": "sa"}), "a").join(
        signs.withColumnsRenamed({"key": "b", "signature": "sb"}), "b"
    )
    return both.select("a", "b", "sa", "sb").mapInArrow(sift, "a long, b long")


def _texts_of(wanted: DataFrame, rows: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(key, text) of the wanted class keys, a row each."""
    known = wanted.distinct().join(classes.select("key", "rep"), "key")
    store = write_store(known.select("key", F.coalesce("rep", F.lit(0)).alias("rep")), "wanted")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE):
            key, _ = digests(*shingle_sets(part.column("text"), width))
            there, values, _ = store.find(key)
            own = pc.fill_null(part.column("doc_id"), 0).to_numpy(zero_copy_only=False)
            chosen = pa.array(np.nonzero(there & (values[:, 0] == own))[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)).take(chosen), part.column("text").take(chosen)], names=["key", "text"]
            )

    # Repeated rows of one id and text are one.
    return written(rows.mapInArrow(pick, "key long, text string").groupBy("key").agg(F.min("text").alias("text")), "texts")


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE, "ta"):
            sides = [shingle_sets(batch.column(c), width) for c in ("ta", "tb")]
            row = [np.repeat(np.arange(batch.num_rows), sizes) for _, sizes in sides]
            both = np.concatenate([s for s, _ in sides])
            at = np.concatenate(row)
            order = np.lexsort((both, at))
            both, at = both[order], at[order]
            shared = np.bincount(at[1:][(both[1:] == both[:-1]) & (at[1:] == at[:-1])], minlength=batch.num_rows)
            union = sides[0][1] + sides[1][1] - shared
            kept = pa.array(np.nonzero(100 * shared >= percent * union)[0])
            yield pa.RecordBatch.from_arrays([batch.column("a").take(kept), batch.column("b").take(kept)], names=["a", "b"])

    found = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("key")), rows, classes, width)
    both = pairs.join(found.withColumnsRenamed({"key": "a", "text": "ta"}), "a").join(
        found.withColumnsRenamed({"key": "b", "text": "tb"}), "b"
    )
    return written(both.select("a", "b", "ta", "tb").mapInArrow(confirm, "a long, b long"), "links")


@dataclass
class Members:
    """Classes of a group: their keys, components, blocks, signatures and sets."""

    key: np.ndarray
    root: np.ndarray
    block: np.ndarray
    signature: np.ndarray
    shingles: np.ndarray
    sizes: np.ndarray

    def shared(self) -> np.ndarray:
        """How many shingles each two sets share. Shingles of one set alone can't matter."""
        n = len(self.key)
        row = np.repeat(np.arange(n), self.sizes)
        _, code, times = np.unique(self.shingles, return_inverse=True, return_counts=True)
        matters = times[code] > 1
        row, code = row[matters], np.unique(code[matters], return_inverse=True)[1]
        counts = np.zeros((n, n), np.float32)
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        for start in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
            a, b = np.searchsorted(code, [start, start + COLUMNS])
            held = np.zeros((n, COLUMNS), np.float32)
            held[row[a:b], code[a:b] - start] = 1
            counts += held @ held.T
        return counts.astype(np.int64)

    def links(self, blocks: tuple[int, int], percent: int, miss: float) -> list[tuple[int, int]]:
        """Links that join components, between the two blocks or within the one."""
        left, right = ((np.nonzero(self.block == b)[0]) for b in blocks)
        lead = {int(r): int(r) for r in np.unique(self.root)}

        def leader(r: int) -> int:
            while lead[r] != r:
                lead[r] = lead[lead[r]]
                r = lead[r]
            return r

        found: list[tuple[int, int]] = []
        counts = None
        step = max(1, PAIRS_AT_ONCE // max(1, len(right)))
        for start in range(0, len(left), step):
            a, b = (x.ravel() for x in np.meshgrid(left[start : start + step], right, indexing="ij"))
            current = np.array([leader(int(r)) for r in self.root])
            apart = (current[a] != current[b]) & ((a < b) | (blocks[0] != blocks[1]))
            a, b = a[apart], b[apart]
            alive = plausible(self.signature[a], self.signature[b], percent / 100, miss)
            a, b = a[alive], b[alive]
            if not len(a):
                continue
            counts = self.shared() if counts is None else counts
            linked = 100 * counts[a, b] >= percent * (self.sizes[a] + self.sizes[b] - counts[a, b])
            for i, j in zip(a[linked].tolist(), b[linked].tolist(), strict=True):
                x, y = leader(int(self.root[i])), leader(int(self.root[j]))
                if x != y:
                    lead[max(x, y)] = min(x, y)
                    found.append((int(self.key[i]), int(self.key[j])))
        return found


def _grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple[int, int], Members]]:
    """Groups of rows in order of (head, i, j), with their sets."""
    held: list[Members] = []
    current: tuple | None = None

    def merged() -> Members:
        return Members(*(np.concatenate([getattr(m, f) for m in held]) for f in Members.__dataclass_fields__))

    for part in slices(batches, SLICE):
        shingles, sizes = shingle_sets(part.column("text"), width)
        ends = np.cumsum(sizes)
        head, i, j, key, root, block = (
            part.column(c).to_numpy(zero_copy_only=False) for c in ("head", "i", "j", "key", "root", "block")
        )
        signature = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(part.num_rows, -1)
        new = np.nonzero(np.concatenate([[True], (np.diff(head) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)]))[0]
        for a, b in zip(new.tolist(), [*new[1:].tolist(), part.num_rows], strict=True):
            group = (int(head[a]), int(i[a]), int(j[a]))
            if held and group != current:
                yield current[1:], merged()
                held = []
            current = group
            held.append(
                Members(key[a:b], root[a:b], block[a:b], signature[a:b], shingles[ends[a] - sizes[a] : ends[b - 1]], sizes[a:b])
            )
    if held:
        yield current[1:], merged()


def _group_links(
    crowded: DataFrame, roots: DataFrame, rows: DataFrame, classes: DataFrame, width: int, percent: int, miss: float
) -> DataFrame:
    """Links between components among classes that share a bucket, found block by block."""
    placed = crowded.join(roots, "key")
    split = placed.groupBy("bucket").agg((F.min("root") != F.max("root")).alias("split")).where("split").select("bucket")
    members = written(placed.join(split, "bucket").select("head", "key", "root").distinct(), "members")
    found = _texts_of(members.select("key"), rows, classes, width)
    blocks = members.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = (
        members.join(blocks, "head")
        .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
    )
    full = dealt.join(found, "key").join(classes.select("key", "signature"), "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks_, group in _grouped(batches, width):
            if links := group.links(blocks_, percent, miss):
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    ordered = (
        full.select("head", "i", "j", "key", "root", "block", "signature", "text")
        .repartition("head", "i", "j")
        .sortWithinPartitions("head", "i", "j")
    )
    return written(ordered.mapInArrow(compare, "a long, b long"), "links")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(key, root): the least key that links lead to. Nodes without links are their own root.

    Each round a node takes the least root among its own, its neighbours' and its root's.
    """
    both = written(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    state = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "key"), "roots")
    while True:
        near = both.join(state.withColumnsRenamed({"key": "b", "root": "near"}), "b").groupBy("a").agg(F.min("near").alias("near"))
        above = state.select(F.col("key").alias("root"), F.col("root").alias("above"))
        step = (
            state.join(near.withColumnRenamed("a", "key"), "key", "left")
            .join(above, "root", "left")
            .select("key", F.least("root", "near", "above").alias("next"), "root")
        )
        done = written(step, "roots")
        if done.where(F.col("next") != F.col("root")).isEmpty():
            break
        state = done.select("key", F.col("next").alias("root"))
    return nodes.join(state, "key", "left").select("key", F.coalesce("root", "key").alias("root"))


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 36, rows_per_band: int = 5, miss: float = 1e-6,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Sets of `width`-word shingles are linked if 100 x intersection >= `percent` x union; component_id is the
    smallest id reachable over links, and that row is kept. A text without words links with nothing:
    its component is its own id. Rows with an unknown id link as others do; a component of unknown ids alone has
    an unknown id, and they are kept. Rows of the same id and text are kept alike.
    """
    rows = texts(docs, id_col, text_col)
    count = bands * rows_per_band

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _classed(batches, width, count)

    own = written(
        rows.mapInArrow(classify, "doc_id long, n_shingles long, key long, check long, signature binary"), "sets"
    )
    full = own.where("n_shingles > 0")
    classes = written(full.groupBy("key", "check").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.count(F.lit(1)).alias("copies")), "classes")
    size = 2 * rows_per_band
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.substring(F.col("signature"), b * size + 1, F.lit(size)))
    )
    buckets = classes.select("key", "copies", F.explode(keys).alias("bucket"))
    heads = buckets.groupBy("bucket").agg(
        F.max(F.struct("copies", "key")).alias("most"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").select("bucket", F.col("most.key").alias("head"))
    crowded = written(buckets.select("bucket", "key").join(heads, "bucket"), "buckets")
    stars = crowded.where("key != head").select(F.col("head").alias("a"), F.col("key").alias("b")).distinct()
    links = _verified(written(_surviving(stars, classes, percent / 100, miss), "pairs"), rows, classes, width, percent)
    nodes = classes.select("key")
    roots = written(components(nodes, links), "components")
    more = _group_links(crowded, roots, rows, classes, width, percent, miss)
    if not more.isEmpty():
        roots = written(components(nodes, links.union(more)), "components")
    least = roots.join(classes.select("key", "rep"), "key").groupBy("root").agg(F.min("rep").alias("component"))
    of_key = roots.join(least, "root").select("key", "component")
    return own.select("doc_id", "n_shingles", "key").join(of_key, "key", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of `docs`, with all their columns, that `near_duplicates` keeps; of equal rows one stays."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **parameters)
    ids = written(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).where("kept"), "kept")
    store = write_store(ids.where("doc_id is not null").select(F.col("doc_id").alias("key"), (F.col("n") > 1).cast("long").alias("again")), "kept")
    unknown = not ids.where("doc_id is null").isEmpty()

    @F.arrow_udf("long")
    def again(ids: pa.Array) -> pa.Array:
        """0 for a kept id that occurs once, 1 if it occurs more often, else null; unknown ids are among the latter."""
        there, values, _ = store.find(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        null = pc.is_null(ids).to_numpy(zero_copy_only=False)
        return pa.array(np.where(null, 1, values[:, 0]), mask=np.where(null, not unknown, ~there))

    def rows(times: int) -> DataFrame:
        """Kept rows whose id occurs once (0), or more often (1). Only ids go to Python and back."""
        return docs.where(again(docs[id_col].cast("long")) == times)

    # Texts are filtered where they are read; only rows of repeated ids are shuffled, to keep one of those that are equal.
    same = rows(1).withColumn("__near_text", F.xxhash64(text_col)).dropDuplicates([id_col, "__near_text"]).drop("__near_text")
    return rows(0).unionByName(same)


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, width=4, percent=80)
