"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within them, one vector of each group.

1. Equal vectors become one class (two 64-bit hashes of the vector, after a partial aggregation), so copies cost nothing.
2. Spherical k-means is fitted by Spark on a hash sample of `SAMPLE` classes per cell; every class then has
   the cell of its nearest centre as its home.
3. A class visits other cells too, by a rule that loses no link. Let x be at home with centre a and y with b. The
   plane halfway between a and b separates them, so the angle between x and y is at least the sum of
   their angles to that plane. Two vectors within the angle of the threshold therefore have one of the two within half
   that angle of the plane, and that one visits the other's cell: x visits b if x.a - x.b <= |a - b| sin(angle / 2).
4. Homes of a cell are compared with all that are in it (homes and visitors), block by block, by matrix products: in single
   precision for all, with a margin that no rounding exceeds, and in double precision where that leaves a pair. A block
   returns a row per class that has links: how many, and the least class it is joined to.
   Pairs never become rows. A pair that meets in both cells counts once for each side.
5. Classes are joined to components by the least id.

Centres are the one thing that travels to tasks: at most CENTRES_BYTES, checked when their number is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hand_back, written
from .near_dedup import components

#: Classes per cell aimed at, classes of the sample per cell, rounds of k-means, and what all centres may take.
#: A row that is dealt to a cell costs as much as some thousand products, so cells are no smaller.
CELL, SAMPLE, ROUNDS, CENTRES_BYTES = 4096, 64, 4, 64 << 20
#: Homes and members of a block at most, the bytes that the vectors of either may take, and similarities worked on at once.
HOMES, MEMBERS, BLOCK_BYTES, AT_ONCE = 8192, 16384, 8 << 20, 1 << 18
#: Stands for an unknown id among classes: the largest, so that known ones come first.
UNKNOWN = (1 << 63) - 1


def unit_rows(packed: pa.Array, dims: int) -> np.ndarray:
    """Vectors of little-endian doubles as rows of length 1; shorter ones are continued by zeros."""
    data = packed.to_pylist()
    if all(len(d) == 8 * dims for d in data):
        rows = np.frombuffer(b"".join(data), "<f8").reshape(-1, dims).copy()
    else:
        rows = np.zeros((len(data), dims))
        for i, own in enumerate(data):
            rows[i, : len(own) // 8] = np.frombuffer(own, "<f8")
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _classes(rows: DataFrame) -> DataFrame:
    """(h1, h2, node, copies, vector): a row per distinct usable vector, as packed doubles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype("<f8")
            ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]) * 8
            raw = flat.tobytes()
            packed = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], names=batch.schema.names)

    distinct = rows.where("usable").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")
    )
    named = distinct.select("h1", "h2", F.coalesce("node", F.lit(UNKNOWN)).alias("node"), "copies", "vector")
    return written(named.mapInArrow(pack, "h1 long, h2 long, node long, copies long, vector binary"), "vectors")


def _share(classes: DataFrame, wanted: int, n: int) -> DataFrame:
    """About `wanted` of the n classes, by their hash."""
    if wanted >= n:
        return classes
    return classes.where(F.col("h1") < F.lit(-(1 << 63) + int(wanted / n * 2**64)))


def fitted(classes: DataFrame, n: int, dims: int, k: int) -> np.ndarray:
    """Centres of length 1 from spherical k-means on a sample of the classes."""
    sample = written(_share(classes, SAMPLE * k, n), "sample")
    first = _share(classes, max(2 * k, 64), n).orderBy("h1", "h2").limit(k).select("vector").collect()  # of about twice as many
    centres = unit_rows(pa.array([r.vector for r in first], pa.binary()), dims)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = unit_rows(batch.column("vector"), dims)
            for start in range(0, len(rows), step := max(1, AT_ONCE // len(centres))):
                own = rows[start : start + step]
                home = np.argmax(own @ centres.T, axis=1)
                for cell in np.unique(home).tolist():
                    totals[cell] = totals.get(cell, 0) + own[home == cell].sum(axis=0)
        if totals:
            yield pa.RecordBatch.from_pydict({"cell": pa.array(totals.keys(), pa.int32()), "total": [t.tobytes() for t in totals.values()]})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, total in zip(batch.column("cell").to_pylist(), batch.column("total").to_pylist(), strict=True):
                totals[cell] = totals.get(cell, 0) + np.frombuffer(total)
        if totals:
            yield pa.RecordBatch.from_pydict({"cell": pa.array(totals.keys(), pa.int32()), "total": [t.tobytes() for t in totals.values()]})

    schema = "cell int, total binary"
    for _ in range(ROUNDS if len(centres) > 1 else 0):
        centres = centres.copy()
        for row in sample.mapInArrow(sums, schema).repartition("cell").mapInArrow(added, schema).collect():  # a row per cell
            total = np.frombuffer(row.total)
            if (length := sqrt(total @ total)) > 0:
                centres[row.cell] = total / length
    return centres


def _placed(classes: DataFrame, centres: np.ndarray, dims: int, threshold: float) -> DataFrame:
    """The classes with their home and the other cells they visit."""
    half = sqrt((1 - threshold) / 2)  # sine of half the threshold's angle

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step := max(1, AT_ONCE // len(centres))):
                part = batch.slice(start, step)
                near = unit_rows(part.column("vector"), dims) @ centres.T
                home = np.argmax(near, axis=1)
                apart = np.sqrt(np.maximum(0, 2 - 2 * (centres[home] @ centres.T)))
                best = near[np.arange(len(near)), home]
                visits = best[:, None] - near <= half * apart + 1e-9
                visits[np.arange(len(near)), home] = False
                at, cells = np.nonzero(visits)
                ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(near)))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cells, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home, pa.int32()), lists], names=[*part.schema.names, "home", "visits"])
        hand_back()

    return written(classes.mapInArrow(place, "h1 long, h2 long, node long, copies long, vector binary, home int, visits array<int>"), "cells")


def _join(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Join what the pairs link; `parent` leads each to the least of its group, and does so again afterwards."""
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def _products(left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows of the left, of the right) of unit vectors with a product of at least `threshold` in double precision, in pieces.

    A product in single precision differs by less than (dims + 2) units of 2^-24, as the vectors have length 1; the margin is four times that.
    """
    margin = (left.shape[1] + 2) * 2.0**-22
    narrow, other = left.astype(np.float32), np.ascontiguousarray(right.astype(np.float32).T)
    for start in range(0, len(left), step := max(1, AT_ONCE // max(1, len(right)))):
        near = narrow[start : start + step] @ other >= threshold - margin
        if near.any():
            rows, columns = np.nonzero(near.any(axis=1))[0], np.nonzero(near.any(axis=0))[0]
            i, j = np.nonzero(left[start + rows] @ right[columns].T >= threshold)
            yield start + rows[i], columns[j]


def _block(table: pa.Table, dims: int, threshold: float) -> pa.Table:
    """Links of one block: per class that has some, their number and the least class (node, mark) it is joined to."""
    columns = {c: table.column(c).to_numpy() for c in ("h1", "h2", "node", "copies", "home", "cell")}
    role = table.column("is_home").to_numpy(zero_copy_only=False).astype(bool)
    vectors = unit_rows(table.column("vector").combine_chunks(), dims)
    homes, members = np.nonzero(role)[0], np.nonzero(~role)[0]
    cell = int(columns["cell"][0])
    # Visitors that a home visits in turn are counted in that cell.
    slots, slot = np.unique(columns["home"][members], return_inverse=True)
    returned = np.zeros((len(homes), len(slots)), bool)
    visits = table.column("visits").to_pylist()
    for row, i in enumerate(homes.tolist()):
        known = np.array(visits[i], np.int64)
        at = np.minimum(np.searchsorted(slots, known), len(slots) - 1)
        returned[row, at[slots[at] == known]] = True
    counts = np.zeros(len(role), np.int64)
    linked = np.zeros(len(role), bool)
    # Rows in order of their ids: groups are led by the least.
    order = np.lexsort((columns["h1"], columns["node"]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    parent = np.arange(len(order))
    for i, j in _products(vectors[homes], vectors[members], threshold):
        x, y = homes[i], members[j]
        other = (columns["h1"][x] != columns["h1"][y]) | (columns["h2"][x] != columns["h2"][y])
        i, j, x, y = i[other], j[other], x[other], y[other]
        np.add.at(counts, x, columns["copies"][y])
        back = (columns["home"][y] != cell) & ~returned[i, slot[j]]
        np.add.at(counts, y[back], columns["copies"][x[back]])
        linked[x] = linked[y] = True
        _join(parent, rank[x], rank[y])
    root = order[parent[rank]]
    at = np.nonzero(linked)[0]
    return pa.table({
        "h1": columns["h1"][at], "h2": columns["h2"][at], "node": columns["node"][at], "n": counts[at],
        "root": columns["node"][root[at]], "root_mark": columns["h1"][root[at]],
    })


def _linked(placed: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(h1, h2, node, n, root, root_mark): what each block found about each class with links."""
    most_homes, most_members = (max(1, min(n, BLOCK_BYTES // (8 * dims))) for n in (HOMES, MEMBERS))
    sizes = (
        placed.select("home", F.explode(F.concat(F.array("home"), "visits")).alias("cell"))
        .groupBy("cell")
        .agg(F.count(F.when(F.col("home") == F.col("cell"), 1)).alias("homes"), F.count(F.lit(1)).alias("members"))
        .select("cell", F.ceil(F.col("homes") / most_homes).cast("int").alias("hb"), F.ceil(F.col("members") / most_members).cast("int").alias("mb"))
        .where("hb > 0")
    )
    inside = placed.withColumn("cell", F.explode(F.concat(F.array("home"), "visits"))).join(F.broadcast(sizes), "cell")  # a row per cell
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod("h2", F.col(n)).cast("int")
    columns = ["cell", "i", "j", "is_home", "h1", "h2", "node", "copies", "home", "visits", "vector"]
    homes = inside.where("cell = home").withColumn("is_home", F.lit(True)).withColumn("i", own("hb")).withColumn("j", every("mb"))
    # Only homes need to know where they visit.
    members = inside.withColumn("is_home", F.lit(False)).withColumn("j", own("mb")).withColumn("i", every("hb")).withColumn("visits", F.array().cast("array<int>"))
    blocks = homes.select(columns).unionByName(members.select(columns))
    found = blocks.groupBy("cell", "i", "j").applyInArrow(
        lambda table: _block(table, dims, threshold), "h1 long, h2 long, node long, n long, root long, root_mark long"
    )
    return written(found, "found")


def near_vectors(
    vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links (other vectors with a cosine of at least `threshold`), component_id, kept.

    component_id is the least id reachable over links; the row with that id is kept. A vector that is null, empty or zero, or holds a null
    or non-finite component, links with nothing: its component is its own id. A shorter vector counts as
    continued by zeros. Rows with an unknown id link as others do; a component of unknown ids alone has an unknown id, and they
    are kept. Repeated rows are vectors of their own: each counts as a link of the others, and they are kept alike. All links are
    found (see above). `threshold` lies above 0 and up to 1. An empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold: above 0, at most 1")
    vector = vectors[vector_col].cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = vectors.select(
        vectors[id_col].cast("long").alias("vec_id"), usable.alias("usable"), F.xxhash64(vector).alias("h1"),
        F.xxhash64(F.lit("second"), vector).alias("h2"), vector.alias("vector"),
    )
    classes = _classes(rows)
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("vector")).alias("bytes")).first()
    if not size.n:
        alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return alone.withColumn("kept", F.lit(True))
    dims = size.bytes // 8
    k = max(1, min(size.n // CELL, CENTRES_BYTES // size.bytes))
    found = _linked(_placed(classes, fitted(classes, size.n, dims, k), dims, threshold), dims, threshold)
    node = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("mark"))
    links = found.select(node("node", "h1").alias("a"), node("root", "root_mark").alias("b")).where("a != b")
    # The least of a block's group stands on the right only, but may be joined to a lesser one elsewhere.
    roots = components(links.select(F.explode(F.array("a", "b")).alias("key")).distinct(), links)
    counts = found.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    known = classes.join(counts, ["h1", "h2"], "left").withColumn("key", node("node", "h1")).join(roots, "key", "left")
    totals = written(
        known.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root.id", "node").alias("root")),
        "totals",
    )
    out = rows.select("vec_id", "usable", "h1", "h2").join(totals, ["h1", "h2"], "left")
    component = F.when(F.col("usable"), F.nullif("root", F.lit(UNKNOWN))).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", F.when(F.col("usable"), F.col("n_links")).otherwise(0).alias("n_links"), component.alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def one_of_each_vector(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The rows of `vectors`, with all their columns, whose id is that of their component."""
    kept = near_vectors(vectors, threshold, id_col, vector_col).where("kept").select(F.col("vec_id").alias("__kept")).distinct()
    return vectors.join(kept, vectors[id_col].cast("long").eqNullSafe(kept["__kept"]), "left_semi")


def op11_embedding_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
