"""Operator 13: near-duplicates among vectors of one label, by cells of spherical k-means.

Equal vectors of a label become one class with its number of rows before anything else.  Spherical k-means, fitted on a
sample of about ``SAMPLE`` classes, assigns every class to the cell of the centroid with the highest cosine.  A class near a
border is offered to the cells of smaller number across it as well, so a pair on two sides of a border meets in just
one cell.  Within a cell, the rows of a label are dealt in blocks, and a task multiplies one pair of blocks: it gives a
row for each class that has a link there, with the number of rows it is linked to and the least class that the links of this
pair of blocks reach.  No pair is ever a row.  Counts are summed, components come from these stars, and the smallest id of
a component is the representative that is kept.

How far an offer reaches: classes whose distance to the border is at most ``margin``.  A pair at the threshold differs
by sin = sqrt(1 - threshold^2); with the whole of it as margin nothing can be missed.  By default the margin is ``SPREADS``
times the part of it that points in one given direction on average, sin / sqrt(dimension - 1): only pairs at the threshold
that differ straight towards a centroid are missed (see the README for measured recall).  Links that are made are exact.

The centroids (at most ``MOST_CELLS`` times the dimension) are all that reaches the driver or every task.  Cells of any size
are dealt in blocks, of ``BLOCK`` rows or of ``BLOCK_BYTES`` if that is less.

Edge cases: vectors that are null, empty or zero, hold null or non-finite components, or have no label, link with nothing
and are kept; vectors of another dimension than the most frequent one are compared in a single cell, and only with those
of their own dimension; rows that repeat an id are rows of their own; a row without an id counts as a link of others and
can join them, its component is the smallest id there is, null if there is none; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import sorted_groups, table, written
from gradus.llm.components import components

THRESHOLD = 0.93
SAMPLE, STEPS = 1 << 16, 8
CELL_ROWS, LEAST_CELLS, MOST_CELLS = 2048, 8, 4096
SPREADS = 2.5
BLOCK, BLOCK_BYTES = 2048, 1 << 24


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, those of huge or tiny components too."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def stars(linked: np.ndarray, left: np.ndarray, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's component) of a matrix of links, between two sets or (one set) within one."""
    nodes = left if right is None else np.concatenate([left, right])
    out, open_left = nodes.copy(), np.ones(len(left), bool)
    open_right = open_left if right is None else np.ones(len(right), bool)
    for start in range(len(left)):
        if not open_left[start]:
            continue
        rows, found = np.array([start]), [np.array([start])]
        open_left[start] = False
        while len(rows):
            columns = np.flatnonzero(linked[rows].any(axis=0) & open_right)
            open_right[columns] = False
            if right is None:
                rows = columns
                found.append(rows)
                continue
            found.append(len(left) + columns)
            rows = np.flatnonzero(linked[:, columns].any(axis=1) & open_left)
            open_left[rows] = False
            found.append(rows)
        own = np.concatenate(found)
        out[own] = nodes[own].min()
    return nodes, out


# Cells ----------------------------------------------------------------------------------------------------------------


def _vectors(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have the dimension, their vectors as unit vectors)."""
    own = pc.equal(pc.list_value_length(batch.column("x")), dim)
    flat = batch.column("x").filter(own).flatten().to_numpy(zero_copy_only=False)
    return np.asarray(own), unit(flat.reshape(-1, dim)) if len(flat) else np.zeros((0, dim))


def fit_cells(classes: DataFrame, dim: int, cells: int, threshold: float, steps: int = STEPS) -> np.ndarray:
    """Centroids of spherical k-means, from starting vectors of which no two are as near as a link."""
    order = classes.where(F.size("x") == dim).orderBy(F.xxhash64("x"), "x").limit(4 * cells).select("x")
    start, centroids = unit(np.array([r["x"] for r in order.collect()], float)), []  # at most 4 * MOST_CELLS vectors
    for v in start:
        if len(centroids) < cells and (not centroids or (np.array(centroids) @ v).max() < threshold):
            centroids.append(v)
    held = np.array(centroids)

    for _ in range(steps if len(held) > 1 else 0):
        current = held

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(current)
            for batch in batches:
                _, u = _vectors(batch, dim)
                np.add.at(total, (u @ current.T).argmax(axis=1), u)
            met = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array([total[k].tobytes() for k in met], pa.binary())], ["cell", "sum"])

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (cell,), rows in sorted_groups(batches, ("cell",)):
                total = sum(np.frombuffer(b) for b in rows["sum"].tolist())
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["cell", "sum"])

        parts = classes.select("x").mapInArrow(sums, "cell int, sum binary").repartition("cell").sortWithinPartitions("cell")
        held = current.copy()
        for row in parts.mapInArrow(merged, "cell int, sum binary").collect():  # a row per cell
            mean = np.frombuffer(row["sum"])
            if np.linalg.norm(mean) > 0:
                held[row["cell"]] = mean / np.linalg.norm(mean)
    return held


def margin_of(threshold: float, dim: int) -> float:
    whole = math.sqrt(max(0.0, 1 - threshold**2))
    return min(whole, SPREADS * whole / math.sqrt(max(dim - 1, 1)))


def _placed(classes: DataFrame, centroids: np.ndarray, dim: int, margin: float) -> DataFrame:
    """Classes with their cell (``home``), and again with every cell that they are offered to."""
    apart = np.linalg.norm(centroids[:, None] - centroids, axis=2) if len(centroids) <= 512 else np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))
    schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("cell", pa.int32()), ("home", pa.bool_()), ("node", pa.int64()), ("rows", pa.int64()), ("u", pa.binary())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, u = _vectors(batch, dim)
            score = u @ centroids.T
            cell = score.argmax(axis=1)
            # distance of each vector to the border with each cell of smaller number, as far as the margin goes
            gap = score[np.arange(len(u)), cell, None] - score <= margin * apart[cell]
            offered, to = np.nonzero(gap & (np.arange(len(centroids)) < cell[:, None]))
            coded = pa.array([v.tobytes() for v in u], pa.binary())
            mine, n = batch.filter(pa.array(own)), len(u)
            for at, cells, home in ((np.arange(n), cell, True), (offered, to, False)):
                picked = mine.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([picked.column("label"), pa.array(np.full(len(at), dim), pa.int32()), pa.array(cells, pa.int32()), pa.array(np.full(len(at), home)), picked.column("node"), picked.column("rows"), coded.take(pa.array(at))], schema=schema)
            for row in batch.filter(pa.array(~own)).to_pylist():
                v = unit(np.array([row["x"]]))[0]
                yield pa.RecordBatch.from_pylist([{"label": row["label"], "dim": len(v), "cell": 0, "home": True, "node": row["node"], "rows": row["rows"], "u": v.tobytes()}], schema)

    kinds = "label string, dim int, cell int, home boolean, node long, rows long, u binary"
    return classes.select("label", "x", "node", "rows").mapInArrow(place, kinds)


# Links ----------------------------------------------------------------------------------------------------------------

UNIT = ("label", "dim", "cell", "within", "a", "b")


def _compared(placed: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, links, root): what each pair of blocks finds."""
    cell = ["label", "dim", "cell"]
    size = F.least(F.lit(block), F.greatest(F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim"))), F.lit(1)))
    blocks = lambda n: F.ceil(n / size).cast("int")
    counts = placed.groupBy(*cell).agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests")).where("homes > 0 and homes + guests > 1")
    counts = written(counts.select(*cell, blocks(F.col("homes")).alias("homes"), blocks(F.col("guests")).alias("guests")), "op13-cells")
    met = placed.join(counts, cell)
    own = F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    met = met.withColumn("own", own)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    seat = lambda within, a, b, side: F.struct(F.lit(within).alias("within"), a.alias("a"), b.alias("b"), F.lit(side).alias("side"))
    own = F.col("own")
    first = F.transform(F.sequence(own, F.col("homes") - 1), lambda j: seat(True, own, j, 0))
    second = F.transform(upto(own), lambda i: seat(True, i, own, 1))
    host = F.transform(upto(F.col("guests")), lambda j: seat(False, own, j, 0))
    guest = F.transform(upto(F.col("homes")), lambda i: seat(False, i, own, 1))
    seats = F.when(F.col("home"), F.concat(first, second, host)).otherwise(guest)
    dealt = met.select(*cell, F.explode(seats).alias("s"), "node", "rows", "u").select(*cell, "s.within", "s.a", "s.b", "s.side", "node", "rows", "u")
    dealt = dealt.repartition(*UNIT).sortWithinPartitions(*UNIT)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, dim, _, within, a, b), rows in sorted_groups(batches, UNIT):
            u = np.frombuffer(b"".join(rows["u"].tolist())).reshape(-1, dim)
            nodes, weight, side = rows["node"], rows["rows"], rows["side"] == 1
            if within and a == b:
                linked = u @ u.T >= threshold
                np.fill_diagonal(linked, False)
                met = linked.any(axis=1)
                linked, nodes, weight = linked[met][:, met], nodes[met], weight[met]
                found, root = stars(linked, nodes)
                links = linked @ weight
            else:
                linked = u[~side] @ u[side].T >= threshold
                left, right = linked.any(axis=1), linked.any(axis=0)
                linked = linked[left][:, right]
                found, root = stars(linked, nodes[~side][left], nodes[side][right])
                links = np.concatenate([linked @ weight[side][right], weight[~side][left] @ linked])
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(links, pa.int64()), pa.array(root, pa.int64())], ["node", "links", "root"])

    return dealt.mapInArrow(compare, "node long, links long, root long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, cells: int | None = None, margin: float | None = None, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept."""
    x = F.col(vector_col).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), x.alias("x"), F.coalesce(sound & F.col(label_col).isNotNull(), F.lit(False)).alias("sound"))
    classes = rows.where("sound").groupBy("label", "x").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("rows"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "op13-classes")
    common = classes.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim, n = common["dim"], common["n"]
    drawn = F.pmod(F.xxhash64("x"), F.lit(1 << 40)) < int(min(1.0, sample / n) * (1 << 40))
    centroids = fit_cells(classes.where((F.size("x") == dim) & drawn), dim, cells or min(max(n // CELL_ROWS, LEAST_CELLS), MOST_CELLS), threshold)
    placed = written(_placed(classes, centroids, dim, margin_of(threshold, dim) if margin is None else margin), "op13-placed")
    found = written(_compared(placed, threshold, block), "op13-links")
    links = written(found.groupBy("node").agg(F.sum("links").alias("links")), "op13-counts")
    groups = components(found.where("node <> root"), "node", "root")
    known = classes.select("node", "vec_id", "rows").join(links, "node", "left").join(groups, "node", "left")
    known = written(known.select("node", "vec_id", "rows", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")), "op13-groups")
    least = written(known.groupBy("component").agg(F.min("vec_id").alias("component_id")), "op13-least")
    said = known.join(least, "component").select("node", (F.col("links") + F.col("rows") - 1).alias("n_links"), "component_id")
    said = classes.select("node", "label", "x").join(said, "node").select("label", "x", "n_links", "component_id")
    linked = rows.where("sound").select("vec_id", "label", "x").join(written(said, "op13-said"), ["label", "x"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where case when len(a.e) = len(b.e) then list_cosine_similarity(a.e, b.e) >= {THRESHOLD} else false end),
reach as (select vec_id as node, vec_id as other from embeddings union select node, b from reach join l on other = a),
c as (select a, count(*) as n from l group by a)
select node as vec_id, coalesce(max(n), 0) as n_links, min(other) as component_id, node = min(other) as kept from reach left join c on a = node group by node"""
