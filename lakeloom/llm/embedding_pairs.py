"""Near-duplicate embeddings by PCA-ordered tiled comparison, exact.

Second moments over all vectors give an orthonormal basis ordered by spread.
Vectors are rotated into it, so the leading dimensions carry most of every
inner product. Leading coordinates are cut at medians into boxes, and each
box's vectors make a tile, or several of a bounded size. Two vectors of cosine
t or more lie within sqrt(2 - 2t) of each other, so a pair of tiles is compared
only if their boxes, and their balls about their centres, come that near. A
task compares two tiles, adding up leading dimensions first and bounding the
rest by the product of suffix norms, and stops for a pair when the bound can't
reach t. What is left is decided in double precision on the vectors as given.

Tiles move whole, a row each, to the tasks that need them. There are a few
tiles up to LEAST_TILES of full size, so that a vector is dealt to as many
tasks whatever the table; beyond, vectors without any structure are compared
all with all, which is the method's cost, and clustered ones by near tiles.

Vectors that are null, empty or zero, or hold null or non-finite components,
link with nothing and stay apart. Equal vectors are compared once and counted
by their number. Vectors of different lengths never link. Rows of one vec_id
are rows of the result each and links of one node. Only the id and the vector
are read, so other columns may have any name. Above MAX_DIMS dimensions the
basis is the given one, which only prunes less. An empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

#: Most vectors of a tile, and bytes of their doubles. Two tiles and a block of their products are a task's memory.
TILE, TILE_BYTES = 1 << 16, 32 << 20
#: Tiles that even a small table is cut into, so that tasks share its work.
LEAST_TILES = 6
#: Leading coordinates that boxes are cut in, and vectors that the cuts are fitted on; every vector is placed by them.
BOX_DIMS, FITTED = 16, 1 << 14
#: Dimensions added up between bounds.
STEP = 8
#: Slack of bounds for rounding in single and in double precision; exact decisions follow.
ROUGH, SLACK = 1e-4, 1e-9
#: Most dimensions whose second moments are gathered.
MAX_DIMS = 4096
#: Most distinct vectors, and bytes of theirs, that are broadcast to find their copies.
BROADCAST_VECTORS, BROADCAST_BYTES = 50_000, 16 << 20


def pca_basis(moments: np.ndarray) -> np.ndarray:
    """Columns: eigenvectors of the second moments, greatest eigenvalue first."""
    values, vectors = np.linalg.eigh(moments)
    return vectors[:, np.argsort(-values, kind="stable")]


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def first_slab(tail: np.ndarray, threshold: float, step: int) -> int:
    """Dimensions to add up at first: as many as leave a mean bound on the rest clearly below the threshold."""
    dims = tail.shape[1]
    rest = np.append((tail**2).mean(0)[step::step], 0.0)
    return min(dims, step * (1 + int(np.argmax(rest <= threshold - 0.15))))


def tile_pairs(a: np.ndarray, b: np.ndarray, threshold: float, step: int = STEP) -> np.ndarray:
    """Positions (i, j) of rotated unit rows of a and b whose inner product may reach the threshold.

    After each slab of dimensions a pair's bound is its sum so far plus the
    product of the suffix norms; pairs are dropped when it falls short. The
    first slab is one product, with the suffix norms as one dimension more.
    """
    dims = a.shape[1]
    tail_a, tail_b = (np.sqrt(np.maximum(np.cumsum(x[:, ::-1] ** 2, 1)[:, ::-1], 0)) for x in (a, b))
    done = first_slab(tail_a, threshold, step)
    rough = [np.concatenate([x[:, :done], t[:, done : done + 1]], 1).astype(np.float32) for x, t in ((a, tail_a), (b, tail_b))]
    i, j = np.nonzero(rough[0] @ rough[1].T >= np.float32(threshold - ROUGH))
    sums = np.einsum("ij,ij->i", a[i, :done], b[j, :done])
    while done < dims and len(i):
        if len(i) * 8 > len(a) * len(b):
            # Most pairs go on: the rest is one product.
            keep = (a @ b.T)[i, j] >= threshold - SLACK
            return np.stack([i[keep], j[keep]], 1)
        more = min(done + step, dims)
        sums = sums + np.einsum("ij,ij->i", a[i, done:more], b[j, done:more])
        bound = sums + (tail_a[i, more] * tail_b[j, more] if more < dims else 0)
        keep = bound >= threshold - SLACK
        i, j, sums, done = i[keep], j[keep], sums[keep], more
    return np.stack([i, j], 1)


class Boxes:
    """Cuts at medians of leading coordinates, a binary tree of a fixed depth."""

    def __init__(self, points: np.ndarray, depth: int):
        self.axis, self.cut, self.depth = np.zeros(1 << depth, np.int64), np.zeros(1 << depth), depth
        groups = {1: points}
        for node in range(1, 1 << depth):
            mine = groups.pop(node)
            if len(mine):
                k = int(np.argmax(mine.var(0)))
                self.axis[node], self.cut[node] = k, np.median(mine[:, k])
            right = mine[:, self.axis[node]] > self.cut[node]
            groups[2 * node], groups[2 * node + 1] = mine[~right], mine[right]

    def of(self, points: np.ndarray) -> np.ndarray:
        """The box of each point."""
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node


def _usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, v (floats or doubles, as given) and ok of every row."""
    single = df.schema[embedding].dataType.simpleString() == "array<float>"
    v = F.col(embedding).cast("array<float>" if single else "array<double>")
    ok = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(ok, F.lit(False)).alias("ok"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row: links are pairs of cosine >= threshold."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a positive cosine")
    rows = _usable(vectors, vec_id, embedding)
    usable = rows.where("ok AND vec_id IS NOT NULL").select("vec_id", "v")
    # -0.0 and 0.0 are one value in a grouping key, and in a cosine.
    found = stored(usable.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")), "vectors")
    about = found.agg(F.max(F.size("v")).alias("dims"), F.count("*").alias("n"), F.count_if(F.col("copies") > 1).alias("copied")).first()
    if not about.n:
        out = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    else:
        links = stored(_links(found, about.n, about.dims, threshold, tile), "pairs")
        # Only vectors with copies are looked for among the rows; the others are their own first.
        copied = found.where("copies > 1").withColumnRenamed("v", "w")
        if about.copied <= BROADCAST_VECTORS and about.copied * about.dims * 8 <= BROADCAST_BYTES:
            copied = F.broadcast(copied)
        each = usable.join(copied, F.col("v") == F.col("w"), "left").select("vec_id", F.coalesce("first", "vec_id").alias("first"), F.coalesce("copies", F.lit(1)).alias("copies"))
        each = stored(each, "firsts")
        counts = links.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
        each = each.join(counts, F.col("first") == F.col("node"), "left").select("vec_id", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
        labels = components(links.select(F.col("root").alias("src"), F.col("node").alias("dst")).union(each.select("first", "vec_id").where("first <> vec_id")))
        good = each.join(labels, each.vec_id == labels.node, "left").select("vec_id", F.col("n").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        bad = rows.where("NOT ok OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        out = good.unionByName(bad)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _basis(found: DataFrame, dims: int) -> np.ndarray | None:
    """The PCA basis of all unit vectors, padded to dims: moments are summed in tasks, then over tasks a slab of rows at a time."""
    if dims > MAX_DIMS:
        return None
    slab = max(1, (1 << 17) // dims)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            unit = _unit(_matrix(batch.column("v"), dims))
            total += unit.T @ unit
        for at in range(0, dims, slab):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total[at : at + slab].tobytes()], pa.binary())], names=["at", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in table.column("part").to_pylist())
        return pa.table({"at": table.column("at")[:1].cast(pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    summed = found.select("v").mapInArrow(sums, "at int, part binary").groupBy("at").applyInArrow(add, "at int, part binary")
    moments = np.zeros((dims, dims))
    for r in summed.toLocalIterator():
        part = np.frombuffer(r.part, np.float64).reshape(-1, dims)
        moments[r.at : r.at + len(part)] = part
    return pca_basis(moments)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The lists as rows of doubles, padded with zeros."""
    if len(column) and pc.min(pc.list_value_length(column)).as_py() == dims:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)
    out = np.zeros((len(column), dims))
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = v
    return out


def near_tiles(low: np.ndarray, high: np.ndarray, centre: np.ndarray, radius: np.ndarray, length: np.ndarray, i: int, reach: float) -> np.ndarray:
    """The tiles from i on that can hold a vector within reach of one of tile i."""
    gap = np.maximum(np.maximum(low[i:] - high[i], low[i] - high[i:]), 0)
    apart = np.linalg.norm(centre[i:] - centre[i], axis=1) - radius[i:] - radius[i]
    return i + np.flatnonzero((length[i:] == length[i]) & ((gap**2).sum(1) <= reach**2) & (apart <= reach))


def _links(found: DataFrame, n: int, dims: int, threshold: float, tile: int) -> DataFrame:
    """node, root, links: in each task a vector's linked rows (counted with copies) and its component there."""
    basis = _basis(found, dims)
    axes = min(BOX_DIMS, dims)
    tile = max(1, min(tile, TILE_BYTES // (8 * dims), -(-n // LEAST_TILES)))
    reach = math.sqrt(2 - 2 * threshold) + 1e-6
    turn = (lambda unit, k: unit[:, :k] if basis is None else unit @ basis[:, :k])

    def leading(batch: pa.RecordBatch) -> np.ndarray:
        return turn(_unit(_matrix(batch.column("v"), dims)), axes)

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(leading(batch)), pa.list_(pa.float64()))], names=["x"])

    # The least hashes: the same vectors however the table is dealt.
    some = found.withColumn("h", F.xxhash64("first")).orderBy("h").limit(FITTED).select("v").mapInArrow(coordinates, "x array<double>").toLocalIterator()
    boxes = Boxes(np.array([r.x for r in some]), max(0, math.ceil(math.log2(n / tile))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(boxes.of(leading(batch))), pa.array(pc.list_value_length(batch.column("v")), pa.int32())], names=[*batch.schema.names, "box", "length"])

    kind = found.schema["v"].dataType.simpleString()
    placed = found.mapInArrow(place, f"v {kind}, first long, copies long, box long, length int")
    # A box that holds more than a tile, as a crowd of near copies can, is cut by hash.
    counts = placed.groupBy("box", "length").agg(F.ceil(F.count("*") / F.lit(tile)).alias("parts"))
    cut = stored(counts, "boxes").select(F.col("box").alias("b"), F.col("length").alias("l"), "parts")
    dealt = placed.join(cut, (F.col("box") == F.col("b")) & (F.col("length") == F.col("l")))
    dealt = dealt.select("v", "first", "copies", "box", "length", F.pmod(F.xxhash64("first"), F.col("parts")).alias("part"))
    shape = "box long, length long, part long, ids binary, copies binary, rows binary, low array<double>, high array<double>, centre array<double>, radius double"

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = table.column("v").chunk(0)
        length = len(column[0])
        given = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
        padded = np.zeros((len(given), dims))
        padded[:, :length] = given
        unit = _unit(padded)
        ahead, centre = turn(unit, axes), unit.mean(0)
        radius = float(np.linalg.norm(unit - centre, axis=1).max())
        values = [*(table.column(c)[0].as_py() for c in ("box", "length", "part")), table.column("first").to_numpy().tobytes(), table.column("copies").to_numpy().tobytes(), given.tobytes(), ahead.min(0), ahead.max(0), centre, radius]
        return pa.table([pa.array([v]) for v in values], names=[c.split()[0] for c in shape.split(", ")])

    tiles = stored(dealt.groupBy("box", "length", "part").applyInArrow(pack, shape), "tiles")
    # A row of numbers for each tile: for TILE vectors of any width, less than a part in 10000 of the table.
    marks = tiles.select("box", "length", "part", "low", "high", "centre", "radius").orderBy("length", "box", "part").toPandas()
    names = [tuple(int(x) for x in r) for r in marks[["box", "length", "part"]].to_numpy()]
    low, high, centre = (np.stack(marks[c].to_list()) for c in ("low", "high", "centre"))
    radius, length = marks["radius"].to_numpy(), marks["length"].to_numpy()

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_pylist():
                found_ = near_tiles(low, high, centre, radius, length, i, reach).tolist()
                rows = [(*names[k], f"{i},{j}", k == i) for j in found_ for k in {i, j}]
                yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*rows, strict=True)], names=["b", "l", "p", "task", "mine"])

    spark = found.sparkSession
    wanted = spark.range(len(names)).mapInArrow(partners, "b long, l long, p long, task string, mine boolean")
    moved = tiles.drop("low", "high", "centre", "radius").join(wanted, (F.col("box") == F.col("b")) & (F.col("length") == F.col("l")) & (F.col("part") == F.col("p"))).select("task", "mine", "ids", "copies", "rows", "length")
    number = np.float32 if kind == "array<float>" else np.float64

    def compare(table: pa.Table) -> pa.Table:
        sides = {}
        for mine, ids, copies, rows, width in zip(*(table.column(c).to_pylist() for c in ("mine", "ids", "copies", "rows", "length")), strict=True):
            given = np.frombuffer(rows, number).reshape(-1, width).astype(np.float64)
            norms = np.linalg.norm(given, axis=1)
            unit = np.zeros((len(given), dims))
            unit[:, :width] = given / norms[:, None]
            sides[mine] = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64), given, norms, turn(unit, dims)
        alone = len(sides) == 1
        held = [sides[True]] if alone else [sides[True], sides[False]]
        shift = 0 if alone else len(held[0][0])
        ids, copies, given, norms, turned = (np.concatenate([h[k] for h in held]) for k in range(5))
        left = np.arange(len(held[0][0]))
        right = left if alone else np.arange(shift, len(ids))
        links, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        # Blocks bound the products held at once.
        for a0 in range(0, len(left), 1024):
            a = left[a0 : a0 + 1024]
            for b0 in range(a0 if alone else 0, len(right), 1024):
                b = right[b0 : b0 + 1024]
                at = tile_pairs(turned[a], turned[b], threshold)
                x, y = a[at[:, 0]], b[at[:, 1]]
                if alone:
                    x, y = x[x < y], y[x < y]
                cosine = np.einsum("ij,ij->i", given[x], given[y]) / (norms[x] * norms[y])
                x, y = x[cosine >= threshold], y[cosine >= threshold]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    i, j = root(i), root(j)
                    if ids[i] < ids[j]:
                        parent[j] = i
                    elif i != j:
                        parent[i] = j
        hit = np.flatnonzero(links)
        return pa.table({"node": ids[hit], "root": ids[[root(i) for i in hit.tolist()]].astype(np.int64), "links": links[hit]})

    return moved.groupBy("task").applyInArrow(compare, "node long, root long, links long")
