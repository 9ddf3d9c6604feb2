"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to length one and rotated to the principal axes of the
whole table (second moments summed over all rows), so that the leading
coordinates carry most of every product. The vectors of a label are cut into
tiles, over and over along the widest of the leading axes, so tiles are small in all of them.
Two tiles are compared only if the boxes of their leading coordinates and the norms of the
rest leave the threshold in reach; that is asked of whole branches first, and of the parts of two
branches only where it holds. Inside a pair of tiles, products are accumulated a few axes at a time; after
each step a pair goes on only if its partial product plus the product of the
two suffix norms can reach the threshold. What is left at the end is decided
by the cosine of the given vectors in double precision.

Equal vectors of a label are one node with a weight. A task holds two tiles,
and returns counts and one spanning edge per joined node, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.components import components
from cohortlens.llm.scratch import keep, stored

THRESHOLD = 0.93
#: Vectors in a tile.
TILE = 2048
#: Vectors of a tile compared with another tile at once.
LINES = 512
#: Axes added between two bounds.
STEP = 8
#: Leading axes in a tile's box.
BOX = 8
#: Axes at most that are rotated as a whole (the moment matrix is its square); of longer vectors, the leading ones alone.
ROTATED = 2048
#: Leading axes of vectors longer than that, found by power iteration.
LEADING = 24
#: Vector lengths that get axes of their own, the commonest first; vectors of other lengths keep the given axes.
LENGTHS = 16
#: Parts that a tile is cut into at once.
PARTS = 16
_SLACK = 1e-7
_FAN_IN = 16


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def usable(vector: str = "embedding"):
    """True for vectors that may link: not null, without null or non-finite components, not zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False))


def _added(nodes: DataFrame, sizes: dict[int, int], matrix) -> dict[int, np.ndarray]:
    """{length: sum of ``matrix(length, unit vectors)`` over all vectors of that length}, length x sizes[length].

    Every partition sends a row for each row of its matrices; groups of partitions add theirs up, level by level."""
    lengths = list(sizes)

    def emit(part: int, sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part for d in sums for _ in range(d)], pa.int64()), pa.array([d for d in sums for _ in range(d)], pa.int32()),
                                           pa.array([i for d in sums for i in range(d)], pa.int32()), pa.array([r.tolist() for d in sums for r in sums[d]], pa.list_(pa.float64()))],
                                          ["part", "dim", "i", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                if d in sizes:
                    sums[d] = sums.get(d, 0) + matrix(d, _unit(_matrix(batch.column("embedding").filter(pa.array(dims == d)))))
        if sums:
            yield emit(TaskContext.get().partitionId(), sums)

    def add(key, table):
        d = key[1].as_py()
        i, rows = table.column("i").to_numpy(), _matrix(table.column("row").combine_chunks())
        out = np.zeros((d, rows.shape[1]))
        np.add.at(out, i, rows)
        return pa.Table.from_batches([emit(key[0].as_py(), {d: out})])

    schema = "part bigint, dim int, i int, row array<double>"
    parts, left = nodes.select("dim", "embedding").mapInArrow(run, schema), nodes.rdd.getNumPartitions()
    while left > 1:
        parts = parts.withColumn("part", F.expr(f"part div {_FAN_IN}")).groupBy("part", "dim").applyInArrow(add, schema)
        left = -(-left // _FAN_IN)
    out = {d: np.zeros((d, sizes[d])) for d in lengths}
    for r in parts.collect():  # as many rows as the lengths together
        out[r["dim"]][r["i"]] += r["row"]
    return out


def rotation(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes as columns, the strongest first, of the unit vectors of the commonest lengths: all axes of a
    length up to ROTATED, LEADING ones of longer vectors."""
    common = [r["dim"] for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()]
    out: dict[int, np.ndarray] = {}
    whole = [d for d in common if d <= ROTATED]
    if whole:
        moments = _added(nodes, {d: d for d in whole}, lambda d, x: x.T @ x)
        out = {d: np.linalg.eigh(m)[1][:, ::-1] for d, m in moments.items()}
    long = [d for d in common if d > ROTATED]
    if long:
        rng = np.random.default_rng(0)
        axes = {d: np.linalg.qr(rng.normal(size=(d, LEADING)))[0] for d in long}
        for _ in range(3):
            shared = nodes.sparkSession.sparkContext.broadcast(axes)
            made = _added(nodes, {d: LEADING for d in long}, lambda d, x, shared=shared: x.T @ (x @ shared.value[d]))
            axes = {d: np.linalg.qr(m)[0] for d, m in made.items()}
        out |= axes
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # keeps squares in range
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def close_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray | None, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of x and y with cosine >= threshold; i < j when they are the same tile."""
    a, b = _unit(x), _unit(y)
    p, q = (a, b) if axes is None else (a @ axes, b @ axes)
    # Norms of what follows an axis: of the coordinates behind it, and of what the axes leave out.
    rest = lambda m: np.sqrt(np.maximum(1 - np.concatenate([np.zeros((len(m), 1)), np.cumsum(m * m, axis=1)], axis=1), 0) + _SLACK ** 2)
    rp, rq, d = rest(p), rest(q), p.shape[1]
    first = min(STEP, d)
    found = []
    for at in range(0, len(p), LINES):
        some = slice(at, at + LINES)
        dot = p[some, :first] @ q[:, :first].T
        alive = dot + rp[some, first][:, None] * rq[:, first][None, :] >= threshold - _SLACK
        if same:
            alive &= np.arange(len(q))[None, :] > np.arange(at, at + len(dot))[:, None]
        i, j = np.nonzero(alive)
        dot, i, s = dot[i, j], i + at, first
        while s < d and len(i):
            e = min(s + STEP, d)
            dot = dot + np.einsum("ij,ij->i", p[i, s:e], q[j, s:e])
            ok = dot + rp[i, e] * rq[j, e] >= threshold - _SLACK
            i, j, dot, s = i[ok], j[ok], dot[ok], e
        for k in range(0, len(i), 1 << 16):  # the vectors as given, so many pairs at a time
            u, v = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
            cos = (x[u] * y[v]).sum(axis=1) / (np.sqrt((x[u] * x[u]).sum(axis=1)) * np.sqrt((y[v] * y[v]).sum(axis=1)))
            bad = ~np.isfinite(cos)
            cos[bad] = (a[u[bad]] * b[v[bad]]).sum(axis=1)
            found.append((u[cos >= threshold], v[cos >= threshold]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *[f[k] for f in found]]) for k in range(2))


def _spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same of n rows as the pairs do: from each row to the first of its group."""
    label = np.arange(n)
    while len(i):
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    k = np.flatnonzero(label != np.arange(n))
    return label[k], k


def embedding_near_dedup(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links between vectors of equal, non-null labels with cosine >= ``threshold``.

    ``rows`` has vec_id, embedding and label. One row per input row: vec_id, n_links
    (other vectors linked directly), component_id (smallest vec_id reachable, itself
    included) and kept (vec_id = component_id). Vectors that are null, empty or zero, hold
    null or non-finite components, or have a null label link with nothing; vectors
    of different lengths do not link. Rows that repeat a vec_id are vectors of
    their own; a null vec_id has no component and is not kept unless its group has a
    smallest id to name.
    """
    spark = rows.sparkSession
    ok = F.col("label").isNotNull() & usable()
    # Components travel as they are given: all work on them is in double precision.
    exact = rows.schema["embedding"].dataType.simpleString() in ("array<float>", "array<double>")
    given = F.col("embedding") if exact else F.col("embedding").cast("array<double>")
    data = rows.select("vec_id", "label", given.alias("embedding")).withColumn("usable", ok)
    # One node per different vector of a label, with its number of rows.
    nodes = (data.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
             .withColumn("dim", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()))
    nodes = stored(nodes, "vectors")
    axes = rotation(nodes)
    shared = spark.sparkContext.broadcast(axes)

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            box = [None] * batch.num_rows
            rest = np.zeros(batch.num_rows)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = _unit(_matrix(batch.column("embedding").take(pa.array(at))))
                p = x @ shared.value[d] if d in shared.value else x
                rest[at] = np.sqrt(np.maximum(1 - (p[:, :BOX] ** 2).sum(axis=1), 0))
                for k, r in zip(at.tolist(), p[:, :BOX], strict=True):
                    box[k] = [*r.tolist(), *[0.0] * (BOX - len(r))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("label"), batch.column("dim"), pa.array(box, pa.list_(pa.float64())), pa.array(rest)],
                                             ["node", "label", "dim", "box", "rest"])

    kind = dict(nodes.dtypes)
    placed = nodes.select("node", "label", "dim", "embedding").mapInArrow(lead, f"node bigint, label {kind['label']}, dim int, box array<double>, rest double")
    tiled, pairs = _tiles(placed, threshold)
    tiled = tiled.join(nodes.select("node", "dim", "weight", "embedding"), "node")
    sides = pairs.withColumn("tile", F.col("x")).union(pairs.where("x <> y").withColumn("tile", F.col("y")))
    loads = sides.join(tiled.select("dim", "tile", "node", "weight", "embedding"), "tile")

    def compare(table: pa.Table) -> pa.Table:
        x, y, d = (table.column(c)[0].as_py() for c in ("x", "y", "dim"))
        tile, node, weight = (table.column(c).to_numpy() for c in ("tile", "node", "weight"))
        vectors = _matrix(table.column("embedding").combine_chunks())
        left, right = np.flatnonzero(tile == x), np.flatnonzero(tile == y)
        i, j = close_pairs(vectors[left], vectors[right], shared.value.get(d), threshold, x == y)
        i, j = left[i], right[j]
        links = np.zeros(len(node), np.int64)
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        got = np.flatnonzero(links)
        u, v = _spanning(i, j, len(node))
        return pa.table({"node": np.concatenate([node[got], node[u]]), "links": np.concatenate([links[got], np.zeros(len(u), np.int64)]),
                         "other": np.concatenate([node[got], node[v]])})

    found = keep(loads.groupBy("x", "y").applyInArrow(compare, "node bigint, links bigint, other bigint"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = nodes.select("node", "label", "embedding", "least", "weight").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(links, "node", "left")
    known = keep(known)
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = keep(known.join(ids, "root").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"))
    linked = data.where("usable").select("vec_id", "label", "embedding").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = data.where("not usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _in_reach(threshold: float):
    """Whether two boxes (a, b) leave the threshold in reach: by the largest product, and by the distance of unit vectors."""
    product, gap = F.col("a.rest_hi") * F.col("b.rest_hi"), F.lit(0.0)
    apart = lambda x, y, z, w: F.greatest(F.lit(0.0), F.col(x) - F.col(w), F.col(y) - F.col(z))
    for k in range(BOX):
        product = product + F.greatest(*[F.col(f"a.{s}{k}") * F.col(f"b.{t}{k}") for s in ("lo", "hi") for t in ("lo", "hi")])
        gap = gap + F.pow(apart(f"a.lo{k}", f"b.lo{k}", f"a.hi{k}", f"b.hi{k}"), F.lit(2.0))
    gap = gap + F.pow(apart("a.rest_lo", "b.rest_lo", "a.rest_hi", "b.rest_hi"), F.lit(2.0))
    # The norm of the rest comes from a difference: near zero it is known to about the root of the rounding.
    return (product >= threshold - 1e-7) & (gap <= 2 - 2 * threshold + 1e-6)


def _tiles(placed: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, tile) and (x, y): tiles of TILE rows at most, and the pairs x <= y of tiles whose boxes leave the threshold in reach.

    Each round cuts every tile that is too large into at most PARTS by quantiles along its widest leading axis (by node
    where all are equal). A pair of tiles in reach is followed by the pairs of their parts that are.
    """
    groups = stored(placed.select("label", "dim").distinct().withColumn("tile", F.monotonically_increasing_id()), "tile-roots")
    rows = stored(placed.join(groups, ["label", "dim"]).select("node", "tile", *[F.col("box")[k].alias(f"c{k}") for k in range(BOX)], "rest"), "tile-rows")
    pairs = groups.select(F.col("tile").alias("x"), F.col("tile").alias("y"))
    while True:
        lows, highs = [F.min(f"c{k}").alias(f"lo{k}") for k in range(BOX)], [F.max(f"c{k}").alias(f"hi{k}") for k in range(BOX)]
        tiles = stored(rows.groupBy("tile").agg(F.count("*").alias("n"), *lows, *highs), "tiles")
        large = tiles.where(F.col("n") > TILE)
        if not large.limit(1).count():
            return rows.select("node", "tile"), pairs
        width = F.array(*[F.col(f"hi{k}") - F.col(f"lo{k}") for k in range(BOX)])
        large = large.select("tile", F.least(F.lit(PARTS), F.ceil(F.col("n") / TILE)).cast("int").alias("parts"), F.array_max(width).alias("width"),
                             F.array_position(width, F.array_max(width)).cast("int").alias("axis"))
        found = rows.join(large, "tile", "left").withColumn("v", F.get(F.array(*[f"c{k}" for k in range(BOX)]), F.col("axis") - 1))
        cuts = [k / PARTS for k in range(1, PARTS)]
        grid = found.where("width > 0").groupBy("tile").agg(F.percentile_approx("v", cuts, 1000).alias("grid"))
        found = found.join(stored(grid, "tile-grid"), "tile", "left")
        # Of equal quantiles the rows between stay together; a part as large as its tile is cut by node at last.
        place = F.size(F.filter("grid", lambda g: g < F.col("v")))
        part = F.when(F.col("parts").isNull(), 0).when(F.col("width") > 0, F.floor(place * F.col("parts") / PARTS)).otherwise(F.pmod(F.xxhash64("node"), F.col("parts")))
        found = stored(found.withColumn("part", part.cast("int")).drop("v", "grid", "axis"), "tile-parts")
        sizes = found.groupBy("tile", "part").agg(F.count("*").alias("m"))
        stuck = sizes.join(tiles.select("tile", "n"), "tile").where((F.col("n") > TILE) & (F.col("m") == F.col("n"))).select("tile", F.lit(True).alias("stuck"))
        found = found.join(stored(stuck, "tile-stuck"), "tile", "left")
        part = F.when(F.col("stuck"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).otherwise(F.col("part"))
        found = found.withColumn("part", part)
        parts = stored(found.groupBy("tile", "part").agg(*lows, *highs, F.min("rest").alias("rest_lo"), F.max("rest").alias("rest_hi")).withColumn("new", F.monotonically_increasing_id()), "tile-boxes")
        rows = stored(found.join(parts.select("tile", "part", "new"), ["tile", "part"]).select("node", F.col("new").alias("tile"), *[f"c{k}" for k in range(BOX)], "rest"), "tile-rows")
        both = (pairs.join(parts.withColumnRenamed("tile", "x").alias("a"), "x").join(parts.withColumnRenamed("tile", "y").alias("b"), "y")
                .where((F.col("x") != F.col("y")) | (F.col("a.new") <= F.col("b.new"))).where(_in_reach(threshold)))
        pairs = stored(both.select(F.col("a.new").alias("x"), F.col("b.new").alias("y")), "tile-pairs")
