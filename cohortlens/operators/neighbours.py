"""Exact k nearest neighbours (survey G1), by pivots and the triangle inequality.

Training rows are dealt to cells by their nearest pivot (centres of a bounded sample). A query row first
looks into its own cell, which bounds the distance of its k-th neighbour from above. It then visits
only cells that may hold anything as near: a cell is left out when its ball (farthest row from the pivot), or the plane
midway between its pivot and the query's, is farther off than that bound. Inside a cell only rows whose distance from the pivot is within the bound of
the query's own are compared. No pair is left out that could matter, so the result is that of all pairs.

Cells are cut into blocks of at most ``block_rows`` rows on either side, so a task's memory is bounded
however many rows share a cell or a point; pairs never become rows, only the k best of a block do. Rows are
known by a number of their own: ids may repeat or be missing. Few training rows make one cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.cluster import _seed_centres
from cohortlens.operators.features import to_array
from cohortlens.session import written as _written

_BLOCK_ROWS = 20_000
#: Most cells, which bounds the table of pivots that tasks get.
_CELLS = 1_024
#: Training rows that pivots are made from.
_PIVOT_SAMPLE = 8_192
#: Distances from rows to pivots that a task works on at once.
_MEASURED = 1 << 19
#: Queries compared at once.
_CHUNK = 256
#: Bounds give way by this share of the numbers they come from, for rounding.
_SLACK = 1e-9


def _points(table: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    x = table.column(column)
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    flat = x.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    if x.null_count or np.isnan(values).any():
        raise ValueError("k-NN features must not be NULL or NaN; fill them first")
    return values.reshape(len(x), -1)


def _rows(df: DataFrame, features: str | Sequence[str], key: str, keep: Sequence[str] = ()) -> DataFrame:
    """(n, id, x, kept columns): written once, so that the row numbers stand."""
    x = to_array(df, features)
    return _written(x.select(F.monotonically_increasing_id().alias("n"), F.col(f"`{key}`").alias("id"), F.col("__x").alias("x"),
                             *[F.col(f"`{c}`").alias(f"nb_{c}") for c in keep]), "knn-rows")


def _pivots(train: DataFrame, cells: int) -> np.ndarray:
    """Centres of a sample of the training rows; one centre without a sample for a single cell."""
    if cells <= 1:
        first = train.select("x").first()
        return np.array([first["x"]], float)
    order = F.xxhash64("n")
    sample = np.array([r["x"] for r in train.orderBy(order, "n").limit(max(_PIVOT_SAMPLE, 4 * cells)).select("x").collect()], float)
    rng = np.random.default_rng(0)
    if cells <= 64:
        return np.unique(_seed_centres(sample, min(cells, len(sample)), rng), axis=0)
    return np.unique(sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)], axis=0)


def _portions(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The batches by as many rows as have ``_MEASURED`` distances from all pivots."""
    step = max(1, _MEASURED // len(pivots))
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)


def _dealt(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` (n, id, x) with the nearest pivot's cell and the distance r from it."""
    kinds = dict(rows.dtypes)

    def deal(batches):
        middle = pivots.mean(axis=0)  # far from the origin the products would lose digits
        P = pivots - middle
        half = (P * P).sum(axis=1) / 2
        for batch in _portions(batches, pivots):
            X = _points(batch, "x")
            cell = (half - (X - middle) @ P.T).argmin(axis=1)
            r = np.sqrt(((X - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("n"), batch.column("id"), batch.column("x"), pa.array(cell, pa.int32()), pa.array(r)], ["n", "id", "x", "cell", "r"])

    return rows.select("n", "id", "x").mapInArrow(deal, f"n bigint, id {kinds['id']}, x array<double>, cell int, r double")


def _at(values: Sequence, cell: str, kind: str) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col(cell))


def _compare(train: DataFrame, visits: DataFrame, n_train: Sequence[int], k: int, block_rows: int) -> DataFrame:
    """The k best of every (visit, block of its cell) within the visit's reach: q, test_id, n, train_id, dist and pairs, which one row of each block has
    (a row of nulls where nothing was in reach).

    ``train`` has n, id, x, cell, r; ``visits`` q, id, x, cell, r (from the cell's pivot) and reach."""
    n_visits = [0] * len(n_train)
    for row in visits.groupBy("cell").agg(F.count("*").alias("v")).collect():
        n_visits[row["cell"]] = row["v"]
    blocks = [max(1, math.ceil(x / block_rows)) for x in n_train]
    parts = [max(1, math.ceil(x / block_rows)) for x in n_visits]
    own = lambda col, counts: F.pmod(F.xxhash64(col), _at(counts, "cell", "int")).cast("int")
    every = lambda counts: F.explode(F.sequence(F.lit(0), _at(counts, "cell", "int") - 1))
    none = F.lit(None)
    test_id, train_id = visits.schema["id"].dataType, train.schema["id"].dataType
    left = train.where(_at([v > 0 for v in n_visits], "cell", "boolean")).select(
        "cell", own("n", blocks).alias("block"), every(parts).alias("part"), F.lit(0).alias("side"), "n", F.col("id").alias("train_id"), none.cast(test_id).alias("test_id"), "x", "r", F.lit(0.0).alias("reach"))
    right = visits.select("cell", every(blocks).alias("block"), own("q", parts).alias("part"), F.lit(1).alias("side"), F.col("q").alias("n"), none.cast(train_id).alias("train_id"),
                          F.col("id").alias("test_id"), "x", "r", "reach")

    def best(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        a, b = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        names = ["q", "test_id", "n", "train_id", "dist", "pairs"]
        # Equal distances go by id, a missing one first, then by row.
        at, bt = pc.sort_indices(a, sort_keys=[("train_id", "ascending"), ("n", "ascending")], null_placement="at_start"), pc.sort_indices(b, sort_keys=[("r", "ascending")])
        X, Q = _points(a, "x")[at.to_numpy()], _points(b, "x")[bt.to_numpy()]
        # The points are not carried along: a found row takes its ids only.
        a, b = a.select(["n", "train_id", "r"]).take(at), b.select(["n", "test_id", "r", "reach"]).take(bt)
        ra, rb, reach = a.column("r").to_numpy(), b.column("r").to_numpy(), b.column("reach").to_numpy()
        centre = X.mean(axis=0) if len(X) else 0.0
        C = X - centre
        xx = (C * C).sum(axis=1)
        by_r = np.argsort(ra, kind="stable")
        sorted_r = ra[by_r]
        rows, found, dists, pairs = [], [], [], 0
        for s in range(0, len(Q) if len(X) else 0, _CHUNK):
            q, give = Q[s:s + _CHUNK], _SLACK * (1 + rb[s:s + _CHUNK].max() + sorted_r[-1])
            low, high = np.searchsorted(sorted_r, [(rb[s:s + _CHUNK] - reach[s:s + _CHUNK]).min() - give, (rb[s:s + _CHUNK] + reach[s:s + _CHUNK]).max() + give])
            if low >= high:
                continue
            some = np.sort(by_r[low:high]) if high - low < len(X) else np.arange(len(X))
            pairs += len(some) * len(q)
            c, kk = q - centre, min(k, len(some))
            qq = (c * c).sum(axis=1)
            approx = xx[some][None, :] - 2.0 * (c @ C[some].T) + qq[:, None]
            # The expansion is off by a few rounding steps of its largest term; every row within that bound of the k-th distance is a candidate.
            slack = 1e-13 * (X.shape[1] + 8) * (xx[some].max() + qq)
            # A row beyond the reach, within which k rows are known, is no neighbour; it is not sent on.
            limit = reach[s:s + _CHUNK] * (1 + _SLACK) + _SLACK
            with np.errstate(over="ignore"):
                far = limit * limit + 2.0 * slack
            hits = (approx <= far[:, None]).sum(axis=1)
            full = np.flatnonzero(hits > 4 * kk)
            if len(full):
                far[full] = np.minimum(far[full], np.partition(approx[full], kk - 1, axis=1)[:, kk - 1] + 2.0 * slack[full])
            for i in np.flatnonzero(hits):
                near = some[np.flatnonzero(approx[i] <= far[i])]
                diff = q[i] - X[near]
                exact = np.sqrt((diff * diff).sum(axis=1))
                pick = np.argsort(exact, kind="stable")[:kk]
                pick = pick[exact[pick] <= limit[i]]
                rows.append(np.full(len(pick), s + i))
                found.append(near[pick])
                dists.append(exact[pick])
        rows, found = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (rows, found))
        count = np.zeros(len(rows), np.int64)
        if len(count):
            count[0] = pairs
        elif pairs:  # compared and nothing in reach: a row for the pairs alone
            none = [pa.nulls(1, kind) for kind in (b.schema.field("n").type, b.schema.field("test_id").type, a.schema.field("n").type, a.schema.field("train_id").type, pa.float64())]
            return pa.Table.from_arrays([*none, pa.array([pairs])], names)
        qa, na = b.take(pa.array(rows)), a.take(pa.array(found))
        return pa.Table.from_arrays([qa.column("n"), qa.column("test_id"), na.column("n"), na.column("train_id"), pa.array(np.concatenate(dists) if dists else np.zeros(0)), pa.array(count)], names)

    schema = f"q bigint, test_id {test_id.simpleString()}, n bigint, train_id {train_id.simpleString()}, dist double, pairs bigint"
    return left.unionByName(right).groupBy("cell", "block", "part").applyInArrow(best, schema)


def _visits(test: DataFrame, pivots: np.ndarray, radius: Sequence[float], n_train: Sequence[int], k: int) -> DataFrame:
    """Every other cell that may hold a neighbour of a query as near as its ``bound`` (null: none known)."""
    kinds = dict(test.dtypes)
    R, counts = np.array(radius), np.array(n_train)
    apart = np.sqrt(((pivots[:, None, :] - pivots[None]) ** 2).sum(axis=2))
    wide = ((pivots - pivots.mean(axis=0)) ** 2).sum(axis=1) + R * R

    def visit(batches):
        for batch in _portions(batches, pivots):
            X, own = _points(batch, "x"), batch.column("cell").to_numpy()
            bound = batch.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)
            bound = np.where(np.isnan(bound), np.inf, bound)
            line = np.arange(len(X))
            d = np.stack([np.sqrt(((X - p) ** 2).sum(axis=1)) for p in pivots], axis=1)
            # Whole cells: the k nearest rows are no farther than the cells, taken by their far ends, that hold k.
            ends = np.where(counts > 0, d + R, np.inf)
            order = np.argsort(ends, axis=1)
            enough = (np.cumsum(counts[order], axis=1) >= k).argmax(axis=1)
            whole = np.where(counts.sum() >= k, ends[line, order[line, enough]], np.inf)
            reach = np.minimum(bound, whole)
            give = _SLACK * (1 + d + R)
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (d * d - (d[line, own] ** 2)[:, None]) / (2 * apart[own])
            plane = np.where(apart[own] > 0, plane, 0)
            give = give + np.where(apart[own] > 0, _SLACK * (1 + d * d + wide) / np.where(apart[own] > 0, apart[own], 1), 0)
            go = (counts > 0) & (d - R - give <= reach[:, None]) & (plane - give <= reach[:, None])
            go[line, own] = False
            row, cell = np.nonzero(go)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("q").take(take), batch.column("id").take(take), batch.column("x").take(take), pa.array(cell.astype(np.int32)),
                                              pa.array(d[row, cell]), pa.array(np.minimum(reach[row], 1e300))], ["q", "id", "x", "cell", "r", "reach"])

    return test.select("q", "id", "x", "cell", "bound").mapInArrow(visit, f"q bigint, id {kinds['id']}, x array<double>, cell int, r double, reach double")


def _candidates(train: DataFrame, test: DataFrame, k: int, block_rows: int, cells: int | None) -> DataFrame:
    """The k best of every block that a query is compared with; among them its k nearest rows."""
    n = train.count()
    # A fixed number of cells would have pairs grow with the square of the rows.
    cells = max(cells or 1, 1 if n <= block_rows else math.ceil(4 * n / block_rows))
    pivots = _pivots(train, min(cells, _CELLS))
    dealt = _dealt(train, pivots)
    if len(pivots) > 1:
        dealt = _written(dealt, "knn-train")
    n_train, radius = [0] * len(pivots), [0.0] * len(pivots)
    if len(pivots) == 1:
        n_train, radius = [n], [math.inf]
    else:
        for row in dealt.groupBy("cell").agg(F.count("*").alias("c"), F.max("r").alias("r")).collect():
            n_train[row["cell"]], radius[row["cell"]] = row["c"], row["r"]
        used = [i for i, c in enumerate(n_train) if c]
        if len(used) < len(pivots):  # a cell without rows has no neighbours to offer
            pivots, n_train, radius = pivots[used], [n_train[i] for i in used], [radius[i] for i in used]
            place = {c: i for i, c in enumerate(used)}
            dealt = dealt.withColumn("cell", _at([place.get(c, -1) for c in range(max(used) + 1)], "cell", "int"))
    home = _dealt(test, pivots).withColumnRenamed("n", "q")
    if len(pivots) == 1:
        return _compare(dealt, home.withColumn("reach", F.lit(1e300)), n_train, k, block_rows)
    home = _written(home, "knn-test")
    first = _written(_compare(dealt, home.withColumn("reach", F.lit(1e300)), n_train, k, block_rows), "knn-first")
    w = Window.partitionBy("q").orderBy("dist")
    bound = first.select("q", "dist", F.row_number().over(w).alias("rank")).where(F.col("rank") == k).select("q", F.col("dist").alias("bound"))
    visits = _written(_visits(home.join(bound, "q", "left"), pivots, radius, n_train, k), "knn-visits")
    return first.unionByName(_compare(dealt, visits, n_train, k, block_rows))


def _nearest(train: DataFrame, test: DataFrame, features, k: int, train_id: str, test_id: str, block_rows: int, keep: Sequence[str], cells: int | None) -> DataFrame:
    """(q, test_id, train_id, dist, kept columns, rank); q numbers the query rows."""
    tr, te = _rows(train, features, train_id, keep), _rows(test, features, test_id)
    kept = [f"nb_{c}" for c in keep]
    if tr.isEmpty() or te.isEmpty():
        kinds = [("q", "bigint"), ("test_id", te.schema["id"].dataType.simpleString()), ("train_id", tr.schema["id"].dataType.simpleString()), ("dist", "double"),
                 *[(c, tr.schema[c].dataType.simpleString()) for c in kept], ("rank", "int")]
        return train.sparkSession.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in kinds))
    cand = _candidates(tr, te, k, block_rows, cells).where("n is not null")
    w = Window.partitionBy("q").orderBy("dist", "train_id", "n")
    best = cand.select("q", "test_id", "n", "train_id", "dist", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
    if kept:
        best = best.join(tr.select("n", *kept), "n")
    return best.select("q", "test_id", "train_id", "dist", *kept, "rank")


def knn_neighbors(train: DataFrame, test: DataFrame, features: str | Sequence[str], k: int = 9, train_id: str = "id",
                  test_id: str = "id", block_rows: int = _BLOCK_ROWS, keep: Sequence[str] = (), cells: int | None = None) -> DataFrame:
    """Exact Euclidean k nearest training rows for every test row.

    Returns (test_id, train_id, dist, rank) plus ``keep`` columns of train (renamed ``nb_<col>``), k rows, or as many as
    there are training rows, for each test row. Ties go to the smaller train id, a missing id first. Ids may repeat: each row keeps its own
    columns. ``cells`` is the least number of pivots (by default one); beyond ``block_rows`` training rows there are four per so many at least, up to
    ``_CELLS`` in all. It changes the work, not the result. A feature that is NULL or NaN is an error; an empty side gives no row.
    """
    return _nearest(train, test, features, k, train_id, test_id, block_rows, keep, cells).drop("q")


def knn_pairs(train: DataFrame, test: DataFrame, features: str | Sequence[str], k: int = 9, train_id: str = "id", test_id: str = "id",
              block_rows: int = _BLOCK_ROWS, cells: int | None = None) -> DataFrame:
    """What the bounds save: (train_rows, test_rows, pairs compared, fraction of all pairs), one row."""
    tr, te = _rows(train, features, train_id), _rows(test, features, test_id)
    a, b = tr.count(), te.count()
    done = _candidates(tr, te, k, block_rows, cells).agg(F.sum("pairs").alias("p")).first()["p"] if a and b else 0
    return train.sparkSession.createDataFrame([(a, b, done, done / (a * b) if a and b else None)], "train_rows long, test_rows long, pairs long, fraction double")


def knn_classify(train: DataFrame, test: DataFrame, features: str | Sequence[str], label: str, k: int = 9,
                 train_id: str = "id", test_id: str = "id", positive=1, cells: int | None = None) -> DataFrame:
    """Majority vote of the k nearest (ties -> smaller label) and the share
    of positive neighbours as score. Returns (test_id, prediction, score), one row for every test row."""
    vote = F.col(f"nb_{label}")
    votes = (_nearest(train, test, features, k, train_id, test_id, _BLOCK_ROWS, [label], cells)
             .groupBy("q", "test_id", vote.alias("vote")).agg(F.count(F.lit(1)).alias("n"), F.count_if(vote == F.lit(positive)).alias("hits")))
    best = F.min(F.struct((-F.col("n")).alias("n"), "vote"))["vote"]
    return votes.groupBy("q", "test_id").agg(best.alias("prediction"), (F.sum("hits") / F.sum("n")).alias("score")).drop("q")
