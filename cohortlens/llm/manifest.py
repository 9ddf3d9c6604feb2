"""A Merkle manifest of a dataset, by slot pivots.

Leaves of each group (a source, say) stand in order; every ``FANOUT`` of them
in a row have a parent, and so on up to one node per group; those nodes, in the
order of their groups, are the leaves of the tree above. Conditional aggregates
spread the children of a parent into one row with a column for each slot: all
columns concatenated make the parent's hash, and those before and behind a
child's own are its siblings, without any join of children among themselves.

Proof paths are built downwards: a parent's path, short tables first, goes to
its row of children, which put their own siblings in front. So the bytes shipped for
paths are those of the parents of leaves, a sixteenth of the leaves' own.

No group is gathered in a task, however large: leaves are sorted by range, and a leaf's
place is its place within its partition plus the counts of the partitions
before it. Each level is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.scratch import stored

FANOUT = 16


def record_hash(*columns: Column) -> Column:
    """SHA-256 (lowercase hex) of columns, each `-` if null, else its count of UTF-8 bytes, `:` and its value."""
    part = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.sha2(F.concat(*part), 256)


def _joined(columns: list[str]) -> Column:
    return F.concat_ws("", *columns) if columns else F.lit("")


def _places(rows: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with at__, parts): parts has, per partition of the sorted rows and group, what turns at__ into a place in the group."""
    rows = stored(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("at__", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at__", 33).alias("part__")
    parts = rows.groupBy(part, *group).agg(F.min("at__").alias("from__"), F.count("*").alias("n__"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    return rows, parts.select("part__", *group, "from__", (F.sum("n__").over(whole.orderBy("part__")) - F.col("n__")).alias("before__"), F.sum("n__").over(whole).alias("size"))


def _placed(leaves: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(leaves with tree, pos and size; groups with tree): tree numbers the groups in order, null first."""
    rows, parts = _places(leaves, [group], order)
    parts = stored(parts, "parts")
    names, spans = _places(parts.select(group).distinct(), [], [group])
    names = names.join(spans, F.shiftright(names["at__"], 33) == spans["part__"])
    names = stored(names.select(group, (F.col("at__") - F.col("from__") + F.col("before__")).alias("tree"), F.col("size").alias("trees")), "groups")
    parts = parts.join(names.select(F.col(group).alias("name__"), "tree"), F.col(group).eqNullSafe(F.col("name__"))).drop("name__").withColumnRenamed(group, "group__")
    found = rows.join(parts, (F.shiftright(rows["at__"], 33) == parts["part__"]) & rows[group].eqNullSafe(parts["group__"]))
    return found.withColumn("pos", F.col("at__") - F.col("from__") + F.col("before__")).drop("at__", "part__", "group__", "from__", "before__"), names


def _slots(nodes: DataFrame, fanout: int) -> DataFrame:
    """One row per parent: tree, pos, size (children in the whole tree), c0 .. (the children's structs) and hash."""
    spread = nodes.groupBy("tree", F.floor(F.col("pos") / fanout).alias("pos"), "size").agg(
        *[F.first(F.when(F.col("pos") % fanout == i, F.col("node")), ignorenulls=True).alias(f"c{i}") for i in range(fanout)])
    one = F.col("size") == 1
    return spread.withColumn("hash", F.when(one, F.col("c0.hash")).otherwise(F.sha2(_joined([f"c{i}.hash" for i in range(fanout)]), 256)))


def _climb(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """(levels from the leaves' parents up, (tree, hash) of each tree's top). ``nodes``: tree, pos, size, node (struct with hash)."""
    levels, tops = [], []
    while True:
        level = stored(_slots(nodes, fanout), "level")
        levels.append(level)
        tops.append(level.where(F.col("size") <= fanout).select("tree", "hash"))
        more = level.where(F.col("size") > fanout)
        if not more.limit(1).count():
            break
        nodes = more.select("tree", "pos", F.ceil(F.col("size") / fanout).alias("size"), F.struct("hash").alias("node"))
    top = tops[0]
    for t in tops[1:]:
        top = top.union(t)
    return levels, top


def _children(level: DataFrame, carry: list[str], fanout: int) -> DataFrame:
    """Every child of a level that has its parents' path: tree, pos, node, carry and its own path."""
    each = []
    for i in range(fanout):
        left, right = _joined([f"c{k}.hash" for k in range(i)]), _joined([f"c{k}.hash" for k in range(i + 1, fanout)])
        each.append(F.struct((F.col("pos") * fanout + i).alias("pos"), F.col(f"c{i}").alias("node"), F.struct(left.alias("left"), right.alias("right")).alias("step")))
    kids = level.select("tree", "size", "path", *carry, F.explode(F.array(*each)).alias("k")).where("k.node is not null")
    path = F.when(F.col("size") == 1, F.col("path")).otherwise(F.concat(F.array("k.step"), F.col("path")))
    return kids.select("tree", F.col("k.pos").alias("pos"), F.col("k.node").alias("node"), *carry, path.alias("path"))


def _descend(levels: list[DataFrame], tops: DataFrame, carry: list[str], fanout: int) -> DataFrame:
    """Every leaf with its path: tree, pos, node, carry, path. ``tops`` has tree, path (above the tree) and carry."""
    down = None
    for level in reversed(levels):
        with_path = level.where(F.col("size") <= fanout).join(tops, "tree")
        if down is not None:
            with_path = with_path.unionByName(level.where(F.col("size") > fanout).join(down.drop("node"), ["tree", "pos"]))
        down = _children(with_path, carry, fanout)
    return down


def merkle_manifest(leaves: DataFrame, group: str, order: list[str], carry: list[str], fanout: int = FANOUT) -> DataFrame:
    """Proof paths of all ``leaves``, a table with ``leaf`` (lowercase hex digest), ``group``, ``order`` and ``carry`` columns.

    One row per input row: the carry columns, leaf, subroot (its group's top
    hash), root and path, an array from the leaf's level to the root of
    (left, right): the concatenated digests of its siblings before and behind
    it. Within a group leaves stand in ascending ``order``, nulls first, equal ones
    by leaf, then as read; groups stand in ascending order too, a null group
    first. A group of one leaf has that leaf as its subroot. An empty table has no root and no row.
    """
    slim = leaves.select(F.col(group).alias("group__"), F.struct(*order).alias("order__"), F.monotonically_increasing_id().alias("row__"),
                         F.col("leaf").alias("hash__"), F.struct(F.col("leaf").alias("hash"), *[F.col(f"`{c}`").alias(f"v{i}__") for i, c in enumerate(carry)]).alias("node"))
    placed, groups = _placed(stored(slim, "leaves"), "group__", ["order__", "hash__", "row__"])
    levels, subroots = _climb(placed.select("tree", "pos", "size", "node"), fanout)
    subroots = subroots.join(groups.select("tree", "trees"), "tree")
    above, root = _climb(subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.col("trees").alias("size"), F.struct("hash").alias("node")), fanout)
    none = F.array().cast("array<struct<left:string,right:string>>")
    tops = _descend(above, root.select("tree", F.col("hash").alias("root"), none.alias("path")), ["root"], fanout)
    tops = stored(tops.select(F.col("pos").alias("tree"), "path", "root", F.col("node.hash").alias("subroot")), "subroots")
    found = _descend(levels, tops, ["subroot", "root"], fanout)
    return found.select(*[F.col(f"node.v{i}__").alias(c) for i, c in enumerate(carry)], F.col("node.hash").alias("leaf"), "subroot", "root", "path")


def proof(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path's siblings give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
