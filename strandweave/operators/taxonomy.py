"""Trees of taxa: closure, roll-up and compression of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut
from .cluster import frequency_vectors

#: The ranks that groups of references are kept for.
RANKS = ("species", "genus", "family", "order", "class", "phylum")


def closure(nodes: DataFrame, *, most: int = 64) -> DataFrame:
    """``id, ancestor, depth``: every node with itself (depth 0) and all nodes above it. ``nodes`` is ``id, parent_id``; a root has a
    null parent or itself. A loop over the levels of the tree, at most ``most`` deep; a circle is refused."""
    up = cut(nodes.where("parent_id IS NOT NULL AND parent_id <> id").select(F.col("id").alias("ancestor"), "parent_id"))
    level = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")).distinct()
    levels = [level]
    for depth in range(1, most + 1):
        level = cut(level.join(up, "ancestor").select("id", F.col("parent_id").alias("ancestor"), F.lit(depth).alias("depth")))
        if not level.limit(1).count():
            break
        levels.append(level)
    else:
        raise ValueError("the tree has a circle, or is deeper than the bound")
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def compressed(nodes: DataFrame, ranks: list[str]) -> DataFrame:
    """``id, parent_id``: each node's nearest proper ancestor whose rank is listed, or its root (a root keeps itself)."""
    above = closure(nodes)
    rank = nodes.select(F.col("id").alias("ancestor"), "rank", (F.col("parent_id").isNull() | (F.col("parent_id") == F.col("id"))).alias("root"))
    known = above.join(rank, "ancestor").where((F.col("depth") > 0) | F.col("root"))
    stop = known.where(F.col("rank").isin(ranks) & (F.col("depth") > 0) | F.col("root"))
    return stop.groupBy("id").agg(F.min_by("ancestor", "depth").alias("parent_id"))


def rolled_up(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """``id, refs, centre``: for each node with a reference at or below it their number and its centre (an array): the mean of the
    centres of its children that have any, for a leaf the mean of its own vectors. ``refs`` is ``id, vals``. Folded level by
    level from the deepest node up. References of an inner node count for it, its centre comes from its children."""
    above = closure(nodes)
    counts = refs.join(above, "id").groupBy("ancestor").agg(F.count(F.lit(1)).alias("refs")).withColumnRenamed("ancestor", "id")
    depth = cut(above.groupBy("id").agg(F.max("depth").alias("depth")))
    parents = nodes.where("parent_id IS NOT NULL AND parent_id <> id").select("id", "parent_id")
    inner = parents.select(F.col("parent_id").alias("id")).distinct()

    def mean(rows: DataFrame, key: str) -> DataFrame:
        return rows.select(F.col(key).alias("id"), F.posexplode("centre").alias("dim", "v")).groupBy("id", "dim").agg(F.avg("v").alias("v")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("centre"))

    leaves = cut(mean(refs.withColumnRenamed("vals", "centre"), "id").join(inner, "id", "left_anti").join(depth, "id"))
    deepest = depth.agg(F.max("depth")).first()[0] or 0
    level, done = leaves.where(F.col("depth") == deepest).select("id", "centre"), leaves.where(F.col("depth") == deepest).select("id", "centre")
    for d in range(deepest - 1, -1, -1):
        up = mean(level.join(parents, "id").select("parent_id", "centre"), "parent_id")
        level = cut(up.unionByName(leaves.where(F.col("depth") == d).select("id", "centre")))
        done = done.unionByName(level)
    return counts.join(done, "id")


def reference_tables(nodes: DataFrame, sequences: DataFrame, ranks: tuple[str, ...] = RANKS) -> tuple[DataFrame, DataFrame]:
    """The reference database: ``ref, vals`` (frequency vectors) and ``rank, taxon_id, ref``, the references at or below each taxon of
    a listed rank. ``sequences`` is ``ref, taxon_id, seq``; references of unknown taxa are in the first table only."""
    vectors = frequency_vectors(sequences, "ref")
    above = closure(nodes).join(nodes.select(F.col("id").alias("ancestor"), "rank"), "ancestor").where(F.col("rank").isin(*ranks))
    groups = sequences.select("ref", F.col("taxon_id").alias("id")).join(above, "id").select("rank", F.col("ancestor").alias("taxon_id"), "ref").distinct()
    return vectors, groups
