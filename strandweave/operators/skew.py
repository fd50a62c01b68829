"""Per-key counts when a handful of keys holds most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import partitions


def heavy_keys(rows: DataFrame, key: str, *, share: float = 0.002, tracked: int = 4096) -> DataFrame:
    """Keys that hold at least about ``share`` of ``rows``, by a frequent-items sketch of ``tracked`` counters a task:
    at most 1/share keys, whatever the number of distinct ones. Null is never among them."""
    rows = rows.where(F.col(key).isNotNull())
    top = rows.agg(F.expr(f"approx_top_k({key}, {int(1 / share)}, {tracked})").alias("t"), F.count(F.lit(1)).alias("n"))
    return top.select(F.explode("t").alias("t"), "n").where(F.col("t.count") >= share * F.col("n")).select(F.col("t.item").alias(key))


def skew_safe_counts(rows: DataFrame, key: str, *, group: str, record: str, row_id: str, heavy: DataFrame) -> DataFrame:
    """For each ``key``: ``hits`` (distinct row ids), ``records`` (distinct pairs of group and record) and ``groups``
    (distinct groups), whatever the distribution of the keys.

    ``heavy`` lists the keys to spread, at most a few thousand (``heavy_keys``); it is broadcast. Their rows are salted by
    their record, so that no two parts of a key share a record, and the parts' counts are added up. The remaining
    keys take one ordinary shuffle on the key, and both results are united. The list decides only where a row is
    counted, never the counts.

    Defined results: rows with a null key are left out; a null group, record or row id counts as a value of its own; a row
    id that is repeated counts once for each key, group and record; an empty table gives no rows; other columns, whatever
    their names, are ignored.
    """
    n = partitions(rows.sparkSession)
    rows = rows.select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(record).alias("r"), F.col(row_id).alias("i")).where("k IS NOT NULL")
    heavy = F.broadcast(heavy.select(F.col(key).alias("k")))

    def by_group(part: DataFrame, *keys: str) -> DataFrame:
        # each group-by holds all the keys of the exchange before it, so none shuffles again
        rows_once = part.select(*keys, "g", "r", "i").distinct()
        records = rows_once.groupBy(*keys, "g", "r").agg(F.count(F.lit(1)).alias("h"))
        return records.groupBy(*keys, "g").agg(F.sum("h").alias("h"), F.count(F.lit(1)).alias("r"))

    def by_key(groups: DataFrame) -> DataFrame:
        return groups.groupBy("k").agg(F.sum("h").alias("hits"), F.sum("r").alias("records"), F.count(F.lit(1)).alias("groups"))

    light = by_key(by_group(rows.join(heavy, "k", "left_anti").repartition(n, "k"), "k"))
    salted = rows.join(heavy, "k", "left_semi").withColumn("s", F.pmod(F.xxhash64("g", "r"), F.lit(n))).repartition(n, "k", "s")
    merged = by_group(salted, "k", "s").groupBy("k", "g").agg(F.sum("h").alias("h"), F.sum("r").alias("r"))
    return light.unionByName(by_key(merged)).withColumnRenamed("k", key)
