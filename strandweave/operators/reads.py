"""Cleaning, normalising and merging of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import is_acgt, longest_segment, trim_error, trim_right
from ..plans.session import cut


def latest(rows: DataFrame, key: str, order: str = "loaded_at") -> DataFrame:
    """One row for each ``key``, the last by ``order`` (nulls first): resent rows count once. A row without a
    key is no resend of another: it stays, and such rows are spread."""
    rest = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(F.col(order).isNotNull(), F.col(order)))
    own = F.when(F.col(key).isNull(), F.monotonically_increasing_id()).alias("_own")
    return rows.groupBy(key, own).agg(best.alias("_row")).select(key, *(F.col("_row")[c].alias(c) for c in rest))


def clean_reads(reads: DataFrame, *, trim: int = 0) -> DataFrame:
    """Reads with ``seq`` trimmed by ``trim`` bases and cut to its longest part without N (the first of equals), and
    ``active``: whether that is all upper-case ACGT. The others keep their row, with an empty sequence, so mates stay
    aligned. Null sequences are inactive, the empty one is active."""
    longest = longest_segment(trim_right("seq", trim))
    fine = F.coalesce(is_acgt(longest), F.lit(False))
    return reads.withColumn("_cut", longest).withColumn("active", fine).withColumn("seq", F.when(F.col("active"), F.col("_cut")).otherwise("")).drop("_cut")


def split_by_length(reads: DataFrame, *, trim: int = 0, limit: int = 80) -> DataFrame:
    """The older loader: trimmed, cut after the last ACGT letter; ``kind`` is ``short`` up to ``limit`` bases, ``long`` beyond,
    ``bad`` (with an empty sequence) if another letter is left."""
    kept = trim_error(trim_right(F.coalesce("seq", F.lit("")), trim))
    kind = F.when(~is_acgt("seq"), "bad").when(F.length("seq") > limit, "long").otherwise("short")
    return reads.withColumn("seq", kept).withColumn("kind", kind).withColumn("seq", F.when(F.col("kind") == "bad", "").otherwise(F.col("seq")))


def normalize_reads(reads: DataFrame, length: int) -> DataFrame:
    """Reads of at least ``length`` bases, cut to it."""
    return reads.where(F.length("seq") >= length).withColumn("seq", F.substring("seq", 1, length))


def normalize_pairs(reads: DataFrame, length: int) -> DataFrame:
    """As ``normalize_reads``, for pairs both of whose mates are long enough. Reads without a pair are left out."""
    both = reads.where("pair_id IS NOT NULL").withColumn("_n", F.count_if(F.length("seq") >= length).over(Window.partitionBy("pair_id")))
    return normalize_reads(both.where("_n >= 2"), length).drop("_n")


def merged(one: DataFrame, other: DataFrame, *, order: str) -> DataFrame:
    """Rows of two files in turn (``idx, src, name, seq``), as far as the shorter goes. The row index is the rank by ``order``;
    it is counted by partition first, so no single task sorts all rows."""

    def indexed(df: DataFrame) -> DataFrame:
        # written once, so that the numbers of a partition and its count come from one and the same sort
        sorted_ = cut(df.orderBy(order).select("name", "seq", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")))
        counts = sorted_.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
        before = counts.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))  # one row a partition
        return sorted_.join(F.broadcast(before), "p").select((F.col("before") + F.col("m") - F.col("p").cast("bigint") * F.lit(1 << 33)).alias("idx"), "name", "seq")

    a, b = indexed(one), indexed(other)
    both = a.join(b.select("idx"), "idx", "left_semi").withColumn("src", F.lit(0)).unionByName(b.join(a.select("idx"), "idx", "left_semi").withColumn("src", F.lit(1)))
    return both.select("idx", "src", "name", "seq")
