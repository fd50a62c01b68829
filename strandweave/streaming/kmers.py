"""Counting k-mers of reads that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.bases import canonical, is_acgt


def once(reads: DataFrame, late: str, *, ts: str = "loaded_at", read_id: str = "read_id") -> DataFrame:
    """A stream of reads in which those that are resent within ``late`` of each other (by ``ts``) come once. The state holds the
    ids of that span only."""
    return reads.withWatermark(ts, late).dropDuplicatesWithinWatermark([read_id])


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """``kmer, cnt`` of the windows of ACGT letters of a table, or of a stream in update or complete mode."""
    spots = reads.where(F.length("seq") >= k).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("seq") - (k - 1)), lambda i: F.substring("seq", i, F.lit(k)))).alias("w"))
    return spots.where(is_acgt("w")).groupBy(canonical("w").alias("kmer")).agg(F.count(F.lit(1)).alias("cnt"))


def counted_batches(reads: DataFrame, k: int, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's partial counts to ``path`` as its own folder, so a batch that is repeated after a failure
    overwrites itself; the total is ``totals``. No state grows with the number of k-mers."""

    def keep(batch: DataFrame, number: int) -> None:
        kmer_counts(batch, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("kmer").agg(F.sum("cnt").alias("cnt"))
