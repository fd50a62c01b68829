"""The most frequent values: sorted runs with counts, merged range by range, a bounded heap for each."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bases import decode
from ..functions.hits import usable_hits
from ..plans.session import cut, partitions, table
from .term_counts import USABLE

K = 31


def counted_runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs of ``size`` values, each with its count: repeated values shrink before they are shuffled."""

    def run() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["value", "n"])

    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
        n += len(held[-1])
        if n >= size:
            yield run()
            held, n = [], 0
    if n:
        yield run()


def heaviest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` values with the highest sums of ``n`` among rows sorted by value, of equal sums the smaller values. Holds
    one batch, the value that may go on in the next one, and a heap of ``k``."""
    heap: list[tuple[int, int]] = []
    last, total = None, 0

    def offer(values: np.ndarray, sums: np.ndarray) -> None:
        if len(values) > k:
            best = np.lexsort((values, -sums))[:k]
            values, sums = values[best], sums[best]
        for v, n in zip(values.tolist(), sums.tolist()):
            (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (n, -v))

    for batch in batches:
        values, counts = (c.to_numpy() for c in batch.columns)
        if not len(values):
            continue
        starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        sums = np.add.reduceat(counts, starts)
        values = values[starts]
        if last is not None and last == values[0]:
            sums[0] += total
        elif last is not None:
            offer(np.array([last]), np.array([total]))
        last, total = int(values[-1]), int(sums[-1])
        offer(values[:-1], sums[:-1])
    if last is not None:
        offer(np.array([last]), np.array([total]))
    if heap:
        yield pa.RecordBatch.from_arrays([pa.array([-v for _, v in heap], pa.int64()), pa.array([n for n, _ in heap], pa.int64())], names=["value", "n"])


def top_values(rows: DataFrame, value: str, k: int, *, run: int = 1 << 19) -> DataFrame:
    """``value, n``: the ``k`` values of a BIGINT column with the most rows, ties by the smaller value, with their counts.

    An external sort with run-length counting: tasks turn ``run`` values at a time into a sorted run of distinct values
    with counts (so a value that holds a third of all rows is a few rows afterwards), the runs are partitioned by value
    range and merge-sorted by Spark, which spills, and each range is read once in order with a heap of ``k``. Memory
    is bounded by ``run`` and ``k``, not by the number of distinct values. The counts come out exact.

    Defined results: nulls are no value; fewer than ``k`` distinct values give that many rows; an empty table none.
    """
    spark = rows.sparkSession
    # a table, as the bounds of the ranges are sampled from it before it is partitioned
    runs = cut(rows.select(F.col(value).alias("value")).mapInArrow(lambda b: counted_runs(b, run), "value bigint, n bigint"))
    ranges = runs.repartitionByRange(partitions(spark), "value").sortWithinPartitions("value")
    best = ranges.mapInArrow(lambda b: heaviest(b, k), "value bigint, n bigint")
    return best.orderBy(F.desc("n"), "value").limit(k)


def p5_top(spark: SparkSession, sf_dir: str, *, k: int = 15) -> DataFrame:
    once = usable_hits(table(spark, sf_dir, "kmer_hits"), columns=("hit_id",)).distinct()
    return top_values(once, "code", k).select(decode("value", K).alias("kmer"), F.col("n").alias("hits"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_top(spark, sf_dir).select("kmer")


QUERIES = {"p5_top": p5_top, "p5_found": p5_found}
TOP = f"WITH {USABLE} SELECT kmer, count(DISTINCT hit_id) AS hits FROM hits GROUP BY kmer ORDER BY hits DESC, reverse(kmer) LIMIT 15"
ORACLE = {"p5_top": TOP, "p5_found": f"SELECT kmer FROM ({TOP})"}
