"""Frequency vectors of sequences, distances, and clustering by rank distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bases import canonical_code, is_acgt
from ..functions.vectors import rank_vector
from ..plans.session import cut, release


def dimensions(k: int = 4) -> list[tuple[int, bool]]:
    """The codes of canonical k-mers in ascending order, each with whether it is a palindrome (136 for k = 4)."""
    out = {}
    for digits in product(range(4), repeat=k):
        code = sum(d << 2 * i for i, d in enumerate(digits))
        back = sum(3 - d << 2 * (k - 1 - i) for i, d in enumerate(digits))
        out[min(code, back)] = code == back
    return sorted(out.items())


def frequency_vectors(seqs: DataFrame, id_col: str, *, k: int = 4) -> DataFrame:
    """``id_col, vals``: for each sequence the frequencies of its k-mers with both strands merged, over its length; palindromes
    count twice. Windows with other letters than ACGT are left out, lower case counts as upper; null and empty sequences
    have no row."""
    dims = dimensions(k)
    text = seqs.select(F.col(id_col), F.upper("seq").alias("seq")).where(F.length("seq") > 0)
    spots = text.where(F.length("seq") >= k).select(id_col, F.explode(F.transform(F.sequence(F.lit(1), F.length("seq") - (k - 1)), lambda i: F.substring("seq", i, F.lit(k)))).alias("w")).where(is_acgt("w"))
    counts = spots.groupBy(id_col, "w").agg(F.count(F.lit(1)).alias("n")).groupBy(id_col, canonical_code("w").alias("code")).agg(F.sum("n").alias("n"))
    maps = counts.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("m"))  # as many entries as dimensions
    wanted = F.array(*(F.struct(F.lit(c).cast("bigint").alias("c"), F.lit(2 if twice else 1).alias("t")) for c, twice in dims))
    sized = text.select(id_col, F.length("seq").alias("len")).join(maps, id_col, "left")
    value = lambda d: F.when(F.col("m").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.try_element_at("m", d["c"]), F.lit(0)) * d["t"] / F.col("len"))
    return sized.select(id_col, F.transform(wanted, value).alias("vals"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def nearest(points: np.ndarray, ids: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id of the nearest centre of each point, of equal ones the first, and the distance."""
    r = points.astype(np.int16)
    best, at = np.full(len(r), 1 << 30), np.zeros(len(r), np.int64)
    for c, k in zip(ranks, ids):
        d = np.abs(r - c).sum(1, dtype=np.int32)
        at[d < best] = k
        np.minimum(best, d, out=best)
    return at, best


def assigned(points: DataFrame, centres: list[tuple[int, list[int]]], *, dims: int = 136) -> DataFrame:
    """``id, ranks, centre, distance``: the nearest centre (``(id, ranks)``, a bounded list) of each point, of equal ones the first
    in the list. Without centres there are no rows."""
    ids, ranks = np.array([c for c, _ in centres], np.int64), np.array([r for _, r in centres], np.int16).reshape(len(centres), dims)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(ids):
                continue
            at, best = nearest(matrix(batch.column(1), dims), ids, ranks)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(best.astype(np.int32))], names=["id", "ranks", "centre", "distance"])

    return points.select("id", "ranks").mapInArrow(measure, "id bigint, ranks array<int>, centre bigint, distance int")


def cluster_spread(members: DataFrame) -> DataFrame:
    """``centre, n, mean, sd``: members of each centre, and mean and sample deviation of their distances."""
    return members.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean"), F.stddev_samp("distance").alias("sd"))


def centroids(members: DataFrame, vals: DataFrame) -> DataFrame:
    """``centre, vals, ranks``: the mean values of each centre's members and their ranks."""
    spots = members.select("id", "centre").join(vals.select("id", F.posexplode("vals").alias("dim", "v")), "id")
    means = spots.groupBy("centre", "dim").agg(F.avg("v").alias("v")).groupBy("centre").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("vals"))
    return means.withColumn("ranks", rank_vector("vals"))


def moved_centres(points: DataFrame, centres: list[tuple[int, list[int]]], *, dims: int = 136) -> DataFrame:
    """``centre, ranks``: the ranks of the mean values of the points (``id, vals, ranks``) nearest to each centre, by sums that
    the tasks make."""

    ids, ranks = np.array([c for c, _ in centres], np.int64), np.array([r for _, r in centres], np.int16).reshape(len(centres), dims)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(ids) or not len(batch):
                continue
            at, v = nearest(matrix(batch.column(0), dims), ids, ranks)[0], matrix(batch.column(1), dims)
            some = np.unique(at)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([int((at == c).sum()) for c in some], pa.int64()), pa.array([v[at == c].sum(0).tolist() for c in some], pa.list_(pa.float64()))], names=["centre", "n", "sums"])

    parts = points.select("ranks", "vals").mapInArrow(sums, "centre bigint, n bigint, sums array<double>").select("centre", "n", F.posexplode("sums").alias("dim", "v"))
    means = parts.groupBy("centre", "dim").agg((F.sum("v") / F.sum("n")).alias("v")).groupBy("centre").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("vals"))
    return means.select("centre", rank_vector("vals").alias("ranks"))


def kmeans(points: DataFrame, k: int, *, seed: int = 0, rounds: int = 40, outliers: float = 2.0) -> tuple[DataFrame, float]:
    """Clusters of ``points`` (``id, vals, ranks``) by rank distance to the mean's ranks: ``id, centre, distance, outlier``, and the
    mean distance of the points that are no outliers. The first centres are ``k`` points in the order of a seeded hash.
    At most ``rounds`` rounds, ending when no centre moves; then points further than mean + ``outliers`` deviations from
    their centre are set aside, once, and the rounds are repeated without them. Only k centres ever come to the driver."""
    first = points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).collect()
    centres = [(i, list(r.ranks)) for i, r in enumerate(first)]
    inside, aside = points, None
    for phase in range(2):
        for _ in range(rounds):
            moved = {r.centre: list(r.ranks) for r in moved_centres(inside, centres).collect()}
            new = [(i, moved.get(i, old)) for i, old in centres]
            still = new == centres
            centres = new
            if still:
                break
        if phase == 0:
            members = cut(assigned(inside, centres))
            spread = cluster_spread(members)
            limit = F.broadcast(spread.select("centre", (F.col("mean") + outliers * F.coalesce("sd", F.lit(0.0))).alias("limit")))
            marked = cut(members.join(limit, "centre").select("id", (F.col("distance") > F.col("limit")).alias("outlier")))
            release(members)
            aside = marked.where("outlier")
            inside = cut(points.join(marked.where("NOT outlier").select("id"), "id", "left_semi"))
    final = cut(assigned(points, centres).drop("ranks").join(aside, "id", "left").withColumn("outlier", F.coalesce("outlier", F.lit(False))))
    release(marked, inside)
    mean = final.where("NOT outlier").agg(F.avg("distance")).first()[0]
    return final, float("inf") if mean is None else mean


def best_kmeans(points: DataFrame, k: int, *, restarts: int = 10, rounds: int = 40) -> DataFrame:
    """The restart with the smallest mean distance, labels and outliers of one and the same run."""
    best = kmeans(points, k, seed=0, rounds=rounds)
    for s in range(1, restarts):
        run = kmeans(points, k, seed=s, rounds=rounds)
        best, lost = (run, best) if run[1] < best[1] else (best, run)
        release(lost[0])
    return best[0]


def normalized(points: DataFrame) -> DataFrame:
    """``id, vals`` with each dimension's mean taken off and divided by its sample deviation (0 where that is 0 or null)."""
    spots = points.select("id", F.posexplode("vals").alias("dim", "v"))
    stats = spots.groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    order = F.array_sort(F.collect_list(F.struct("dim", "m", "s")))
    whole = F.broadcast(stats.agg(order.alias("stats")))  # one row, an entry a dimension
    z = F.zip_with("vals", "stats", lambda v, s: F.when(s["s"] > 0, (v - s["m"]) / s["s"]).otherwise(0.0))
    return points.join(whole).select("id", z.alias("vals"))


def classified(members: DataFrame, references: list[tuple[int, list[int]]], taxa: DataFrame, ranks: DataFrame) -> DataFrame:
    """``centre, taxon, votes``: for each cluster the taxon whose references (``taxa``: ``ref, taxon``) are most often the nearest
    of a member; of equal votes the smaller taxon."""
    nearest = assigned(members.select("id").join(ranks, "id"), references).select("id", F.col("centre").alias("ref"))
    votes = members.join(nearest, "id").groupBy("centre", "ref").agg(F.count(F.lit(1)).alias("n")).join(taxa, "ref").groupBy("centre", "taxon").agg(F.sum("n").alias("votes"))
    first = Window.partitionBy("centre").orderBy(F.desc("votes"), "taxon")
    return votes.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")


def confusion(rows: DataFrame, cluster: str, label: str) -> DataFrame:
    return rows.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))


def greedy_match(counts: DataFrame, cluster: str, label: str) -> DataFrame:
    """One-to-one pairs of cluster and label, always the largest count left (ties by cluster and label), as ``cluster, label, n``.

    A cell that is the first of its row and of its column is what the greedy choice takes in the end, whatever comes before, so
    every round takes all such cells at once and drops their rows and columns."""
    left = cut(counts.where(F.col(cluster).isNotNull() & F.col(label).isNotNull()).select(cluster, label, "n"))
    taken = []
    while left.limit(1).count():
        first = {}
        for own, other in ((cluster, label), (label, cluster)):
            best = left.groupBy(own).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(other).alias("o"))).alias("b"))
            first[own] = best.select(own, F.col("b.o").alias(other))
        took = cut(left.join(first[cluster], [cluster, label], "left_semi").join(first[label], [cluster, label], "left_semi"))
        rest = cut(left.join(took.select(cluster), cluster, "left_anti").join(took.select(label), label, "left_anti"))
        release(left)
        taken.append(took)
        left = rest
    release(left)
    return reduce(DataFrame.unionByName, taken) if taken else counts.select(cluster, label, "n").limit(0)


def accuracy(counts: DataFrame, matched: DataFrame) -> DataFrame:
    """``correct, total, accuracy``: how many records of a confusion table lie in the label that their cluster is matched with,
    and the percentage."""
    correct = matched.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("correct"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return correct.join(F.broadcast(total)).select("correct", "total", F.round(100 * F.col("correct") / F.nullif(F.col("total"), F.lit(0)), 6).alias("accuracy"))


def group_distances(queries: DataFrame, points: DataFrame, *, block: int = 4096, dims: int = 136) -> DataFrame:
    """``g1, g2, n, min, max, mean, median``: rank distances between a query group's and a group's members (``id, grp, ranks``),
    no point against itself. Queries are met in blocks of ``block`` by one pass over the points each; distances are counted
    by value in the tasks, so what is shuffled and sorted are counts of distinct distances. The median is the upper one."""
    rows = queries.select("id", "grp", "ranks").orderBy("id").toLocalIterator()
    parts: list[DataFrame] = []

    def met(q: list) -> DataFrame:
        ids, grp = np.array([r.id for r in q]), np.array([r.grp for r in q])
        ranks = np.array([r.ranks for r in q], np.int16)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, g2, r = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), dims).astype(np.int16)
                frames = []
                for i in range(len(ids)):
                    d = np.abs(r - ranks[i]).sum(1, dtype=np.int32)
                    frames.append(pd.DataFrame({"g1": grp[i], "g2": g2, "d": d})[own != ids[i]])
                out = pd.concat(frames).groupby(["g1", "g2", "d"]).size().reset_index(name="c")
                yield pa.RecordBatch.from_pandas(out.astype({"g1": "int64", "g2": "int64", "d": "int32", "c": "int64"}), preserve_index=False)

        return points.select("id", "grp", "ranks").mapInArrow(count, "g1 bigint, g2 bigint, d int, c bigint")

    chunk: list = []
    for r in rows:
        chunk.append(r)
        if len(chunk) == block:
            parts.append(met(chunk))
            chunk = []
    if chunk or not parts:
        parts.append(met(chunk) if chunk else points.sparkSession.createDataFrame([], "g1 bigint, g2 bigint, d int, c bigint"))
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    counts = counts.groupBy("g1", "g2", "d").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("g1", "g2").orderBy("d"))
    whole = F.sum("c").over(Window.partitionBy("g1", "g2"))
    run = counts.withColumns({"upto": upto, "n": whole})
    return run.groupBy("g1", "g2").agg(F.max("n").alias("n"), F.min("d").alias("min"), F.max("d").alias("max"), F.round(F.sum(F.col("d") * F.col("c")) / F.max("n"), 6).alias("mean"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("d"))).alias("median"))
