"""How many members every two of many sets share, from bottom-k hash sketches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bases import clean_name
from ..functions.hits import usable_hits
from ..plans.session import broadcast_checked, cut, table


def sketches(members: DataFrame, owner: str, member: str, *, k: int) -> DataFrame:
    """``owner, n, hashes``: the size of each set and its ``k`` smallest hashes, ascending. ``members`` must be distinct."""
    hashed = members.select(F.col(owner).alias("o"), F.xxhash64(member).alias("h"))
    order = Window.partitionBy("o").orderBy("h")
    low = hashed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)  # limited before the shuffle too
    lists = low.groupBy("o").agg(F.array_sort(F.collect_list("h")).alias("hashes"))  # k at most
    sizes = hashed.groupBy("o").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(lists, "o").withColumnRenamed("o", owner)


def compared(one: np.ndarray, other: np.ndarray, k: int) -> tuple[int, int, float]:
    """Of the ``k`` smallest hashes of the union: how many there are, how many both sets have, and the union's size."""
    both = np.concatenate((one, other))
    if not len(both):
        return 0, 0, 0.0
    both.sort(kind="stable")
    again = np.r_[both[1:] == both[:-1], False]
    first = np.r_[True, ~again[:-1]]
    kept = np.flatnonzero(first)[:k]
    shared = int(again[kept].sum())
    if len(kept) < k:  # then both sketches are whole sets
        return len(kept), shared, float(len(kept))
    return k, shared, (k - 1) / ((float(both[kept[-1]]) + 2.0**63) / 2.0**64)


def overlaps(sets: DataFrame, owner: str, *, k: int, block: int = 64) -> DataFrame:
    """``a, b, n_a, n_b, seen, shared, both, exact`` for every two sets, a < b: of ``seen`` smallest hashes of their
    union ``shared`` are in both, and ``both`` is the estimated size of the intersection, the shared fraction times the
    union's size (exact where the sketches are the whole sets). ``sets`` comes from ``sketches``, as a table.

    The result has a row for every pair, so every pair of sketches must meet: sets are put into blocks of about ``block``,
    and a task compares two blocks; no member is ever compared or expanded.
    """
    blocks = max(1, -(-sets.count() // block))
    placed = sets.select(F.col(owner).alias("o"), "n", "hashes", F.pmod(F.xxhash64(owner), F.lit(blocks)).cast("int").alias("x"))
    spread = placed.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"i": F.least("x", "y"), "j": F.greatest("x", "y")})

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf.i.iloc[0]), int(pdf.j.iloc[0])
        rows = list(zip(pdf.o, pdf.n, pdf.hashes, pdf.x))
        left, right = [r for r in rows if r[3] == i], [r for r in rows if r[3] == j]
        out = []
        for p, one in enumerate(left):
            for other in left[p + 1 :] if i == j else right:
                a, b = (one, other) if one[0] < other[0] else (other, one)
                seen, shared, union = compared(a[2], b[2], k)
                out.append((a[0], b[0], a[1], b[1], seen, shared, shared / seen * union if seen else 0.0, seen < k))
        return pd.DataFrame(out, columns=["a", "b", "n_a", "n_b", "seen", "shared", "both", "exact"])

    kind = sets.schema[owner].dataType.simpleString()
    return spread.groupBy("i", "j").applyInPandas(pairs, f"a {kind}, b {kind}, n_a bigint, n_b bigint, seen bigint, shared bigint, both double, exact boolean")


def exact_overlaps(pairs: DataFrame, members: DataFrame, owner: str, member: str) -> DataFrame:
    """``a, b, both``: members in both sets of each listed pair (pairs that share none give no row)."""
    pairs = broadcast_checked(pairs.select("a", "b"))
    one = members.select(F.col(owner).alias("a"), F.col(member).alias("m")).join(pairs, "a")
    other = members.select(F.col(owner).alias("b"), F.col(member).alias("m"))
    return one.join(other, ["b", "m"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))


def alike_sets(members: DataFrame, owner: str, member: str, *, dice: float, k: int = 1024, z: float = 6.0) -> DataFrame:
    """``a, b``: pairs of sets whose Dice percentage 100*2*|A and B|/(|A|+|B|) is at least ``dice``.

    Decided by the sketches where the estimate is further than ``z`` standard errors from the bound; the pairs nearer to
    it, and only those, are counted exactly by joins. Distinct members count; null owners or members are left out;
    sets without members have no pairs; an empty table gives no rows.
    """
    members = cut(members.select(owner, member).where(F.col(owner).isNotNull() & F.col(member).isNotNull()).distinct())
    pairs = overlaps(cut(sketches(members, owner, member, k=k)), owner, k=k)
    bound = dice / (200 - dice)  # as a shared fraction of the union
    fraction, error = F.col("shared") / F.col("seen"), z * (bound * (1 - bound) / k) ** 0.5
    found = cut(pairs.select("a", "b", "n_a", "n_b", F.when(F.col("exact") & (fraction >= bound - 1e-9) | (fraction > bound + error), "sure").when(~F.col("exact") & (fraction >= bound - error), "near").alias("how")).where("how IS NOT NULL"))
    near = found.where("how = 'near'")
    counted = exact_overlaps(near, members, owner, member).join(near, ["a", "b"]).where(200 * F.col("both") >= dice * (F.col("n_a") + F.col("n_b")))
    return found.where("how = 'sure'").select("a", "b").unionByName(counted.select("a", "b"))


def reference_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable_hits(table(spark, sf_dir, "ref_kmers"), columns=("ref",)).select(clean_name("ref").alias("ref"), "code")


def p3_overlaps(spark: SparkSession, sf_dir: str, *, k: int = 1024) -> DataFrame:
    """Estimated shared k-mers and Dice percentage of every two references."""
    members = cut(reference_members(spark, sf_dir).where("ref IS NOT NULL").distinct())
    pairs = overlaps(cut(sketches(members, "ref", "code", k=k)), "ref", k=k)
    return pairs.select(F.col("a").alias("ref1"), F.col("b").alias("ref2"), F.round("both", 1).alias("shared"), F.round(200 * F.col("both") / (F.col("n_a") + F.col("n_b")), 2).alias("dice"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike_sets(reference_members(spark, sf_dir), "ref", "code", dice=20).select(F.col("a").alias("ref1"), F.col("b").alias("ref2"))


QUERIES = {"p3_overlaps": p3_overlaps, "p3_found": p3_found}
ORACLE = {
    "p3_found": r"""
WITH t AS (SELECT ltrim(rtrim(ref, ' \t\r\n\f\v'), ' \t\r\n\f\v>') AS ref, upper(trim(kmer, ' \t\r\n\f\v')) AS k FROM ref_kmers WHERE ref IS NOT NULL),
m AS (SELECT DISTINCT ref, least(k, translate(reverse(k), 'ACGT', 'TGCA')) AS k FROM t WHERE regexp_full_match(k, '[ACGT]{31}')),
n AS (SELECT ref, count(*) AS n FROM m GROUP BY ref),
p AS (SELECT a.ref AS ref1, b.ref AS ref2, count(*) AS x FROM m a JOIN m b ON a.k = b.k AND a.ref < b.ref GROUP BY a.ref, b.ref)
SELECT ref1, ref2 FROM p JOIN n a ON a.ref = ref1 JOIN n b ON b.ref = ref2 WHERE 200 * x >= 20 * (a.n + b.n)""".replace(r"\t", "\t").replace(r"\r", "\r").replace(r"\n", "\n").replace(r"\f", "\f").replace(r"\v", "\v"),
}
