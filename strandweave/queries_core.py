"""Registered queries of the core problems, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.bases import clean_name, decode
from .functions.hits import usable_hits
from .operators.intervals import coverage_segments
from .operators.skew import heavy_keys, skew_safe_counts
from .plans.session import cut, table

K = 31


def kmer_counts(spark: SparkSession, sf_dir: str, *, sample: float = 0.1) -> DataFrame:
    """``code, hits, records, groups`` of each k-mer of ``kmer_hits``. The heavy k-mers come from a sketch over a sample."""
    raw = table(spark, sf_dir, "kmer_hits")
    heavy = heavy_keys(usable_hits(raw.sample(sample, 7), columns=()), "code")
    return skew_safe_counts(usable_hits(raw), "code", group="run_id", record="read_id", row_id="hit_id", heavy=heavy)


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer_counts(spark, sf_dir).select(decode("code", K).alias("kmer"), "hits", F.col("records").alias("reads"), F.col("groups").alias("runs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut(kmer_counts(spark, sf_dir).select("code", "hits"))
    total = counts.agg(F.sum("hits")).first()[0] or 0
    return counts.where(F.col("hits") * 100 >= total).select(decode("code", K).alias("kmer"))


def aligned_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "delta_alignments").where("ref_from BETWEEN 1 AND ref_len AND ref_to BETWEEN 1 AND ref_len")
    return rows.select(clean_name("ref").alias("ref"), "ref_from", "ref_to")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage_segments(aligned_stretches(spark, sf_dir), "ref", "ref_from", "ref_to")


QUERIES = {"p4_counts": p4_counts, "p4_found": p4_found, "p6_found": p6_found}

USABLE = """
usable AS (SELECT DISTINCT hit_id, run_id, read_id, t FROM (SELECT hit_id, run_id, read_id, upper(trim(kmer, ' \t\r\n\f\v')) AS t FROM kmer_hits) WHERE regexp_full_match(t, '[ACGT]{31}')),
hits AS (SELECT hit_id, run_id, read_id, CASE WHEN translate(t, 'ACGT', 'TGCA') < reverse(t) THEN translate(reverse(t), 'ACGT', 'TGCA') ELSE t END AS kmer FROM usable)"""

ORACLE = {
    "p4_counts": f"WITH {USABLE} SELECT kmer, count(DISTINCT hit_id) AS hits, count(DISTINCT (run_id, read_id)) AS reads, count(DISTINCT run_id) AS runs FROM hits GROUP BY kmer",
    "p4_found": f"WITH {USABLE} SELECT kmer FROM hits GROUP BY kmer HAVING 100 * count(DISTINCT hit_id) >= (SELECT count(DISTINCT hit_id) FROM hits)",
    "p6_found": r"""
WITH iv AS (SELECT regexp_replace(ref, '^[>\s]+|\s+$', '', 'g') AS ref, CAST(least(ref_from, ref_to) AS BIGINT) AS a, CAST(greatest(ref_from, ref_to) AS BIGINT) AS b
            FROM delta_alignments WHERE ref IS NOT NULL AND ref_from BETWEEN 1 AND ref_len AND ref_to BETWEEN 1 AND ref_len),
m AS (SELECT *, max(b) OVER (PARTITION BY ref ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM iv),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY ref ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m),
p AS (SELECT ref, min(a) AS a, max(b) AS b FROM i GROUP BY ref, island)
SELECT ref, 'period' AS kind, a AS seg_from, b AS seg_to FROM p
UNION ALL
SELECT ref, 'gap' AS kind, b + 1 AS seg_from, n - 1 AS seg_to FROM (SELECT ref, b, lead(a) OVER (PARTITION BY ref ORDER BY a) AS n FROM p) WHERE n IS NOT NULL""",
}
