"""Evaluation of assemblies: length statistics, reference coverage, error profiles, concordance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import coverage_segments


def length_stats(rows: DataFrame, length: str, *, by: list[str] | None = None, least: int = 0, total: Column | None = None, strict: bool = True) -> DataFrame:
    """``n, sum_len, n50, n80, max_len, mean_len`` of lengths of at least ``least``, per ``by``. N50 is the longest length at which
    the running sum over descending lengths passes half of ``total`` (a column constant per group; None: the sum), N80 four
    fifths; ``strict`` asks for more than that, else at least. The mean is ``total`` over n when total is given.

    Runs over counts of equal lengths, so one group's window never holds more rows than it has distinct lengths. Null
    lengths are left out; an N value that is never reached is 0.
    """
    by = by or []
    kept = rows.where(F.col(length) >= least)
    per = kept.groupBy(*by, F.col(length).cast("bigint").alias("len")).agg(F.count(F.lit(1)).alias("c"), *([F.max(total).alias("t")] if total is not None else []))
    down = Window.partitionBy(*by).orderBy(F.desc("len"))
    whole = Window.partitionBy(*by)
    run = per.withColumns({"run": F.sum(F.col("len") * F.col("c")).over(down), "all": F.sum(F.col("len") * F.col("c")).over(whole)})
    bound = F.max("t").over(whole) if total is not None else F.col("all")
    run = run.withColumn("bound", bound)

    def reached(tenths: int) -> Column:
        passed = F.col("run") * 10 > F.col("bound") * tenths if strict else F.col("run") * 10 >= F.col("bound") * tenths
        return F.coalesce(F.max(F.when(passed, F.col("len"))), F.lit(0))

    n = F.sum("c")
    of = F.max("bound") if total is not None else F.sum(F.col("len") * F.col("c"))
    return run.groupBy(*by).agg(n.alias("n"), F.sum(F.col("len") * F.col("c")).alias("sum_len"), reached(5).alias("n50"), reached(8).alias("n80"), F.max("len").alias("max_len"), F.floor(of / n).alias("mean_len"))


def reference_report(hits: DataFrame, *, min_contig: int = 100) -> DataFrame:
    """Per reference: distinct contigs found, N50/N80/max/mean of the aligned lengths against the reference's length, covered
    positions and percentage, and merged blocks (one that touches the reference's end is not counted).
    ``hits`` is ``ref, ref_len, start, stop, contig`` with half-open 0-based ranges."""
    long_ = hits.where(F.col("stop") - F.col("start") >= min_contig)
    per = long_.groupBy("ref").agg(F.count_distinct("contig").alias("found"), F.max("ref_len").alias("ref_len"))
    sized = long_.withColumn("size", F.col("stop") - F.col("start"))
    stats = length_stats(sized, "size", by=["ref"], total=F.col("ref_len"))
    mean = sized.groupBy("ref").agg(F.floor(F.avg("size")).alias("mean"))
    blocks = coverage_segments(long_.select("ref", "start", (F.col("stop") - 1).alias("last")), "ref", "start", "last").where("kind = 'period'")
    covered = blocks.join(per.select("ref", "ref_len"), "ref").groupBy("ref").agg(F.sum(F.col("seg_to") - F.col("seg_from") + 1).alias("covered"), F.count_if(F.col("seg_to") + 1 < F.col("ref_len")).alias("blocks"))
    return per.join(stats.select("ref", "n50", "n80", F.col("max_len").alias("longest"), F.col("sum_len").alias("mapped")), "ref").join(mean, "ref").join(covered, "ref").withColumn("percent", F.round(100 * F.col("covered") / F.col("ref_len"), 4))


def unaligned(contigs: DataFrame, hits: DataFrame, *, min_contig: int = 100) -> DataFrame:
    """``n, sum_len`` of the contigs of at least ``min_contig`` bases without any hit."""
    rest = contigs.where(F.col("len") >= min_contig).join(hits.select("name").distinct(), "name", "left_anti")
    return rest.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("sum_len"))


def similar_hits(alignments: DataFrame, *, similar: float = 0.95, min_contig: int = 100) -> DataFrame:
    """``ref, ref_len, start, stop, contig, size``: alignments of nearly whole contigs: the reference part at least ``similar`` of the
    contig's length and the other way round, at most 1-``similar`` of it errors. Rows without errors count are left out."""
    start, stop = F.least("ref_from", "ref_to") - 1, F.greatest("ref_from", "ref_to")
    size = F.greatest("contig_from", "contig_to") - F.least("contig_from", "contig_to") + 1
    rows = alignments.select("ref", "ref_len", start.alias("start"), stop.alias("stop"), "contig", "contig_len", size.alias("size"), "errors")
    span = F.col("stop") - F.col("start")
    return rows.where((span >= similar * F.col("contig_len")) & (F.col("contig_len") >= span * similar) & (F.col("errors") <= F.col("contig_len") * (1 - similar)) & (F.col("contig_len") >= min_contig))


def similar_report(hits: DataFrame) -> DataFrame:
    """Per reference the distinct contigs, N50 (at least half the reference), longest and mean size and the covered
    percentage over length+1 positions of ``similar_hits``."""
    per = hits.groupBy("ref").agg(F.count_distinct("contig").alias("contigs"), F.max("ref_len").alias("ref_len"), F.max("size").alias("longest"), F.floor(F.avg("size")).alias("mean"))
    n50 = length_stats(hits, "size", by=["ref"], total=F.col("ref_len"), strict=False).select("ref", "n50")
    blocks = coverage_segments(hits.select("ref", "start", (F.col("stop") - 1).alias("last")), "ref", "start", "last").where("kind = 'period'")
    covered = blocks.groupBy("ref").agg(F.sum(F.col("seg_to") - F.col("seg_from") + 1).alias("covered"))
    return per.join(n50, "ref").join(covered, "ref").withColumn("percent", F.round(100 * F.col("covered") / (F.col("ref_len") + 1), 4))


def near_pairs(places: DataFrame, name: str, *, near: int = 500, least: int = 100) -> DataFrame:
    """``ref, a, b``: pairs of placements (``ref, id, off, len``) of at least ``least`` bases, a before b (of equal offsets the
    larger id before), where a's end is less than ``near`` from b's start. A range join on position buckets."""
    kept = places.where(F.col("len") >= least)
    a = kept.select("ref", F.col("id").alias("a"), F.col("off").alias("off_a"), (F.col("off") + F.col("len")).alias("end_a"))
    a = a.withColumn("bucket", F.explode(F.transform(F.array(*(F.lit(s) for s in (-1, 0, 1))), lambda s: F.floor(F.col("end_a") / near) + s)))
    b = kept.select("ref", F.col("id").alias("b"), F.col("off").alias("off_b"), F.floor(F.col("off") / near).alias("bucket"))
    first = (F.col("off_a") < F.col("off_b")) | ((F.col("off_a") == F.col("off_b")) & (F.col("a") > F.col("b")))
    return a.join(b, ["ref", "bucket"]).where(first & (F.abs(F.col("end_a") - F.col("off_b")) < near)).select("ref", "a", "b")


def concordance(one: DataFrame, other: DataFrame) -> DataFrame:
    """``n1, n2, same``: pairs near each other in each table of placements, and those that are so in both, in the same order."""
    p, q = near_pairs(one, "1"), near_pairs(other, "2")
    rows = p.withColumn("w", F.lit(1)).unionByName(q.withColumn("w", F.lit(2))).groupBy("ref", "a", "b").agg(F.sum("w").alias("w"))
    return rows.agg(F.count_if(F.col("w").isin(1, 3)).alias("n1"), F.count_if(F.col("w").isin(2, 3)).alias("n2"), F.count_if(F.col("w") == 3).alias("same"))


def error_profile(hits: DataFrame, reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """``pos, errors, repeated``: for each read position the reads whose base differs from the contig they lie on, and those whose
    base before differed too. ``hits`` is ``read_id, contig_id, off, rev``: where the read's first base lies (on the
    reverse strand, where its last base lies). Only the first hit of a read counts."""
    first = hits.groupBy("read_id").agg(F.min(F.struct("contig_id", "off", "rev")).alias("h")).select("read_id", "h.*")
    # hints: what is exploded from contigs is larger than the planner takes it for
    rows = first.join(reads.select("read_id", "seq").hint("merge"), "read_id").join(contigs.select("contig_id", F.col("seq").alias("contig")).hint("merge"), "contig_id")
    read = F.when(F.col("rev"), F.reverse(F.translate("seq", "ACGT", "TGCA"))).otherwise(F.col("seq"))
    wrong = F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: F.substring(read, i, F.lit(1)) != F.substring("contig", F.col("off") + i, F.lit(1)))
    inside = (F.col("off") >= 0) & (F.col("off") + F.length("seq") <= F.length("contig")) & (F.length("seq") > 0)
    flags = rows.where(inside).select(F.col("rev"), wrong.alias("w")).select(F.when(F.col("rev"), F.reverse("w")).otherwise(F.col("w")).alias("w"))
    spots = flags.select(F.posexplode(F.transform("w", lambda x, i: F.struct(x.alias("e"), F.when(i > 0, F.element_at("w", F.greatest(i, F.lit(1)))).otherwise(False).alias("p")))).alias("pos", "x"))
    return spots.groupBy("pos").agg(F.count(F.lit(1)).alias("bases"), F.count_if("x.e").alias("errors"), F.count_if(F.col("x.e") & F.col("x.p")).alias("repeated"))


def depth_histogram(hits: DataFrame, contigs: DataFrame) -> DataFrame:
    """``depth, contigs``: how many contigs have each mean depth of read bases (rounded down). ``hits`` is ``contig_id, len``."""
    sums = hits.groupBy("contig_id").agg(F.sum("len").alias("bases"))
    depth = contigs.where(F.length("seq") > 0).select("contig_id", F.length("seq").alias("size")).join(sums.hint("merge"), "contig_id", "left")
    return depth.groupBy(F.floor(F.coalesce("bases", F.lit(0)) / F.col("size")).alias("depth")).agg(F.count(F.lit(1)).alias("contigs"))
