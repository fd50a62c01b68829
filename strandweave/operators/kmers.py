"""Counting of canonical k-mers, their edges, and the graph of solid ones.

Reads are ``read_id, seq`` with upper-case ACGT sequences (``clean_reads``). A mask has bit 0..3 for A, C, G, T: an out bit is the
next base, an in bit the complement of the base before, that is the next base of the other strand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import Vertices, is_acgt, revcomp, word_text
from ..functions.hits import BASE_CODE
from ..plans.session import cut


def kmer_windows(reads: DataFrame, k: int, *, id_col: str = "read_id") -> DataFrame:
    """``id_col, len, pos, kmer, rev, nexts, prevs``: every window of k ACGT letters in canonical form (``rev``: it was turned), with
    the bits of the neighbouring bases. The other strand is made once for each read, not for each window."""
    n = F.length("seq")
    strands = reads.where(n >= k).select(F.col(id_col), "seq", revcomp("seq").alias("rc"), F.reverse("seq").alias("back"), F.translate("seq", "ACGT", "TGCA").alias("comp"), n.alias("len"))
    spots = strands.select("*", F.explode(F.sequence(F.lit(1), F.col("len") - (k - 1))).alias("pos"))
    mirror = F.col("len") - (k - 2) - F.col("pos")  # start of the same window on the other strand
    ahead, turned = F.substring("seq", F.col("pos"), F.lit(k)), F.substring("rc", mirror, F.lit(k))
    # a k-mer is the smaller one if it is when read backwards
    rev = F.substring("comp", F.col("pos"), F.lit(k)) < F.substring("back", mirror, F.lit(k))
    base = F.lit("ACGT")
    after = F.instr(base, F.substring("seq", F.col("pos") + k, F.lit(1)))
    before = F.instr(base, F.when(F.col("pos") > 1, F.substring("comp", F.col("pos") - 1, F.lit(1))).otherwise(F.lit(" ")))

    def bit(i):
        return F.when((i > 0) & (F.col("pos") + k <= F.col("len")), F.call_function("shiftleft", F.lit(1), i - 1)).otherwise(0)

    def bit_before(i):
        return F.when((i > 0) & (F.col("pos") > 1), F.call_function("shiftleft", F.lit(1), i - 1)).otherwise(0)

    rows = spots.select(id_col, "len", "pos", rev.alias("rev"), F.when(rev, turned).otherwise(ahead).alias("kmer"), bit(after).alias("a"), bit_before(before).alias("b"))
    return rows.where(is_acgt("kmer")).select(id_col, "len", "pos", "kmer", "rev", F.when(F.col("rev"), F.col("b")).otherwise(F.col("a")).alias("nexts"), F.when(F.col("rev"), F.col("a")).otherwise(F.col("b")).alias("prevs"))


def coded_windows(text: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Canonical words (``bases.word``) and the masks of the bases before and after, as bytes, of all windows of k ACGT letters, and where
    each window begins in the texts when they are laid one after another with a letter between them."""
    raw = np.frombuffer(("N".join(t or "" for t in text) + "N").encode("ascii", "replace"), np.uint8)
    base = BASE_CODE[raw]
    n = len(base) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint8), np.empty(0, np.uint8), np.empty(0, np.int64)
    bad = np.r_[0, np.cumsum(base > 3)]
    at = np.flatnonzero(bad[k:] == bad[:-k])  # a window that spans two reads holds the N between them
    two = (base & 3).astype(np.int64)
    ahead, turned = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for i in range(k):
        b = two[at + i]
        ahead |= b << (2 * (k - 1 - i))
        turned |= (3 - b) << (2 * i)
    bit = np.r_[np.uint8(1) << np.minimum(base, 3), np.uint8(0)] * np.r_[base < 4, False]
    back = np.r_[np.uint8(8) >> np.minimum(base, 3), np.uint8(0)] * np.r_[base < 4, False]
    after, before = bit[at + k], np.where(at > 0, back[at - 1], 0)
    rev = turned < ahead
    return np.where(rev, turned, ahead), np.where(rev, after, before).astype(np.uint8), np.where(rev, before, after).astype(np.uint8), at


BATCH = "word bigint, cnt bigint, long_cnt bigint, in_mask int, out_mask int, spots array<struct<read_id:bigint,len:int,pos:int>>"


def batch_counts(reads: DataFrame, k: int, *, thin: int = 0) -> DataFrame:
    """``word, cnt, long_cnt, in_mask, out_mask, spots`` of all windows, k at most 31, counted in Arrow batches of about a million windows,
    each of which has one row for a k-mer. ``long_cnt`` counts the windows of reads longer than k. Where a batch has fewer than ``thin``
    windows of a k-mer, ``spots`` says where in such reads they lie (from 1 on); windows with other letters than ACGT are counted 0 times
    under words below 0, with their spots. Reads without an id have no spots."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str | None] = []
        names: list[int | None] = []
        size = 0

        def summed() -> pa.RecordBatch:
            code, prevs, nexts, at = coded_windows(held, k)
            lens = np.array([len(t or "") for t in held], np.int64)
            begins = np.cumsum(lens + 1) - lens - 1
            named = np.array([n is not None for n in names])
            ids = np.array([n or 0 for n in names], np.int64)
            real = np.ones(len(at), np.int64)
            if thin and (lens - k + 1).sum() > len(at):
                spans = lens - k + 1
                every = np.arange(spans.sum()) + np.repeat(begins - np.cumsum(spans) + spans, spans)
                other = np.setdiff1d(every, at, assume_unique=True)
                code = np.r_[code, -1 - (ids[np.searchsorted(begins, other, side="right") - 1] & (2**62 - 1))]
                none = np.zeros(len(other), np.uint8)
                prevs, nexts, at, real = np.r_[prevs, none], np.r_[nexts, none], np.r_[at, other], np.r_[real, none]
            order = np.argsort(code, kind="stable")
            code, at, real = code[order], at[order], real[order]
            owner = np.searchsorted(begins, at, side="right") - 1
            long_ = lens[owner] > k
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, np.int64)
            n = np.diff(np.r_[starts, len(code)])
            add = lambda x: np.add.reduceat(x, starts) if len(code) else x
            masks = [np.bitwise_or.reduceat(m[order], starts) if len(code) else m for m in (prevs, nexts)]
            told = (np.repeat((n < thin) | (code[starts] < 0), n) if len(code) else np.empty(0, bool)) & long_ & named[owner] if thin else np.zeros(len(code), bool)
            where = pa.StructArray.from_arrays([pa.array(ids[owner][told]), pa.array(lens[owner][told].astype(np.int32)), pa.array((at - begins[owner] + 1)[told].astype(np.int32))], ["read_id", "len", "pos"])
            offsets = np.r_[0, np.cumsum(add(told.astype(np.int64)))].astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(code[starts]), pa.array(add(real)), pa.array(add(real * long_)), *(pa.array(m.astype(np.int32)) for m in masks), pa.ListArray.from_arrays(pa.array(offsets), where)],
                names=["word", "cnt", "long_cnt", "in_mask", "out_mask", "spots"],
            )

        for batch in batches:
            held += batch.column(1).to_pylist()
            names += batch.column(0).to_pylist()
            size += batch.column(1).nbytes
            if size > 1 << 20:
                yield summed()
                held, names, size = [], [], 0
        if held:
            yield summed()

    name = F.col("read_id").cast("bigint") if "read_id" in reads.columns else F.lit(None).cast("bigint")
    return reads.where(F.length("seq") >= k).select(name.alias("read_id"), "seq").mapInArrow(count, BATCH)


def summed_counts(batches: DataFrame) -> DataFrame:
    """``word, cnt, long_cnt, in_mask, out_mask`` over all batches, behind one exchange."""
    return batches.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("cnt", "long_cnt")), *(F.bit_or(c).alias(c) for c in ("in_mask", "out_mask")))


def counted(reads: DataFrame, k: int) -> DataFrame:
    """``kmer, cnt, in_mask, out_mask`` over all windows, on codes where they hold k bases. One shuffle, aggregated before it, so
    frequent k-mers don't skew it."""
    if k <= 31:
        return summed_counts(batch_counts(reads, k)).select(word_text("word", k).alias("kmer"), "cnt", "in_mask", "out_mask")
    return kmer_windows(reads, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt"), F.bit_or("prevs").alias("in_mask"), F.bit_or("nexts").alias("out_mask"))


def capped(cap: int | None) -> Column:
    return F.least(F.col("cnt"), F.lit(cap)) if cap else F.col("cnt")


def count_kmers(reads: DataFrame, k: int, *, cap: int | None = 65535) -> DataFrame:
    """``kmer, cnt, in_mask, out_mask`` over all windows. Counts stop at ``cap``, as 16-bit counters do; None lifts that."""
    return counted(reads, k).withColumn("cnt", capped(cap))


def solid_kmers(reads: DataFrame, k: int, min_count: int) -> DataFrame:
    """``kmer``: those with at least ``min_count`` windows."""
    return counted(reads, k).where(F.col("cnt") >= min_count).select("kmer")


def spectrum(counts: DataFrame) -> DataFrame:
    """``cnt, kmers``: how many k-mers have each count."""
    return counts.groupBy("cnt").agg(F.count(F.lit(1)).alias("kmers"))


def gap_fill(reads: DataFrame, solid: DataFrame, k: int) -> DataFrame:
    """``kmer``: k-mers that are not solid but lie between the first and last solid window of a read (longer than k) whose
    solid windows number more than max(L-2k+1, (L-k+1)/2). Decided against the solid set alone, whatever the order of reads."""
    windows = kmer_windows(reads.where(F.length("seq") > k), k).select("read_id", "len", "pos", "kmer")
    marked = windows.join(solid.select("kmer", F.lit(True).alias("hit")), "kmer", "left")
    read = Window.partitionBy("read_id")
    spot = F.when(F.col("hit"), F.col("pos"))
    spread = marked.withColumns({"hits": F.count("hit").over(read), "first": F.min(spot).over(read), "last": F.max(spot).over(read)})
    enough = F.col("hits") > F.greatest(F.col("len") - (2 * k - 1), ((F.col("len") - (k - 1)) / 2).cast("int"))
    return spread.where(enough & F.col("hit").isNull() & (F.col("pos") > F.col("first")) & (F.col("pos") < F.col("last"))).select("kmer").distinct()


def graph_nodes(reads: DataFrame, vertices: DataFrame, k: int, *, cap: int | None = 65535) -> DataFrame:
    """``kmer, cnt, in_mask, out_mask`` of the given vertices, counted over reads longer than k. Edges may still lead
    outside (``prune_edges``). A vertex in no such read has count 0. Windows are counted before they meet the vertices."""
    found = counted(reads.where(F.length("seq") > k), k).withColumn("cnt", capped(cap))
    return vertices.join(found, "kmer", "left").select("kmer", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("cnt", "in_mask", "out_mask")))


def solid_graph(reads: DataFrame, k: int, min_count: int, *, cap: int | None = 65535) -> DataFrame:
    """The ``graph_nodes`` of all solid and filled-in k-mers; for k up to 31 with ``kmer`` as a word. ``read_id`` must be unique; reads
    without one are counted and fill no gap.

    The windows are counted once, in batches. Only k-mers that are thin in a batch travel with the places where they lie, and of those
    only the ones that are thin in all reads are put in order for each read: solid windows are the read's others."""
    if k > 31:
        solid = cut(solid_kmers(reads, k, min_count))
        return graph_nodes(reads, solid.unionByName(gap_fill(reads, solid, k)), k, cap=cap)
    batches = cut(batch_counts(reads, k, thin=min_count))
    totals = cut(summed_counts(batches))
    thin = totals.where(F.col("cnt") < min_count).select("word")
    places = batches.where(F.size("spots") > 0).select("word", "spots").join(thin, "word", "left_semi").select("word", F.inline("spots"))
    read = Window.partitionBy("read_id")
    order = read.orderBy("pos")
    placed = places.withColumns({"rank": F.row_number().over(order), "n": F.count(F.lit(1)).over(read)}).withColumn("all", F.col("len") - (k - 1))
    enough = F.col("all") - F.col("n") > F.greatest(F.col("len") - (2 * k - 1), F.floor(F.col("all") / 2))
    inside = (F.col("rank") < F.col("pos")) & (F.col("n") - F.col("rank") < F.col("all") - F.col("pos"))  # a solid window before and after
    filled = placed.where(enough & inside & (F.col("word") >= 0)).select("word").distinct()
    kept = totals.where((F.col("cnt") >= min_count) & (F.col("word") >= 0)).unionByName(totals.where(F.col("cnt") < min_count).join(filled, "word", "left_semi"))
    return kept.select(F.col("word").alias("kmer"), F.col("long_cnt").alias("cnt"), "in_mask", "out_mask").withColumn("cnt", capped(cap))


def oriented_edges(nodes: DataFrame, k: int | None = None) -> DataFrame:
    """``u, v``: an edge for each mask bit, with every vertex written as its string or word on the strand it is met on. Out bits leave
    the k-mer, in bits leave its reverse complement, so edges come with their mirror image."""
    vx = Vertices.like(nodes, "kmer", k or 0)
    both = nodes.select("kmer", vx.turned("kmer").alias("rc"), "in_mask", "out_mask")
    # a palindrome's bits stand in both masks, and its edges are those of one strand
    same = F.col("kmer") == F.col("rc")
    strands = both.select(F.explode(F.array(F.struct(F.col("kmer").alias("u"), F.when(same, F.col("out_mask").bitwiseOR(F.col("in_mask"))).otherwise(F.col("out_mask")).alias("mask")), F.struct(F.col("rc").alias("u"), F.when(same, 0).otherwise(F.col("in_mask")).alias("mask")))).alias("s")).select("s.*")
    bits = strands.select("u", "mask", F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("i")).where(F.call_function("shiftright", F.col("mask"), F.col("i")).bitwiseAND(F.lit(1)) == 1)
    v = vx.following("u", F.col("i")) if vx.coded else F.concat(F.substring("u", F.lit(2), F.length("u")), vx.letter(F.col("i")))
    return bits.select("u", v.alias("v"))


def prune_edges(nodes: DataFrame, k: int | None = None) -> DataFrame:
    """``u, v``: edges both of whose ends exist, in both directions."""
    vx = Vertices.like(nodes, "kmer", k or 0)
    edges = oriented_edges(nodes, k).withColumn("kmer", vx.canonical("v"))
    kept = edges.join(nodes.select("kmer"), "kmer", "left_semi").select("u", "v")
    return kept.unionByName(kept.select(vx.turned("v").alias("u"), vx.turned("u").alias("v"))).distinct()


def all_edges(nodes: DataFrame) -> DataFrame:
    """``nodes`` with all eight edge bits set."""
    return nodes.withColumns({"in_mask": F.lit(15), "out_mask": F.lit(15)})


def read_hits(reads: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``read_id, windows, hits``: for each read its windows and how many of them are vertices; a read is kept by later steps
    if it has any, and is valid if it has all."""
    windows = kmer_windows(reads, k).select("read_id", "kmer")
    marked = windows.join(nodes.select("kmer", F.lit(1).alias("hit")), "kmer", "left")
    return marked.groupBy("read_id").agg(F.count(F.lit(1)).alias("windows"), F.count("hit").alias("hits"))


def coverage_stats(nodes: DataFrame) -> DataFrame:
    """``kmers, edges, mean_cnt, median_cnt``: the upper median, by counts of counts instead of a sort of all nodes."""
    counts = nodes.groupBy("cnt").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("cnt")  # one row for each distinct count, at most 65,536
    run = counts.withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy())})
    median = run.where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("cnt").alias("median_cnt"))
    edges = F.floor(F.sum(F.bit_count("in_mask") + F.bit_count("out_mask")) / 2)
    return nodes.agg(F.count(F.lit(1)).alias("kmers"), edges.alias("edges"), F.round(F.avg("cnt"), 6).alias("mean_cnt")).join(F.broadcast(median), F.lit(True))


def dice(sets: DataFrame, owner: str, member: str) -> DataFrame:
    """``a, b, shared, dice`` for every two sets with a common member: 100*2*|A and B|/(|A|+|B|) over distinct members."""
    members = sets.select(F.col(owner).alias("o"), F.col(member).alias("m")).where("o IS NOT NULL AND m IS NOT NULL").distinct()
    sizes = members.groupBy("o").agg(F.count(F.lit(1)).alias("n"))
    # members of the same sets count together, so a pair of sets is made once for each such pattern, not for each member
    patterns = members.groupBy("m").agg(F.array_sort(F.collect_list("o")).alias("os")).where(F.size("os") > 1).groupBy("os").agg(F.count(F.lit(1)).alias("n"))
    first = patterns.select("n", "os", F.posexplode("os").alias("i", "a")).select("a", "n", F.explode(F.slice("os", F.col("i") + 2, F.size("os"))).alias("b"))
    both = first.groupBy("a", "b").agg(F.sum("n").alias("shared"))
    sized = both.join(sizes.select(F.col("o").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("o").alias("b"), F.col("n").alias("n_b")), "b")
    return sized.select("a", "b", "shared", F.round(200 * F.col("shared") / (F.col("n_a") + F.col("n_b")), 6).alias("dice"))
