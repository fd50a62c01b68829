"""Union of intervals and the gaps between them, also for entities with any number of intervals of any length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import cut

#: Shards of one level that make a shard of the next.
FAN = 1 << 10


def shard_of(position: Column, width: int | None) -> Column:
    """Where the shard of a position begins; the last level, of width None, has one shard."""
    return F.lit(0).cast("bigint") if width is None else position - F.pmod(position, F.lit(width))


def clipped(rows: DataFrame, widths: list[int | None]) -> DataFrame:
    """``e, k, s, a, b``: intervals cut into pieces that lie in one shard ``s`` of level ``k``. The shards of a level that an interval
    covers whole are an interval of the next level; what it has before and after them are its pieces here. So it makes two
    pieces a level at most, however long it is."""
    up = lambda x, w: x + F.pmod(-x, F.lit(w))
    down = lambda x, w: shard_of(x + 1, w) - 1
    pieces, a, b = [], F.col("a"), F.col("b")
    for k, width in enumerate(widths):
        below = widths[k - 1] if k else 1
        first, last = up(a, below), down(b, below)
        if width is None:
            pieces.append(F.when(first <= last, F.struct(F.lit(k).alias("k"), shard_of(first, width).alias("s"), first.alias("a"), last.alias("b"))))
            break
        next_, end = up(a, width), down(b, width) + 1
        head = F.struct(F.lit(k).alias("k"), shard_of(first, width).alias("s"), first.alias("a"), F.least(last, next_ - 1).alias("b"))
        tail = F.struct(F.lit(k).alias("k"), end.alias("s"), end.alias("a"), last.alias("b"))
        pieces += [F.when((first <= last) & (first < next_), head), F.when((end >= next_) & (end <= last), tail)]
    one = F.explode(F.filter(F.array(*pieces), lambda p: p.isNotNull())).alias("p")
    return rows.select("e", one).select("e", "p.*")


def islands(pieces: DataFrame) -> DataFrame:
    """``e, k, s, a, b``: the pieces of each shard merged where they overlap, nest or touch."""
    starts = pieces.groupBy("e", "k", "s", "a").agg(F.max("b").alias("b"))
    inside = Window.partitionBy("e", "k", "s").orderBy("a")
    before = F.max("b").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    marked = starts.withColumn("new", (before.isNull() | (F.col("a") > before + 1)).cast("int")).withColumn("island", F.sum("new").over(inside))
    return marked.groupBy("e", "k", "s", "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")


def uncovered(merged: DataFrame, widths: list[int | None]) -> DataFrame:
    """``merged`` without the pieces in shards that a piece of a higher level covers whole; what is left is disjoint."""
    for k in range(len(widths) - 1, 0, -1):
        cover = merged.where(F.col("k") == k).select("e", F.col("s").alias("up"), F.col("a").alias("from"), F.col("b").alias("to"))
        below = shard_of(F.col("a"), widths[k - 1])
        shards = merged.where(F.col("k") < k).select("e", below.alias("below")).distinct().withColumn("up", shard_of(F.col("below"), widths[k]))
        hidden = shards.join(cover, ["e", "up"]).where("below BETWEEN `from` AND `to`").select("e", "below", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k"))
        merged = cut(merged.withColumn("below", below).join(hidden, ["e", "k", "below"], "left_anti").select("e", "k", "s", "a", "b"))
    return merged


def stitched(members: DataFrame, last: bool) -> DataFrame:
    """``e, a, b, left, right, gap``: disjoint ``members`` (``e, k, s, a, b, left, right``) coalesced where they touch inside a
    shard. ``left`` and ``right`` say that nothing can touch there any more, ``gap`` is where the gap before begins,
    if it lies in this shard. On the ``last`` level everything ends."""
    along = Window.partitionBy("e", "k", "s").orderBy("a")
    before, after = F.lag(F.struct("b")).over(along), F.lead(F.struct("a")).over(along)
    seen = members.withColumns({"before": before["b"], "after": after["a"]})
    touches = ~F.col("left") & F.col("before").isNotNull() & (F.col("a") == F.col("before") + 1)
    gap = F.when(~F.col("left") & (F.col("a") > F.col("before") + 1), F.col("before") + 1)
    ends = {"gap": gap, "new": (~F.coalesce(touches, F.lit(False))).cast("int"), "left": F.col("left") | F.col("before").isNotNull() | F.lit(last), "right": F.col("right") | F.col("after").isNotNull() | F.lit(last)}
    marked = seen.withColumns(ends).withColumn("run", F.sum("new").over(along))
    return marked.groupBy("e", "k", "s", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min_by("left", "a").alias("left"), F.max_by("right", "a").alias("right"), F.max("gap").alias("gap")).drop("k", "s", "run")


def coverage_segments(intervals: DataFrame, entity: str, start: str, end: str, *, shard: int = 1 << 16) -> DataFrame:
    """``entity, kind, seg_from, seg_to``: per entity the covered ``period``s (intervals that overlap, nest or touch are
    one) and the uncovered ``gap``s between neighbouring periods. Integer positions, both ends included.

    Intervals are clipped into shards of ``shard`` positions and merged inside each (entity, shard), which is where the rows
    are: a group holds at most ``shard`` different starts, whatever an entity has. The whole shards inside a long
    interval are not listed: they are one interval among shards, clipped in its turn into shards of ``FAN`` shards, and so on
    (``clipped``). Then the first and last piece of each shard, and only those, are stitched in the shards of the next level,
    level by level up to the entity, so that no window holds more than about ``3 * FAN`` rows.

    Defined results: rows with a null entity or end are left out; ends in the wrong order are swapped; repeated rows
    change nothing; an entity with a single period has no gap; an empty table gives no rows; other columns are ignored.
    Positions must stay ``FAN * FAN * shard`` away from the ends of BIGINT.
    """
    lo, hi = F.least(start, end).cast("bigint"), F.greatest(start, end).cast("bigint")
    rows = intervals.select(F.col(entity).alias("e"), F.when(F.col(end).isNotNull(), lo).alias("a"), F.when(F.col(start).isNotNull(), hi).alias("b")).where("e IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL")
    low, high, longest = rows.agg(F.min("a"), F.max("b"), F.max(F.col("b") - F.col("a"))).first()
    low, high, longest = low or 0, high or 0, longest or 0
    widths: list[int | None] = [shard]
    while high // widths[-1] - low // widths[-1] >= FAN:
        widths.append(widths[-1] * FAN)
    widths.append(None)
    merged = islands(clipped(rows, widths))
    if longest >= shard - 1:
        merged = uncovered(cut(merged), widths)
    else:  # no piece above the first level
        merged = merged.where("k = 0")
    open_, kinds, out = None, ["e", "k", "s", "a", "b", "left", "right"], []
    for k, width in enumerate(widths):
        level = [] if k and longest < shard - 1 else [merged.where(F.col("k") == k).select("e", "k", "s", "a", "b", F.lit(False).alias("left"), F.lit(False).alias("right"))]
        if open_ is not None:
            level.append(open_.withColumns({"k": F.lit(k), "s": shard_of(F.col("a"), width)}).select(*kinds))
        runs = cut(stitched(reduce(DataFrame.unionByName, level), width is None))
        out.append(runs.where("gap IS NOT NULL").select("e", F.lit("gap").alias("kind"), F.col("gap").alias("seg_from"), (F.col("a") - 1).alias("seg_to")))
        out.append(runs.where("left AND right").select("e", F.lit("period").alias("kind"), F.col("a").alias("seg_from"), F.col("b").alias("seg_to")))
        open_ = runs.where("NOT (left AND right)").select("e", "a", "b", "left", "right")
    return reduce(DataFrame.unionByName, out).withColumnRenamed("e", entity)
