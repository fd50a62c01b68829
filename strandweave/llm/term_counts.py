"""How often every term occurs, and in how many records: counting over a bursting trie of term prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bases import decode, is_acgt, strip
from ..functions.hits import usable_hits
from ..plans.session import broadcast_checked, cut, partitions, table

K = 31


def burst(counts: dict[int, int], depth: int, capacity: int) -> list[tuple[int, int, int]]:
    """The trie's leaves for each prefix of ``depth`` base-4 digits: ``(prefix, first leaf, leaves)``.

    A node with at most ``capacity`` rows is one leaf, however long its prefix; a larger one bursts into its four children.
    Where the digits end and a node is still too large, it bursts on into as many leaves as it needs by its records.
    """
    levels = [counts]
    for _ in range(depth):
        up: dict[int, int] = {}
        for prefix, n in levels[-1].items():
            up[prefix >> 2] = up.get(prefix >> 2, 0) + n
        levels.append(up)
    levels.reverse()  # levels[d] has the prefixes of d digits
    routes, leaf, todo = [], 0, [(0, 0)]
    while todo:
        d, prefix = todo.pop()
        n = levels[d].get(prefix, 0)
        if n > capacity and d < depth:
            todo += [(d + 1, prefix << 2 | digit) for digit in (3, 2, 1, 0)]
            continue
        below, leaves = 2 * (depth - d), max(1, -(-n // capacity))
        routes += [(p, leaf, leaves) for p in range(prefix << below, (prefix + 1) << below)]
        leaf += leaves
    return routes


#: Rows that a task holds before it packs them into tries.
HELD = 1 << 20
#: Entries of a trie in the order of its levels, and bits of ``null`` for what is null in a row.
LEVELS = ("t", "g", "r", "null", "i")
NULLS = {"g": 1, "r": 2, "i": 4}


def narrow(x: np.ndarray) -> bytes:
    """Integers as their least one and the differences from it, in as few bytes each as these need."""
    if not len(x):
        return b""
    low = x.min()
    over = (x - low).view(np.uint64)  # wraps where int64 does not hold the difference
    width = next(w for w in (1, 2, 4, 8) if int(over.max()) < 1 << (8 * w))
    return low.tobytes() + bytes([width]) + over.astype(f"<u{width}").tobytes()


def widened(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.int64)
    low, width = np.frombuffer(data, np.int64, 1)[0], data[8]
    return np.frombuffer(data, f"<u{width}", offset=9).astype(np.uint64).view(np.int64) + low


def sorted_rows(rows: dict[str, np.ndarray], *first: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Distinct rows in the order of ``first`` and of the levels, and their old places."""
    keys = [*first, *(rows[c] for c in LEVELS)]
    if rows["null"].any():  # a null is a value beside 0 on each level
        null = {c: rows["null"] & bit for c, bit in NULLS.items()}
        keys = [*first, rows["t"], rows["g"], null["g"], rows["r"], null["r"], rows["i"], null["i"]]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in (*first, *rows.values()):
        y = x[order]
        new[1:] |= y[1:] != y[:-1]
    order = order[new]
    return {c: x[order] for c, x in rows.items()}, order


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def packed_tries(rows: dict[str, np.ndarray], routes: np.ndarray, below: int) -> pa.RecordBatch:
    """One row for each leaf that the rows reach: the subtree below it, each term once with its counters of hits and records,
    and the records and row ids under it by which equal subtrees of other tasks are merged."""
    base, leaves = routes[rows["t"] >> below].T
    mix = (rows["g"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ rows["r"].view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    leaf = base + ((mix >> np.uint64(33)) % leaves.astype(np.uint64)).astype(np.int64)
    rows, order = sorted_rows(rows, leaf)
    leaf, many = leaf[order], leaves[order] > 1
    starts = changes(leaf)
    out = []
    for low, high in zip(starts, np.r_[starts[1:], len(leaf)]):
        part = {c: x[low:high] for c, x in rows.items()}
        at = changes(part["t"], part["g"], part["null"] & NULLS["g"])
        hits = np.diff(np.r_[at, high - low])
        new = np.zeros(high - low, np.int64)
        new[changes(part["t"], part["g"], part["r"], part["null"] & (NULLS["g"] | NULLS["r"]))] = 1
        records = np.add.reduceat(new, at)
        out.append([narrow(x) for x in (np.r_[part["t"][:1], np.diff(part["t"][at])], part["g"][at], hits, records, part["r"], part["null"], part["i"])])
    columns = [pa.array([o[k] for o in out], pa.binary()) for k in range(7)]
    return pa.RecordBatch.from_arrays([pa.array(leaf[starts]), pa.array(many[starts]), *columns], names=["leaf", "parts", *TRIE])


TRIE = ("terms", "groups", "hits", "records", "rows", "nulls", "ids")


def merged_tries(tries: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, groups, whether the group is null, hits and records of subtrees of one leaf. A single subtree has its counters; of
    several, the rows under equal terms are united."""
    parts = [{c: widened(tries.column(c)[k].as_py()) for c in TRIE} for k in range(tries.num_rows)]
    for p in parts:
        p["terms"] = np.cumsum(p["terms"])
    null = lambda p: p["nulls"][np.cumsum(np.r_[0, p["hits"][:-1]])] & NULLS["g"]
    if len(parts) == 1:
        p = parts[0]
        return p["terms"], p["groups"], null(p) > 0, p["hits"], p["records"]
    rows = {"t": [np.repeat(p["terms"], p["hits"]) for p in parts], "g": [np.repeat(p["groups"], p["hits"]) for p in parts], "r": [p["rows"] for p in parts], "null": [p["nulls"] for p in parts], "i": [p["ids"] for p in parts]}
    one, _ = sorted_rows({c: np.concatenate(x) for c, x in rows.items()})
    at = changes(one["t"], one["g"], one["null"] & NULLS["g"])
    new = np.zeros(len(one["t"]), np.int64)
    new[changes(one["t"], one["g"], one["r"], one["null"] & (NULLS["g"] | NULLS["r"]))] = 1
    return one["t"][at], one["g"][at], (one["null"][at] & NULLS["g"]) > 0, np.diff(np.r_[at, len(one["t"])]), np.add.reduceat(new, at)


def term_counts(rows: DataFrame, *, sample: DataFrame, term: str, bits: int, group: str, record: str, row_id: str, weight: float = 1.0, depth: int = 6, leaves: int = 8, most: int = 1 << 20) -> DataFrame:
    """``group, term, hits, records``: in each group the number of rows and of distinct records of every term. Terms
    are integers of ``bits`` bits, two bits a digit, the highest digits first; the other columns are integers too.

    Rows are routed by adaptive prefixes: the prefix counts of ``sample`` (rows of the same kind, each for ``weight`` of them; it
    only balances the work) burst a trie until no leaf has more than its share of the rows, ``leaves`` leaves a partition, nor
    more than ``most``. Each task accumulates its rows in compact tries, a subtree for each leaf: terms in order, as
    differences, with counters of hits and records and the records under them. Only these subtrees are shuffled, by leaf;
    those of one leaf match and are merged. A term that is too large for a leaf bursts on by its records: its counters stand
    in several leaves, with no record in two of them, and are added up in the end. At most 4**depth routes are broadcast.

    Defined results: rows with a null term are left out; a null group, record or row id counts as a value of its own; a
    repeated row id counts once for each term, group and record; an empty table gives no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    n, below = partitions(spark), bits - 2 * depth
    prefix = F.shiftright(F.col(term), below).cast("int").alias("p")
    seen = {r.p: r.n for r in sample.where(F.col(term).isNotNull()).groupBy(prefix).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 4**depth
    capacity = max(1, min(-(-sum(seen.values()) // (n * leaves)), int(most / weight)))
    routes = spark.sparkContext.broadcast(np.array([(base, many) for _, base, many in sorted(burst(seen, depth, capacity))], np.int64))
    names = (("t", term), ("g", group), ("r", record), ("i", row_id))
    source = rows.where(F.col(term).isNotNull()).select(*(F.col(c).cast("bigint").alias(k) for k, c in names))

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def tries() -> pa.RecordBatch:
            return packed_tries({c: np.concatenate([h[c] for h in held]) for c in LEVELS}, routes.value, below)

        for batch in batches:
            if not batch.num_rows:
                continue
            null = np.zeros(batch.num_rows, np.int64)
            for c, bit in NULLS.items():
                if batch.column(c).null_count:
                    null |= np.where(batch.column(c).is_null().to_numpy(zero_copy_only=False), bit, 0)
            held.append({"null": null, **{c: batch.column(c).fill_null(0).to_numpy() for c in ("t", "g", "r", "i")}})
            size += batch.num_rows
            if size >= HELD:
                yield tries()
                held, size = [], 0
        if held:
            yield tries()

    def merge(tries: pa.Table) -> pa.Table:
        t, g, null, hits, records = merged_tries(tries)
        parts = pa.array(np.full(len(t), tries.column("parts")[0].as_py()))
        return pa.table([parts, pa.array(g, mask=null), pa.array(t), pa.array(hits), pa.array(records)], names=["parts", "g", "t", "hits", "records"])

    blocks = source.mapInArrow(accumulate, "leaf bigint, parts boolean, " + ", ".join(f"{c} binary" for c in TRIE))
    counts = cut(blocks.repartition(n, "leaf").groupBy("leaf").applyInArrow(merge, "parts boolean, g bigint, t bigint, hits bigint, records bigint"))
    merged = counts.where("parts").groupBy("g", "t").agg(F.sum("hits").alias("hits"), F.sum("records").alias("records"))
    kind = rows.schema[group].dataType
    return counts.where("NOT parts").select("g", "t", "hits", "records").unionByName(merged).select(F.col("g").cast(kind).alias(group), F.col("t").alias(term), "hits", "records")


def marked(counts: DataFrame, groups: DataFrame, *, group: str, common_per_mille: int = 40) -> DataFrame:
    """``counts`` with ``mark``: ``rare`` below the group's ``least`` hits, else ``common`` in more than ``common_per_mille``
    of the group's ``total`` records, else null. A group that ``groups`` lacks has no marks."""
    rare, common = F.col("hits") < F.col("least"), F.col("records") * 1000 > common_per_mille * F.col("total")
    return counts.join(broadcast_checked(groups), group).withColumn("mark", F.when(rare, "rare").when(common, "common"))


def kmer_term_counts(spark: SparkSession, sf_dir: str, *, sample: float = 0.05) -> DataFrame:
    raw = table(spark, sf_dir, "kmer_hits")
    return term_counts(usable_hits(raw), sample=usable_hits(raw.sample(sample, 11), columns=()), term="code", bits=2 * K, group="run_id", record="read_id", row_id="hit_id", weight=1 / sample)


def run_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_id, least, total``: the least number of hits, and the reads that have a usable hit."""
    text = F.upper(strip("kmer"))
    reads = table(spark, sf_dir, "kmer_hits").where((F.length(text) == K) & is_acgt(text)).select("run_id", "read_id").distinct()
    total = reads.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"))
    runs = table(spark, sf_dir, "asm_runs").groupBy("run_id").agg(F.max_by("min_count", "started_at").alias("least"))
    return cut(total.join(runs, "run_id", "left").select("run_id", F.coalesce("least", F.lit(2)).alias("least"), "total"))


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer_term_counts(spark, sf_dir).select("run_id", decode("code", K).alias("kmer"), "hits", F.col("records").alias("reads"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = marked(kmer_term_counts(spark, sf_dir), run_limits(spark, sf_dir), group="run_id")
    return counts.where("mark IS NOT NULL").select("run_id", decode("code", K).alias("kmer"), "mark")


QUERIES = {"p1_counts": p1_counts, "p1_found": p1_found}

#: Views that several modules' SQL starts with.
USABLE = """
usable AS (SELECT DISTINCT hit_id, run_id, read_id, t FROM (SELECT hit_id, run_id, read_id, upper(trim(kmer, ' \t\r\n\f\v')) AS t FROM kmer_hits) WHERE regexp_full_match(t, '[ACGT]{31}')),
hits AS (SELECT hit_id, run_id, read_id, CASE WHEN translate(t, 'ACGT', 'TGCA') < reverse(t) THEN translate(reverse(t), 'ACGT', 'TGCA') ELSE t END AS kmer FROM usable)"""

ORACLE = {
    "p1_counts": f"WITH {USABLE} SELECT run_id, kmer, count(DISTINCT hit_id) AS hits, count(DISTINCT read_id) AS reads FROM hits GROUP BY run_id, kmer",
    "p1_found": f"""WITH {USABLE},
c AS (SELECT run_id, kmer, count(DISTINCT hit_id) AS hits, count(DISTINCT read_id) AS reads FROM hits GROUP BY run_id, kmer),
n AS (SELECT run_id, count(DISTINCT read_id) AS total FROM hits GROUP BY run_id),
m AS (SELECT run_id, arg_max(min_count, started_at) AS least FROM asm_runs GROUP BY run_id)
SELECT * FROM (SELECT run_id, kmer, CASE WHEN hits < coalesce(least, 2) THEN 'rare' WHEN reads * 1000 > 40 * total THEN 'common' END AS mark
               FROM c JOIN n USING (run_id) LEFT JOIN m USING (run_id)) WHERE mark IS NOT NULL""",
}
