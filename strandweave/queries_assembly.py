"""Registered queries of alignment, scaffolding and iterated assembly, and the same in SQL.

Contigs are halved, and pairs of reads are cut from the whole contigs, so that pairs lie within and across the halves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.bases import revcomp
from .operators import align, contig_graph, evaluate, graph, scaffold
from .plans import assembly
from .plans.session import cut, shared_dir, table
from .queries_graph import active_reads, canon, latest_reads, rc, read_graph, typed

K, READ = 21, 40


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "contigs").select("contig_id", "seq").distinct()


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    middle = F.floor(F.length("seq") / 2).cast("int")
    parts = F.array(F.struct((F.col("contig_id") * 2).alias("contig_id"), F.substring("seq", F.lit(1), middle).alias("seq")), F.struct((F.col("contig_id") * 2 + 1).alias("contig_id"), F.substring("seq", middle + 1, F.length("seq")).alias("seq")))
    return whole(spark, sf_dir).select(F.explode(parts).alias("x")).select("x.*")


def mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``read_id, pair_id, mate, seq``: 40 bases at each end of stretches of 100 to 110, every 7 bases."""
    long_ = whole(spark, sf_dir).where("length(seq) >= 110")
    spots = long_.select("contig_id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 110, F.lit(7))).alias("s"))
    insert = F.lit(100) + (F.col("contig_id") * 31 + F.col("s")) % 11
    rows = spots.select((F.col("contig_id") * 1000 + F.col("s")).alias("pair_id"), "seq", "s", insert.cast("int").alias("ins"))
    two = rows.withColumn("mate", F.explode(F.array(F.lit(1), F.lit(2))))
    text = F.when(F.col("mate") == 1, F.substring("seq", F.col("s") + 1, F.lit(READ))).otherwise(revcomp(F.substring("seq", F.col("s") + F.col("ins") - (READ - 1), F.lit(READ))))
    return two.select((F.col("pair_id") * 2 + F.col("mate") - 1).alias("read_id"), "pair_id", "mate", text.alias("seq"))


def align_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.kmer_index(halves(spark, sf_dir), K)


def align_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignments(mates(spark, sf_dir), align_index(spark, sf_dir), K)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaffold.mate_pairs(align_reads(spark, sf_dir), mates(spark, sf_dir), K)


def insert_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaffold.insert_histogram(pairs(spark, sf_dir))


def insert_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaffold.insert_size(insert_histogram(spark, sf_dir))


def linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    met = cut(pairs(spark, sf_dir))
    size = cut(scaffold.insert_size(scaffold.insert_histogram(met)))
    return scaffold.links(met, size, K, min_pairs=2), size


def scaffold_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark, sf_dir)[0]


def scaffold_close_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = cut(pairs(spark, sf_dir))
    return scaffold.close_links(met, scaffold.insert_size(scaffold.insert_histogram(met)), min_pairs=2, least=60)


def scaffold_gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, size = linked(spark, sf_dir)
    return scaffold.gapped_scaffolds(cut(halves(spark, sf_dir)), cut(found), size)


def thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs in three parts that overlap by k-1 bases; the middle one is short."""
    middle = F.floor(F.length("seq") / 2).cast("int")
    piece = lambda i, a, b: F.struct((F.col("contig_id") * 3 + i).alias("contig_id"), F.substring("seq", a, b).alias("seq"))
    parts = F.array(piece(0, F.lit(1), middle), piece(1, middle - (K - 2), F.lit(K + 9)), piece(2, middle - (K - 2) + 10, F.length("seq")))
    return whole(spark, sf_dir).where("length(seq) >= 120").select(F.explode(parts).alias("x")).select("x.*")


def scaffold_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs in three overlapping parts, put together again along the paths that pairs confirm."""
    parts = cut(thirds(spark, sf_dir))
    read = cut(mates(spark, sf_dir))
    met = cut(scaffold.mate_pairs(align.alignments(read, align.kmer_index(parts, K), K), read, K))
    size = cut(scaffold.insert_size(scaffold.insert_histogram(met)))
    row = size.first()
    if row is None:
        return parts.select("seq", F.length("seq").alias("len"), F.lit(1).cast("bigint").alias("parts")).limit(0)
    found = cut(scaffold.links(met, size, K, min_pairs=2))
    return scaffold.path_scaffolds(parts, cut(scaffold.linked_paths(parts, found, row.delta, K)), K)


def read_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error profile of the mates where their longest alignment places them on the halves; the stretch of a mate that lies beyond
    a half's end is not compared, as such mates are left out."""
    rows = align_reads(spark, sf_dir)
    start = F.col("contig_off") - F.col("read_off")
    off = F.when(F.col("rev"), F.col("contig_len") - start - F.col("read_len")).otherwise(start)
    placed = rows.select("read_id", "contig_id", off.cast("int").alias("off"), "rev")
    return evaluate.error_profile(placed, mates(spark, sf_dir), halves(spark, sf_dir))


def contig_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.depth_histogram(align_reads(spark, sf_dir).select("contig_id", "len"), halves(spark, sf_dir))


def contigs_iterated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs of all reads over the default range of k, 25 to 50."""
    start = cut(graph.unitigs(*read_graph(spark, sf_dir, assembly.Options().mink, False), assembly.Options().mink).select("seq", "sum_cov"))
    return contig_graph.iterated(start, cut(active_reads(spark, sf_dir)), assembly.Options().mink, assembly.Options().maxk)


def assembly_gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole assembly of all reads with its default options: the k loop, scaffolds along paths and scaffolds with gaps."""
    rows = latest_reads(spark, sf_dir).select("read_id", "seq", "pair_id", "mate")
    return assembly.assemble(spark, rows, f"{shared_dir(spark)}/assembly-{uuid.uuid4().hex}", with_scaffolds=True, with_gaps=True)


QUERIES = {f.__name__: f for f in (align_index, align_reads, insert_histogram, insert_estimate, scaffold_links, scaffold_close_links, scaffold_gapped, scaffold_paths, read_errors, contig_depth, contigs_iterated, assembly_gapped)}


def win(name: str, src: str, key: str) -> str:
    return f"{name} AS (SELECT {key}, len, pos, {canon('km')} AS kmer, translate(km, 'ACGT', 'TGCA') < reverse(km) AS rev FROM (SELECT {key}, length(seq) AS len, pos, substr(seq, pos, {K}) AS km FROM (SELECT *, unnest(range(1, length(seq) - {K} + 2)) AS pos FROM {src} WHERE length(seq) >= {K})))"


INDEX = f"""WITH RECURSIVE wh AS (SELECT DISTINCT contig_id, seq FROM contigs),
hv AS (SELECT contig_id * 2 AS contig_id, left(seq, length(seq) // 2) AS seq FROM wh UNION ALL SELECT contig_id * 2 + 1, substr(seq, length(seq) // 2 + 1) FROM wh),
{win('cw', 'hv', 'contig_id')},
ix AS (SELECT kmer, contig_id, pos - 1 AS off, len AS contig_len, rev AS contig_rev FROM cw QUALIFY row_number() OVER (PARTITION BY kmer ORDER BY contig_id DESC, pos DESC) = 1)"""
ALIGN = f"""{INDEX},
sp AS (SELECT contig_id, seq, unnest(range(0, length(seq) - 109, 7)) AS s FROM wh WHERE length(seq) >= 110),
mt AS (SELECT (contig_id * 1000 + s) * 2 AS read_id, contig_id * 1000 + s AS pair_id, 1 AS mate, substr(seq, s + 1, {READ}) AS seq FROM sp
       UNION ALL SELECT (contig_id * 1000 + s) * 2 + 1, contig_id * 1000 + s, 2, {rc(f"substr(seq, s + 100 + (contig_id * 31 + s) % 11 - {READ - 1}, {READ})")} FROM sp),
{win('rw', 'mt', 'read_id')},
h0 AS (SELECT read_id, len AS read_len, pos, contig_id, contig_len, rev <> contig_rev AS rev, CASE WHEN rev <> contig_rev THEN contig_len - off - {K} ELSE off END AS spot FROM rw JOIN ix USING (kmer)),
h1 AS (SELECT *, CASE WHEN lag(contig_id) OVER o = contig_id AND lag(rev) OVER o = rev AND lag(spot) OVER o + 1 = spot THEN 0 ELSE 1 END AS new FROM h0 WINDOW o AS (PARTITION BY read_id ORDER BY pos)),
h2 AS (SELECT *, sum(new) OVER (PARTITION BY read_id ORDER BY pos) AS run FROM h1),
al AS (SELECT read_id, read_len, min(pos) - 1 AS read_off, contig_id, min(spot) AS contig_off, contig_len, count(*) + {K - 1} AS len, rev FROM h2 GROUP BY read_id, read_len, run, contig_id, contig_len, rev)"""
PAIRS = f"""{ALIGN},
sg AS (SELECT * FROM al WHERE contig_len >= {2 * K} QUALIFY count(*) OVER (PARTITION BY read_id) = 1),
pr AS (SELECT a.contig_id AS ac, a.rev AS ar, a.contig_len AS alen, a.contig_off - a.read_off AS st, b.contig_id AS bc, NOT b.rev AS br, b.contig_len - b.contig_off - b.len + b.read_off + b.len AS sp
       FROM sg a JOIN mt ma ON ma.read_id = a.read_id AND ma.mate = 1 JOIN mt mb ON mb.pair_id = ma.pair_id AND mb.mate = 2 JOIN sg b ON b.read_id = mb.read_id),
hi AS (SELECT sp - st AS size, count(*) AS n FROM pr WHERE ac = bc AND ar = br AND sp - st BETWEEN 0 AND 9999 GROUP BY 1)"""
SIZE = f"""{PAIRS},
cu AS (SELECT *, sum(n) OVER (ORDER BY size) AS below, sum(n) OVER (ORDER BY size DESC) AS above, sum(n) OVER () // 200 AS least FROM hi),
me AS (SELECT CAST(round(sum(size * n) / sum(n)) AS INT) AS estimate, sum(n) * 90 // 100 AS region FROM cu WHERE below >= least AND above >= least),
ri AS (SELECT estimate, region, abs(size - estimate) AS ring, sum(n) AS n FROM hi, me GROUP BY ALL),
rh AS (SELECT *, sum(n) OVER (ORDER BY ring) AS held FROM ri),
sz AS (SELECT estimate, CAST(greatest(least(coalesce(min(ring) FILTER (WHERE held >= region), estimate) + 1, greatest(estimate, 1)), estimate // 20) AS INT) AS delta FROM rh GROUP BY estimate)"""
LINKS = f"""{SIZE},
l0 AS (SELECT ac AS src, ar AS src_rev, bc AS dst, br AS dst_rev, -(alen - st) - sp AS d FROM pr WHERE ac <> bc OR ar <> br),
l1 AS (SELECT src, src_rev, dst, dst_rev, d FROM l0 UNION ALL SELECT dst, NOT dst_rev, src, NOT src_rev, d FROM l0),
l2 AS (SELECT src, src_rev, dst, dst_rev, list_sort(list(d + estimate)) AS v, max(delta) AS delta FROM l1, sz GROUP BY ALL),
l3 AS (SELECT *, len(v) AS n, v[len(v) // 2 + 1] AS dist FROM l2),
lk AS (SELECT src, src_rev, dst, dst_rev, n, dist FROM l3 WHERE n >= 2 AND dist >= {-2 * K} AND len(list_filter(v[n // 10 + 1 : n - n // 10], lambda x: abs(x - dist) > delta)) = 0)"""
ORACLE = {
    "align_index": f"{INDEX} SELECT kmer, contig_id, CAST(off AS INT) AS off, CAST(contig_len AS INT) AS contig_len, contig_rev FROM ix",
    "align_reads": f"{ALIGN} SELECT read_id, read_len, read_off, contig_id, contig_off, contig_len, len, rev FROM al",
    "insert_histogram": f"{PAIRS} SELECT size, n FROM hi",
    "insert_estimate": f"{SIZE} SELECT estimate, delta FROM sz",
    "scaffold_links": f"{LINKS} SELECT src, src_rev, dst, dst_rev, n, dist FROM lk",
    "scaffold_close_links": f"""{SIZE},
c0 AS (SELECT ac AS src, ar AS src_rev, bc AS dst, br AS dst_rev, -(alen - st) - sp AS d FROM pr WHERE (ac <> bc OR ar <> br) AND alen >= 60 AND ac IN (SELECT contig_id FROM hv WHERE length(seq) >= 60) AND bc IN (SELECT contig_id FROM hv WHERE length(seq) >= 60)),
c1 AS (SELECT src, src_rev, dst, dst_rev, d FROM c0 UNION ALL SELECT dst, NOT dst_rev, src, NOT src_rev, d FROM c0)
SELECT src, src_rev, dst, dst_rev, count(*) AS n, round(avg(d + estimate), 6) AS dist FROM c1, sz GROUP BY src, src_rev, dst, dst_rev HAVING count(*) >= 2 AND max(d + estimate) - avg(d + estimate) <= max(delta) AND avg(d + estimate) - min(d + estimate) <= max(delta)""",
    "scaffold_gapped": f"""{LINKS},
g0 AS (SELECT src * 2 + src_rev::INT AS u, dst * 2 + dst_rev::INT AS v, dist AS gap FROM lk WHERE dst IN (SELECT contig_id FROM hv, sz WHERE length(seq) >= estimate + delta)),
g1 AS (SELECT u, any_value(v) AS v, any_value(gap) AS gap FROM g0 GROUP BY u HAVING count(*) = 1),
g2 AS MATERIALIZED (SELECT * FROM g1 a WHERE u // 2 <> v // 2 AND EXISTS (SELECT 1 FROM g1 b WHERE b.u = xor(a.v, 1) AND b.v = xor(a.u, 1))),
vx AS (SELECT contig_id * 2 AS u, seq FROM hv UNION ALL SELECT contig_id * 2 + 1, {rc('seq')} FROM hv),
wk AS (SELECT u AS head, u, CAST(seq AS VARCHAR) AS seq, 1 AS parts FROM vx WHERE u NOT IN (SELECT v FROM g2)
       UNION ALL SELECT head, g2.v, wk.seq || repeat('N', greatest(gap, 0)) || substr(vx.seq, greatest(-gap, 0) + 1), parts + 1 FROM wk JOIN g2 ON g2.u = wk.u JOIN vx ON vx.u = g2.v),
en AS (SELECT * FROM wk WHERE u NOT IN (SELECT u FROM g2))
SELECT DISTINCT least(seq, {rc('seq')}) AS seq, length(seq) AS len, CAST(parts AS BIGINT) AS parts FROM en""",
    "read_errors": f"""{ALIGN},
p0 AS (SELECT read_id, contig_id, CASE WHEN rev THEN contig_len - (contig_off - read_off) - read_len ELSE contig_off - read_off END AS off, rev FROM al QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY contig_id, off, rev) = 1),
p1 AS (SELECT p0.*, mt.seq AS r, hv.seq AS c FROM p0 JOIN mt USING (read_id) JOIN hv USING (contig_id) WHERE off >= 0 AND off + length(mt.seq) <= length(hv.seq)),
p2 AS (SELECT read_id, pos, substr(r, pos + 1, 1) <> CASE WHEN rev THEN translate(substr(c, off + length(r) - pos, 1), 'ACGT', 'TGCA') ELSE substr(c, off + pos + 1, 1) END AS e FROM (SELECT *, unnest(range(0, length(r))) AS pos FROM p1)),
p3 AS (SELECT *, lag(e) OVER (PARTITION BY read_id ORDER BY pos) AS p FROM p2)
SELECT CAST(pos AS INT) AS pos, count(*) AS bases, count(*) FILTER (WHERE e) AS errors, count(*) FILTER (WHERE e AND p) AS repeated FROM p3 GROUP BY pos""",
    "contig_depth": f"{ALIGN}, b AS (SELECT contig_id, sum(len) AS b FROM al GROUP BY contig_id) SELECT CAST(floor(coalesce(b, 0) / length(seq)) AS BIGINT) AS depth, count(*) AS contigs FROM hv LEFT JOIN b USING (contig_id) WHERE length(seq) > 0 GROUP BY 1",
}
ORACLE["align_reads"] = typed(ORACLE["align_reads"], INTEGER="read_len read_off contig_off contig_len")
ORACLE["scaffold_gapped"] = typed(ORACLE["scaffold_gapped"], INTEGER="len")
