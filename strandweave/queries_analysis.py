"""Registered queries of evaluation, clustering and taxonomy, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.bases import clean_name
from .functions.vectors import is_numeric_vector, is_vector, rank_vector
from .operators import cluster, evaluate, taxonomy
from .operators.reads import latest
from .plans.session import cut, table
from .queries_graph import typed


def one_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "contigs").distinct()


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments once each, with usable ends and cleaned reference names."""
    rows = latest(table(spark, sf_dir, "delta_alignments"), "aln_id").withColumn("ref", clean_name("ref"))
    return rows.where("ref IS NOT NULL AND ref_from BETWEEN 1 AND ref_len AND ref_to BETWEEN 1 AND ref_len")


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, stop = F.least("ref_from", "ref_to") - 1, F.greatest("ref_from", "ref_to")
    return hits(spark, sf_dir).select("ref", "ref_len", start.alias("start"), stop.alias("stop"), "contig")


def contig_n50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.length_stats(one_contigs(spark, sf_dir), "len", least=100)


def contig_n50_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.length_stats(one_contigs(spark, sf_dir), "len", least=100, total=F.lit(50_000))


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.reference_report(ranges(spark, sf_dir))


def contigs_unaligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.unaligned(one_contigs(spark, sf_dir), hits(spark, sf_dir).select(F.col("contig").alias("name")))


def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.similar_hits(hits(spark, sf_dir), similar=0.5, min_contig=60)


def similar_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.similar_report(similar(spark, sf_dir))


def similar_wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.unaligned(one_contigs(spark, sf_dir), similar(spark, sf_dir).select(F.col("contig").alias("name")), min_contig=60)


def placement_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last placement of each contig on a reference as two tables of placements."""
    rows = hits(spark, sf_dir).where("contig IS NOT NULL AND contig_len IS NOT NULL")
    place = F.struct((F.least("ref_from", "ref_to") - 1).alias("off"), F.col("contig_len").alias("len"))
    both = cut(rows.groupBy("ref", F.col("contig").alias("id")).agg(F.min_by(place, "aln_id").alias("p"), F.max_by(place, "aln_id").alias("q")))
    return evaluate.concordance(both.select("ref", "id", "p.*"), both.select("ref", "id", "q.*"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, vals, ranks, seq_len`` of records whose values are all numbers."""
    rows = latest(table(spark, sf_dir, "kmer_vectors").where(is_numeric_vector("vals", 136)), "seq_id")
    return rows.select(F.col("seq_id").alias("id"), "vals", rank_vector("vals").alias("ranks"), "seq_len")


def known_centres(spark: SparkSession, sf_dir: str, most: int = 10_000) -> list[tuple[int, list[int]]]:
    """Centres left over from earlier, by id: their ranks. More than ``most`` are refused."""
    rows = latest(table(spark, sf_dir, "centers").where(is_vector("ranks", 136)), "center_id", "computed_at").orderBy("center_id").select("center_id", "ranks").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} centres")
    return [(r.center_id, list(r.ranks)) for r in rows]


def vector_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.col("id").alias("seq_id"), "ranks")


def contig_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster.frequency_vectors(one_contigs(spark, sf_dir), "contig_id")
    return rows.select("contig_id", F.transform("vals", lambda v: F.round(v, 9)).alias("vals"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.assigned(vectors(spark, sf_dir), known_centres(spark, sf_dir))


def vector_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir).drop("ranks")


def cluster_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_spread(members(spark, sf_dir)).withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster.centroids(members(spark, sf_dir), vectors(spark, sf_dir).where("vals[0] < 1"))
    return rows.select("centre", F.transform("vals", lambda v: F.round(v, 8)).alias("vals"))


def vectors_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster.normalized(vectors(spark, sf_dir).select("id", "vals"))
    return rows.select("id", F.transform("vals", lambda v: F.round(v, 5)).alias("vals"))


def cluster_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = members(spark, sf_dir).join(vectors(spark, sf_dir).select("id", "seq_len"), "id")
    return cluster.confusion(rows, "centre", "seq_len")


def cluster_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.greedy_match(cluster_confusion(spark, sf_dir), "centre", "seq_len")


def cluster_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of records whose length is the one that their cluster is matched with."""
    counts = cut(cluster_confusion(spark, sf_dir).where("seq_len IS NOT NULL"))
    return cluster.accuracy(counts, cluster.greedy_match(counts, "centre", "seq_len"))


def cluster_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the known centres, classified by the nearest of the even-numbered centres, whose taxon is the id over 4."""
    own = cut(members(spark, sf_dir))
    even = [c for c in known_centres(spark, sf_dir) if c[0] % 2 == 0]
    taxa = table(spark, sf_dir, "centers").select(F.col("center_id").alias("ref"), F.floor(F.col("center_id") / 4).alias("taxon")).distinct()
    return cluster.classified(own.select("id", "centre"), even, taxa, own.select("id", "ranks"))


def group_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from the groups of the query records (ids divisible by 100) to all groups."""
    rows = cut(members(spark, sf_dir).select("id", F.col("centre").alias("grp"), "ranks"))
    return cluster.group_distances(rows.where("id % 100 = 0"), rows)


def vector_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = cut(vectors(spark, sf_dir).select("id", "vals", "ranks"))
    return cluster.best_kmeans(points, 8)


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier"))
    node = lambda df, p, key, q, up, rank: df.select(F.concat(F.lit(p), key).alias("id"), (F.concat(F.lit(q), up) if up else F.lit("root")).alias("parent_id"), F.lit(rank).alias("rank"))
    root = spark.range(1).select(F.lit("root").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("root").alias("rank"))
    parts = [node(region, "r", "r_regionkey", "", None, "region"), node(nation, "n", "n_nationkey", "r", "n_regionkey", "nation"), node(customer, "c", "c_custkey", "n", "c_nationkey", "leaf"), node(supplier, "s", "s_suppkey", "n", "s_nationkey", "leaf")]
    for p in parts:
        root = root.unionByName(p)
    return root


def taxonomy_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.closure(tree(spark, sf_dir))


def taxonomy_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.compressed(tree(spark, sf_dir), ["region"])


def taxonomy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda t, p, key, v: table(spark, sf_dir, t).select(F.concat(F.lit(p), key).alias("id"), F.array(v).alias("vals"))
    refs = value("customer", "c", "c_custkey", "c_acctbal").unionByName(value("supplier", "s", "s_suppkey", "s_acctbal"))
    return taxonomy.rolled_up(tree(spark, sf_dir), refs).select("id", "refs", F.round(F.col("centre")[0], 4).alias("centre"))


def taxonomy_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs as references of customers' taxa: which lie at or below each nation and region."""
    seqs = one_contigs(spark, sf_dir).select(F.col("contig_id").alias("ref"), F.concat(F.lit("c"), F.col("contig_id") % 100).alias("taxon_id"), "seq")
    return taxonomy.reference_tables(tree(spark, sf_dir), seqs, ("region", "nation"))[1]


QUERIES = {f.__name__: f for f in (contig_n50, contig_n50_reference, coverage_report, contigs_unaligned, similar_report, similar_wrong, placement_concordance, vector_ranks, contig_vectors, vector_nearest, cluster_spread, cluster_centroids, vectors_normalized, cluster_confusion, cluster_matched, cluster_accuracy, cluster_classified, group_distances, vector_kmeans, taxonomy_closure, taxonomy_compressed, taxonomy_rollup, taxonomy_references)}

BLANK = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
HITS = f"""h0 AS (SELECT * REPLACE (ltrim(rtrim(ref, {BLANK}), {BLANK} || '>') AS ref) FROM delta_alignments QUALIFY row_number() OVER (PARTITION BY aln_id ORDER BY loaded_at DESC NULLS LAST) = 1),
h AS (SELECT *, least(ref_from, ref_to) - 1 AS start, greatest(ref_from, ref_to) AS stop FROM h0 WHERE ref IS NOT NULL AND ref_from BETWEEN 1 AND ref_len AND ref_to BETWEEN 1 AND ref_len)"""
SIMILAR = f"""{HITS}, s0 AS (SELECT *, stop - start AS span, greatest(contig_from, contig_to) - least(contig_from, contig_to) + 1 AS size FROM h),
s AS (SELECT * FROM s0 WHERE span >= 0.5 * contig_len AND contig_len >= span * 0.5 AND errors <= contig_len * 0.5 AND contig_len >= 60)"""


def covered_sql(src: str) -> str:
    return f"""m0 AS (SELECT ref, start AS a, stop - 1 AS b, max(stop - 1) OVER (PARTITION BY ref ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {src}),
m1 AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY ref ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM m0),
m2 AS (SELECT ref, min(a) AS a, max(b) AS b FROM m1 GROUP BY ref, i)"""


def n50_sql(src: str, cond: str) -> str:
    return f"""r0 AS (SELECT ref, ref_len, size, sum(size) OVER (PARTITION BY ref ORDER BY size DESC ROWS UNBOUNDED PRECEDING) AS run, max(ref_len) OVER (PARTITION BY ref) AS t FROM {src}),
r1 AS (SELECT ref, coalesce(max(size) FILTER (WHERE run * 10 {cond} t * 5), 0) AS n50, coalesce(max(size) FILTER (WHERE run * 10 {cond} t * 8), 0) AS n80, max(size) AS longest, sum(size) AS mapped, CAST(floor(avg(size)) AS BIGINT) AS mean FROM r0 GROUP BY ref)"""


N50 = """WITH c AS (SELECT len FROM (SELECT DISTINCT * FROM contigs) WHERE len >= 100), t AS (SELECT {total} AS t),
r AS (SELECT len, sum(len) OVER (ORDER BY len DESC ROWS UNBOUNDED PRECEDING) AS run, t FROM c, t)
SELECT count(*) AS n, CAST(sum(len) AS BIGINT) AS sum_len, CAST(coalesce(max(len) FILTER (WHERE run * 10 > t * 5), 0) AS BIGINT) AS n50, CAST(coalesce(max(len) FILTER (WHERE run * 10 > t * 8), 0) AS BIGINT) AS n80, CAST(max(len) AS BIGINT) AS max_len, CAST(floor(max(t) / count(*)) AS BIGINT) AS mean_len FROM r"""
VEC = """v0 AS (SELECT * FROM kmer_vectors WHERE len(vals) = 136 AND len(list_filter(vals, lambda x: x IS NOT NULL AND NOT isnan(x))) = 136 QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY loaded_at DESC NULLS LAST) = 1),
v1 AS (SELECT seq_id AS id, unnest(vals) AS v, unnest(range(0, 136)) AS dim FROM v0),
v2 AS (SELECT id, dim, v, row_number() OVER (PARTITION BY id ORDER BY v, dim) - 1 AS r FROM v1),
vec AS (SELECT id, list(CAST(r AS INT) ORDER BY dim) AS ranks, list(v ORDER BY dim) AS vals FROM v2 GROUP BY id)"""
MEM = VEC + """,
c0 AS (SELECT center_id, ranks FROM centers WHERE len(ranks) = 136 AND len(list_filter(ranks, lambda x: x IS NOT NULL)) = 136 QUALIFY row_number() OVER (PARTITION BY center_id ORDER BY computed_at DESC NULLS LAST) = 1),
d0 AS (SELECT id, center_id, list_sum(list_transform(list_zip(vec.ranks, c0.ranks), lambda p: abs(p[1] - p[2]))) AS d FROM vec, c0),
mem AS (SELECT id, center_id AS centre, CAST(d AS INT) AS distance FROM d0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, center_id) = 1)"""
TREE = """tree AS (SELECT 'root' AS id, CAST(NULL AS VARCHAR) AS parent_id, 'root' AS rank UNION ALL SELECT 'r' || r_regionkey, 'root', 'region' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'nation' FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'leaf' FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'leaf' FROM supplier),
cl AS (SELECT id, id AS ancestor, 0 AS depth FROM tree UNION ALL SELECT cl.id, tree.parent_id, depth + 1 FROM cl JOIN tree ON tree.id = cl.ancestor WHERE tree.parent_id IS NOT NULL)"""

ORACLE = {
    "contig_n50": N50.format(total="(SELECT sum(len) FROM c)"),
    "contig_n50_reference": N50.format(total="50000"),
    "coverage_report": f"""WITH {HITS}, l AS (SELECT *, stop - start AS size FROM h WHERE stop - start >= 100), {n50_sql('l', '>')}, {covered_sql('l')},
p AS (SELECT ref, count(DISTINCT contig) AS found, max(ref_len) AS ref_len FROM l GROUP BY ref), cv AS (SELECT ref, CAST(sum(b - a + 1) AS BIGINT) AS covered, count(*) FILTER (WHERE b + 1 < ref_len) AS blocks FROM m2 JOIN p USING (ref) GROUP BY ref)
SELECT ref, found, ref_len, n50, n80, longest, CAST(mapped AS BIGINT) AS mapped, mean, covered, blocks, round(100 * covered / ref_len, 4) AS percent FROM p JOIN r1 USING (ref) JOIN cv USING (ref)""",
    "contigs_unaligned": f"WITH {HITS} SELECT count(*) AS n, CAST(coalesce(sum(len), 0) AS BIGINT) AS sum_len FROM (SELECT DISTINCT * FROM contigs) WHERE len >= 100 AND name NOT IN (SELECT contig FROM h WHERE contig IS NOT NULL)",
    "similar_report": f"""WITH {SIMILAR}, {n50_sql('s', '>=')}, {covered_sql('s')}, p AS (SELECT ref, count(DISTINCT contig) AS contigs, max(ref_len) AS ref_len FROM s GROUP BY ref), cv AS (SELECT ref, CAST(sum(b - a + 1) AS BIGINT) AS covered FROM m2 GROUP BY ref)
SELECT ref, contigs, ref_len, longest, mean, n50, covered, round(100 * covered / (ref_len + 1), 4) AS percent FROM p JOIN r1 USING (ref) JOIN cv USING (ref)""",
    "similar_wrong": f"WITH {SIMILAR} SELECT count(*) AS n, CAST(coalesce(sum(len), 0) AS BIGINT) AS sum_len FROM (SELECT DISTINCT * FROM contigs) WHERE len >= 60 AND name NOT IN (SELECT contig FROM s WHERE contig IS NOT NULL)",
    "placement_concordance": f"""WITH {HITS}, b AS (SELECT ref, contig AS id, arg_min(start, aln_id) AS o1, arg_min(contig_len, aln_id) AS l1, arg_max(start, aln_id) AS o2, arg_max(contig_len, aln_id) AS l2 FROM h WHERE contig IS NOT NULL AND contig_len IS NOT NULL GROUP BY ref, contig),
p AS (SELECT a.ref, a.id AS a, c.id AS b FROM b a JOIN b c ON a.ref = c.ref AND a.id <> c.id AND a.l1 >= 100 AND c.l1 >= 100 AND (a.o1 < c.o1 OR (a.o1 = c.o1 AND a.id > c.id)) AND abs(a.o1 + a.l1 - c.o1) < 500),
q AS (SELECT a.ref, a.id AS a, c.id AS b FROM b a JOIN b c ON a.ref = c.ref AND a.id <> c.id AND a.l2 >= 100 AND c.l2 >= 100 AND (a.o2 < c.o2 OR (a.o2 = c.o2 AND a.id > c.id)) AND abs(a.o2 + a.l2 - c.o2) < 500)
SELECT (SELECT count(*) FROM p) AS n1, (SELECT count(*) FROM q) AS n2, (SELECT count(*) FROM p JOIN q USING (ref, a, b)) AS same""",
    "vector_ranks": f"WITH {VEC} SELECT id AS seq_id, ranks FROM vec",
    "contig_vectors": """WITH c AS (SELECT DISTINCT contig_id, upper(seq) AS seq FROM contigs WHERE length(seq) > 0),
dim AS (SELECT kmer, row_number() OVER (ORDER BY reverse(kmer)) AS dim, kmer = translate(reverse(kmer), 'ACGT', 'TGCA') AS pal FROM (SELECT a || b || g || t AS kmer FROM (VALUES ('A'), ('C'), ('G'), ('T')) x(a), (VALUES ('A'), ('C'), ('G'), ('T')) y(b), (VALUES ('A'), ('C'), ('G'), ('T')) z(g), (VALUES ('A'), ('C'), ('G'), ('T')) w(t)) WHERE reverse(kmer) <= translate(kmer, 'ACGT', 'TGCA')),
w AS (SELECT contig_id, substr(seq, i, 4) AS w FROM (SELECT contig_id, seq, unnest(range(1, length(seq) - 2)) AS i FROM c)),
n AS (SELECT contig_id, CASE WHEN translate(w, 'ACGT', 'TGCA') < reverse(w) THEN translate(reverse(w), 'ACGT', 'TGCA') ELSE w END AS kmer, count(*) AS n FROM w WHERE regexp_full_match(w, '[ACGT]{4}') GROUP BY ALL)
SELECT contig_id, list(round(coalesce(n, 0) * CASE WHEN pal THEN 2 ELSE 1 END / length(seq), 9) ORDER BY dim) AS vals FROM c CROSS JOIN dim LEFT JOIN n USING (contig_id, kmer) GROUP BY contig_id""",
    "vector_nearest": f"WITH {MEM} SELECT id, centre, distance FROM mem",
    "cluster_spread": f"WITH {MEM} SELECT centre, count(*) AS n, round(avg(distance), 6) AS mean, round(stddev_samp(distance), 6) AS sd FROM mem GROUP BY centre",
    "cluster_centroids": f"WITH {MEM}, m AS (SELECT centre, dim, round(avg(v), 8) AS v FROM mem JOIN v1 USING (id) WHERE id IN (SELECT id FROM vec WHERE vals[1] < 1) GROUP BY centre, dim) SELECT centre, list(v ORDER BY dim) AS vals FROM m GROUP BY centre",
    "vectors_normalized": f"WITH {VEC}, s AS (SELECT dim, avg(v) AS m, stddev_samp(v) AS s FROM v1 GROUP BY dim) SELECT id, list(round(CASE WHEN s > 0 THEN (v - m) / s ELSE 0 END, 5) ORDER BY dim) AS vals FROM v1 JOIN s USING (dim) GROUP BY id",
    "cluster_confusion": f"WITH {MEM} SELECT centre, seq_len, count(*) AS n FROM mem JOIN v0 ON seq_id = id GROUP BY centre, seq_len",
    "cluster_classified": f"""WITH {MEM}, nr AS (SELECT id, center_id AS ref FROM d0 WHERE center_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, center_id) = 1),
vt AS (SELECT centre, CAST(floor(ref / 4) AS BIGINT) AS taxon, count(*) AS votes FROM mem JOIN nr USING (id) GROUP BY ALL)
SELECT centre, taxon, votes FROM vt QUALIFY row_number() OVER (PARTITION BY centre ORDER BY votes DESC, taxon) = 1""",
    "group_distances": f"""WITH {MEM}, x AS (SELECT id, centre, ranks FROM mem JOIN vec USING (id)),
y AS (SELECT a.centre AS g1, b.centre AS g2, CAST(list_sum(list_transform(list_zip(a.ranks, b.ranks), lambda p: abs(p[1] - p[2]))) AS INT) AS d FROM x a, x b WHERE a.id % 100 = 0 AND a.id <> b.id)
SELECT g1, g2, count(*) AS n, min(d) AS min, max(d) AS max, round(avg(d), 6) AS mean, list_sort(list(d))[count(*) // 2 + 1] AS median FROM y GROUP BY g1, g2""",
    "taxonomy_closure": f"WITH RECURSIVE {TREE} SELECT id, ancestor, CAST(depth AS INT) AS depth FROM cl",
    "taxonomy_compressed": f"WITH RECURSIVE {TREE} SELECT id, arg_min(ancestor, depth) AS parent_id FROM (SELECT cl.id, ancestor, depth FROM cl JOIN tree ON tree.id = cl.ancestor WHERE (depth > 0 AND rank = 'region') OR rank = 'root') GROUP BY id",
    "taxonomy_references": f"WITH RECURSIVE {TREE} SELECT DISTINCT t.rank, cl.ancestor AS taxon_id, c.contig_id AS ref FROM contigs c JOIN cl ON cl.id = 'c' || (c.contig_id % 100) JOIN tree t ON t.id = cl.ancestor WHERE t.rank IN ('region', 'nation')",
    "taxonomy_rollup": f"""WITH RECURSIVE {TREE}, f AS (SELECT 'c' || c_custkey AS id, c_acctbal AS v FROM customer UNION ALL SELECT 's' || s_suppkey, s_acctbal FROM supplier),
l AS (SELECT id, avg(v) AS c FROM f GROUP BY id), n AS (SELECT parent_id AS id, avg(c) AS c FROM l JOIN tree USING (id) GROUP BY parent_id), r AS (SELECT parent_id AS id, avg(c) AS c FROM n JOIN tree USING (id) GROUP BY parent_id), o AS (SELECT parent_id AS id, avg(c) AS c FROM r JOIN tree USING (id) GROUP BY parent_id),
a AS (SELECT * FROM l UNION ALL SELECT * FROM n UNION ALL SELECT * FROM r UNION ALL SELECT * FROM o), k AS (SELECT ancestor AS id, count(*) AS refs FROM f JOIN cl USING (id) GROUP BY ancestor)
SELECT id, refs, round(c, 4) AS centre FROM a JOIN k USING (id)""",
}
ORACLE["coverage_report"] = typed(ORACLE["coverage_report"], BIGINT="n50 n80 longest")
ORACLE["similar_report"] = typed(ORACLE["similar_report"], BIGINT="n50")
