"""Registered queries of reads, k-mers and their graph, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bases as B
from .operators import contracted, graph, kmers, reads
from .plans.session import cut, table

K, MIN_COUNT = 25, 2


def latest_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.latest(table(spark, sf_dir, "short_reads"), "read_id")


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.clean_reads(latest_reads(spark, sf_dir))


def active_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(spark, sf_dir).where("active").select("read_id", "seq")


def read_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.clean_reads(latest_reads(spark, sf_dir), trim=3).select("read_id", "seq", "active")


def read_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.split_by_length(latest_reads(spark, sf_dir), trim=2).select("read_id", "seq", "kind")


def read_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.normalize_reads(latest_reads(spark, sf_dir), 90).select("read_id", "seq")


def read_normalize_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.normalize_pairs(latest_reads(spark, sf_dir), 85).select("read_id", "pair_id", "seq")


def read_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mates 1 and 2 as two files, merged position by position."""
    rows = latest_reads(spark, sf_dir).where("seq IS NOT NULL")
    return reads.merged(rows.where("mate = 1"), rows.where("mate = 2"), order="read_id")


def base_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar functions over sequences, on every contig."""
    c = table(spark, sf_dir, "contigs").select("contig_id", "seq", "len", "sum_cov").distinct()
    k = 31
    return c.select(
        "contig_id",
        B.revcomp("seq").alias("rc"),
        B.encode_digits("seq").alias("digits"),
        B.decode_digits(B.encode_digits("seq")).alias("letters"),
        B.trim_right("seq", 7).alias("trimmed"),
        B.trim_error(F.concat("seq", F.lit("NNxN"))).alias("untailed"),
        F.substring("seq", 10, k).alias("kmer"),
        B.canonical(F.substring("seq", 10, k)).alias("canon"),
        B.decode(B.canonical_code(F.substring("seq", 10, k)), k).alias("decoded"),
        B.is_palindrome(F.substring("seq", 1, 2)).alias("palindrome"),
        B.is_acgt("seq").alias("acgt"),
        F.left("seq", F.lit(k)).alias("begin_kmer"),
        F.right("seq", F.lit(k)).alias("end_kmer"),
        F.round(B.coverage("sum_cov", "len", k), 6).alias("coverage"),
        B.merge_overlap(F.left("seq", F.lit(40)), F.substring("seq", 41 - (k - 1), 60), k).alias("merged"),
        B.merge_gap("seq", F.lit("ACGTACGT"), (F.col("contig_id") % 7 - 3).cast("int")).alias("gapped"),
        B.degree((F.col("contig_id") % 16).cast("int")).alias("degree"),
        B.saturated("sum_cov").alias("capped"),
        F.format_string("contig%d_%d", "contig_id", F.coalesce("sum_cov", F.lit(0))).alias("label"),
        F.concat(F.lit(">"), F.format_string("contig%d_%d", "contig_id", F.coalesce("sum_cov", F.lit(0))), F.lit("\n"), "seq").alias("fasta"),
        F.repeat(F.lit("a"), F.length("seq")).alias("quality"),
    )


def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsing of record names: first token, trailing digits, digits after the first underscore."""
    c = table(spark, sf_dir, "contigs").select("name").distinct()
    number = lambda pattern: F.expr(f"try_cast(nullif(regexp_extract(name, '{pattern}', 1), '') AS bigint)")
    return c.select("name", F.split(F.trim("name"), r"\s+")[0].alias("token"), number("([0-9]*)$").alias("sum_cov"), number("_([0-9]+)").alias("label"))


def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.count_kmers(active_reads(spark, sf_dir), K)


def kmer_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.spectrum(kmers.count_kmers(active_reads(spark, sf_dir), K).where(F.col("cnt") >= MIN_COUNT))


def kmer_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = active_reads(spark, sf_dir)
    return kmers.gap_fill(r, kmers.solid_kmers(r, K, MIN_COUNT), K)


def read_graph(spark: SparkSession, sf_dir: str, k: int = K, edges: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Nodes (``kmer, cnt, in_mask, out_mask``) and pruned edges (None without ``edges``) of the solid and filled-in k-mers of all reads, as words."""
    nodes = read_nodes(spark, sf_dir, k)
    return nodes, cut(kmers.prune_edges(nodes, k)) if edges else None


def read_nodes(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return cut(kmers.solid_graph(active_reads(spark, sf_dir), k, MIN_COUNT))


def lettered(df: DataFrame, *columns: str) -> DataFrame:
    """Words of K bases as strings."""
    return df.withColumns({c: B.word_text(c, K) for c in columns})


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lettered(read_nodes(spark, sf_dir), "kmer")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lettered(read_graph(spark, sf_dir)[1], "u", "v")


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.coverage_stats(read_nodes(spark, sf_dir))


def graph_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lettered(graph.graph_violations(*read_graph(spark, sf_dir), K), "u", "v")


def graph_check_unpruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the check finds on edges that still lead to k-mers outside the graph."""
    nodes = read_nodes(spark, sf_dir)
    return lettered(graph.graph_violations(nodes, cut(kmers.oriented_edges(nodes, K)), K), "u", "v")


def read_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = active_reads(spark, sf_dir)
    return kmers.read_hits(r, kmers.solid_kmers(r, K, MIN_COUNT), K).withColumn("valid", F.col("windows") == F.col("hits"))


def unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unitigs(*read_graph(spark, sf_dir), K)


def unitigs_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs after tips have been trimmed."""
    return contracted.trimmed_unitigs(*read_graph(spark, sf_dir), K, 75)


def unitigs_thick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs after those of a coverage below 4 have been dropped."""
    return graph.unitigs(*graph.drop_thin(*read_graph(spark, sf_dir), K, 4.0), K)


def bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bubbles(*read_graph(spark, sf_dir), K)


def contig_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``read_id, seq``: each contig of ACGT letters two or three times, and twice with another base in its middle."""
    c = table(spark, sf_dir, "contigs").select("contig_id", "seq").distinct().where(B.is_acgt("seq"))
    middle = F.floor(F.length("seq") / 2).cast("int")
    variant = F.concat(F.substring("seq", F.lit(1), middle), F.translate(F.substring("seq", middle + 1, F.lit(1)), "ACGT", "CATG"), F.substring("seq", middle + 2, F.length("seq")))
    copies = F.explode(F.sequence(F.lit(0), F.lit(3) + (F.col("contig_id") % 2).cast("int")))
    return c.select("contig_id", "seq", variant.alias("other"), copies.alias("i")).select((F.col("contig_id") * 5 + F.col("i")).alias("read_id"), F.when(F.col("i") < 2, F.col("other")).otherwise(F.col("seq")).alias("seq"))


def bubbles_of_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bubbles of the graph of all contigs and their variants; every other contig is as covered as its variant."""
    nodes = cut(kmers.solid_graph(contig_variants(spark, sf_dir), K, MIN_COUNT))
    return graph.bubbles(nodes, cut(kmers.prune_edges(nodes, K)), K)


def reference_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.upper(B.strip("kmer"))
    rows = table(spark, sf_dir, "ref_kmers").select(B.clean_name("ref").alias("ref"), text.alias("t")).where((F.length("t") == 31) & B.is_acgt("t"))
    return kmers.dice(rows.select("ref", B.canonical("t").alias("kmer")), "ref", "kmer").withColumnsRenamed({"a": "ref1", "b": "ref2"})


QUERIES = {f.__name__: f for f in (read_clean, read_split, read_normalize, read_normalize_pairs, read_merge, base_functions, name_tokens, kmer_counts, kmer_spectrum, kmer_gap_fill, graph_nodes, graph_edges, graph_stats, graph_check, graph_check_unpruned, read_hits, unitigs, unitigs_trimmed, unitigs_thick, bubbles, bubbles_of_variants, reference_dice)}

LATEST = "lr AS (SELECT * FROM short_reads QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY loaded_at DESC NULLS LAST) = 1)"


def cleaned(trim: int) -> str:
    return f"""{LATEST},
seg AS (SELECT *, CASE WHEN seq IS NOT NULL THEN list_reduce(list_prepend('', string_split(substr(seq, 1, greatest(length(seq) - {trim}, 0)), 'N')), lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END) END AS c FROM lr),
cr AS (SELECT read_id, run_id, pair_id, mate, CASE WHEN regexp_full_match(c, '[ACGT]*') THEN c ELSE '' END AS seq, coalesce(regexp_full_match(c, '[ACGT]*'), false) AS active FROM seg)"""


def typed(sql: str, **kinds: str) -> str:
    """The query with the named columns (separated by blanks) cast to a type."""
    casts = ", ".join(f'CAST("{c}" AS {kind}) AS "{c}"' for kind, names in kinds.items() for c in names.split())
    return f"SELECT * REPLACE ({casts}) FROM ({sql})"


def rc(x: str) -> str:
    return f"translate(reverse({x}), 'ACGT', 'TGCA')"


def canon(x: str) -> str:
    return f"CASE WHEN translate({x}, 'ACGT', 'TGCA') < reverse({x}) THEN {rc(x)} ELSE {x} END"


def windows_sql(k: int) -> str:
    return f"""w0 AS (SELECT read_id, length(seq) AS len, seq, unnest(range(1, length(seq) - {k} + 2)) AS pos FROM cr WHERE active AND length(seq) >= {k}),
w1 AS (SELECT read_id, len, pos, substr(seq, pos, {k}) AS km, instr('ACGT', substr(seq, pos + {k}, 1)) AS a0, instr('TGCA', substr(seq, pos - 1, 1)) AS b0 FROM w0),
w2 AS (SELECT *, CASE WHEN pos + {k} <= len THEN 1 << (a0 - 1)::INT ELSE 0 END AS a, CASE WHEN pos > 1 THEN 1 << (b0 - 1)::INT ELSE 0 END AS b, translate(km, 'ACGT', 'TGCA') < reverse(km) AS rev FROM w1),
win AS (SELECT read_id, len, pos, CASE WHEN rev THEN {rc('km')} ELSE km END AS kmer, CASE WHEN rev THEN b ELSE a END AS nexts, CASE WHEN rev THEN a ELSE b END AS prevs FROM w2)"""


BASE = f"WITH RECURSIVE {cleaned(0)},\n{windows_sql(K)},\nsolid AS (SELECT kmer FROM win GROUP BY kmer HAVING count(*) >= {MIN_COUNT})"
FILL = f"""lw AS (SELECT * FROM win WHERE len > {K}),
mk AS (SELECT lw.*, solid.kmer IS NOT NULL AS hit FROM lw LEFT JOIN solid USING (kmer)),
sp AS (SELECT *, count(*) FILTER (WHERE hit) OVER (PARTITION BY read_id) AS hits, min(pos) FILTER (WHERE hit) OVER (PARTITION BY read_id) AS f, max(pos) FILTER (WHERE hit) OVER (PARTITION BY read_id) AS l FROM mk),
fill AS (SELECT DISTINCT kmer FROM sp WHERE NOT hit AND hits > greatest(len - {2 * K - 1}, (len - {K - 1}) // 2) AND pos > f AND pos < l)"""
NODES = f"""{FILL},
vx AS (SELECT kmer FROM solid UNION ALL SELECT kmer FROM fill),
fd AS (SELECT kmer, least(count(*), 65535) AS cnt, bit_or(prevs) AS in_mask, bit_or(nexts) AS out_mask FROM lw WHERE kmer IN (SELECT kmer FROM vx) GROUP BY kmer),
nodes AS MATERIALIZED (SELECT kmer, coalesce(cnt, 0) AS cnt, coalesce(in_mask, 0) AS in_mask, coalesce(out_mask, 0) AS out_mask FROM vx LEFT JOIN fd USING (kmer))"""
EDGES = f"""bb AS (SELECT unnest(range(0, 4))::INT AS x),
oe AS (SELECT kmer AS u, substr(kmer, 2) || substr('ACGT', x + 1, 1) AS v FROM nodes, bb WHERE (out_mask >> x) & 1 = 1
       UNION SELECT {rc('kmer')}, substr({rc('kmer')}, 2) || substr('ACGT', x + 1, 1) FROM nodes, bb WHERE (in_mask >> x) & 1 = 1),
ke AS MATERIALIZED (SELECT u, v FROM oe WHERE {canon('v')} IN (SELECT kmer FROM nodes)),
edges AS MATERIALIZED (SELECT u, v FROM ke UNION SELECT {rc('v')}, {rc('u')} FROM ke)"""


def unitig_sql(nodes: str, edges: str, p: str = "") -> str:
    """CTEs up to ``{p}contigs``; circles are cut before their smallest canonical k-mer (after it on the other strand)."""
    return f"""{p}vt AS (SELECT kmer AS u, cnt FROM {nodes} UNION SELECT {rc('kmer')}, cnt FROM {nodes}),
{p}st AS (SELECT u, any_value(v) AS v FROM {edges} GROUP BY u HAVING count(*) = 1),
{p}in1 AS (SELECT v FROM {edges} GROUP BY v HAVING count(*) = 1),
{p}sc AS (SELECT u, v FROM {p}st WHERE v IN (SELECT v FROM {p}in1) AND u <> {rc('u')} AND v <> {rc('v')} AND v <> {rc('u')}),
{p}hd AS (SELECT u FROM {p}vt WHERE u NOT IN (SELECT v FROM {p}sc)),
{p}wk AS (SELECT u AS head, u, 0 AS pos FROM {p}hd UNION ALL SELECT head, v, pos + 1 FROM {p}wk JOIN {p}sc USING (u)),
{p}ci AS (SELECT u FROM {p}vt WHERE u NOT IN (SELECT u FROM {p}wk)),
{p}rg AS (SELECT u AS s, u, 0 AS n FROM {p}ci UNION ALL SELECT s, v, n + 1 FROM {p}rg JOIN {p}sc USING (u) WHERE n = 0 OR u <> s),
{p}lc AS (SELECT s AS u, min({canon('u')}) AS least FROM {p}rg GROUP BY s),
{p}ch AS (SELECT u FROM {p}lc WHERE u = least UNION SELECT v FROM {p}sc JOIN {p}lc USING (u) WHERE u = {rc('least')}),
{p}wc AS (SELECT u AS head, u, 0 AS pos FROM {p}ch UNION ALL SELECT head, v, pos + 1 FROM {p}wc JOIN {p}sc USING (u) WHERE v NOT IN (SELECT u FROM {p}ch)),
{p}al AS (SELECT * FROM {p}wk UNION ALL SELECT * FROM {p}wc),
{p}pc AS (SELECT head, substr(head, 1, {K - 1}) || string_agg(right(u, 1), '' ORDER BY pos) AS seq, sum(cnt) AS sum_cov, arg_max(u, pos) AS lastu FROM {p}al JOIN {p}vt USING (u) GROUP BY head),
{p}tg AS (SELECT *, lastu NOT IN (SELECT u FROM {edges}) OR head NOT IN (SELECT v FROM {edges}) AS is_tangle FROM {p}pc),
{p}contigs AS (SELECT DISTINCT least(seq, {rc('seq')}) AS seq, length(seq) AS len, CAST(sum_cov AS BIGINT) AS sum_cov, is_tangle FROM {p}tg)"""


def without_sql(p: str, nodes: str, edges: str, gone: str) -> str:
    """CTEs ``{p}nodes`` and ``{p}edges`` without the k-mers of the contigs that ``gone`` selects."""
    return f"""{p}gk AS (SELECT DISTINCT {canon('km')} AS kmer FROM (SELECT substr(seq, i, {K}) AS km FROM (SELECT seq, unnest(range(1, length(seq) - {K} + 2)) AS i FROM ({gone})))),
{p}nodes AS (SELECT * FROM {nodes} WHERE kmer NOT IN (SELECT kmer FROM {p}gk)),
{p}edges AS (SELECT * FROM {edges} WHERE {canon('u')} NOT IN (SELECT kmer FROM {p}gk) AND {canon('v')} NOT IN (SELECT kmer FROM {p}gk))"""


def trimmed_sql() -> str:
    parts, nodes, edges = [], "nodes", "edges"
    for i, shift in enumerate((3, 2, 1, 0)):
        parts += [unitig_sql(nodes, edges, f"t{i}_"), without_sql(f"r{i}_", nodes, edges, f"SELECT seq FROM t{i}_contigs WHERE is_tangle AND len < {K + (75 >> shift) - 1}")]
        nodes, edges = f"r{i}_nodes", f"r{i}_edges"
    return ",\n".join([*parts, unitig_sql(nodes, edges, "z_")])


GRAPH = f"{BASE},\n{NODES},\n{EDGES}"
ORACLE = {
    "read_clean": f"WITH {cleaned(3)} SELECT read_id, seq, active FROM cr",
    "read_split": f"""WITH {LATEST}, t AS (SELECT read_id, regexp_replace(substr(coalesce(seq, ''), 1, greatest(length(coalesce(seq, '')) - 2, 0)), '[^ACGT]+$', '') AS s FROM lr)
SELECT read_id, CASE WHEN regexp_full_match(s, '[ACGT]*') THEN s ELSE '' END AS seq, CASE WHEN NOT regexp_full_match(s, '[ACGT]*') THEN 'bad' WHEN length(s) > 80 THEN 'long' ELSE 'short' END AS kind FROM t""",
    "read_normalize": f"WITH {LATEST} SELECT read_id, left(seq, 90) AS seq FROM lr WHERE length(seq) >= 90",
    "read_normalize_pairs": f"WITH {LATEST}, n AS (SELECT *, count(*) FILTER (WHERE length(seq) >= 85) OVER (PARTITION BY pair_id) AS n FROM lr WHERE pair_id IS NOT NULL) SELECT read_id, pair_id, left(seq, 85) AS seq FROM n WHERE n >= 2 AND length(seq) >= 85",
    "read_merge": f"""WITH {LATEST}, s AS (SELECT mate, name, seq, row_number() OVER (PARTITION BY mate ORDER BY read_id) - 1 AS idx FROM lr WHERE seq IS NOT NULL AND mate IN (1, 2)),
m AS (SELECT min(n) AS n FROM (SELECT count(*) FILTER (WHERE mate = 1) AS n FROM s UNION ALL SELECT count(*) FILTER (WHERE mate = 2) FROM s))
SELECT idx, CAST(mate - 1 AS INT) AS src, name, seq FROM s, m WHERE idx < n""",
    "base_functions": f"""SELECT contig_id, {rc('seq')} AS rc, translate(seq, 'ACGTN', '01234') AS digits, seq AS letters, left(seq, greatest(length(seq) - 7, 0)) AS trimmed, regexp_replace(seq || 'NNxN', '[^ACGT]+$', '') AS untailed,
 substr(seq, 10, 31) AS kmer, {canon('substr(seq, 10, 31)')} AS canon, {canon('substr(seq, 10, 31)')} AS decoded, left(seq, 2) = {rc('left(seq, 2)')} AS palindrome, regexp_full_match(seq, '[ACGT]*') AS acgt,
 left(seq, 31) AS begin_kmer, right(seq, 31) AS end_kmer, CASE WHEN len >= 31 THEN round(sum_cov / (len - 30), 6) END AS coverage, left(seq, 40) || substr(substr(seq, 11, 60), 31) AS merged,
 seq || repeat('N', greatest(contig_id % 7 - 3, 0)) || CASE WHEN contig_id % 7 < 3 THEN substr('ACGTACGT', 4 - contig_id % 7) ELSE 'ACGTACGT' END AS gapped,
 CAST(bit_count(contig_id % 16) AS INT) AS degree, least(sum_cov, 65535) AS capped, 'contig' || contig_id || '_' || coalesce(sum_cov, 0) AS label, '>contig' || contig_id || '_' || coalesce(sum_cov, 0) || chr(10) || seq AS fasta, repeat('a', length(seq)) AS quality
FROM (SELECT DISTINCT contig_id, seq, len, sum_cov FROM contigs)""",
    "name_tokens": "SELECT name, string_split_regex(trim(name), '\\s+')[1] AS token, TRY_CAST(nullif(regexp_extract(name, '([0-9]*)$', 1), '') AS BIGINT) AS sum_cov, TRY_CAST(nullif(regexp_extract(name, '_([0-9]+)', 1), '') AS BIGINT) AS label FROM (SELECT DISTINCT name FROM contigs)",
    "kmer_counts": f"{BASE} SELECT kmer, least(count(*), 65535) AS cnt, bit_or(prevs) AS in_mask, bit_or(nexts) AS out_mask FROM win GROUP BY kmer",
    "kmer_spectrum": f"{BASE} SELECT cnt, count(*) AS kmers FROM (SELECT least(count(*), 65535) AS cnt FROM win GROUP BY kmer) WHERE cnt >= {MIN_COUNT} GROUP BY cnt",
    "kmer_gap_fill": f"{BASE},\n{FILL} SELECT kmer FROM fill",
    "graph_nodes": f"{BASE},\n{NODES} SELECT kmer, cnt, in_mask, out_mask FROM nodes",
    "graph_edges": f"{GRAPH} SELECT u, v FROM edges",
    "graph_stats": f"{BASE},\n{NODES} SELECT count(*) AS kmers, CAST(sum(bit_count(in_mask) + bit_count(out_mask)) // 2 AS BIGINT) AS edges, round(avg(cnt), 6) AS mean_cnt, list_sort(list(cnt))[count(*) // 2 + 1] AS median_cnt FROM nodes",
    "graph_check": f"{GRAPH} SELECT u, v, 'target' AS why FROM edges WHERE {canon('v')} NOT IN (SELECT kmer FROM nodes)",
    "read_hits": f"{BASE} SELECT read_id, count(*) AS windows, count(*) FILTER (WHERE kmer IN (SELECT kmer FROM solid)) AS hits, count(*) = count(*) FILTER (WHERE kmer IN (SELECT kmer FROM solid)) AS valid FROM win GROUP BY read_id",
    "unitigs": f"{GRAPH},\n{unitig_sql('nodes', 'edges')} SELECT seq, len, sum_cov, is_tangle FROM contigs",
    "unitigs_trimmed": f"{GRAPH},\n{trimmed_sql()} SELECT seq, len, sum_cov, is_tangle FROM z_contigs",
    "unitigs_thick": f"{GRAPH},\n{unitig_sql('nodes', 'edges', 'a_')},\n{without_sql('r_', 'nodes', 'edges', f'SELECT seq FROM a_contigs WHERE sum_cov < 4.0 * (len - {K - 1})')},\n{unitig_sql('r_nodes', 'r_edges', 'z_')} SELECT seq, len, sum_cov, is_tangle FROM z_contigs",
    "bubbles": f"""{GRAPH},\n{unitig_sql('nodes', 'edges', 'a_')},
bs AS MATERIALIZED (SELECT seq, sum_cov AS cov FROM a_contigs WHERE len = {2 * K - 1} UNION ALL SELECT {rc('seq')}, sum_cov FROM a_contigs WHERE len = {2 * K - 1}),
fl AS MATERIALIZED (SELECT seq, cov, left(seq, {K}) AS f, right(seq, {K}) AS l FROM bs),
p1 AS MATERIALIZED (SELECT seq, cov, u AS b, l FROM fl JOIN edges ON v = f),
pa AS MATERIALIZED (SELECT seq, cov, b, v AS e FROM p1 JOIN edges ON u = l),
dg AS MATERIALIZED (SELECT u, count(*) AS outs FROM edges GROUP BY u), dn AS MATERIALIZED (SELECT v, count(*) AS ins FROM edges GROUP BY v),
ok AS MATERIALIZED (SELECT seq, cov, b, e FROM pa WHERE b <> e AND b IN (SELECT u FROM dg WHERE outs = 2) AND b IN (SELECT v FROM dn WHERE ins = 1) AND e IN (SELECT u FROM dg WHERE outs = 1) AND e IN (SELECT v FROM dn WHERE ins = 2))
SELECT DISTINCT least(p.seq, {rc('p.seq')}) AS seq, least(q.seq, {rc('q.seq')}) AS rival FROM ok p JOIN ok q ON p.b = q.b AND p.e = q.e AND p.seq <> q.seq
WHERE q.cov < p.cov OR (q.cov = p.cov AND least(q.seq, {rc('q.seq')}) < least(p.seq, {rc('p.seq')}))""",
    "reference_dice": r"""
WITH t AS (SELECT ltrim(rtrim(ref, chr(9) || chr(10) || chr(13) || ' '), chr(9) || chr(10) || chr(13) || ' >') AS ref, upper(trim(kmer, chr(9) || chr(10) || chr(13) || ' ')) AS k FROM ref_kmers WHERE ref IS NOT NULL),
m AS (SELECT DISTINCT ref, least(k, translate(reverse(k), 'ACGT', 'TGCA')) AS k FROM t WHERE regexp_full_match(k, '[ACGT]{31}')),
n AS (SELECT ref, count(*) AS n FROM m GROUP BY ref),
p AS (SELECT a.ref AS ref1, b.ref AS ref2, count(*) AS shared FROM m a JOIN m b ON a.k = b.k AND a.ref < b.ref GROUP BY a.ref, b.ref)
SELECT ref1, ref2, shared, round(200 * shared / (a.n + b.n), 6) AS dice FROM p JOIN n a ON a.ref = ref1 JOIN n b ON b.ref = ref2""",
}
ORACLE["graph_check_unpruned"] = f"""{GRAPH} SELECT u, v, 'target' AS why FROM oe WHERE {canon('v')} NOT IN (SELECT kmer FROM nodes)
UNION ALL SELECT u, v, 'mirror' FROM oe a WHERE NOT EXISTS (SELECT 1 FROM oe b WHERE b.u = {rc('a.v')} AND b.v = {rc('a.u')})"""
VARIANTS = """cv AS (SELECT DISTINCT contig_id, seq FROM contigs WHERE regexp_full_match(seq, '[ACGT]*')),
cr AS (SELECT contig_id * 5 + i AS read_id, true AS active, CASE WHEN i < 2 THEN left(seq, length(seq) // 2) || translate(substr(seq, length(seq) // 2 + 1, 1), 'ACGT', 'CATG') || substr(seq, length(seq) // 2 + 2) ELSE seq END AS seq
       FROM (SELECT *, unnest(range(0, 4 + contig_id % 2)) AS i FROM cv))"""
ORACLE["bubbles_of_variants"] = ORACLE["bubbles"].replace(cleaned(0), VARIANTS)
ORACLE |= {name: typed(ORACLE[name], INTEGER="len") for name in ("unitigs", "unitigs_trimmed", "unitigs_thick")}
