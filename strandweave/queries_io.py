"""Registered queries of text formats, paths and streaming, and the same in SQL. The round trips write a table in
a format to the shared folder and read it again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.bases import clean_name
from .functions import paths
from .operators import cluster
from .operators.depth import read_number
from .plans.session import shared_dir, table
from .queries_analysis import hits
from .queries_graph import LATEST, canon, latest_reads, rc, typed
from .sources import fastq, text
from .streaming import kmers as stream


def folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/io-{uuid.uuid4().hex}"


def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text.write_fasta(latest_reads(spark, sf_dir), path := folder(spark))
    return text.read_fasta(spark, path)


def fasta_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fasta_round_trip(spark, sf_dir).agg(F.count(F.lit(1)).alias("records"))


def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of 100,000 bytes, so that records lie across their ends."""
    text.write_fastq(latest_reads(spark, sf_dir).where("length(seq) > 0"), path := folder(spark), quality="quality")
    fastq.register(spark)
    return spark.read.format("fastq").option("split", 100_000).load(path)


def fastq_to_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    text.write_fasta(fastq_round_trip(spark, sf_dir), path := folder(spark))
    return text.read_fasta(spark, path)


def contig_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "contigs").distinct()
    text.write_fasta(rows, path := folder(spark), name=text.contig_name("contig_id", "sum_cov"))
    return text.read_contigs(spark, path)


def delta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir).where("errors IS NOT NULL AND contig IS NOT NULL AND ref <> ''")
    text.delta_text(rows).write.text(path := folder(spark))
    return text.read_delta(spark, path)


def placement_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir).select(F.concat_ws(" ", "aln_id", F.least("ref_from", "ref_to"), "contig_len").alias("value"))
    rows.write.text(path := folder(spark))
    return text.read_placements(spark, path)


def taxa_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.concat_ws("\t|\t", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), "c_mktsegment").alias("value"))
    rows.write.text(path := folder(spark))
    return text.read_taxa(spark, path)


def interval_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir).where("contig IS NOT NULL AND ref <> ''").select(F.concat_ws(" ", F.lit("v"), "contig", F.lit("0 1 +"), "ref", "ref_from", "ref_to", F.lit("+ 9")).alias("value"))
    rows.write.text(path := folder(spark))
    return text.read_interval_alignments(spark, path)


def merge_log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.concat_ws(", ", "n_nationkey", "n_regionkey", F.col("n_nationkey") + 100, F.format_number(F.col("n_nationkey") / 4, 2)).alias("value"))
    names = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("value"))
    names.unionByName(rows).write.text(path := folder(spark))
    return text.read_merge_log(spark, path)


def hit_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments as lines of 17 fields under header lines."""
    f = lambda c: F.col(c).cast("string")
    rows = hits(spark, sf_dir).where("contig IS NOT NULL AND ref <> ''")
    line = F.concat_ws("\t", F.abs(F.col("contig_to") - F.col("contig_from")).cast("string"), *[F.lit("0")] * 7, F.when(F.col("ref_from") > F.col("ref_to"), "-").otherwise("+"), "contig", F.lit("99"), f("contig_from"), f("contig_to"), "ref", f("ref_len"), f("ref_from"), f("ref_to"))
    head = spark.range(5).select(F.concat(F.lit("header line "), F.col("id").cast("string")).alias("value"))
    head.unionByName(rows.select(line.alias("value"))).write.text(path := folder(spark))
    return text.read_hits(spark, path)


def cluster_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads in a folder of FASTA files for each run, read again with their run."""
    rows = latest_reads(spark, sf_dir).where("seq IS NOT NULL").select("run_id", F.concat(F.col("run_id").cast("string"), F.lit(":"), "name").alias("name"), "seq")
    text.write_clusters(rows, path := folder(spark), "run_id")
    found = text.read_fasta(spark, path + "/*")
    return found.groupBy(F.split("name", ":")[0].cast("bigint").alias("run_id")).agg(F.count(F.lit(1)).alias("reads"), F.sum(F.length("seq")).alias("bases"))


def read_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads needed for a depth of 30 over each reference."""
    refs = table(spark, sf_dir, "delta_alignments").select(clean_name("ref").alias("ref"), "ref_len").where("ref IS NOT NULL").groupBy("ref").agg(F.max("ref_len").alias("ref_len"))
    return refs.select("ref", read_number(F.col("ref_len"), 30.0, 75).alias("reads"))


def annotation_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An annotation file for each run, a plasmid where its largest k is even, and what is read of them."""
    rows = table(spark, sf_dir, "asm_runs").where("run_id IS NOT NULL").groupBy("run_id").agg(F.max("maxk").alias("maxk"))
    kind = F.when(F.col("maxk") % 2 == 0, " Plasmid").otherwise(" chromosome")
    value = F.concat(F.lit("# annotation\nsource taxon:"), F.col("run_id"), kind, F.lit("\nsource taxon:0 plasmid"))
    rows.select("run_id", value.alias("value")).write.partitionBy("run_id").text(path := folder(spark))
    return text.read_annotations(spark, path + "/*").select("taxon_id", "is_plasmid")


def fastq_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fastq_round_trip(spark, sf_dir).agg(F.count(F.lit(1)).alias("records"))


def fasta_to_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    text.write_fastq(fasta_round_trip(spark, sf_dir).where("length(seq) > 0"), path := folder(spark))
    fastq.register(spark)
    return spark.read.format("fastq").option("split", 100_000).load(path)


def taxonomy_text(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """References with their vectors, and the references of each taxon, written as text and read again."""
    seqs = table(spark, sf_dir, "contigs").where("contig_id IS NOT NULL AND seq IS NOT NULL").groupBy("contig_id").agg(F.max("seq").alias("seq"))
    refs = cluster.frequency_vectors(seqs.select(F.concat(F.lit("c"), "contig_id").alias("ref"), "seq"), "ref")
    taxa = seqs.select(F.explode(F.array(F.struct(F.lit("genus").alias("rank"), (F.col("contig_id") % 97).alias("taxon_id")), F.struct(F.lit("phylum").alias("rank"), (F.col("contig_id") % 7).alias("taxon_id")))).alias("t"), F.concat(F.lit("c"), "contig_id").alias("ref"))
    text.write_taxonomy(refs, taxa.select("t.rank", "t.taxon_id", "ref"), path := folder(spark))
    return text.read_taxonomy(spark, path)


def taxonomy_text_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy_text(spark, sf_dir)[1]


def taxonomy_text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and sizes of the vectors read, and that each differs from the one written by rounding only."""
    refs, _ = taxonomy_text(spark, sf_dir)
    return refs.select("ref", F.size("vals").alias("dims"), F.round(F.aggregate("vals", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The algebra of paths, on the oriented contigs of each reference in the order of their alignments' ids."""
    rows = table(spark, sf_dir, "delta_alignments").where("aln_id IS NOT NULL AND ref IS NOT NULL").groupBy("aln_id").agg(F.max(clean_name("ref")).alias("ref")).where("ref <> ''")
    nodes = rows.select("ref", (F.col("aln_id") % 40).alias("part"), (F.col("aln_id") % 23).alias("node"), "aln_id")
    path = nodes.groupBy("ref", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("aln_id", "node"))), lambda s: s["node"]).alias("path"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return path.select("ref", "part", joined(paths.turned("path")).alias("turned"), joined(paths.appended("path", F.col("part"))).alias("appended"), joined(paths.popped("path")).alias("popped"), joined(paths.suffix("path", 2)).alias("suffix"), paths.is_simple("path").alias("simple"), paths.contains("path", paths.suffix("path", 1)).alias("whole"))


def streamed_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the k-mers of all reads, resent ones once, fed to a stream file by file."""
    source = folder(spark)
    table(spark, sf_dir, "short_reads").select("read_id", "seq", "loaded_at").write.parquet(source)
    reads = spark.readStream.schema("read_id bigint, seq string, loaded_at timestamp").option("maxFilesPerTrigger", 4).parquet(source)
    query = stream.counted_batches(stream.once(reads, "3650 days"), 25, path := folder(spark), folder(spark))
    query.awaitTermination()
    return stream.totals(spark.read.schema("kmer string, cnt bigint").parquet(path))


QUERIES = {f.__name__: f for f in (fasta_round_trip, fasta_count, fastq_round_trip, fastq_to_fasta, contig_round_trip, delta_round_trip, placement_round_trip, taxa_round_trip, interval_round_trip, merge_log_round_trip, hit_round_trip, cluster_files, read_numbers, fastq_count, fasta_to_fastq, annotation_round_trip, taxonomy_text_groups, taxonomy_text_vectors, path_functions, streamed_kmers)}

BLANK = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
H = f"""h AS (SELECT * REPLACE (ltrim(rtrim(ref, {BLANK}), {BLANK} || '>') AS ref) FROM delta_alignments WHERE ref IS NOT NULL AND ref_from BETWEEN 1 AND ref_len AND ref_to BETWEEN 1 AND ref_len QUALIFY row_number() OVER (PARTITION BY aln_id ORDER BY loaded_at DESC NULLS LAST) = 1)"""


ORACLE = {
    "fasta_round_trip": f"WITH {LATEST} SELECT name, seq FROM lr WHERE name IS NOT NULL AND seq IS NOT NULL",
    "fasta_count": f"WITH {LATEST} SELECT count(*) AS records FROM lr WHERE name IS NOT NULL AND seq IS NOT NULL",
    "fastq_round_trip": f"WITH {LATEST} SELECT name, seq, coalesce(quality, repeat('a', length(seq))) AS quality FROM lr WHERE name IS NOT NULL AND length(seq) > 0",
    "fastq_to_fasta": f"WITH {LATEST} SELECT name, seq FROM lr WHERE name IS NOT NULL AND length(seq) > 0",
    "contig_round_trip": "SELECT 'contig' || contig_id || '_' || coalesce(sum_cov, 0) AS name, seq, length(seq) AS len, coalesce(sum_cov, 0) AS sum_cov FROM (SELECT DISTINCT * FROM contigs) WHERE seq IS NOT NULL",
    "delta_round_trip": f"WITH {H} SELECT ref, contig, ref_len, contig_len, ref_from, ref_to, contig_from, contig_to, errors FROM h WHERE errors IS NOT NULL AND contig IS NOT NULL AND ref <> ''",
    "placement_round_trip": f"WITH {H} SELECT aln_id AS id, least(ref_from, ref_to) AS offset, contig_len AS length FROM h WHERE contig_len IS NOT NULL",
    "taxa_round_trip": "SELECT c_custkey AS id, c_nationkey AS parent_id, c_mktsegment AS rank FROM customer",
    "interval_round_trip": f"WITH {H} SELECT contig AS query, ref, ref_from AS \"from\", ref_to AS \"to\" FROM h WHERE contig IS NOT NULL AND ref <> ''",
    "merge_log_round_trip": "SELECT CAST(n_nationkey AS BIGINT) AS c1, CAST(n_regionkey AS BIGINT) AS c2, CAST(n_nationkey + 100 AS BIGINT) AS \"new\", round(n_nationkey / 4, 2) AS dist FROM nation",
    "hit_round_trip": f"WITH {H} SELECT abs(contig_to - contig_from) AS match, CASE WHEN ref_from > ref_to THEN '-' ELSE '+' END AS strand, contig AS read, contig_from AS r_from, contig_to AS r_to, ref AS contig, ref_len AS c_len, ref_from AS c_from, ref_to AS c_to FROM h WHERE contig IS NOT NULL AND ref <> '' AND contig_from IS NOT NULL AND contig_to IS NOT NULL",
    "cluster_files": f"WITH {LATEST} SELECT run_id, count(*) AS reads, CAST(sum(length(seq)) AS BIGINT) AS bases FROM lr WHERE seq IS NOT NULL AND name IS NOT NULL GROUP BY run_id",
    "read_numbers": f"SELECT ref, n + n % 2 AS reads FROM (SELECT ltrim(rtrim(ref, {BLANK}), {BLANK} || '>') AS ref, CAST(floor(30.0 * max(ref_len) / 75) AS BIGINT) AS n FROM delta_alignments WHERE ref IS NOT NULL GROUP BY 1)",
    "annotation_round_trip": "SELECT run_id AS taxon_id, coalesce(max(maxk) % 2 = 0, false) AS is_plasmid FROM asm_runs WHERE run_id IS NOT NULL GROUP BY run_id",
    "fastq_count": f"WITH {LATEST} SELECT count(*) AS records FROM lr WHERE name IS NOT NULL AND length(seq) > 0",
    "fasta_to_fastq": f"WITH {LATEST} SELECT name, seq, repeat('a', length(seq)) AS quality FROM lr WHERE name IS NOT NULL AND length(seq) > 0",
    "taxonomy_text_groups": "WITH c AS (SELECT DISTINCT contig_id FROM contigs WHERE contig_id IS NOT NULL AND seq IS NOT NULL) SELECT 'genus' AS rank, contig_id % 97 AS taxon_id, 'c' || contig_id AS ref FROM c UNION ALL SELECT 'phylum', contig_id % 7, 'c' || contig_id FROM c",
    "path_functions": f"""WITH r AS (SELECT aln_id, max(ltrim(rtrim(ref, {BLANK}), {BLANK} || '>')) AS ref FROM delta_alignments WHERE aln_id IS NOT NULL AND ref IS NOT NULL GROUP BY aln_id),
p AS (SELECT ref, aln_id % 40 AS part, list(aln_id % 23 ORDER BY aln_id) AS p FROM r WHERE ref <> '' GROUP BY ref, aln_id % 40)
SELECT ref, part, array_to_string(list_transform(list_reverse(p), lambda x: xor(x, 1)), ' ') AS turned, array_to_string(list_append(p, part), ' ') AS appended, array_to_string(p[1 : len(p) - 1], ' ') AS popped,
 array_to_string(p[3 :], ' ') AS suffix, len(list_distinct(list_transform(p, lambda x: x // 2))) = len(p) AS simple, true AS whole FROM p""",
    "streamed_kmers": f"""WITH {LATEST}, w AS (SELECT substr(seq, p, 25) AS w FROM (SELECT seq, unnest(range(1, length(seq) - 23)) AS p FROM lr WHERE length(seq) >= 25))
SELECT {canon('w')} AS kmer, count(*) AS cnt FROM w WHERE regexp_full_match(w, '[ACGT]*') GROUP BY 1""",
}
NUMBERS = {"delta_round_trip": "ref_len contig_len ref_from ref_to contig_from contig_to errors", "placement_round_trip": "offset length", "taxa_round_trip": "parent_id", "interval_round_trip": "from to", "hit_round_trip": "match r_from r_to c_len c_from c_to"}
ORACLE |= {name: typed(ORACLE[name], BIGINT=columns) for name, columns in NUMBERS.items()}
ORACLE["contig_round_trip"] = typed(ORACLE["contig_round_trip"], INTEGER="len")
