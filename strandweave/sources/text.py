"""Sequence and alignment text formats as DataFrames. Reading and writing stay in Spark's text source, so large files are
split; only FASTQ, whose records have no unambiguous separator, has a reader of its own (``fastq.py``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``name, seq``: headers without ``>``, bodies of any number of lines joined, white space dropped, the rest of a header
    stripped of trailing blanks. A record without a body has an empty sequence; blank records are left out."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(record, r"^([^\n]*)", 1)
    body = F.substring(record, F.length(head) + 1, F.length(record))
    return raw.where(F.length(F.trim("value")) > 0).select(F.regexp_replace(head, r"\s+$", "").alias("name"), F.regexp_replace(body, r"\s+", "").alias("seq"))


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """``name, seq, len, sum_cov``: FASTA with the coverage as the trailing digits of the header (null without)."""
    digits = F.expr("try_cast(nullif(regexp_extract(name, '([0-9]*)$', 1), '') AS bigint)")
    return read_fasta(spark, path).select("name", "seq", F.length("seq").alias("len"), digits.alias("sum_cov"))


def fasta_text(name: Column | str, seq: Column | str) -> Column:
    return F.concat(F.lit(">"), name if isinstance(name, Column) else F.col(name), F.lit("\n"), seq if isinstance(seq, Column) else F.col(seq))


def write_fasta(df: DataFrame, path: str, *, name: Column | str = "name", seq: Column | str = "seq") -> None:
    """One line a sequence. Rows with a null name or sequence are left out."""
    df.select(fasta_text(name, seq).alias("value")).where("value IS NOT NULL").write.text(path)


def write_fastq(df: DataFrame, path: str, *, name: str = "name", seq: str = "seq", quality: str | None = None) -> None:
    """FASTQ; without a quality column, or where it is null, the constant quality ``a``."""
    constant = F.repeat(F.lit("a"), F.length(seq))
    q = F.coalesce(F.col(quality), constant) if quality else constant
    df.select(F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), q).alias("value")).where("value IS NOT NULL").write.text(path)


def contig_name(number: Column | str, sum_cov: Column | str) -> Column:
    return F.concat(F.lit("contig"), number, F.lit("_"), F.coalesce(sum_cov, F.lit(0)))


def write_clusters(df: DataFrame, path: str, cluster: str) -> None:
    """A folder of FASTA files for each cluster."""
    df.select(cluster, fasta_text("name", "seq").alias("value")).where("value IS NOT NULL").write.partitionBy(cluster).text(path)


def tokens(df: DataFrame, pattern: str = r"\s+") -> DataFrame:
    return df.select(F.split(F.trim("value"), pattern).alias("t"))


def number(i: int) -> Column:
    return F.try_element_at("t", F.lit(i)).try_cast("bigint")


def word(i: int) -> Column:
    return F.try_element_at("t", F.lit(i))


def read_interval_alignments(spark: SparkSession, path: str) -> DataFrame:
    """``query, ref, from, to``: lines of eight or more tokens, the 2nd and 6th are the names, the 7th and 8th numbers."""
    rows = tokens(spark.read.text(path).where(~F.col("value").startswith("--")))
    return rows.select(word(2).alias("query"), word(6).alias("ref"), number(7).alias("from"), number(8).alias("to")).where("`from` IS NOT NULL AND `to` IS NOT NULL")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Read-to-contig hits of 17 fields, header lines dropped: positions are half-open and 0-based."""
    rows = tokens(spark.read.text(path)).where(number(1).isNotNull() & (F.size("t") >= 17))
    return rows.select(number(1).alias("match"), word(9).alias("strand"), word(10).alias("read"), number(12).alias("r_from"), number(13).alias("r_to"), word(14).alias("contig"), number(15).alias("c_len"), number(16).alias("c_from"), number(17).alias("c_to"))


def read_delta(spark: SparkSession, path: str) -> DataFrame:
    """``ref, contig, ref_len, contig_len, ref_from, ref_to, contig_from, contig_to, errors``: of each ``>`` record the lines of five
    or more numbers; the offsets between them are dropped."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    parts = raw.select(F.split(F.regexp_replace("value", "^>", ""), r"\r?\n").alias("lines"))
    headed = parts.select(F.split(F.trim(F.col("lines")[0]), r"\s+").alias("h"), F.explode(F.slice("lines", 2, F.size("lines"))).alias("value"))
    rows = headed.where(F.size("h") >= 4).select("h", F.split(F.trim("value"), r"\s+").alias("t")).where((F.size("t") >= 5) & number(1).isNotNull())
    head = lambda i: F.try_element_at("h", F.lit(i))
    return rows.select(head(1).alias("ref"), head(2).alias("contig"), head(3).try_cast("bigint").alias("ref_len"), head(4).try_cast("bigint").alias("contig_len"), *(number(i + 1).alias(c) for i, c in enumerate(("ref_from", "ref_to", "contig_from", "contig_to", "errors"))))


def delta_text(df: DataFrame) -> DataFrame:
    """One record an alignment."""
    line = F.concat_ws(" ", *(F.col(c).cast("string") for c in ("ref_from", "ref_to", "contig_from", "contig_to", "errors")))
    return df.select(F.concat(F.lit(">"), F.concat_ws(" ", "ref", "contig", F.col("ref_len").cast("string"), F.col("contig_len").cast("string")), F.lit("\n"), line, F.lit("\n0")).alias("value"))


def read_taxa(spark: SparkSession, path: str) -> DataFrame:
    """``id, parent_id, rank`` of lines ``id | parent | rank | ...``."""
    rows = tokens(spark.read.text(path), r"\s*\|\s*")
    return rows.select(number(1).alias("id"), number(2).alias("parent_id"), word(3).alias("rank")).where("id IS NOT NULL")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """``path, taxon_id, is_plasmid`` of annotation files: taken from the first line that is no comment."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_extract("value", r"(?m)^([^#\n][^\n]*)", 1).alias("line"))
    return whole.select("path", F.expr("try_cast(nullif(regexp_extract(line, 'taxon:([0-9]+)', 1), '') AS bigint)").alias("taxon_id"), F.contains(F.lower("line"), F.lit("plasmid")).alias("is_plasmid"))


def read_placements(spark: SparkSession, path: str) -> DataFrame:
    """``id, offset, length`` of lines of three numbers; other lines are headers."""
    rows = tokens(spark.read.text(path)).where(F.size("t") == 3)
    return rows.select(number(1).alias("id"), number(2).alias("offset"), number(3).alias("length")).where("id IS NOT NULL AND offset IS NOT NULL AND length IS NOT NULL")


def read_merge_log(spark: SparkSession, path: str) -> DataFrame:
    """``c1, c2, new, dist`` of the lines that are numbers; the names before them are dropped."""
    rows = tokens(spark.read.text(path), r"[,\s]+").where(F.size("t") >= 4)
    return rows.select(number(1).alias("c1"), number(2).alias("c2"), number(3).alias("new"), word(4).try_cast("double").alias("dist")).where("c1 IS NOT NULL AND c2 IS NOT NULL AND new IS NOT NULL")


def write_taxonomy(refs: DataFrame, groups: DataFrame, path: str) -> None:
    """The reference database as text: ``references`` has a name and its numbers, six places each, a line (``ref, vals``);
    ``groups`` a rank, a taxon and one of its references (``rank, taxon_id, ref``). So neither a taxon's references nor all of
    them are ever one record."""
    numbers = F.array_join(F.transform("vals", lambda v: F.format_string("%.6f", v)), " ")
    refs.select(F.concat_ws(" ", "ref", numbers).alias("value")).where("ref IS NOT NULL AND vals IS NOT NULL").write.text(f"{path}/references")
    groups.where("rank IS NOT NULL AND taxon_id IS NOT NULL AND ref IS NOT NULL").select(F.concat_ws(" ", "rank", "taxon_id", "ref").alias("value")).write.text(f"{path}/groups")


def read_taxonomy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``ref, vals`` and ``rank, taxon_id, ref`` of a reference database."""
    rows = tokens(spark.read.text(f"{path}/references")).where(F.size("t") > 1)
    refs = rows.select(word(1).alias("ref"), F.transform(F.slice("t", F.lit(2), F.size("t") - 1), lambda x: x.try_cast("double")).alias("vals"))
    groups = tokens(spark.read.text(f"{path}/groups")).where(F.size("t") >= 3)
    return refs, groups.select(word(1).alias("rank"), number(2).alias("taxon_id"), word(3).alias("ref"))
