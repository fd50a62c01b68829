"""Text formats, the FASTQ source at span ends, and streams."""

import random

from conftest import rows

from strandweave.operators import cluster
from strandweave.sources import fastq, text
from strandweave.streaming import kmers as stream


def test_fasta_of_several_lines_and_line_ends(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one  x \nACGT\nAC\n\n>two\r\nGG\r\n>empty\n>contig3_77\nA\n")
    assert rows(text.read_fasta(spark, str(tmp_path))) == [("contig3_77", "A"), ("empty", ""), ("one  x", "ACGTAC"), ("two", "GG")]
    assert [r.sum_cov for r in text.read_contigs(spark, str(tmp_path)).where("name = 'contig3_77'").collect()] == [77]


def test_fastq_spans_find_their_records(spark, tmp_path):
    want = [(f"r{i}", "ACGTN"[: 1 + i % 5] * (1 + i % 7), "") for i in range(400)]
    want = [(n, s, ("@" + "I" * (len(s) - 1)) if i % 3 else "+" * len(s)) for i, (n, s, _) in enumerate(want)]
    (tmp_path / "x.fq").write_text("".join(f"@{n}\n{s}\n+{n if i % 2 else ''}\n{q}\n" for i, (n, s, q) in enumerate(want)))
    fastq.register(spark)
    for split in (37, 501, 1 << 20):
        assert rows(spark.read.format("fastq").option("split", split).load(str(tmp_path))) == sorted(want)


def test_delta_annotations_and_taxa(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.delta").write_text("/a/ref.fa /a/q.fa\nNUCMER\n>chr1 contig1_5 1000 200\n1 100 5 104 3 3 0\n-7\n12\n0\n300 350 60 10 1 1 0\n0\n>chr2 contig2_9 50 60\n5 9 1 5 0 0 0\n0\n")
    got = rows(text.read_delta(spark, str(tmp_path / "d")))
    assert got == [("chr1", "contig1_5", 1000, 200, 1, 100, 5, 104, 3), ("chr1", "contig1_5", 1000, 200, 300, 350, 60, 10, 1), ("chr2", "contig2_9", 50, 60, 5, 9, 1, 5, 0)]
    (tmp_path / "g").mkdir()
    (tmp_path / "g/a.gff").write_text("##gff\n#x\nseq\tsrc\tregion\tdb_xref=taxon:511145;genome=chromosome\nplasmid\n")
    (tmp_path / "g/b.gff").write_text("#x\nseq\tregion\ttaxon:99;Plasmid\n")
    assert sorted((r.taxon_id, r.is_plasmid) for r in text.read_annotations(spark, str(tmp_path / "g")).collect()) == [(99, True), (511145, False)]
    (tmp_path / "n").mkdir()
    (tmp_path / "n/nodes").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tspecies\t|\n")
    assert rows(text.read_taxa(spark, str(tmp_path / "n"))) == [(1, 1, "no rank"), (2, 1, "species")]


def test_stream_counts_like_a_table(spark, tmp_path):
    data = [(i, "ACGTACGTTAGC"[i % 4 :]) for i in range(40)]
    spark.createDataFrame(data, "read_id bigint, seq string").repartition(5).write.parquet(str(tmp_path / "in"))
    reads = spark.readStream.schema("read_id bigint, seq string").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    stream.counted_batches(reads, 5, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = stream.totals(spark.read.parquet(str(tmp_path / "out")))
    assert rows(got.select("kmer", "cnt")) == rows(stream.kmer_counts(spark.createDataFrame(data, "read_id bigint, seq string"), 5))


def test_stream_drops_resent_reads(spark, tmp_path):
    data = [(i % 30, "ACGTACGTTAGC", f"2024-01-{1 + i // 30:02d} 00:00:00") for i in range(60)]
    df = spark.createDataFrame(data, "read_id bigint, seq string, t string").selectExpr("read_id", "seq", "CAST(t AS timestamp) AS loaded_at")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    reads = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.counted_batches(stream.once(reads, "30 days"), 5, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = stream.totals(spark.read.parquet(str(tmp_path / "out")))
    assert rows(got.select("kmer", "cnt")) == rows(stream.kmer_counts(df.limit(30), 5))


def test_greedy_match_and_accuracy(spark):
    rng = random.Random(3)
    cells = [(c, t, rng.randrange(1, 9)) for c in range(12) for t in range(10) if rng.random() < 0.5] + [(None, 1, 99), (3, None, 99)]
    left, right, want = set(), set(), []
    for c, t, n in sorted((x for x in cells if None not in x), key=lambda x: (-x[2], x[0], x[1])):
        if c not in left and t not in right:
            want.append((c, t, n))
            left.add(c)
            right.add(t)
    counts = spark.createDataFrame(cells, "centre bigint, taxon int, n bigint")
    matched = cluster.greedy_match(counts, "centre", "taxon")
    assert rows(matched) == sorted(want)
    whole = counts.where("centre IS NOT NULL AND taxon IS NOT NULL")
    total, correct = sum(n for c, t, n in cells if None not in (c, t)), sum(n for *_, n in want)
    assert [tuple(r) for r in cluster.accuracy(whole, matched).collect()] == [(correct, total, round(100 * correct / total, 6))]
    assert cluster.greedy_match(counts.limit(0), "centre", "taxon").collect() == []


def test_taxonomy_text(spark, tmp_path):
    refs = spark.createDataFrame([("a", [0.25, 0.75]), ("b", [1.0, 0.0]), (None, [1.0]), ("c", None)], "ref string, vals array<double>")
    groups = spark.createDataFrame([("genus", 5, "a"), ("genus", 5, "b"), ("phylum", None, "a")], "rank string, taxon_id bigint, ref string")
    text.write_taxonomy(refs, groups, str(tmp_path / "db"))
    back, taxa = text.read_taxonomy(spark, str(tmp_path / "db"))
    assert rows(back.select("ref", "vals")) == [("a", [0.25, 0.75]), ("b", [1.0, 0.0])]
    assert rows(taxa) == [("genus", 5, "a"), ("genus", 5, "b")]
