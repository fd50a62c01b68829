"""Base and vector functions against plain Python."""

import random

from conftest import rows
from pyspark.sql import functions as F

from strandweave.functions import bases as B
from strandweave.functions.hits import usable_hits
from strandweave.functions.vectors import rank_distance, rank_vector

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def turned(s):
    return s[::-1].translate(COMPLEMENT)


def canon(s):
    return min(s, turned(s), key=lambda x: x[::-1])


def test_canonical_and_codes(spark):
    rng = random.Random(1)
    kmers = ["".join(rng.choice("ACGT") for _ in range(k)) for k in (1, 2, 15, 31) for _ in range(40)] + ["A" * 31, "T" * 31, "ACGT", "C" * 31]
    df = spark.createDataFrame([(s, len(s)) for s in kmers], "s string, k int")
    for r in df.select("s", B.canonical("s").alias("c"), B.canonical_code("s").alias("n"), B.code("s").alias("own"), B.is_palindrome("s").alias("p")).collect():
        assert r.c == canon(r.s)
        assert r.n == sum("ACGT".index(b) << 2 * i for i, b in enumerate(r.c)) == min(r.own, r.n)
        assert r.p == (r.s == turned(r.s))
    long_ = df.where("k = 31")
    assert all(r[0] == r[1] for r in long_.select(B.canonical("s"), B.decode(B.canonical_code("s"), 31)).collect())


def test_usable_hits_agree_with_columns(spark):
    rng = random.Random(2)
    good = ["".join(rng.choice("ACGT") for _ in range(31)) for _ in range(50)]
    texts = good + [g.lower() for g in good[:5]] + ["  " + g + "\t" for g in good[:5]] + [None, "", "A" * 30, "A" * 32, "N" * 31, good[0][:-1] + "@", good[0][:-1] + "á", " " * 31]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "hit_id bigint, kmer string, code string")
    got = rows(usable_hits(df, columns=("hit_id",)))
    t = F.upper(B.strip("kmer"))
    want = rows(df.select("hit_id", t.alias("t")).where((F.length("t") == 31) & B.is_acgt("t")).select("hit_id", B.canonical_code("t")))
    assert got == want and len(got) == 60
    assert rows(usable_hits(df.limit(0), columns=("hit_id",))) == []


def test_segments_names_and_merges(spark):
    df = spark.createDataFrame([("ANNCCNGG", 2), ("NN", -1), ("", 0), (None, 1), ("acgtN", 3)], "s string, g int")
    assert [r[0] for r in df.select(B.longest_segment("s")).collect()] == ["CC", "", "", None, "acgt"]
    names = spark.createDataFrame([(" >ref1 ",), ("ref1",), (None,), (">>x",), ("a b",)], "n string")
    assert [r[0] for r in names.select(B.clean_name("n")).collect()] == ["ref1", "ref1", None, "x", "a b"]
    gaps = spark.createDataFrame([("AA", "CGT", 2), ("AA", "CGT", -2), ("AA", "CGT", 0)], "a string, b string, g int")
    assert [r[0] for r in gaps.select(B.merge_gap("a", "b", F.col("g"))).collect()] == ["AANNCGT", "AAT", "AACGT"]
    assert gaps.select(B.merge_overlap(F.lit("ACGT"), F.lit("GTTT"), 3)).first()[0] == "ACGTTT"


def test_rank_vectors_break_ties_by_dimension(spark):
    df = spark.createDataFrame([([0.5, 0.1, 0.5, 0.0],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(rank_vector("v")).collect()] == [[2, 1, 3, 0], None]
    two = spark.createDataFrame([([0, 1, 2], [2, 1, 0])], "a array<int>, b array<int>")
    assert two.select(rank_distance("a", "b")).first()[0] == 4


def test_paths(spark):
    from strandweave.functions import paths as P
    from strandweave.operators.scaffold import uncontained

    df = spark.createDataFrame([([2, 4, 7], [4, 7], [30, 21, 40], ["AACG", "CGT", "GTTT"])], "p array<bigint>, q array<bigint>, n array<int>, s array<string>")
    r = df.select(P.turned("p"), P.appended("p", F.lit(9).cast("bigint")), P.popped("q"), P.suffix("p", 1), P.is_simple("p"), P.is_simple(F.array_append("p", F.lit(5).cast("bigint"))), P.contains("p", "q"), P.contains("q", "p"), P.merged("s", 3), P.internal_size("n", 11)).first()
    assert list(r) == [[6, 5, 3], [2, 4, 7, 9], [4], [4, 7], True, False, True, False, "AACGTTT", 13]
    some = spark.createDataFrame([(2, [2, 4]), (2, [2, 4, 6]), (2, [2, 4]), (8, [2, 4])], "u bigint, path array<bigint>")
    assert rows(uncontained(some)) == [(2, [2, 4, 6]), (8, [2, 4])]
