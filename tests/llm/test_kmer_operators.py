"""Term counts, most frequent values and set overlaps against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from strandweave.llm import set_overlap, term_counts, top_terms


def rows(df):
    return sorted(tuple(r) for r in df.collect())


HITS = "hit bigint, run bigint, read bigint, term bigint, g string, t string, r int, p int, leaf int, hits int"


def sample_hits(n=3000, seed=1):
    rng = random.Random(seed)
    data = [(i, rng.randrange(3), rng.randrange(200), 5 if rng.random() < 0.35 else rng.randrange(1 << 20), "g", None, 1, 2, 3, 4) for i in range(n)]
    return data + data[:100] + [(None, None, None, 7, *[None] * 6), (1, None, 2, None, *[None] * 6)]


@pytest.mark.parametrize("leaves", [1, 16])
def test_term_counts_are_exact(spark, leaves):
    data = sample_hits()
    seen = defaultdict(set)
    for hit, run, read, term, *_ in data:
        if term is not None:
            seen[run, term].add((read, hit))
    want = sorted(((run, term, len(s), len({r for r, _ in s})) for (run, term), s in seen.items()), key=str)
    df = spark.createDataFrame(data, HITS)
    got = term_counts.term_counts(df, sample=df.select("term"), term="term", bits=20, group="run", record="read", row_id="hit", depth=3, leaves=leaves)
    assert sorted((tuple(r) for r in got.select("run", "term", "hits", "records").collect()), key=str) == want


def test_term_counts_of_an_empty_table(spark):
    df = spark.createDataFrame([], HITS)
    assert term_counts.term_counts(df, sample=df.select("term"), term="term", bits=20, group="run", record="read", row_id="hit").count() == 0


def test_tries_hold_counters_and_merge():
    rng = np.random.default_rng(5)
    rows = {c: rng.integers(lo, hi, 500) for c, lo, hi in (("t", 0, 64), ("g", -3, 3), ("r", 0, 9), ("i", -(10**14), 10**14), ("null", 0, 8))}
    for c, bit in term_counts.NULLS.items():
        rows[c][rows["null"] & bit > 0] = 0
    routes = np.array(sorted(term_counts.burst(dict(Counter((rows["t"] >> 4).tolist())), 1, 60)), np.int64)[:, 1:]
    halves = [term_counts.packed_tries({c: x[k::2] for c, x in rows.items()}, routes, 4) for k in (0, 1)]
    assert all(b.num_rows < 30 for b in halves)
    seen = defaultdict(set)
    for t, g, r, i, null in zip(*(rows[c].tolist() for c in ("t", "g", "r", "i", "null"))):
        seen[t, None if null & 1 else g].add((None if null & 2 else r, None if null & 4 else i))
    got = Counter()
    both = pa.Table.from_batches(halves)
    for leaf in set(both.column("leaf").to_pylist()):
        t, g, null, hits, records = term_counts.merged_tries(both.filter(pa.compute.equal(both.column("leaf"), leaf)))
        for x in zip(t.tolist(), g.tolist(), null.tolist(), hits.tolist(), records.tolist()):
            got[x[0], None if x[2] else x[1], "hits"] += x[3]
            got[x[0], None if x[2] else x[1], "records"] += x[4]
    assert got == {(*k, what): n for k, s in seen.items() for what, n in (("hits", len(s)), ("records", len({r for r, _ in s})))}


def test_narrow_integers_of_any_size():
    for x in ([], [5], [-(2**63), 2**63 - 1], [0, 255], [10**12, 10**12 + 70_000]):
        assert term_counts.widened(term_counts.narrow(np.array(x, np.int64))).tolist() == x


def test_trie_bursts_only_where_it_is_full():
    counts = {p: 1 for p in range(64)} | {5: 1000}
    routes = term_counts.burst(counts, 3, 20)
    assert sorted(p for p, _, _ in routes) == list(range(64))
    assert dict((p, n) for p, _, n in routes)[5] == 50
    leaves = {leaf for _, leaf, _ in routes}
    assert len(leaves) < 64 and {leaf for p, leaf, _ in routes if p >= 16} & {leaf for p, leaf, _ in routes if p < 16} == set()


def test_marks(spark):
    counts = spark.createDataFrame([(1, 1, 1, 1), (1, 2, 9, 5), (1, 3, 9, 4), (2, 1, 1, 1), (9, 1, 1, 1)], "run bigint, term bigint, hits bigint, records bigint")
    limits = spark.createDataFrame([(1, 2, 100), (2, 1, 20)], "run bigint, least int, total bigint")
    got = term_counts.marked(counts, limits, group="run").select("run", "term", "mark")
    assert sorted(map(tuple, got.collect())) == [(1, 1, "rare"), (1, 2, "common"), (1, 3, None), (2, 1, "common")]


def test_top_values_with_ties_nulls_and_heavy_value(spark):
    rng = random.Random(3)
    data = [None] * 20 + [7] * 900 + [rng.randrange(300) for _ in range(2000)]
    want = sorted(Counter(x for x in data if x is not None).items(), key=lambda x: (-x[1], x[0]))
    df = spark.createDataFrame([(x, "n") for x in data], "value bigint, n string").repartition(5)
    for k, run in ((1, 50), (15, 64), (1000, 1 << 19)):
        got = [tuple(r) for r in top_terms.top_values(df, "value", k, run=run).collect()]
        assert got == want[:k]
    assert top_terms.top_values(df.limit(0), "value", 5).collect() == []


def test_heaviest_joins_a_value_over_batches():
    batches = [pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(n, pa.int64())], names=["value", "n"]) for v, n in (([1, 1, 2], [1, 1, 5]), ([], []), ([2, 2], [1, 1]), ([2, 3], [1, 4]))]
    out = list(top_terms.heaviest(iter(batches), 2))[0].to_pydict()
    assert sorted(zip(out["n"], out["value"])) == [(4, 3), (8, 2)]


def set_data(seed=4):
    rng = random.Random(seed)
    core = rng.sample(range(10**9), 4000)
    sets = {f"s{i}": set(rng.sample(core, 300 + 90 * i)) | set(rng.sample(range(10**9, 2 * 10**9), 200 * (i % 3))) for i in range(12)}
    sets["tiny"] = set(core[:3])
    sets["same"] = set(sets["s1"])
    return sets


def test_overlap_estimates_and_exact_decision(spark):
    sets = set_data()
    data = [(o, m, 1) for o, s in sets.items() for m in s for _ in range(1 + m % 2)] + [(None, 5, 1), ("s1", None, 1), ("none", None, 1)]
    df = spark.createDataFrame(data, "o string, h bigint, n int")
    members = df.where("o IS NOT NULL AND h IS NOT NULL").select("o", "h").distinct()
    pairs = {(r.a, r.b): r for r in set_overlap.overlaps(set_overlap.sketches(members, "o", "h", k=256), "o", k=256, block=4).collect()}
    assert len(pairs) == len(sets) * (len(sets) - 1) // 2
    for (a, b), r in pairs.items():
        both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if union < 256:
            assert r.exact and r.both == both
        else:
            f = both / union  # five standard errors of the shared fraction, and as many of the union's size
            assert abs(r.both - both) <= union * 5 * (f * (1 - f) / 256) ** 0.5 + both * 5 / 16
    want = sorted((a, b) for a in sets for b in sets if a < b and 200 * len(sets[a] & sets[b]) >= 20 * (len(sets[a]) + len(sets[b])))
    assert rows(set_overlap.alike_sets(df, "o", "h", dice=20, k=64)) == want
    assert rows(set_overlap.alike_sets(df.limit(0), "o", "h", dice=20)) == []


def test_compared_counts_shared_hashes():
    one, other = np.array([1, 3, 5, 9]), np.array([1, 2, 5, 8])
    assert set_overlap.compared(one, other, 4)[:2] == (4, 2)
    assert set_overlap.compared(one, other, 100) == (6, 2, 6.0)
    assert set_overlap.compared(np.array([], np.int64), np.array([], np.int64), 4) == (0, 0, 0.0)


def test_skew_of_one_set(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, "big").otherwise(F.concat(F.lit("x"), (F.col("id") % 4).cast("string"))).alias("o"), F.col("id").alias("m"))
    assert rows(set_overlap.alike_sets(df, "o", "m", dice=20, k=32)) == []
