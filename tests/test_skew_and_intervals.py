"""Skew-safe counts and interval coverage against brute force, with the awkward cases."""

import random
from collections import defaultdict

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandweave.operators import intervals
from strandweave.operators.intervals import coverage_segments
from strandweave.operators.skew import heavy_keys, skew_safe_counts

HITS = "hit bigint, run bigint, read bigint, key bigint, k string, g int, hits int"


def counted(data):
    seen = defaultdict(set)
    for hit, run, read, key, *_ in data:
        if key is not None:
            seen[key].add((run, read, hit))
    return sorted((k, len(v), len({x[:2] for x in v}), len({x[0] for x in v})) for k, v in seen.items())


@pytest.mark.parametrize("listed", [[], [1], [1, 2, 99]])
def test_counts_are_exact_whatever_is_heavy(spark, listed):
    data = [(i, i % 5, i % 97, 1, "x", 0, 0) for i in range(900)] + [(10_000 + i, i % 3, i, i % 7, "y", 1, 1) for i in range(200)]
    data += data[:50]  # resent
    data += [(None, None, None, 1, None, None, None), (5, None, 3, None, None, None, None), (77_777, 2, None, 4, None, None, None)]
    df = spark.createDataFrame(data, HITS)
    heavy = spark.createDataFrame([(x,) for x in listed], "key bigint")
    got = skew_safe_counts(df, "key", group="run", record="read", row_id="hit", heavy=heavy)
    assert rows(got.select("key", "hits", "records", "groups")) == counted(data)


def test_heavy_keys_finds_them_and_empty_tables_work(spark):
    df = spark.createDataFrame([(1 if i % 3 else i,) for i in range(3000)], "key bigint")
    assert rows(heavy_keys(df, "key", share=0.1)) == [(1,)]
    empty = spark.createDataFrame([], HITS)
    assert rows(heavy_keys(empty, "key")) == []
    assert rows(skew_safe_counts(empty, "key", group="run", record="read", row_id="hit", heavy=empty.select("key"))) == []


def test_heavy_rows_are_spread(spark):
    df = spark.range(20_000).select(F.col("id").alias("hit"), F.lit(1).alias("run"), F.col("id").alias("read"), F.lit(7).cast("bigint").alias("key"))
    heavy = spark.createDataFrame([(7,)], "key bigint")
    got = skew_safe_counts(df, "key", group="run", record="read", row_id="hit", heavy=heavy)
    assert rows(got.select("key", "hits", "records", "groups")) == [(7, 20_000, 20_000, 1)]


def segments(data):
    by = defaultdict(set)
    for ref, a, b in data:
        if None not in (ref, a, b):
            by[ref] |= set(range(min(a, b), max(a, b) + 1))
    out = []
    for ref, cells in by.items():
        cells, runs = sorted(cells), []
        for c in cells:
            if runs and runs[-1][1] + 1 == c:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        out += [(ref, "period", a, b) for a, b in runs]
        out += [(ref, "gap", x[1] + 1, y[0] - 1) for x, y in zip(runs, runs[1:])]
    return sorted(out)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-30, 90)), st.one_of(st.none(), st.integers(-30, 90))), max_size=25))
def test_segments_like_brute_force(spark, data):
    df = spark.createDataFrame([(*r, "s") for r in data], "ref string, start int, stop int, s string")
    for shard in (1, 8, 1 << 16):
        assert rows(coverage_segments(df, "ref", "start", "stop", shard=shard)) == segments(data)


def test_segments_of_empty_and_clashing_tables(spark):
    df = spark.createDataFrame([("r", 1, 100, 5, 6), ("r", 200, 101, 5, 6), ("r", 1, 100, 5, 6), ("r", 300, 400, 1, 1)], "e string, a int, b int, s int, kind int")
    assert rows(coverage_segments(df, "e", "a", "b", shard=16)) == [("r", "gap", 201, 299), ("r", "period", 1, 200), ("r", "period", 300, 400)]
    assert rows(coverage_segments(df.limit(0), "e", "a", "b")) == []


def test_segments_over_several_levels(spark, monkeypatch):
    """Shards of three levels, with intervals that cover whole shards of each."""
    monkeypatch.setattr(intervals, "FAN", 4)
    rng = random.Random(12)
    data = []
    for ref, long in (("a", 3), ("b", 400), ("c", 60)):
        for _ in range(60):
            a = rng.randrange(-1500, 1500)
            data.append((ref, a, a + (rng.randrange(long) if rng.random() < 0.2 else rng.randrange(4))))
    df = spark.createDataFrame(data, "ref string, start int, stop int")
    for shard in (2, 8):
        assert rows(coverage_segments(df, "ref", "start", "stop", shard=shard)) == segments(data)


def test_a_long_interval_is_as_quick_as_a_short_one(spark):
    far = 10**11
    df = spark.createDataFrame([("r", 5, far), ("r", 70_000, 70_010), ("r", far + 3, far + 9), ("r", far // 2, far + 1)], "ref string, a bigint, b bigint")
    assert rows(coverage_segments(df, "ref", "a", "b")) == [("r", "gap", far + 2, far + 2), ("r", "period", 5, far + 1), ("r", "period", far + 3, far + 9)]
    lo, widths = spark.createDataFrame([("r", 5, far)], "e string, a bigint, b bigint"), [1 << 16, 1 << 26, 1 << 36, None]
    assert intervals.clipped(lo, widths).count() <= 2 * len(widths)
