"""Grid clusters against planted groups and brute force."""

import numpy as np

from pyspark.sql import functions as F

from strandweave.llm import grid_clusters as gc
from strandweave.plans import session
from strandweave.plans.session import cut


def records(seed=1, groups=(120, 60, 30, 5), loners=12, dims=136):
    rng = np.random.default_rng(seed)
    out, truth = [], []
    for g, n in enumerate(groups):
        base = rng.dirichlet(np.full(dims, 2.0))
        for _ in range(n):
            out.append(rng.multinomial(2000, base) / 2000)
            truth.append(g)
    for k in range(loners):
        out.append(rng.multinomial(2000, rng.dirichlet(np.full(dims, 2.0))) / 2000)
        truth.append(100 + k)
    return np.array(out), np.array(truth)


def test_planted_groups_come_out(spark):
    vals, truth = records()
    ranks = np.argsort(np.argsort(vals, axis=1, kind="stable"), axis=1, kind="stable")
    df = spark.createDataFrame([(i, r.tolist(), 2000, 1) for i, r in enumerate(ranks)], "id bigint, ranks array<int>, length int, part int")
    got = gc.groups(df).collect()
    found = {r.id: r.part for r in got}
    assert len(found) == len(got)
    for g in set(truth):
        own = {found.get(int(i)) for i in np.flatnonzero(truth == g)}
        assert own == ({None} if g >= 100 else own - {None}) and len(own) == 1, (g, own)
    assert len({found[int(np.flatnonzero(truth == g)[0])] for g in range(4)}) == 4


def test_few_and_no_records(spark):
    schema = "id bigint, ranks array<int>, length int"
    assert gc.groups(spark.createDataFrame([], schema)).count() == 0
    r = list(range(136))
    two = spark.createDataFrame([(5, r, None), (9, r, 700)], schema)
    assert sorted(x.id for x in gc.groups(two).collect()) == [5, 9]
    assert gc.groups(spark.createDataFrame([(5, r, 1), (9, r[::-1], 1)], schema)).count() == 0


def test_usable_vectors(spark):
    v = [float(x) for x in range(136)]
    nan = [float("nan")] + v[1:]
    back = list(range(135, -1, -1))
    rows = [(1, v, back, 9, "2024-01-01"), (1, v[::-1], None, 9, "2024-02-01"), (2, None, back, 9, None), (3, v[:9], None, 9, None), (4, nan, back, None, None), (5, nan, None, 1, None), (None, v, None, 1, None), (6, v, back[:3], 1, None)]
    df = spark.createDataFrame(rows, "seq_id bigint, vals array<double>, ranks array<int>, seq_len int, loaded_at string")
    got = {r.id: r.ranks for r in gc.usable_vectors(df).collect()}
    assert set(got) == {1, 2, 4, 5, 6}
    assert got[1] == back and got[2] == back and got[4] == back and got[6] == list(range(136)) and got[5][0] == 135


def components(n, edges):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_propagated_labels(spark):
    edges = [(0, 3), (3, 5), (5, 9), (9, 2), (1, 4), (7, 8)]
    nodes = spark.createDataFrame([(i,) for i in range(10)], "node bigint")
    both = spark.createDataFrame(edges + [(b, a) for a, b in edges], "a bigint, b bigint")
    got = [r.label for r in gc.propagated(nodes, both).orderBy("node").collect()]
    assert got == components(10, edges)


def test_cell_labels_like_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        cells = np.unique(rng.integers(-4, 5, (40, 2)), axis=0)
        n = rng.integers(1, 5, len(cells))
        got = gc.cell_labels(cells, n, 3)
        near = np.abs(cells[:, None] - cells[None]).max(2) <= 1
        dense = n >= 3
        lean = {i: max((j for j in np.flatnonzero(near[i] & dense)), key=lambda j: n[j], default=None) for i in np.flatnonzero(~dense)}
        alone = {i for i, j in lean.items() if j is None}
        edges = [(a, b) for a in range(len(cells)) for b in range(len(cells)) if a < b and near[a, b] and (dense[a] and dense[b] or a in alone and b in alone)]
        want = components(len(cells), edges)
        for i in range(len(cells)):
            for j in range(len(cells)):
                if lean.get(i) is None and lean.get(j) is None:
                    assert (got[i] == got[j]) == (want[i] == want[j])
            if lean.get(i) is not None:
                beside = np.flatnonzero(near[i] & dense)
                assert got[i] in {got[j] for j in beside if n[j] == n[beside].max()}


def test_more_labels_than_the_bound_are_refused(spark):
    import pytest

    assert len(gc.bounded(spark.range(3), 3, "rows")) == 3
    with pytest.raises(ValueError, match="more than 2"):
        gc.bounded(spark.range(3), 2, "rows")


def test_tree_of_grids_parts_planted_groups():
    vals, truth = records(seed=4, groups=(400, 200, 150, 100, 60), loners=10)
    ranks = np.argsort(np.argsort(vals, axis=1, kind="stable"), axis=1, kind="stable").astype(float)
    nodes = gc.grids_of(ranks, gc.Grid())
    leaf, _ = gc.walked(ranks, nodes)
    for found in set(leaf.tolist()) - {-1}:
        mine = truth[leaf == found]
        assert np.mean(mine == np.bincount(mine).argmax()) > 0.95
    assert np.mean(leaf[truth < 5] >= 0) > 0.7
    assert gc.grids_of(ranks[:3], gc.Grid()) == []


def test_means_of_labels(spark):
    rng = np.random.default_rng(7)
    ranks = np.array([rng.permutation(136) for _ in range(40)])
    df = spark.createDataFrame([(i, r.tolist(), None, i % 3) for i, r in enumerate(ranks)], "id bigint, ranks array<int>, length int, label bigint")
    rows = gc.packed(df, 136).join(df.select("id", F.when(F.col("label") < 2, F.col("label")).alias("label")), "id")
    got = {r.label: (r.n, np.frombuffer(r["mean"])) for r in gc.label_means(rows, "label", gc.Grid()).collect()}
    assert set(got) == {0, 1}
    for k, (n, mean) in got.items():
        want = ranks[np.arange(40) % 3 == k]
        assert n == len(want) and np.allclose(mean, want.mean(0))


def test_means_of_one_composition_are_joined():
    base = np.arange(136.0)
    means = np.array([base, base + 5, base[::-1], base + 90])
    assert gc.one_composition(np.array([50, 9, 30, 9]), means, 200.0).tolist() == [0, 0, 2, 3]


def test_tree_is_fitted_on_every_record(spark):
    vals, _ = records(seed=11, groups=(900, 500, 300, 200, 100), loners=30)
    ranks = np.argsort(np.argsort(vals, axis=1, kind="stable"), axis=1, kind="stable")
    rows = cut(gc.packed(spark.createDataFrame([(i, r.tolist(), 2000) for i, r in enumerate(ranks)], "id bigint, ranks array<int>, length int"), 136))
    want = gc.walked(ranks.astype(float), gc.grids_of(ranks.astype(float), gc.Grid()))[0]
    name = lambda leaf: [0 if x < 0 else 1 + int(np.flatnonzero(leaf == x)[0]) for x in leaf]
    for gathered in (150, 400, 5000):  # by Spark, by both, in one task
        leaf = gc.walked(ranks.astype(float), gc.fitted(rows, len(ranks), gc.Grid(gathered=gathered)))[0]
        assert name(leaf) == name(want), gathered


def test_links_span_their_components():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 60, (2, 40))
    a, b = np.r_[a, np.repeat(range(100, 110), 10)], np.r_[b, np.tile(range(100, 110), 10)]
    got = gc.spanning(a, b)
    assert components(110, got) == components(110, np.c_[a, b]) and len(got) < 60


def test_few_copies_of_the_records_are_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    vals, _ = records(seed=6, groups=(600, 400), loners=5)
    ranks = np.argsort(np.argsort(vals, axis=1, kind="stable"), axis=1, kind="stable")
    gc.groups(spark.createDataFrame([(i, r.tolist(), 2000) for i, r in enumerate(ranks)], "id bigint, ranks array<int>, length int")).count()
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < ranks.size * gc.RANK.itemsize
