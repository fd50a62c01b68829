"""k-means over rank vectors."""

import numpy as np
from pyspark.sql import functions as F


def test_registered_kmeans_runs_all_restarts_until_centres_rest(monkeypatch):
    from strandweave import queries_analysis
    from strandweave.operators import cluster

    asked = []
    monkeypatch.setattr(queries_analysis, "vectors", lambda *_: type("Rows", (), {"select": lambda self, *_: self})())
    monkeypatch.setattr(queries_analysis, "cut", lambda df: df)
    monkeypatch.setattr(cluster, "release", lambda *_: None, raising=False)
    monkeypatch.setattr(cluster, "kmeans", lambda points, k, *, seed, rounds: (asked.append((k, seed, rounds)), (seed, float(abs(seed - 6))))[1])
    assert queries_analysis.vector_kmeans(None, "") == 6
    assert asked == [(8, seed, 40) for seed in range(10)]


def test_moved_centres_are_means_of_the_nearest(spark):
    from strandweave.functions.vectors import rank_vector
    from strandweave.operators import cluster

    rng = np.random.default_rng(3)
    rows = [(i, rng.random(136).tolist()) for i in range(60)]
    points = spark.createDataFrame(rows, "id bigint, vals array<double>").withColumn("ranks", rank_vector("vals"))
    centres = [(i, list(r.ranks)) for i, r in enumerate(points.orderBy("id").limit(4).collect())]
    want = {r.centre: list(r.ranks) for r in cluster.centroids(cluster.assigned(points, centres), points).collect()}
    assert {r.centre: list(r.ranks) for r in cluster.moved_centres(points, centres).collect()} == want
    best = cluster.best_kmeans(points, 3, restarts=2, rounds=3)
    assert best.count() == 60 and best.select(F.countDistinct("id")).first()[0] == 60
