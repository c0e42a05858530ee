"""Training of the isolation forest against plain loops over its trees and samples."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import forest
from tidewire.schema import FEATURES

TREES, SAMPLE, SHARE = 12, 64, 0.05


def c(n):
    """Mean depth of an unsuccessful search, as the paper has it."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(20, 2, (300, len(FEATURES))), 3)
    x[::100] = 500.0  # three outliers
    x[5] = x[4]
    rows = [("c", f"10.0.0.{n}", 60.0 * n, *map(float, v)) for n, v in enumerate(x)]
    return spark.createDataFrame(rows, "capture string, src_ip string, window_start double, " + ", ".join(f"{f} double" for f in FEATURES))


@pytest.fixture(scope="module")
def model(windows):
    return forest.fit(windows, 60, SHARE, TREES, SAMPLE)


def walk(tree, x):
    """The nodes that a row passes."""
    at, way = 0, []
    while True:
        node = tree[at]
        way.append(at)
        if node["feature"] < 0:
            return way
        at = node["low"] if x[node["feature"]] <= node["at"] else node["high"]


def trees_of(model):
    return {int(k): {int(r["node"]): r for r in t.to_dict("records")} for k, t in model.nodes.groupby("tree")}


def test_trees_are_grown_from_their_samples(windows, model):
    rows = windows.toPandas()
    values = rows[list(FEATURES)].to_numpy()
    trees = trees_of(model)
    assert sorted(trees) == list(range(TREES))
    for t, tree in trees.items():
        order = windows.select("src_ip", F.xxhash64(F.lit(forest.SEED), F.lit(t), "capture", "src_ip", "window_start").alias("h")).orderBy("h").limit(SAMPLE).toPandas()
        mine = rows["src_ip"].isin(order["src_ip"]).to_numpy()
        passed = [walk(tree, x) for x in values[mine]]
        for n, node in tree.items():
            there = [x for x, way in zip(values[mine], passed) if n in way]
            assert node["size"] == len(there) and node["depth"] <= math.ceil(math.log2(SAMPLE))
            if node["feature"] >= 0:
                own = [x[node["feature"]] for x in there]
                assert min(own) <= node["at"] < max(own)
                assert tree[node["low"]]["size"] + tree[node["high"]]["size"] == len(there)
            else:  # a leaf is one row, rows alike, or as deep as trees go
                assert node["depth"] == math.ceil(math.log2(SAMPLE)) or len({tuple(x) for x in there}) == 1


def test_scores_and_offset_equal_plain_loops(windows, model):
    got = {r["src_ip"]: r["raw"] for r in forest.scored(windows, model).collect()}
    trees = trees_of(model)
    plain = {}
    for r in windows.collect():
        x = [r[f] for f in FEATURES]
        ends = [(tree, walk(tree, x)[-1]) for tree in trees.values()]
        depth = np.mean([tree[n]["depth"] + c(tree[n]["size"]) for tree, n in ends])
        plain[r["src_ip"]] = -(2 ** (-depth / c(SAMPLE)))
    offset = np.quantile(list(plain.values()), SHARE)
    assert model.offset == pytest.approx(offset, abs=1e-12)
    assert all(got[k] == pytest.approx(plain[k] - offset, abs=1e-9) for k in plain)
    assert set(sorted(got, key=got.get)[:3]) == {"10.0.0.0", "10.0.0.100", "10.0.0.200"}
    assert model.medians == pytest.approx([np.median([r[f] for r in windows.collect()]) for f in FEATURES])


def test_training_again_gives_the_same(windows, model):
    again = forest.fit(windows.repartition(7), 60, SHARE, TREES, SAMPLE)
    key = ["tree", "node"]
    assert again.offset == pytest.approx(model.offset, abs=1e-12)
    assert again.nodes.sort_values(key).reset_index(drop=True).equals(model.nodes.sort_values(key).reset_index(drop=True))


def test_windows_are_made_once_for_training_and_scoring(spark, monkeypatch):
    from tidewire.operators import anomaly
    from tidewire.plans import queries

    plans = []
    for of, name in ((forest, "fit"), (anomaly, "ml_anomaly")):
        monkeypatch.setattr(of, name, lambda windows, *a, own=getattr(of, name): (plans.append(windows._jdf.queryExecution().optimizedPlan().toString()), own(windows, *a))[1])
    assert queries.anomaly_alerts(spark, "/root/testdata/sf0.001").count() == 10
    assert len(plans) == 2 and not any("Aggregate" in p or "get_json_object" in p for p in plans)
