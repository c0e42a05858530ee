"""Isolation forest (Liu, Ting and Zhou, 2008) over feature windows.

Each tree is grown from a bounded sample in its own group, so trees grow in parallel and
no task sees more than one sample.  A fitted forest is a small table that is saved as
Parquet beside its settings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.features import baseline, order_statistics
from tidewire.schema import FEATURES

TREES, SAMPLE, SEED = 100, 256, 42
NODES = "tree int, node int, feature int, at double, low int, high int, size int, depth int"


def path_length(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n."""
    n = np.asarray(n, float)
    h = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator, most: int) -> list[tuple]:
    nodes: list[tuple] = []

    def split(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append(())
        wide = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth >= most or not len(wide):
            nodes[me] = (me, -1, 0.0, -1, -1, len(rows), depth)
            return me
        f = int(rng.choice(wide))
        at = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        below = rows[:, f] <= at
        a, b = split(rows[below], depth + 1), split(rows[~below], depth + 1)
        nodes[me] = (me, f, at, a, b, len(rows), depth)
        return me

    split(x, 0)
    return nodes


@dataclass
class Forest:
    """Trees as arrays, the decision offset and the baseline."""

    nodes: pd.DataFrame
    sample: int
    offset: float
    medians: list[float]
    scales: list[float]
    window_seconds: float
    n_windows: int
    features: tuple = FEATURES
    _trees: list = field(default_factory=list, repr=False)

    def score(self, x: np.ndarray) -> np.ndarray:
        """-1 (surely an outlier) to 0."""
        if not self._trees:
            self._trees = [t.sort_values("node") for _, t in self.nodes.groupby("tree")]
        depth = np.zeros(len(x))
        for t in self._trees:
            f, at, low, high, size, d = (t[c].to_numpy() for c in ("feature", "at", "low", "high", "size", "depth"))
            here = np.zeros(len(x), np.int64)
            while (inner := f[here] >= 0).any():
                i = np.flatnonzero(inner)
                h = here[i]
                here[i] = np.where(x[i, f[h]] <= at[h], low[h], high[h])
            depth += d[here] + path_length(size[here])
        return -(2.0 ** (-depth / len(self._trees) / max(float(path_length(self.sample)), 1e-9)))

    def decision(self, x: np.ndarray) -> np.ndarray:
        """Negative for outliers."""
        return self.score(x) - self.offset

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        meta = [(list(self.features), self.sample, self.offset, self.medians, self.scales, self.window_seconds, self.n_windows)]
        spark.createDataFrame(meta, "features array<string>, sample int, offset double, medians array<double>, scales array<double>, window_seconds double, n_windows long").coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        """FileNotFoundError if there is no model, ValueError if it has other features."""
        from pyspark.errors import AnalysisException

        try:
            m = spark.read.schema("features array<string>, sample int, offset double, medians array<double>, scales array<double>, window_seconds double, n_windows long").json(f"{path}/meta").first()
            nodes = spark.read.parquet(f"{path}/trees").toPandas()
        except AnalysisException as e:
            raise FileNotFoundError(f"no model at {path}") from e
        if m is None or tuple(m["features"]) != FEATURES:
            raise ValueError("the model has other features; train it anew")
        return Forest(nodes, m["sample"], m["offset"], m["medians"], m["scales"], m["window_seconds"], m["n_windows"])


def fit(windows: DataFrame, window_seconds: float, contamination: float = 0.05, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """Fit on the windows of ``windows``; ValueError with fewer than two, or a contamination outside (0, 0.5]."""
    if not 0 < contamination <= 0.5:
        raise ValueError("ml.contamination must be greater than 0 and no more than 0.5")
    n = windows.count()
    if n < 2:
        raise ValueError(f"{n} flow window(s) are too few to train on")
    size = min(sample, n)
    # Every tree has its own hash order; rows are thinned by it first, so few reach the exact choice.
    rate = min(1.0, 4.0 * size / n + 20.0 / n)
    place = lambda t: F.xxhash64(F.lit(seed), t, "capture", "src_ip", "window_start")
    # Told row by row as compiled code, which a lambda over an array would not be.
    each = windows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("h", place(F.col("tree")))
    keyed = each.where(F.col("h").cast("double") < (2 * rate - 1) * float(1 << 63))

    def tree(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        own = x.sort_values("h").head(size)[list(FEATURES)].to_numpy(float)
        nodes = grow(own, np.random.default_rng([seed, int(key[0])]), int(np.ceil(np.log2(max(size, 2)))))
        return pd.DataFrame([(key[0], *v) for v in nodes], columns=["tree", "node", "feature", "at", "low", "high", "size", "depth"])

    nodes = keyed.groupBy("tree").applyInPandas(tree, NODES).toPandas()  # trees * 2 * sample rows at most
    base = {r["feature"]: r for r in baseline(windows).collect()}
    model = Forest(nodes, size, 0.0, [base[f]["median"] for f in FEATURES], [base[f]["scale"] for f in FEATURES], float(window_seconds), n)
    raw = scored(windows, model).select("raw").persist(StorageLevel.MEMORY_AND_DISK)
    at = contamination * (n - 1)  # between two ranks their values are weighed
    low, high = int(np.floor(at)), int(np.ceil(at))
    found = order_statistics(raw, {"raw": [low, high]})
    raw.unpersist()
    model.offset = found["raw", low] if low == high else (high - at) * found["raw", low] + (at - low) * found["raw", high]
    return model


def scored(windows: DataFrame, model: Forest) -> DataFrame:
    """Adds ``raw``, the decision value; a forest of fixed size goes to every task."""
    shared = windows.sparkSession.sparkContext.broadcast(model)  # bounded by trees * 2 * sample nodes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x.assign(raw=shared.value.decision(x[list(FEATURES)].to_numpy(float)) if len(x) else [])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema.fields)
    return windows.mapInPandas(run, f"{fields}, raw double")
