"""Outlying traffic windows as alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.functions import network as N
from tidewire.operators.detectors import evidence
from tidewire.operators.features import contributors
from tidewire.operators.forest import Forest, scored
from tidewire.schema import FEATURES

#: Anomaly scores from which an alert is HIGH or MEDIUM.
HIGH, MEDIUM = 0.8, 0.6


def outliers(windows: DataFrame, model: Forest) -> DataFrame:
    """Windows with a decision of 0 or less, and ``anomaly``: 1 for a capture's most outlying one, 0 for its least."""
    low = scored(windows, model).where("raw <= 0")
    ends = low.groupBy("capture").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    return low.join(ends, "capture").withColumn("anomaly", 1 - (F.col("raw") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9))).drop("lo", "hi")


def top(scored_windows: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("capture").orderBy(F.desc("anomaly"), "window_start", "src_ip")
    return scored_windows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)


def ml_anomaly(windows: DataFrame, model: Forest, k: int = 10) -> DataFrame:
    """The k most outlying windows of each capture, after all other alerts."""
    if k < 1:
        k = 1
    out = top(outliers(windows, model), k)
    w = F.lit(model.window_seconds)
    proof = evidence(
        anomaly_score=F.round("anomaly", 4), raw_if_score=F.round("raw", 4), window_seconds=w, top_feature_contributors=contributors(model.medians, model.scales),
        **{f: F.round(f, 4) for f in FEATURES},
    )
    rank = F.when(F.col("anomaly") >= HIGH, 3).when(F.col("anomaly") >= MEDIUM, 2).otherwise(1)
    name = F.concat(F.lit("ml_"), "src_ip", F.lit("_"), F.col("window_start").cast("long").cast("string"))
    text = F.concat(F.lit("ML anomaly detected for "), "src_ip", F.lit(": anomaly score "), F.format_number("anomaly", 3), F.lit(f" in {model.window_seconds:g}s window"))
    us = lambda c: F.round(F.col(c) * 1_000_000).cast("long")
    return out.select(
        "capture", name.alias("id"), F.lit("ml_anomaly").alias("detector"), N.severity_of(rank).alias("severity"), rank.alias("severity_rank"), "src_ip", F.lit(None).cast("string").alias("dst"),
        us("window_start").alias("start_us"), us("window_end").alias("end_us"), F.round("anomaly", 4).alias("score"), text.alias("summary"), proof.alias("evidence"),
        F.lit((1 << 63) - 1).cast("long").alias("emit_seq"), F.col("place").cast("int").alias("emit_ord"),
    ).withColumnRenamed("src_ip", "src")
