"""The analysis as one plan: packets to merged, ranked alerts."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from tidewire.config import load_config, micros
from tidewire.operators.alerts import merge, ranked, union
from tidewire.operators.anomaly import ml_anomaly
from tidewire.operators.detectors import ARP_MUTE, CREDS_MUTE, RULES, Detector
from tidewire.operators.features import flow_windows
from tidewire.operators.forest import Forest, fit
from tidewire.operators.stateful import FAILURES, StatefulDetector
from tidewire.operators.stateful import run as run_stateful
from tidewire.operators.temporal import sweeps
from tidewire.schema import ALERTS
from tidewire.sources.pcap import capture_stats, read_captures
from tidewire.store import Tables

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Analysis:
    """Relations of an analysis.  Packets are cached and alerts are tables until ``close``; also a context."""

    packets: DataFrame
    stats: DataFrame
    raw: DataFrame
    alerts: DataFrame
    config: dict[str, Any]
    tables: Tables
    failures: DataFrame

    def close(self) -> None:
        self.packets.unpersist()
        self.tables.close()

    def __enter__(self) -> Analysis:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def detect(packets: DataFrame, config: dict[str, Any], detectors: dict[str, Detector | type[StatefulDetector]] | None = None, model: Forest | None = None, keep_going: bool = False, tables: Tables | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw alerts of all detectors, and the packets at which users' detectors failed; ``detectors`` may add or replace some.

    A detector is a function of tables or a class of ``StatefulDetector``.  The sweeps, and
    each detector's alerts, are written once, several side by side.  A function that fails
    stops the analysis, unless it is to ``keep_going``: it is then logged and left out.  A
    class fails by packets.
    """
    tables = tables or Tables(packets.sparkSession)
    if micros(config["state_ttl_seconds"]) < micros(max(CREDS_MUTE, ARP_MUTE)):
        raise ValueError("state_ttl_seconds must not be below the mute times of alerts")
    swept = tables.keep(sweeps(packets, micros(config["sweep_interval_seconds"])), "sweeps")
    found: dict[str, DataFrame] = {}
    failures = []
    for name, detector in (detectors or RULES).items():
        if isinstance(detector, type):  # a stateful detector of a user's own
            both = tables.keep(run_stateful(packets, config, swept, detector), f"stateful-{name}")
            found[name] = both.where("alert is not null").select("alert.*")
            failures.append(both.where("failure is not null").select("failure.*"))
            continue
        try:
            found[name] = detector(packets, config, swept)
        except Exception:
            if not keep_going:
                raise
            log.exception("detector %s failed and is left out", name)
    if model is not None:
        if model.window_seconds != float(config["ml"]["window_seconds"]):
            raise ValueError(f"the model has windows of {model.window_seconds:g} s, the settings of {config['ml']['window_seconds']:g} s")
        found["ml_anomaly"] = ml_anomaly(flow_windows(packets, model.window_seconds), model, int(config["ml"]["top_k"]))
    parts = []
    for name, rows in tables.keep_all(found).items():
        if not isinstance(rows, Exception):
            parts.append(rows)
        elif keep_going and name != "ml_anomaly":
            log.error("detector %s failed and is left out", name, exc_info=rows)
        else:
            raise rows
    spark = packets.sparkSession
    return union([spark.createDataFrame([], ALERTS), *parts]), union([spark.createDataFrame([], FAILURES), *failures])


def analyse(packets: DataFrame, config: dict[str, Any] | None = None, detectors: dict[str, Detector | type[StatefulDetector]] | None = None, keep_going: bool = False) -> Analysis:
    """Analyse packets, which may hold many captures.

    Decoded packets are kept for the detectors that share them, spilling to disk.
    """
    config = config or load_config()
    packets = packets.persist(StorageLevel.MEMORY_AND_DISK)
    good = packets.where("not coalesce(malformed, false)")
    tables = Tables(packets.sparkSession)
    try:
        model = Forest.load(packets.sparkSession, config["ml"]["model_path"]) if config["ml"]["enabled"] else None
        raw, failures = detect(good, config, detectors, model, keep_going, tables)
        merged = tables.keep(merge(raw, micros(config["window_seconds"])), "merged")
        return Analysis(packets, tables.keep(capture_stats(packets), "stats"), raw, tables.keep(ranked(merged), "ranked"), config, tables, failures)
    except BaseException:
        packets.unpersist()
        tables.close()
        raise


def analyse_captures(spark: SparkSession, *paths: str, config: dict[str, Any] | None = None, keep_going: bool = False) -> Analysis:
    config = config or load_config()
    return analyse(read_captures(spark, *paths, mask_opaque=config["cleartext_creds"].get("mask_opaque_username", False)), config, keep_going=keep_going)


def train(spark: SparkSession, paths: list[str], config: dict[str, Any], output: str) -> dict[str, Any]:
    """Fit a forest on baseline captures and save it.  Windows never span captures."""
    ml = config["ml"]
    windows = flow_windows(read_captures(spark, *paths), float(ml["window_seconds"])).persist(StorageLevel.MEMORY_AND_DISK)
    model = fit(windows, float(ml["window_seconds"]), float(ml["contamination"]))
    model.save(spark, output)
    windows.unpersist()
    return {"n_windows": model.n_windows, "model_path": output, "feature_names": list(model.features)}
