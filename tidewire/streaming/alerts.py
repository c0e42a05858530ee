"""Merged alerts over a stream, late rows, and a table that a restarted stream writes once."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewire.operators.alerts import KEY, keyed, united

#: What is open or closed of an island; ``first`` is its first part as JSON.
PART = "n int, first string, emit_seq long, emit_ord int, start_us long, end_us long, severity_rank int, score double, probes long, reported int, ports array<int>"


class Islands(StatefulProcessor):
    """The open island of a key; it closes when a part comes too late for it, or when time has passed it."""

    def __init__(self, gap_us: int, longest_us: int):
        self.gap_us, self.longest_us = gap_us, longest_us
        self.names = [*KEY, *(x.split()[0] for x in PART.split(", "))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "doc string")

    def _joined(self, island: dict | None, r: dict[str, Any]) -> dict:
        ports = [int(p) for p in r["ports"]] if r["ports"] is not None else []
        number = lambda v: None if v is None or v != v else int(v)
        own = {"n": 1, "first": r["first"], "emit_seq": int(r["emit_seq"]), "emit_ord": int(r["emit_ord"]), "start_us": int(r["start_us"]), "end_us": int(r["end_us"]), "severity_rank": int(r["severity_rank"]), "score": float(r["score"]),
               "probes": number(r["probes"]), "reported": number(r["reported"]), "ports": ports}
        if island is None:
            return own
        some = lambda f, a, b: b if a is None else a if b is None else f(a, b)
        seen = min((island["emit_seq"], island["emit_ord"]), (own["emit_seq"], own["emit_ord"]))
        return {
            **island, "n": island["n"] + 1, "emit_seq": seen[0], "emit_ord": seen[1], "probes": some(lambda a, b: a + b, island["probes"], own["probes"]), "reported": some(max, island["reported"], own["reported"]),
            "ports": sorted({*island["ports"], *ports}), **{k: max(island[k], own[k]) for k in ("end_us", "severity_rank", "score")},
        }

    def _frame(self, key: Any, closed: list[dict]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *i.values()) for i in closed], columns=self.names)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["start_us", "emit_seq", "emit_ord"])
        island, closed = json.loads(self.state.get()[0]) if self.state.exists() else None, []
        last = None if island is None else island.pop("last")
        for r in batch.to_dict("records"):
            if island is not None and int(r["start_us"]) > last + self.gap_us:  # the part before ends here, as in batch
                closed.append(island)
                island = None
            island, last = self._joined(island, r), int(r["end_us"])
        self.state.update((json.dumps({**island, "last": last}),))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((island["end_us"] + self.gap_us + self.longest_us) // 1000 + 1)
        yield self._frame(key, closed)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        island = json.loads(self.state.get()[0])
        island.pop("last")
        self.state.clear()
        yield self._frame(key, [island])

    def close(self) -> None:
        pass


def merged(raw: DataFrame, gap_us: int, longest_us: int = 0, watermark: str = "1 minute") -> DataFrame:
    """A stream of alerts merged as ``operators.alerts.merge`` does; an alert comes out once, when nothing can join it any more.

    ``longest_us`` is the longest span of a single alert: one that ends later may begin so
    much before.  State is an open alert a key; its ports are at most 65,536.
    """
    first = F.to_json(F.struct("id", "dst", "summary", "evidence", "severity"))
    rows = keyed(raw).select(
        *KEY, first.alias("first"), "emit_seq", "emit_ord", "start_us", "end_us", "severity_rank", "score", F.col("evidence.total_probes").alias("probes"), F.col("evidence.distinct_ports_count").alias("reported"),
        F.col("evidence.sample_ports").alias("ports"), F.timestamp_micros("end_us").alias("event_time"),
    ).withWatermark("event_time", watermark)
    out = ", ".join([*(f"`{k}` string" for k in KEY), PART])
    closed = rows.groupBy(*KEY).transformWithStateInPandas(statefulProcessor=Islands(gap_us, longest_us), outputStructType=out, outputMode="Append", timeMode="EventTime")
    kind = raw.select(F.struct("id", "dst", "summary", "evidence", "severity").alias("f")).schema["f"].dataType
    return united(closed.select(*KEY, "n", F.from_json("first", kind).alias("f"), F.struct("emit_seq", "emit_ord").alias("seen"), "start_us", "end_us", "severity_rank", "score", "probes", "reported", "ports"))


class BatchTable:
    """A table of micro-batches, each a folder by its number.

    A stream that stops between writing a batch and committing it runs that batch again under
    the same number; its folder is then written anew, so the table has every row once.
    Folders without their marker are not read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def batches(self) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        at = path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[6:]) for n in names if n.startswith("batch=") and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def read(self, schema: Any, before: int | None = None) -> DataFrame:
        own = [f"{self.path}/batch={b}" for b in self.batches() if before is None or b < before]
        return self.spark.read.schema(schema).parquet(*own) if own else self.spark.createDataFrame([], schema)


def stored(stream: DataFrame, folder: str, checkpoint: str, late_after: str | None = None, trigger: dict[str, Any] | None = None, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start a stream into ``folder``/rows, each row once, however often it is restarted.

    With ``late_after`` (such as "1 minute"), rows whose ``us`` is more than that before the
    latest time of all batches before, which a stateful operator of that watermark would drop,
    go to ``folder``/late.  ``then`` is called with each batch after it was written.
    """
    spark = stream.sparkSession
    rows, late, marks = (BatchTable(spark, f"{folder}/{name}") for name in ("rows", "late", "marks"))

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            if late_after is None:
                rows.write(batch, number)
            else:
                top = marks.read("top long", number).agg(F.max("top")).first()[0]  # a row a batch
                horizon = None if top is None else spark.sql(f"SELECT unix_micros(timestamp_micros({top}) - INTERVAL {late_after})").first()[0]
                timely = F.lit(True) if horizon is None else F.coalesce(F.col("us") >= horizon, F.lit(True))
                rows.write(batch.where(timely), number)
                late.write(batch.where(~timely), number)
                marks.write(batch.agg(F.max("us").alias("top")), number)
            if then is not None:
                then(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
