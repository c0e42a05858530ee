"""Merging, ranking and rolling up alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.functions import network as N
from tidewire.operators.temporal import islands
from tidewire.schema import DETECTORS, EVIDENCE, SEVERITIES


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def sub_key() -> Column:
    """What tells alerts of one detector, source and destination apart."""
    e = lambda name: F.coalesce(F.col(f"evidence.{name}"), F.lit(""))
    return (
        F.when(F.col("detector") == "port_scan", e("scan_type"))
        .when(F.col("detector") == "cleartext_creds", F.concat(e("protocol"), F.lit(":"), e("username")))
        .when(F.col("detector") == "dns_tunnel", e("parent_domain"))
        .when(F.col("detector") == "arp_spoof", e("victim_ip"))
        .otherwise("")
    )


#: Alerts of one key may be merged.
KEY = ["capture", "detector", "src", "_dst", "_sub"]


def keyed(raw: DataFrame) -> DataFrame:
    return raw.withColumn("_dst", F.coalesce("dst", F.lit(""))).withColumn("_sub", sub_key())


def merge(raw: DataFrame, gap_us: int) -> DataFrame:
    """Alerts of one key whose next starts within ``gap_us`` of the end of the one before become one.

    Such an alert has the span, highest severity and highest score of its parts, and
    all else of the first.  Port scans also unite their sample ports and add up their
    probes.  Alerts that stay alone are unchanged.
    """
    key, order = KEY, ["emit_seq", "emit_ord"]
    rows = islands(keyed(raw), key, gap_us, order)
    # A row a sample port (at most ten an alert), so that one grouping unites ports and sums up; what an alert says once counts in its first row.
    rows = rows.select("*", F.posexplode_outer("evidence.sample_ports").alias("_place", "_port"))
    own = F.coalesce(F.col("_place"), F.lit(0)) == 0
    parts = rows.groupBy(*key, "island").agg(
        F.count_if(own).cast("int").alias("n"), F.min_by(F.struct("id", "dst", "summary", "evidence", "severity"), F.struct("start_us", *order)).alias("f"), F.min(F.struct(*order)).alias("seen"),
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.max("severity_rank").alias("severity_rank"), F.max("score").alias("score"),
        F.sum(F.when(own, F.col("evidence.total_probes"))).alias("probes"), F.max("evidence.distinct_ports_count").alias("reported"), F.array_sort(F.collect_set("_port")).alias("ports"),  # 65,536 at most
    )
    return united(parts)


def united(parts: DataFrame) -> DataFrame:
    """Alerts of what their parts come to: n, f (the first part), seen, start_us, end_us, severity_rank, score, probes, reported, ports."""
    many = F.col("n") > 1
    scan = many & (F.col("detector") == "port_scan")
    span = N.seconds(F.greatest(F.lit(1000), F.col("end_us") - F.col("start_us")))
    distinct = F.greatest("reported", F.size("ports"))
    new = {
        "sample_ports": F.when(scan, F.slice("ports", 1, 15)), "distinct_ports_count": F.when(scan, distinct), "total_probes": F.when(scan, F.col("probes")),
        "probe_rate_per_sec": F.when(scan, F.round(F.col("probes") / span, 2)), "merged_alerts_count": F.when(many, F.col("n")),
    }
    proof = F.struct(*(F.coalesce(new[k], F.col(f"f.evidence.{k}")).cast(t).alias(k) if k in new else F.col(f"f.evidence.{k}").alias(k) for k, t in EVIDENCE.items()))
    text = F.concat(F.upper(F.col("f.evidence.scan_type")), F.lit(" port scan detected from "), "src", F.lit(": "), distinct.cast("string"), F.lit(" distinct ports targeted in "), F.round(span, 2).cast("string"), F.lit("s"))
    return parts.select(
        "capture", F.col("f.id").alias("id"), "detector", N.severity_of(F.col("severity_rank")).alias("severity"), "severity_rank", "src", F.col("f.dst").alias("dst"), "start_us", "end_us", "score",
        F.when(scan, text).otherwise(F.col("f.summary")).alias("summary"), proof.alias("evidence"), F.col("seen.emit_seq").alias("emit_seq"), F.col("seen.emit_ord").alias("emit_ord"),
    )


def rank_order() -> list[Column]:
    return [F.desc("severity_rank"), F.desc("score"), F.asc("start_us"), F.asc("emit_seq"), F.asc("emit_ord"), F.asc("id")]


#: Seconds of a capture whose alerts are ranked in one task.
RANK_SLICE = 3600


def ranked(alerts: DataFrame) -> DataFrame:
    """Adds each alert's rank in its capture.

    Alerts are ordered within those of their capture, severity, score and hour alone;
    how many go before such a group follows from the groups' sizes.  ``alerts`` is read
    twice, so it had better be a table (``Tables``).
    """
    group = ["capture", "severity_rank", "score", "_hour"]
    own = alerts.withColumn("_hour", F.floor(F.col("start_us") / F.lit(RANK_SLICE * 1_000_000)))
    ahead = Window.partitionBy("capture").orderBy(F.desc("severity_rank"), F.desc("score"), "_hour")
    before = own.groupBy(*group).agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(ahead) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*rank_order()))
    return own.withColumn("_place", place).join(before, group).select(*alerts.columns, (F.col("_before") + F.col("_place")).alias("rank"))


def serialised(alerts: DataFrame) -> DataFrame:
    """Times in seconds, rounded, and evidence as JSON without what is null."""
    s = N.seconds
    return alerts.select(
        "capture", "id", "detector", "severity", "src", "dst", F.round(s(F.col("start_us")), 4).alias("start_ts"), F.round(s(F.col("end_us")), 4).alias("end_ts"),
        F.round(F.greatest(F.lit(0.0), s(F.col("end_us") - F.col("start_us"))), 4).alias("duration_seconds"), F.round("score", 4).alias("score"), "summary", F.to_json("evidence").alias("evidence"),
    )


def grid(alerts: DataFrame, detectors: tuple = DETECTORS) -> DataFrame:
    """detector, severity, n: every pair, those without alerts with 0."""
    dense = alerts.sparkSession.createDataFrame([(d, s) for d in detectors for s in SEVERITIES], "detector string, severity string")
    counts = alerts.groupBy("detector", "severity").agg(F.count("*").alias("n"))
    return dense.join(counts, ["detector", "severity"], "left").select("detector", "severity", F.coalesce("n", F.lit(0)).alias("n"))


def top_scores(alerts: DataFrame, detectors: tuple = DETECTORS) -> DataFrame:
    dense = alerts.sparkSession.createDataFrame([(d,) for d in detectors], "detector string")
    best = alerts.groupBy("detector").agg(F.max("score").alias("score"))
    return dense.join(best, "detector", "left").select("detector", F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score_max"))


def offenders(alerts: DataFrame, k: int) -> DataFrame:
    """The k sources with most alerts: their number, detectors and highest severity; ties to the one ranked first."""
    by = alerts.groupBy("src").agg(
        F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("detector")), ", ").alias("detectors"), F.max("severity_rank").alias("severity_rank"),
        F.min(F.struct(-F.col("severity_rank"), -F.col("score"), F.col("start_us"), F.col("emit_seq"), F.col("emit_ord"), F.col("id"))).alias("first"),
    )
    return by.orderBy(F.desc("n"), F.asc("first")).limit(k).select("src", "n", "detectors", N.severity_of(F.col("severity_rank")).alias("severity"))
