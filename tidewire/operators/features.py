"""Traffic features of an endpoint in fixed time windows."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.schema import FEATURES


def flow_windows(packets: DataFrame, window_seconds: float = 60.0) -> DataFrame:
    """capture, src_ip, window_start, window_end and the features of each endpoint and window in which it sent.

    A packet counts as sent for its source and as received for its destination, unless
    they are one.  Both roles go through one aggregation, combined before the shuffle,
    so a busy endpoint costs a row a task.
    """
    if window_seconds <= 0:
        raise ValueError("window_seconds must be positive")
    w = F.lit(float(window_seconds))
    flags = F.coalesce("tcp_flags", F.lit(""))
    tcp = F.col("proto") == "TCP"
    syn, ack = F.contains(flags, F.lit("S")), F.contains(flags, F.lit("A"))
    dns = (F.col("proto") == "UDP") & (F.col("dst_port") == 53) & (F.coalesce("app.dns.qname", F.lit("")) != "") & (F.col("app.dns.qr") == 0)
    own = packets.select(
        "capture", "src_ip", "dst_ip", (F.floor(F.col("ts") / w) * w).alias("window_start"), F.col("length").cast("long").alias("length"),
        F.struct("proto", "dst_ip", "src_port", "dst_port").alias("connection"), "dst_port",
        (tcp & syn & ~ack).alias("syn"), (tcp & syn & ack).alias("synack"), F.coalesce(dns, F.lit(False)).alias("dns"),
    )
    sent = own.where("src_ip <> ''").withColumn("ip", F.col("src_ip")).withColumn("out", F.lit(True))
    received = own.where("dst_ip <> '' and (src_ip is null or dst_ip <> src_ip)").withColumn("ip", F.col("dst_ip")).withColumn("out", F.lit(False))
    out, back = F.col("out"), ~F.col("out")
    both = sent.unionByName(received)
    counts = both.groupBy("capture", "ip", "window_start").agg(
        F.count_if(out).alias("packets"), F.sum(F.when(out, F.col("length"))).alias("sent"), F.sum(F.when(back, F.col("length"))).alias("received"),
        F.count_if(out & F.col("syn")).alias("syn"), F.count_if(back & F.col("synack")).alias("synack"), F.count_if(out & F.col("dns")).alias("dns"),
    ).where("packets > 0")

    # Distinct values are made so in a first aggregation, so no task holds all of an endpoint's connections.
    kinds = F.array(
        F.struct(F.lit(0).alias("k"), F.to_json("connection").alias("v")), F.struct(F.lit(1).alias("k"), F.when(F.col("dst_ip") != "", F.col("dst_ip")).alias("v")), F.struct(F.lit(2).alias("k"), F.col("dst_port").cast("string").alias("v"))
    )
    values = sent.select("capture", "ip", "window_start", F.explode(kinds).alias("x")).where("x.v is not null").distinct()
    sizes = values.groupBy("capture", "ip", "window_start").agg(*(F.count_if(F.col("x.k") == n).alias(name) for n, name in enumerate(("connections", "ips", "ports"))))
    joined = counts.join(sizes, ["capture", "ip", "window_start"])
    minutes = w / 60.0
    received = F.greatest(F.coalesce("received", F.lit(0)), F.lit(1))
    values = (
        F.col("connections") / minutes, F.col("ips"), F.col("ports"), F.col("syn"), F.col("syn") / F.greatest("synack", F.lit(1)),
        F.col("sent") / received, F.col("sent") / F.col("packets"), F.col("dns") / minutes,
    )
    return joined.select("capture", F.col("ip").alias("src_ip"), "window_start", (F.col("window_start") + w).alias("window_end"), *(F.round(v.cast("double"), 6).alias(n) for n, v in zip(FEATURES, values)))


#: Buckets of a histogram in which a rank is looked for.
BUCKETS = 1 << 12


def order_statistics(df: DataFrame, ranks: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """(column, rank from 0): the value of that rank in a column of finite doubles without nulls, exactly.

    A histogram tells in which bucket a rank lies; the values of that bucket alone then
    make the next histogram, until they are all alike.  So no task and no driver holds
    more than BUCKETS counts a rank, however many values there are.
    """
    values = F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in ranks))
    rows = df.select(F.explode(values).alias("x")).select("x.c", "x.v")
    ends = {r["c"]: (r["lo"], r["hi"]) for r in rows.groupBy("c").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    sought, out = [(c, k, *ends[c], 0) for c, own in ranks.items() for k in sorted(set(own))], {}
    while sought:
        out |= {(c, k): lo for c, k, lo, hi, _ in sought if lo == hi}
        sought = [x for x in sought if x[2] != x[3]]
        if sought:
            goal = F.broadcast(df.sparkSession.createDataFrame(sought, "c string, k long, lo double, hi double, before long"))  # a row a rank
            bucket = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS), F.lit(BUCKETS - 1))
            counts = rows.join(goal, "c").where("v between lo and hi").groupBy("c", "k", "before", bucket.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            upto = F.col("before") + F.sum("n").over(Window.partitionBy("c", "k").orderBy("b"))
            hit = counts.withColumn("upto", upto).where("upto > k and upto - n <= k")
            sought = [(r["c"], r["k"], r["lo"], r["hi"], r["upto"] - r["n"]) for r in hit.collect()]
    return out


def baseline(windows: DataFrame) -> DataFrame:
    """feature, median, scale: a row a feature; the scale is the population deviation, 1e-6 at least."""
    windows = windows.persist(StorageLevel.MEMORY_AND_DISK)
    stats = windows.agg(F.count("*").alias("n"), *(F.greatest(F.stddev_pop(f), F.lit(1e-6)).alias(f) for f in FEATURES)).first()
    n = stats["n"]
    found = order_statistics(windows, {f: [(n - 1) // 2, n // 2] for f in FEATURES}) if n else {}
    windows.unpersist()
    rows = [(f, (found[f, (n - 1) // 2] + found[f, n // 2]) / 2 if n else None, stats[f]) for f in FEATURES]
    return windows.sparkSession.createDataFrame(rows, "feature string, median double, scale double")


def contributors(medians: list[float], scales: list[float], k: int = 3) -> Column:
    """The k features that deviate most from the baseline, ties to the later feature."""
    rows = F.array(*(
        F.struct((F.abs((F.col(f) - F.lit(m)) / F.lit(max(s, 1e-6)))).alias("d"), F.lit(n).alias("n"), F.lit(f).alias("f"), F.col(f).cast("double").alias("v"), F.lit(float(m)).alias("m"))
        for n, (f, m, s) in enumerate(zip(FEATURES, medians, scales))
    ))
    top = F.slice(F.sort_array(rows, asc=False), 1, k)
    return F.transform(top, lambda x: F.struct(x["f"].alias("feature"), F.round(x["v"], 4).alias("value"), F.round(x["m"], 4).alias("baseline_median"), F.round(x["d"], 3).alias("deviation")))
