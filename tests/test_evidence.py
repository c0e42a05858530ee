"""What trailing windows tell, from panes, against all rows; and how much is read."""

import random

from pyspark.sql import functions as F

from tidewire.operators import temporal as T


def test_window_evidence_equals_all_rows(spark):
    rnd = random.Random(3)
    rows, us = [], -50_000
    for seq in range(1500):
        us += rnd.choice([0, 1, 3, 40, 700])
        rows.append((seq, us, rnd.choice("ab"), f"v{rnd.randrange(60):02d}", rnd.choice(["x", "y", "z", "w"]), rnd.random()))
    df = spark.createDataFrame(rows, "seq long, us long, k string, v string, h string, top double").repartition(3)
    out = [(q, u, k, rnd.choice([0, 5, 900, 7_777, 20_000])) for q, u, k, *_ in rows if rnd.random() < 0.2]
    emitted = spark.createDataFrame(out, "seq long, us long, k string, w long")
    got = [r for f in (T.window_evidence, T.joined_evidence) for r in f(emitted, df, ["k"], F.col("w"), 20_000, {"vs": (F.col("v"), 4), "hs": (F.col("h"), 2)}, ("top",)).collect()]
    assert len(got) == 2 * len(out)
    for r in got:
        own = [x for x in rows if x[2] == r.k and r.us - r.w <= x[1] <= r.us and (x[1] < r.us or x[0] <= r.seq)]
        assert (r.first, r.top, r.vs, r.hs) == (min(x[1] for x in own), max(x[5] for x in own), sorted({x[3] for x in own})[:4], sorted({x[4] for x in own})[:2])


def test_rows_read_grow_with_rows_and_emissions(spark):
    """A steady scanner that is reported every two seconds: its window of 300 s isn't copied for each report."""
    n = 40_000
    rows = spark.range(n).selectExpr("id as seq", "id * 50000 as us", "'a' as k", "cast(id as string) as v")
    emitted = rows.where("seq % 40 = 39").select("seq", "us", "k")
    joined = T.window_evidence(emitted, rows, ["k"], F.lit(300_000_000), 300_000_000, {"vs": (F.col("v"), 5)})
    joined.write.format("noop").mode("overwrite").save()
    plan = joined._jdf.queryExecution().executedPlan()
    made, todo = [], [plan]
    while todo:
        p = todo.pop()
        if hasattr(p, "finalPhysicalPlan") and "AdaptiveSparkPlan" in p.nodeName():
            p = p.finalPhysicalPlan()
        if "QueryStage" in p.nodeName():
            todo.append(p.plan())
            continue
        if "Join" in p.nodeName():
            made.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    assert made and max(made) < 60 * 1000 + n and 1000 * 6000 > 50 * max(made)  # copies of windows would be 6 million rows


def test_both_ways_give_the_same_alerts(spark, monkeypatch):
    from tests import captures as C
    from tidewire.config import load_config, micros
    from tidewire.operators import detectors as D

    rnd = random.Random(6)
    rows = [(C.T0 + i * 300_000 + rnd.randrange(200_000), {"src_ip": f"s{rnd.randrange(2)}", "dst_ip": f"d{rnd.randrange(9)}", "dst_port": rnd.randrange(90), "tcp_flags": rnd.choice(["S", "", "F", "FPU"])}) for i in range(500)]
    cfg = load_config(overrides={"port_scan": {"min_distinct_ports": 8, "window_seconds": 10, "slow_window_seconds": 120, "slow_min_distinct_ports": 30}})
    p = C.packets(spark, rows).persist()
    swept, got = T.sweeps(p, micros(30)), []
    for copies in (0, 10_000):
        monkeypatch.setattr(D, "COPIES", copies)
        got.append(sorted(map(str, D.port_scan(p, cfg, swept).collect())))
    assert got[0] == got[1] and len(got[0]) > 20
