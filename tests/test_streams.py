"""Streams that merge alerts, keep late rows apart, and are restarted."""

import random

import pytest
from pyspark.sql import functions as F

from tests import captures as C
from tests.test_temporal import run_stream
from tidewire.functions import network as N
from tidewire.operators import alerts as A
from tidewire.plans import evaluate
from tidewire.schema import ALERTS, EVIDENCE
from tidewire.streaming.alerts import BatchTable, merged, stored


def raw_alerts(seed, n=120):
    rnd, rows, us = random.Random(seed), [], C.T0
    for seq in range(n):
        us += rnd.choice([1, 4, 30]) * 10**6
        scan = rnd.random() < 0.6
        ev = dict.fromkeys(EVIDENCE) | ({"scan_type": rnd.choice(["syn", "fin"]), "distinct_ports_count": rnd.randrange(5, 40), "total_probes": rnd.randrange(50), "sample_ports": sorted(rnd.sample(range(60), rnd.randrange(1, 10))), "sample_target_hosts": ["a"]} if scan else {"victim_ip": "10.0.0.1"})
        sev = rnd.choice([2, 3])
        rows.append(("c", f"id{seq}", "port_scan" if scan else "arp_spoof", {2: "MEDIUM", 3: "HIGH"}[sev], sev, f"s{rnd.randrange(3)}", rnd.choice([None, "d"]), us - (rnd.randrange(3) * 10**6 if scan else 0), us, rnd.random(), f"text {seq}", tuple(ev.values()), seq, 0 if scan else 3))
    return rows, us


def test_merged_alerts_of_a_stream_equal_batch(spark, tmp_path):
    rows, end = raw_alerts(1)
    far = ("c", "far", "dns_tunnel", "HIGH", 3, "x", None, end + 10**9, end + 10**9, 1.0, "far", tuple(dict.fromkeys(EVIDENCE).values()), 999, 4)
    df = spark.createDataFrame([*rows, far], ALERTS)
    gap = 20 * 10**6
    got = run_stream(spark, df.withColumn("us", F.col("end_us")), tmp_path, lambda s: merged(s.drop("us"), gap, 3 * 10**6, "0 seconds"))
    want = A.merge(df.where("id <> 'far'"), gap)
    assert sorted(map(str, got.where("id <> 'far'").collect())) == sorted(map(str, want.collect())) and 10 < want.count() < len(rows)


def test_a_killed_stream_gives_the_same_table_and_keeps_late_rows(spark, tmp_path):
    schema, src = "us long, v int", tmp_path / "in"
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{n}")
    for n, rows in enumerate(([(100 * 10**6, 1), (200 * 10**6, 2)], [(150 * 10**6, 3), (139 * 10**6, 4), (300 * 10**6, 5)], [(239 * 10**6, 6), (241 * 10**6, 7)])):
        put(n, rows)
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    args = (f"file://{tmp_path}/out", f"file://{tmp_path}/cp")

    def die(batch, number):
        if number == 1:
            raise RuntimeError("killed")

    q = stored(read(), *args, late_after="60 seconds", then=die)
    with pytest.raises(Exception, match="killed"):
        q.awaitTermination(120)
    q = stored(read(), *args, late_after="60 seconds")  # batch 1 was written, but not committed
    q.awaitTermination(120)
    assert q.exception() is None
    rows, late = (BatchTable(spark, f"file://{tmp_path}/out/{k}").read(schema) for k in ("rows", "late"))
    assert sorted(r.v for r in rows.collect()) == [1, 2, 3, 5, 7] and sorted(r.v for r in late.collect()) == [4, 6]


def test_large_allowlists_equal_small_ones(spark, monkeypatch):
    rnd = random.Random(1)
    names = [".".join(rnd.choice(["a", "B", "c", "com", "org", "x1"]) for _ in range(rnd.randrange(1, 5))) + rnd.choice(["", "."]) for _ in range(300)]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "qname string, seq int").withColumn("parent", N.parent_domain(F.col("qname")))
    domains = ["A.com", "b.org.", "c.x1.com", "org", "x1.a.b.c"]
    small = {r.seq for r in N.without_allowed(df, "qname", "parent", domains).collect()}
    monkeypatch.setattr(N, "FEW_DOMAINS", 0)
    assert {r.seq for r in N.without_allowed(df, "qname", "parent", domains).collect()} == small and 0 < len(small) < 300
    many = N.without_allowed(df, "qname", "parent", domains + [f"d{n}.example" for n in range(200_000)])
    assert {r.seq for r in many.collect()} == small


def test_matching_of_many_candidates_equals_the_loop(spark):
    n = 1000
    labels = spark.range(n).selectExpr("'c' as capture", "'all' as split", "cast(id as int) as idx", "'port_scan' as detector", "if(id % 10 = 0, 'B', 'a') as src", "if(id % 3 = 0, 'syn', '') as scan_type", "cast(null as double) as start", "cast(null as double) as end")
    alerts = spark.range(1200).selectExpr("'c' as capture", "cast(id + 1 as int) as rank", "'port_scan' as detector", "if(id % 4 = 0, 'b', 'A') as src", "named_struct('scan_type', if(id % 2 = 0, 'slow_syn', 'fin')) as evidence", "0L as start_us", "0L as end_us")
    pairs = evaluate.candidates(labels, alerts).select("idx", "rank").collect()
    taken, done, want = set(), set(), set()
    for idx, rank in sorted(map(tuple, pairs)):
        if idx not in done and rank not in taken:
            done.add(idx)
            taken.add(rank)
            want.add((idx, rank))
    assert len(pairs) > 500_000 and {(r.idx, r.rank) for r in evaluate.match(labels, alerts).collect()} == want
