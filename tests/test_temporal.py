"""Temporal operators against sequential models of their definitions, batch and stream."""

import random

import pytest
from pyspark.sql import functions as F

from tests import captures as C
from tidewire.config import load_config, micros
from tidewire.operators import detectors as D
from tidewire.operators import temporal as T
from tidewire.store import Tables
from tidewire.streaming import detectors as S


def rows_of(seed, n=400, keys=3, span=200):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(span), str(rnd.randrange(keys)), rnd.randrange(12)) for _ in range(n)]
    return [(q, us, k, v) for q, (us, k, v) in enumerate(sorted(rows, key=lambda r: r[0]))]


@pytest.mark.parametrize("width", [1, 7, 40, 500])
def test_trailing(spark, width):
    rows = rows_of(width)
    df = spark.createDataFrame(rows, "seq long, us long, k string, v int")
    got = {r.seq: (r.n, r.s, r.d) for r in T.trailing(df, ["k"], width, sums={"n": F.lit(1), "s": F.col("v")}, distinct={"d": "v"}).collect()}
    for q, us, k, _ in rows:
        frame = [v for q2, u2, k2, v in rows if k2 == k and q2 <= q and u2 >= us - width]
        assert got[q] == (len(frame), sum(frame), len(set(frame)))


@pytest.mark.parametrize("gap", [0, 3, 25])
def test_throttle(spark, gap):
    rows = rows_of(gap + 50)
    df = spark.createDataFrame(rows, "seq long, us long, k string, v int")
    last, expect = {}, set()
    for q, us, k, _ in rows:
        if k not in last or us - last[k] > gap:
            last[k] = us
            expect.add(q)
    assert {r.seq for r in T.throttle(df, ["k"], gap).collect()} == expect


def test_throttle_boundary(spark):
    df = spark.createDataFrame([(n, t, "a") for n, t in enumerate((0, 50, 100, 150, 161))], "seq long, us long, k string")
    assert sorted(r.us for r in T.throttle(df, ["k"], 60).collect()) == [0, 100, 161]


def test_growth_throttle(spark):
    rnd = random.Random(3)
    rows = [(q, us, "ab"[rnd.randrange(2)], rnd.choice([0, rnd.randrange(1, 60)]), rnd.choice([0, rnd.randrange(1, 60)])) for q, us in enumerate(sorted(rnd.randrange(300) for _ in range(300)))]
    rows = [r for r in rows if r[3] or r[4]]
    state, expect = {}, set()
    for q, us, k, fast, slow in rows:
        for kind, n in (("fast", fast), ("slow", slow)):
            if n and not (k in state and us - state[k][0] < 4 and n < 1.5 * state[k][1]):
                state[k] = (us, n)
                expect.add((q, kind))
                break
    df = spark.createDataFrame(rows, "seq long, us long, k string, fast_n long, slow_n long")
    assert {(r.seq, r.kind) for r in T.growth_throttle(df, ["k"], 4).collect()} == expect


def test_epochs_follow_sweeps(spark):
    rnd = random.Random(9)
    rows = [(q, us, "c", str(rnd.randrange(4))) for q, us in enumerate(sorted(rnd.randrange(1, 1500) for _ in range(150)))]
    df = spark.createDataFrame(rows, "seq long, us long, capture string, k string")
    alive, last_sweep, epoch, expect = {}, None, {}, {}
    for q, us, _, k in rows:
        if last_sweep is None:
            last_sweep = us
        elif us - last_sweep >= 30:
            last_sweep = us
            alive = {x: t for x, t in alive.items() if t >= us - 60}
        if k in epoch and k not in alive:
            epoch[k] += 1
        epoch.setdefault(k, 0)
        alive[k] = us
        expect[q] = epoch[k]
    assert {r.seq: r.epoch for r in T.with_epochs(df, ["capture", "k"], T.sweeps(df, 30), 60).collect()} == expect and max(expect.values()) > 0


def test_arp_eviction_forgets_the_binding(spark):
    arp = lambda us, mac: (us * 10**6, {"proto": "ARP", "arp": (2, mac, "10.0.0.1", "x", "10.0.0.2", False)})
    other = lambda us: (us * 10**6, {"src_ip": "9.9.9.9", "dst_port": 1, "tcp_flags": "A"})
    cfg = load_config()
    for rows, n in (([arp(1, "m1"), arp(40, "m2")], 1), ([arp(1, "m1"), other(200), other(340), arp(350, "m2")], 0)):
        p = C.packets(spark, rows)
        assert D.arp_spoof(p, cfg, T.sweeps(p, micros(30))).count() == n


def test_login_session_expires(spark):
    ftp = lambda us, cmd, arg: (us * 10**6, {"src_ip": "a", "dst_ip": "b", "dst_port": 21, "ftp_cmd": (cmd, arg)})
    p = C.packets(spark, [ftp(1, "USER", "u"), ftp(5, "PASS", "x"), ftp(400, "PASS", "x"), (500 * 10**6, {"src_ip": "a", "dst_ip": None, "dst_port": 0, "http_auth": ("h", "x")})])
    got = sorted((r.start_us // 10**6, r.evidence.username, r.evidence.target_port, r.dst) for r in D.cleartext_creds(p, load_config(), T.sweeps(p, micros(30))).collect())
    assert got == [(5, "u", 21, "b"), (400, "unknown", 21, "b"), (500, "h", 80, "unknown")]
    assert D.cleartext_creds(p, load_config(overrides={"cleartext_creds": {"enabled": False}}), T.sweeps(p, micros(30))).count() == 0


def run_stream(spark, df, folder, make):
    df.orderBy("us").coalesce(1).write.parquet(str(folder / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(df.schema).parquet(str(folder / "in"))
    q = make(stream).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.read.parquet(str(folder / "out"))


def test_streams_equal_batch(spark, tmp_path):
    rnd = random.Random(4)
    cfg = load_config(overrides={"port_scan": {"min_distinct_ports": 5, "window_seconds": 10, "slow_window_seconds": 60, "slow_min_distinct_ports": 12}})
    scans = [(C.T0 + i * 400_000, {"src_ip": f"s{rnd.randrange(2)}", "dst_ip": "d", "dst_port": rnd.randrange(30), "tcp_flags": "S"}) for i in range(120)]
    arps = [(C.T0 + i * 5_000_000, {"proto": "ARP", "src_ip": "x", "arp": (2, f"m{rnd.randrange(3)}", f"10.0.0.{rnd.randrange(2)}", "h", "p", False)}) for i in range(60)]
    p = C.packets(spark, sorted(scans + arps, key=lambda r: r[0])).persist()
    swept = T.sweeps(p, micros(30))
    batch = D.scan_emissions(D.probes(p), cfg, ["capture", "src_ip"])
    stream = run_stream(spark, p, tmp_path / "scan", lambda s: S.scan_emissions(s, cfg))
    assert sorted((r.seq, r.kind) for r in stream.collect()) == sorted((r.seq, r.kind) for r in batch.collect()) != []
    batch = D.arp_spoof(p, cfg, swept)
    stream = run_stream(spark, p, tmp_path / "arp", lambda s: S.arp_changes(s, cfg))
    assert sorted((r.seq, r.was) for r in stream.collect()) == sorted((r.emit_seq, r.evidence.original_mac) for r in batch.collect()) != []


def test_streams_of_names_and_logins_equal_batch(spark, tmp_path):
    rnd = random.Random(7)
    cfg = load_config(overrides={"dns_tunnel": {"min_unique_subdomains": 6, "window_seconds": 20}})
    name = lambda: "".join(rnd.choice("abcdef0123456789") for _ in range(rnd.choice([4, 12, 44]))) + rnd.choice([".x.org", ".y.org"])
    asked = [(C.T0 + i * 700_000, {"proto": "UDP", "src_ip": f"s{rnd.randrange(2)}", "dst_ip": "d", "dst_port": 53, "dns": (0, 0, 0, name(), rnd.choice([1, 16]))}) for i in range(150)]
    said = [(C.T0 + i * 9_000_000 + 1, {"src_ip": f"c{rnd.randrange(2)}", "dst_ip": "f", "dst_port": 21, "ftp_cmd": rnd.choice([("USER", f"u{rnd.randrange(2)}"), ("PASS", "x")])}) for i in range(60)]
    said += [(C.T0 + i * 11_000_000 + 2, {"src_ip": f"c{rnd.randrange(2)}", "dst_ip": "f", "dst_port": 80, "http_auth": (f"h{rnd.randrange(2)}", "x")}) for i in range(40)]
    p = C.packets(spark, sorted(asked + said, key=lambda r: r[0])).persist()
    swept = T.sweeps(p, micros(30))
    batch = D.throttle(D.dns_trips(D.dns_queries(p, cfg), cfg, ["capture", "src_ip", "parent"]), ["capture", "src_ip", "parent"], micros(D.DNS_MUTE))
    pick = lambda df: sorted((r.seq, r.names, r.records, r.total, r.single, r.volume, r.record) for r in df.collect())
    assert pick(run_stream(spark, p, tmp_path / "dns", lambda s: S.dns_emissions(s, cfg))) == pick(batch) != []
    batch = D.cleartext_creds(p, cfg, swept)
    stream = run_stream(spark, p, tmp_path / "login", lambda s: S.logins(s, cfg))
    assert sorted((r.seq, r.protocol, r.username) for r in stream.collect()) == sorted((r.emit_seq, r.evidence.protocol, r.evidence.username) for r in batch.collect()) != []


def test_order_statistics(spark, monkeypatch):
    from tidewire.operators import features as X

    rnd = random.Random(5)
    monkeypatch.setattr(X, "BUCKETS", 4)
    a = [rnd.choice([0.0, 1.5, rnd.random(), 1e12 * rnd.random(), -rnd.random()]) for _ in range(700)]
    b = [3.0] * 650 + [rnd.random() for _ in range(50)]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double").repartition(3)
    ranks = [0, 1, 49, 50, 349, 350, 698, 699]
    got = X.order_statistics(df, {"a": ranks, "b": ranks})
    assert got == {(c, k): sorted(v)[k] for c, v in (("a", a), ("b", b)) for k in ranks}


def test_sweep_clock_over_many_slices(spark, monkeypatch):
    rnd = random.Random(3)
    monkeypatch.setattr(T, "CLOCK_SLICE", 3)
    rows, want = [], []
    for c in range(6):
        us, last = 5, None
        for _ in range(300):
            us += rnd.randrange(1, (4, 20, 70, 500, 2, 90)[c])
            rows.append((f"c{c}", us))
            if last is None or us - last >= 50:
                if last is not None:
                    want.append((f"c{c}", us))
                last = us
    got = T.sweeps(spark.createDataFrame(rows, "capture string, us long").repartition(4), 50)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_stream_features_of_closed_windows(spark, tmp_path):
    from tidewire.operators.features import flow_windows

    rows = [(C.T0 + i * 7_000_000, {"src_ip": f"a{i % 2}", "dst_ip": f"b{i % 3}", "src_port": i % 5, "dst_port": i % 4, "tcp_flags": ("S", "SA", "A")[i % 3], "length": 40 + i}) for i in range(60)]
    p = C.packets(spark, rows).persist()
    stream = run_stream(spark, p, tmp_path, lambda s: S.flow_windows(s, 60, "0 seconds"))
    got, want = {str(r) for r in stream.collect()}, {str(r) for r in flow_windows(p, 60.0).collect()}
    assert got <= want and len(want) - len(got) <= 5  # the last window is still open


def test_places_without_a_single_task(spark):
    own = Tables(spark)
    values = [None, None] + [(k * 7919) % 1000 for k in range(3000)]
    df = spark.createDataFrame([(v, n) for n, v in enumerate(values)], "v long, n long").repartition(6)
    got = own.numbered(df, "v", "n")
    key = lambda r: (r.v is not None, r.v or 0, r.n)
    rows = got.collect()
    assert [r.idx for r in sorted(rows, key=key)] == list(range(1, len(values) + 1)) and got.columns == ["v", "n", "idx"]
    tied = own.numbered(df.select("v"), "v").collect()
    assert [r.v for r in sorted(tied, key=lambda r: r.idx)] == sorted(values, key=lambda v: (v is not None, v or 0)) and {r.idx for r in tied} == {r.idx for r in rows}
    assert own.numbered(df.where("false"), "v").count() == 0
    own.close()


def test_no_sweeps_where_nothing_outlasts_the_ttl(spark, monkeypatch):
    from tidewire.plans import queries
    from tidewire.sources import tables

    p = tables.login_packets(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(T, "sweeps", lambda *a: pytest.fail("sweeps were computed"))
    assert queries.swept(p, queries.settings()) is None
    monkeypatch.undo()
    cfg = queries.settings(state_ttl_seconds=3 * queries.DAY)
    sweeps = queries.swept(p, cfg)
    assert sweeps.count() > 0
    many = {"state_ttl_seconds": 10_000 * queries.DAY}
    told = [sorted(map(tuple, D.credentials(p, queries.settings(**many), s).collect())) for s in (None, sweeps)]
    assert told[0] == told[1] and len(told[0]) > 100


def test_a_fold_passes_runs_of_keys_as_lists(spark):
    """Keys may be null, cross batches, and be as many as rows."""
    rows = [(None if n % 5 == 0 else f"k{n % 40}", n // 40, n, n * 7) for n in range(2000)]
    df = spark.createDataFrame(rows, "a string, b long, seq long, us long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        want, last = [], {}
        got = T.throttle(df, ["a"], 700).collect()
        for a, b, seq, us in rows:
            if a not in last or us - last[a] > 700:
                last[a] = us
                want.append(seq)
        assert sorted(r.seq for r in got) == want
        assert T.throttle(df, ["a", "b"], 10**9).count() == len({r[:2] for r in rows})
        out = T._folded(df, ["a", "b"], ["us"], lambda state, times: (None, ["x"] * len(times)), "kind")
        assert out.count() == 2000 and out.where("kind = 'x'").count() == 2000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
