"""Captures end to end: decoding, detectors, merging, reports, evaluation, command line."""

import json

import pytest
from pyspark.sql import functions as F

from tests import captures as C
from tidewire import cli
from tidewire.config import DEFAULTS, load_config, merged
from tidewire.functions import network as N
from tidewire.plans import report as R
from tidewire.plans.analyze import analyse, analyse_captures
from tidewire.plans.evaluate import evaluate_captures
from tidewire.sources.pcap import capture_stats, find_captures, read_captures, read_captures_anywhere


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    return C.write(tmp_path_factory.mktemp("captures"))


@pytest.fixture(scope="module")
def analysis(spark, files):
    return analyse_captures(spark, *files.values())


def test_config_merges_and_keeps_defaults(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("port_scan: {window_seconds: 5}\nextra: [1]\n")
    cfg = load_config(path, {"port_scan": {"min_distinct_ports": 3}})
    assert cfg["port_scan"]["window_seconds"] == 5 and cfg["port_scan"]["min_distinct_ports"] == 3 and cfg["port_scan"]["slow_min_distinct_ports"] == 40 and cfg["extra"] == [1]
    assert DEFAULTS["port_scan"]["window_seconds"] == 10 and merged({"a": [1]}, {"a": [2]}) == {"a": [2]}
    with pytest.raises(FileNotFoundError):
        load_config(tmp_path / "none.yaml")


def test_functions(spark):
    flags = [r[0] for r in spark.createDataFrame([(b,) for b in (2, 18, 1, 0, 41, None)], "b int").select(N.tcp_flags(F.col("b"))).collect()]
    assert flags == ["S", "SA", "F", "", "FPU", ""]
    got = spark.createDataFrame([("",), ("google",), ("a8f3d9b1c7e42f60ab5e9d3c",)], "s string").select(N.entropy(F.col("s"))).collect()
    assert got[0][0] == 0 and round(got[1][0], 3) == 1.918 and round(got[2][0], 3) == 3.918
    parents = spark.createDataFrame([("example.com",), ("Foo.example.com.",), ("data.tunnel.exfil.org",)], "s string").select(N.parent_domain(F.col("s"))).collect()
    assert [r[0] for r in parents] == ["example.com", "example.com", "exfil.org"]
    auth = spark.createDataFrame([("x Authorization: Basic YWRtaW46cHc= ",), ("proxy-authorization:basic YWRtaW4",), ("AUTHORIZATION: Basic bm9jb2xvbg==",), ("none",)], "p string").select(N.http_basic(F.col("p")).alias("a")).collect()
    assert [r.a.username if r.a else None for r in auth] == ["admin", "unknown", "nocolon", None]
    ftp = spark.createDataFrame([("USER a\r\nUSER b\r\n", 5), ("user c\n", 5), ("User c\n", 5), ("Pass x", 21)], "p string, port int").select(N.ftp_command(F.col("p"), F.lit(9), F.col("port")).alias("a")).collect()
    assert [tuple(r.a) if r.a else None for r in ftp] == [("USER", "b"), ("USER", "c"), None, ("PASS", "***REDACTED***")]


def test_reader_formats_stats_and_breaks(spark, files, tmp_path):
    five = [(C.T0 + i * 10**6, C.tcp("1.1.1.1", "2.2.2.2", 1, 2, 2)) for i in range(5)]
    for n, raw in enumerate((C.classic(five), C.classic(five, ">"), C.classic(five, nanos=True), C.blocks(five))):
        (tmp_path / f"{n}.pcap").write_bytes(raw)
    (tmp_path / "4.pcap").write_bytes(C.classic(five)[:-3])
    (tmp_path / "5.pcap").write_bytes(C.classic([*five, (C.T0, C.tcp("1.1.1.1", "2.2.2.2", 1, 2, 2)[:30])]))
    rows = {r.capture[-6]: r for r in capture_stats(read_captures(spark, str(tmp_path))).collect()}
    assert all(rows[k].valid_packets == 5 and rows[k].duration_seconds == 4.0 for k in "0123")
    assert rows["4"].total_packets == 4 and rows["5"].total_packets == 6 and rows["5"].malformed_packets == 1
    anywhere = read_captures_anywhere(spark, str(tmp_path / "*.pcap"))
    same = read_captures(spark, str(tmp_path)).select("us", "src_ip", "app")
    assert sorted(map(str, anywhere.select("us", "src_ip", "app").collect())) == sorted(map(str, same.collect()))
    with pytest.raises(FileNotFoundError):
        find_captures(str(tmp_path / "nothing"))
    (tmp_path / "bad.bin").write_bytes(b"nonsense")
    with pytest.raises(Exception, match="unable to read capture header"):
        read_captures(spark, str(tmp_path / "bad.bin")).count()


def test_decoder_layers():
    from tidewire.sources.pcap import decode

    vlan = C.tcp("1.2.3.4", "5.6.7.8", 1, 2, 0)
    vlan = vlan[:12] + b"\x81\x00\x00\x05" + vlan[12:]
    assert (d := decode(1, vlan))["src_ip"] == "1.2.3.4" and d["tcp_flags"] == ""
    six = C.ethernet(0x86DD, bytes([0x60, 0, 0, 0, 0, 16, 0, 64]) + bytes(15) + b"\1" + bytes(15) + b"\2" + bytes([17, 0, 0, 0, 0, 0, 0, 0]) + b"\0\7\0\x35\0\x08\0\0")
    assert (d := decode(1, six))["src_ip"] == "::1" and d["proto"] == "UDP" and d["dst_port"] == 53
    assert decode(1, C.ethernet(0x1234, b"zz"))["proto"] == "OTHER" and decode(1, C.ipv4("1.1.1.1", "2.2.2.2", 1, b"12345678"))["proto"] == "ICMP"


def test_expected_alerts_of_fixtures(analysis, files):
    raw = {k: [] for k in files}
    names = {v: k for k, v in files.items()}
    for r in analysis.raw.collect():
        raw[names[r.capture]].append(r)
    assert {k: len(v) for k, v in raw.items()} == {"syn_scan": 1, "xmas_scan": 1, "cleartext_creds": 2, "benign": 0, "arp_spoof": 1, "dns_tunnel": 1}
    scan = raw["syn_scan"][0]
    assert (scan.score, scan.severity, scan.end_us - scan.start_us) == (0.808, "MEDIUM", 950_000) and scan.evidence.distinct_ports_count == 20 and scan.evidence.probe_rate_per_sec == 21.05
    assert scan.summary == "SYN port scan detected from 192.168.56.10: 20 distinct ports targeted across 1 host(s) in 0.95s" and scan.dst == "192.168.56.20" and scan.evidence.sample_ports == list(range(1000, 1010))
    assert raw["xmas_scan"][0].evidence.scan_type == "xmas"
    assert sorted(r.evidence.username for r in raw["cleartext_creds"]) == ["admin", "dev"] and sorted(r.evidence.target_port for r in raw["cleartext_creds"]) == [21, 80]
    arp = raw["arp_spoof"][0]
    assert (arp.severity, arp.score, arp.src, arp.evidence.change_type) == ("HIGH", 0.95, "00:0c:29:ab:cd:ef", "mac_binding_conflict")
    dns = raw["dns_tunnel"][0]
    assert (dns.score, dns.severity, dns.end_us - C.T0, dns.evidence.unique_subdomains_count, dns.evidence.txt_null_queries_count) == (0.8, "HIGH", 1_800_000, 10, 10)
    assert len({r.id for v in raw.values() for r in v}) == 6


def test_secrets_are_nowhere(analysis, tmp_path):
    text = "\n".join(map(str, analysis.packets.collect())) + "".join(R.Report(analysis).json_lines()) + "".join(R.Report(analysis).markdown_lines()) + analysis.packets._jdf.queryExecution().toString()
    assert "s3cretpw" not in text and "hunter2" not in text and "***REDACTED***" in text


def test_reports(analysis):
    own = R.Report(analysis)
    doc = json.loads("".join(own.json_lines()))
    assert doc["summary"]["total_alerts"] == 6 and doc["summary"]["alerts_by_severity"] == {"HIGH": 2, "MEDIUM": 4, "LOW": 0} and doc["alerts"][0]["severity"] == "HIGH"
    assert doc["summary"]["top_offenders"][0] == {"src": "192.168.56.30", "alert_count": 2} and len(doc["alerts"]) == 6
    assert 'tidewire_alerts_total{detector="dns_tunnel",severity="HIGH"} 1' in own.metrics() and 'score_max{detector="ml_anomaly"} 0.0' in own.metrics()
    text = "".join(own.markdown_lines())
    assert "\n6. **MEDIUM" in text and "192.168.56.30 | 2 | MEDIUM" in text


def test_one_call_and_failing_detectors(spark, files, tmp_path, monkeypatch):
    from tidewire.plans import analyze

    found = R.run(spark, files["syn_scan"], out_dir=tmp_path / "one", metrics=tmp_path / "one" / "m.txt")
    assert found.stats["valid_packets"] == 25 and [r.detector for r in found.alerts.collect()] == ["port_scan"] and set(found.reports) == {"json_report", "markdown_report", "metrics_file"}
    assert len(json.loads((tmp_path / "one" / "report.json").read_text())["alerts"]) == 1

    def broken(packets, config, swept):
        raise RuntimeError("broken")

    packets = analyze.read_captures(spark, files["syn_scan"])
    own = {"arp_spoof": analyze.RULES["arp_spoof"], "dns_tunnel": broken}
    with pytest.raises(RuntimeError):
        analyze.detect(packets, load_config(), own)
    assert analyze.detect(packets, load_config(), own, keep_going=True)[0].count() == 0
    assert analyze.detect(packets, load_config(), {"dns_tunnel": broken}, keep_going=True)[0].count() == 0


def test_oversized_records_hide_nothing(monkeypatch):
    import io

    from tidewire.sources import pcap

    monkeypatch.setattr(pcap, "LARGEST", 200)
    packets = [(C.T0, C.tcp("1.1.1.1", "2.2.2.2", 1, 2, 2)), (C.T0 + 1, C.tcp("1.1.1.1", "2.2.2.2", 1, 2, 2, b"x" * 5000)), (C.T0 + 2, C.tcp("1.1.1.1", "2.2.2.2", 1, 3, 2))]
    for raw in (C.classic(packets), C.blocks(packets)):
        f = io.BytesIO(raw)
        rows = [r for b in pcap.batches(f, "c", *pcap.opened(f), None) for r in b.to_pylist()]
        assert [(r["us"] - C.T0, r["dst_port"], r["malformed"]) for r in rows] == [(0, 2, False), (1, None, True), (2, 3, False)]


def test_evaluation_and_commands(spark, files, tmp_path, capsys):
    expect = {"syn_scan": ("port_scan", "192.168.56.10", "syn"), "xmas_scan": ("port_scan", "192.168.56.15", "xmas"), "arp_spoof": ("arp_spoof", "00:0C:29:ab:cd:ef", None), "dns_tunnel": ("dns_tunnel", "192.168.56.99", None)}
    lines = []
    for name, path in files.items():
        lines += [f"- capture: {path}", f"  split: {'held_out' if name in ('arp_spoof', 'dns_tunnel', 'benign') else 'tuning'}"]
        rows = [("cleartext_creds", "192.168.56.30", None)] * 2 if name == "cleartext_creds" else [expect[name]] if name in expect else []
        lines += ["  expected:" + (" []" if not rows else "")] + [f"    - {{detector: {d}, src: '{s}'{f', scan_type: {k}' if k else ''}}}" for d, s, k in rows]
    labels = tmp_path / "labels.yaml"
    labels.write_text("\n".join(lines))
    found = evaluate_captures(spark, labels, load_config())
    assert found.overall == {"tp": 6, "fp": 0, "fn": 0, "precision": 1.0, "recall": 1.0, "f1": 1.0} and found.by_split["held_out"]["tp"] == 2 and found.by_detector["port_scan"]["tp"] == 2
    assert "all                         6 found" in found.table() and json.loads((tmp_path / "e.json").write_text(json.dumps(found.to_dict())) and (tmp_path / "e.json").read_text())["total_captures"] == 6
    assert cli.main(["analyze", files["syn_scan"], "-o", str(tmp_path), "--metrics", str(tmp_path / "m.txt")], spark) == 0
    assert json.loads((tmp_path / "report.json").read_text())["summary"]["total_alerts"] == 1 and (tmp_path / "m.txt").exists() and "[MEDIUM]" in capsys.readouterr().out
    assert cli.main(["analyze", str(tmp_path / "no.pcap")], spark) == 1 and cli.main([], spark) == 1
    model = str(tmp_path / "model")
    assert cli.main(["train", "-b", files["benign"], "-o", model, "--window", "0.5"], spark) == 0
    (tmp_path / "c.yaml").write_text("ml: {window_seconds: 0.5}")
    assert cli.main(["analyze", files["syn_scan"], "-o", str(tmp_path), "-c", str(tmp_path / "c.yaml"), "--ml", "--model", model], spark) == 0
    assert cli.main(["analyze", files["syn_scan"], "-o", str(tmp_path), "--ml", "--model", model], spark) == 1  # windows differ
    assert cli.main(["train", "--baseline", files["arp_spoof"], "--output", model, "--contamination", "0.9"], spark) == 1


def test_several_rules_on_rows(spark):
    s = lambda x: C.T0 + round(x * 1e6)
    rows = [(s(i * 0.2), {"src_ip": "1.1.1.1", "dst_ip": "9.9.9.9", "dst_port": 100 + i, "tcp_flags": f, "capture": n}) for n, f in (("fin", "F"), ("null", None)) for i in range(12)]
    rows += [(s(i), {"src_ip": "1.1.1.1", "dst_ip": "9.9.9.9", "dst_port": (80, 443)[i % 2], "tcp_flags": "S", "capture": "two"}) for i in range(50)]
    rows += [(s(i * 2), {"src_ip": "1.1.1.1", "dst_ip": "9.9.9.9", "dst_port": 200 + i, "tcp_flags": "S", "capture": "slow"}) for i in range(12)]
    cfg = load_config(overrides={"port_scan": {"min_distinct_ports": 10, "window_seconds": 5, "slow_min_distinct_ports": 10, "slow_window_seconds": 60}})
    found = analyse(C.packets(spark, rows), cfg).raw.select("capture", "evidence.scan_type").collect()
    assert {r.capture: r.scan_type for r in found} == {"fin": "fin", "null": "null", "slow": "slow_syn"} and sum(r.capture == "slow" for r in found) == 3


def test_merge_keeps_first_and_sums_probes(spark):
    from tidewire.operators.alerts import merge
    from tidewire.schema import ALERTS, EVIDENCE

    def scan(start, end, n, probes, severity, score, seq):
        ev = {**dict.fromkeys(EVIDENCE), "scan_type": "syn", "distinct_ports_count": n, "total_probes": probes, "sample_ports": list(range(n))}
        return ("c", f"id{seq}", "port_scan", severity, {"HIGH": 3, "MEDIUM": 2}[severity], "a", None, start * 10**6, end * 10**6, score, "text", tuple(ev.values()), seq, 0)

    rows = spark.createDataFrame([scan(10, 15, 8, 20, "MEDIUM", 0.8, 1), scan(18, 25, 10, 30, "HIGH", 0.95, 2), scan(40, 41, 8, 1, "MEDIUM", 0.8, 3)], ALERTS)
    out = {r.id: r for r in merge(rows, 10 * 10**6).collect()}
    assert set(out) == {"id1", "id3"} and out["id3"].summary == "text" and out["id3"].evidence.merged_alerts_count is None
    a = out["id1"]
    assert (a.start_us, a.end_us, a.severity, a.score, a.evidence.total_probes, a.evidence.merged_alerts_count, a.evidence.distinct_ports_count) == (10 * 10**6, 25 * 10**6, "HIGH", 0.95, 50, 2, 10)


def test_feature_values(spark):
    from tidewire.operators.features import flow_windows

    rows = [
        (1_000_000, {"src_ip": "a", "dst_ip": "b", "src_port": 1, "dst_port": 80, "tcp_flags": "S", "length": 60}), (2_000_000, {"src_ip": "a", "dst_ip": "b", "src_port": 1, "dst_port": 80, "tcp_flags": "A", "length": 100}),
        (3_000_000, {"src_ip": "a", "dst_ip": "d", "src_port": 2, "dst_port": 53, "proto": "UDP", "length": 80, "dns": (0, 0, 0, "x.org", 1)}), (4_000_000, {"src_ip": "b", "dst_ip": "a", "src_port": 80, "dst_port": 1, "tcp_flags": "SA", "length": 60}),
        (11_000_000, {"src_ip": "a", "dst_ip": "a", "src_port": 1, "dst_port": 80, "tcp_flags": "S", "length": 10}),
    ]
    got = {(r.src_ip, r.window_start): r for r in flow_windows(C.packets(spark, rows), 10.0).collect()}
    a = got["a", 0.0]
    assert (a.connections_per_minute, a.distinct_dst_ips, a.distinct_dst_ports, a.syn_count, a.syn_to_synack_ratio, a.bytes_sent_received_ratio, a.mean_packet_length, a.dns_queries_per_minute) == (12, 2, 2, 1, 1, 4, 80, 6)
    assert got["a", 10.0].bytes_sent_received_ratio == 10 and set(got) == {("a", 0.0), ("b", 0.0), ("a", 10.0)}
    with pytest.raises(ValueError):
        flow_windows(C.packets(spark, rows), 0)
