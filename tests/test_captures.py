"""The columnar, splittable capture reader against a plain one."""

import io
import random
import struct

import pytest

from tests import captures as C
from tests.plain_pcap import packet_rows
from tidewire.schema import PACKETS
from tidewire.sources import pcap
from tidewire.sources.pcap import boundary, opened, read_captures, spans

NAMES = [x.split()[0] for x in PACKETS.split(", ") if not x.startswith("struct")][:13] + ["app", "malformed"]


def flat(v):
    return tuple(flat(x) for x in v.values()) if isinstance(v, dict) else tuple(map(flat, v)) if isinstance(v, tuple) else v


def columnar(raw, mask=False):
    f = io.BytesIO(raw)
    fmt, first = opened(f)
    rows = [r for b in pcap.batches(f, "c", fmt, first, None, mask) for r in b.to_pylist()]
    assert [r["seq"] for r in rows] == sorted({r["seq"] for r in rows})
    return [tuple(flat(r[k]) for k in NAMES if k != "seq") for r in rows]


def plain(raw, mask=False):
    return [tuple(flat(v) for v, k in zip(r, NAMES) if k != "seq") for r in packet_rows(io.BytesIO(raw), "c", mask)]


def v6(protocol, body, chain=b""):
    return C.ethernet(0x86DD, struct.pack(">IHBB", 6 << 28, len(chain + body), protocol, 64) + bytes(15) + b"\1" + b"\xfe\x80" + bytes(13) + b"\2" + chain + body)


def traffic(seed, n):
    """Packets of every kind, some cut short, some with bytes changed."""
    rnd = random.Random(seed)
    address = lambda: ".".join(str(rnd.randrange(256)) for _ in range(4))
    tcp_head = lambda p=b"": struct.pack(">HHIIBBHHH", rnd.randrange(65536), rnd.choice([80, 21, 53, 443]), 0, 0, 0x50, rnd.randrange(256), 1, 0, 0) + p
    makers = [
        lambda: C.tcp(address(), address(), rnd.randrange(65536), rnd.choice([80, 21, 53, 5353, 443]), rnd.randrange(256), rnd.choice([b"", b"x", b"USER bob\r\nPASS s\r\n", b"pass q", b"GET /\r\nAUTHORIZATION: basic YWRtaW46cHc=\r\n", b"Authorization: Basic YWRtaW4=", b"authorization none"])),
        lambda: C.udp(address(), address(), rnd.randrange(65536), rnd.choice([53, 5353, 9]), rnd.choice([b"", b"zz", C.dns_query("a.b.example.org", 16), b"USER x"])),
        lambda: C.arp(rnd.choice([1, 2]), "00:00:00:00:00:05", rnd.choice(["1.2.3.4", "5.6.7.8"]), rnd.choice(["ff:ff:ff:ff:ff:ff", "00:00:00:00:00:00", "00:00:00:00:00:07"]), "1.2.3.4"),
        lambda: C.ipv4(address(), address(), rnd.choice([1, 2, 47]), b"12345678"),
        lambda: v6(6, tcp_head(b"hello")), lambda: v6(17, struct.pack(">HHHH", 7, 53, 8 + 4, 0) + b"abcd"), lambda: v6(58, b"icmp six"), lambda: v6(0, tcp_head(), bytes([6, 0]) + bytes(6)), lambda: v6(44, tcp_head(), bytes([6, 0, 0, 8]) + bytes(4)),
        lambda: C.ethernet(0x1234, b"other"),
        lambda: (lambda p: p[:12] + b"\x81\x00\x00\x05" * rnd.randrange(1, 4) + p[12:])(C.tcp(address(), address(), 1, 2, 18)),
        lambda: (lambda p: p[:20] + struct.pack(">H", rnd.randrange(1, 0x2000)) + p[22:])(C.udp(address(), address(), 1, 53, b"fragment")),
        lambda: (lambda p: p[:14] + b"\x46" + p[15:])(C.tcp(address(), address(), 1, 2, 2, b"options follow")),
    ]
    out = []
    for i in range(n):
        p = rnd.choice(makers)()
        if rnd.random() < 0.2:
            p = p[: rnd.randrange(len(p) + 1)]
        if rnd.random() < 0.1 and p:
            at = rnd.randrange(len(p))
            p = p[:at] + bytes([rnd.randrange(256)]) + p[at + 1 :]
        out.append((C.T0 + i * 977, p))
    return out


@pytest.mark.parametrize("link", [1, 113, 101, 0, 147])
def test_columns_equal_the_plain_reader(link, monkeypatch):
    packets = traffic(link, 4000)
    cut = {1: 0, 113: 0, 101: 14, 0: 10, 147: 0}[link]
    packets = [(us, (b"\0\0" + p if link == 113 else p)[cut:]) for us, p in packets]
    for chunk in (1 << 22, 700):
        monkeypatch.setattr(pcap, "CHUNK", chunk)
        for order, nanos in (("<", False), (">", True)):
            raw = C.classic(packets, order, nanos)
            raw = raw[:20] + struct.pack(order + "I", link) + raw[24:]
            for whole in (raw, raw[:-7]):
                assert columnar(whole, nanos) == plain(whole, nanos)
        raw = C.blocks(packets)
        raw = raw[:36] + struct.pack("<H", link) + raw[38:]
        assert columnar(raw) == plain(raw) and columnar(raw[:-3]) == plain(raw[:-3])


def test_spans_give_the_same_rows_for_every_size(spark, tmp_path):
    packets = traffic(9, 1500)
    middle = C.blocks(packets[:700])
    face = struct.pack("<II", 1, 28) + struct.pack("<HHI", 1, 0, 65535) + struct.pack("<HHB3xI", 9, 1, 3, 0)[:8] + struct.pack("<I", 28)
    files = {"a.pcap": C.classic(packets), "b.pcap": C.classic(packets, ">", True)[:-5], "c.pcapng": middle + face + C.blocks(packets[700:]), "d.pcapng": C.blocks(packets) + face + C.blocks(packets[:900])[48:]}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    rows = lambda split: read_captures(spark, str(tmp_path), split=split, reach=4096)
    want = sorted(map(str, rows(0).collect()))
    assert len(want) == 1500 + 1499 + 1500 + 2400
    for split in (6_000, 20_011, 50_000):
        assert sorted(map(str, rows(split).collect())) == want
    with open(tmp_path / "a.pcap", "rb") as f:
        fmt, first = opened(f)
        own = spans(str(tmp_path / "a.pcap"), 6_000, None)
        assert sum(s.ends(f, fmt, first, 4096)[0] is not None for s in own) > 0.6 * len(own) > 10
    one = spark.read.format("pcap").option("splitBytes", 9000).option("reachBytes", 4096).load(str(tmp_path / "a.pcap"))
    assert one.count() == 1500 and one.rdd.getNumPartitions() > 5


def test_boundaries_are_records():
    packets = traffic(4, 3000)
    for raw in (C.classic(packets), C.blocks(packets)):
        f = io.BytesIO(raw)
        fmt, first = opened(f)
        heads = set()
        for _, base, found in pcap.chunks(f, fmt, first, None):
            heads |= {base + h for h in found.head}
        found = [boundary(f, at, fmt, 4096) for at in range(0, len(raw) - 5000, 37)]
        assert all(b is None or b in heads for b in found) and sum(b is not None for b in found) > 0.6 * len(found)


def test_spans_that_do_not_meet_fail(spark, tmp_path):
    inner = C.classic([(C.T0, b"q" * 40)] * 2000)[24:]
    (tmp_path / "n.pcap").write_bytes(C.classic([(C.T0, inner)] * 3))  # in its records, only their own records can be seen
    read = lambda split: read_captures(spark, str(tmp_path / "n.pcap"), split=split, reach=4096)
    assert read(0).count() == 3
    with pytest.raises(Exception, match="don't meet"):
        read(30_000).count()


def test_many_small_captures_are_decoded_at_once(spark, monkeypatch):
    """Captures of both formats, some broken off, some without packets, one larger than a chunk: as file by file, but not a file at a time."""
    from tidewire.sources import columnar

    monkeypatch.setattr(pcap, "CHUNK", 20_000)
    files = []
    for n in range(300):
        raw = (C.classic if n % 2 else C.blocks)(traffic(n, n % 4))
        files.append((f"f-{n}", raw[: len(raw) - 5] if n % 7 == 3 else raw))
    files.insert(50, ("large", C.classic(traffic(9, 400), ">", True)))
    want = [(name, *row) for name, raw in files for row in plain(raw, True)]
    calls = []
    monkeypatch.setattr(columnar, "packet_batch", lambda *a, make=columnar.packet_batch: (calls.append(1), make(*a))[1])
    small = [f for f in files if len(f[1]) <= pcap.CHUNK]
    got = [r for b in pcap.small_batches(iter(small), True) for r in b.to_pylist()]
    tell = lambda r: (r["capture"], *(flat(r[k]) for k in NAMES if k not in ("seq", "capture")))
    of = lambda rows: sorted(repr((x[0], *x[2:])) for x in rows)
    assert len(small) == 300 and of([(r["capture"], *tell(r)) for r in got]) == of([w for w in want if w[0] != "large"])
    assert len(calls) <= 2 + sum(len(raw) for _, raw in small) // (pcap.CHUNK // 2)
    monkeypatch.undo()
    monkeypatch.setattr(pcap, "CHUNK", 20_000)
    out = pcap.decode_captures(spark.createDataFrame(files, "path string, content binary").repartition(2), True).collect()
    assert of([(r["capture"], *tell(r.asDict(True))) for r in out]) == of(want)


def test_captures_of_a_file_of_events_are_many_tasks(spark):
    from tidewire.sources import tables

    for made in (tables.capture_files, tables.login_files):
        assert "Exchange hashpartitioning(event_id" in made(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
