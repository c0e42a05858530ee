"""Packets of a buffer as columns: header fields are gathered for all at once.

Whatever needs a payload parsed (DNS, logins), has a truncated header, or an unusual chain of
headers goes to the decoder of single packets; its rows are then put in their places.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from tidewire.functions.network import FLAG_LETTERS
from tidewire.sources import pcap

APP = {
    "dns": pa.struct([("qr", pa.int32()), ("opcode", pa.int32()), ("rcode", pa.int32()), ("qname", pa.string()), ("qtype", pa.int32())]),
    "arp": pa.struct([("op", pa.int32()), ("hwsrc", pa.string()), ("psrc", pa.string()), ("hwdst", pa.string()), ("pdst", pa.string()), ("is_gratuitous", pa.bool_())]),
    "http_auth": pa.struct([("username", pa.string()), ("password", pa.string())]),
    "ftp_cmd": pa.struct([("cmd", pa.string()), ("arg", pa.string())]),
}
FLAGS = pa.array(["".join(c for n, c in enumerate(FLAG_LETTERS) if bits >> n & 1) for bits in range(256)])
TEXT, INT = pa.string(), pa.int32()
#: Ports of DNS and FTP, VLAN tags, protocols that are chains of further headers in IPv6.
DNS_PORTS, FTP_PORT, TAGS, CHAINED = (53, 5353), 21, (0x8100, 0x88A8), (0, 43, 60, 44)
LOGINS = tuple(int.from_bytes(w, "big") for w in (b"USER", b"PASS", b"user", b"pass"))


def _named(values: np.ndarray, name: Callable) -> pa.Array:
    """Names of values, each distinct one of which is spelt once."""
    own, at = np.unique(values, return_inverse=True)
    return pa.array([name(v) for v in own.tolist()], TEXT).take(pa.array(at.reshape(-1)))


def _v4(v: int) -> str:
    return f"{v >> 24}.{v >> 16 & 255}.{v >> 8 & 255}.{v & 255}"


def _mac(v: int) -> str:
    return v.to_bytes(6, "big").hex(":")


def _placed(n: int, parts: list[tuple[np.ndarray, pa.Array]], kind: pa.DataType) -> pa.Array:
    """An array of ``n`` in which each part's values are at its places, and nulls elsewhere."""
    at, done = np.full(n, -1, np.int64), 0
    for places, values in parts:
        at[places] = np.arange(done, done + len(values))
        done += len(values)
    if not done:
        return pa.nulls(n, kind)
    whole = pa.concat_arrays([v.cast(kind) if v.type != kind else v for _, v in parts])
    return whole.take(pa.array(at, mask=at < 0))


def packet_batch(capture: str | pa.Array, buf: bytes | None, seq: np.ndarray, off: np.ndarray, size: np.ndarray, us: np.ndarray, link: np.ndarray, mask_opaque: bool) -> pa.RecordBatch:
    """The packets at ``off`` (ascending) of a buffer, each of ``size`` bytes; without a buffer they were read over, and are malformed.

    ``capture`` is the name of all, or one a packet.
    """
    n, end = len(off), off + size
    raw = np.frombuffer((buf or b"") + bytes(64), np.uint8)
    top = len(raw) - 1
    u8 = lambda at: raw[np.minimum(at, top)].astype(np.int64)
    u16 = lambda at: u8(at) << 8 | u8(at + 1)
    u32 = lambda at: u16(at) << 16 | u16(at + 2)
    u48 = lambda at: u32(at) << 16 | u16(at + 4)

    # Link layer.
    ethernet, cooked, loop = link == pcap.ETHERNET, link == pcap.LINUX_SLL, link == pcap.LOOPBACK
    bare = np.isin(link, pcap.RAW_IP) | loop
    skip = np.where(ethernet, 14, np.where(cooked, 16, np.where(loop, 4, 0)))
    at = off + skip
    slow = np.full(n, buf is None) | (size < skip + bare)
    version = u8(at) >> 4
    kind = np.where(ethernet | cooked, u16(at - 2), np.where(bare, np.where(version == 4, 0x0800, np.where(version == 6, 0x86DD, 0)), 0))
    while (tag := np.isin(kind, TAGS) & ~slow).any():
        slow |= tag & (at + 4 > end)
        kind, at = np.where(tag, u16(at + 2), kind), np.where(tag, at + 4, at)
    arp, v4, v6 = kind == 0x0806, kind == 0x0800, kind == 0x86DD
    slow |= (arp & (at + 28 > end)) | (v4 & (at + 20 > end)) | (v6 & (at + 40 > end))

    # Network layer: where the next header begins and the packet's data ends.
    total = np.where(v4, u16(at + 2), u16(at + 4))
    whole = at + total + np.where(v6, 40, 0)
    stop = np.where((total > 0) & (v4 | v6), np.minimum(end, whole), end)
    protocol = np.where(v4, u8(at + 9), np.where(v6, u8(at + 6), -1))
    fragment = v4 & ((u16(at + 6) & 0x1FFF) > 0)
    slow |= v6 & np.isin(protocol, CHAINED)
    body = at + np.where(v4, (u8(at) & 15) * 4, 40)
    tcp, udp, icmp = ((v4 | v6) & ~fragment & (protocol == p) for p in (6, 17, 1))
    icmp &= v4
    slow |= (tcp & (body + 14 > end)) | (udp & (body + 4 > end))

    # Payloads that must be parsed.
    sport, dport = u16(body), u16(body + 2)
    data = body + np.where(tcp, (u8(body + 12) >> 4) * 4, 8)
    some = (tcp | udp) & (data < stop) & ~slow
    dns = np.isin(sport, DNS_PORTS) | np.isin(dport, DNS_PORTS)
    words = (stop - data >= 5) & np.isin(u32(data), LOGINS) & (u8(data + 4) == 32)
    slow |= some & (dns | (sport == FTP_PORT) | (dport == FTP_PORT) | words)
    low, place, hits = (buf or b"").lower(), -1, []
    while (place := low.find(b"authorization", place + 1)) >= 0:
        hits.append(place)
    if hits and n:
        own = np.searchsorted(off, hits, side="right") - 1
        slow[own[own >= 0]] |= some[own[own >= 0]]

    fast, odd = ~slow, np.flatnonzero(slow)
    one = [_single(None if buf is None else buf[off[k] : end[k]], int(link[k]), mask_opaque) for k in odd.tolist()]
    rest = lambda name, kind: (odd, pa.array([d[name] for d in one], kind))
    where = lambda mask: np.flatnonzero(mask & fast)

    i4, i6, ia, ports = where(v4), where(v6), where(arp), where(tcp | udp)
    six = lambda rows, k: pa.array([str(ipaddress.IPv6Address(raw[a + k : a + k + 16].tobytes())) for a in at[rows].tolist()], TEXT)
    arp_ip = {k: _named(u32(at[ia] + p), _v4) for k, p in (("psrc", 14), ("pdst", 24))}
    arp_hw = {k: u48(at[ia] + p) for k, p in (("hwsrc", 8), ("hwdst", 18))}
    src_ip = _placed(n, [(i4, _named(u32(at[i4] + 12), _v4)), (i6, six(i6, 8)), (ia, arp_ip["psrc"]), rest("src_ip", TEXT)], TEXT)
    dst_ip = _placed(n, [(i4, _named(u32(at[i4] + 16), _v4)), (i6, six(i6, 24)), (ia, arp_ip["pdst"]), rest("dst_ip", TEXT)], TEXT)
    ie, bare_arp = where(ethernet), np.flatnonzero(~ethernet[ia])  # ARP without Ethernet tells its own addresses
    mac = lambda p, name, own: _placed(n, [(ie, _named(u48(off[ie] + p), _mac)), (ia[bare_arp], _named(arp_hw[own][bare_arp], _mac)), rest(name, TEXT)], TEXT)
    op = u16(at[ia] + 6)
    same = u32(at[ia] + 14) == u32(at[ia] + 24)
    gratuitous = (op == 2) & (same | np.isin(arp_hw["hwdst"], (0, (1 << 48) - 1)))
    arps = pa.StructArray.from_arrays([pa.array(op, INT), _named(arp_hw["hwsrc"], _mac), arp_ip["psrc"], _named(arp_hw["hwdst"], _mac), arp_ip["pdst"], pa.array(gratuitous)], fields=list(APP["arp"]))
    app = {k: _placed(n, [*([(ia, arps)] if k == "arp" else []), rest(k, t)], t) for k, t in APP.items()}
    names = np.where(tcp, 0, np.where(udp, 1, np.where(icmp, 2, np.where(arp, 3, 4))))
    proto = pa.array(["TCP", "UDP", "ICMP", "ARP", "OTHER"]).take(pa.array(names))
    it = where(tcp)
    columns = {
        "capture": capture if isinstance(capture, pa.Array) else pa.array([capture]).take(pa.array(np.zeros(n, np.int64))), "seq": pa.array(seq), "ts": pa.array(us / 1e6), "us": pa.array(us), "src_ip": src_ip, "dst_ip": dst_ip,
        "src_mac": mac(6, "src_mac", "hwsrc"), "dst_mac": mac(0, "dst_mac", "hwdst"), "proto": _placed(n, [(np.flatnonzero(fast), proto.filter(pa.array(fast))), rest("proto", TEXT)], TEXT),
        "src_port": _placed(n, [(ports, pa.array(sport[ports], INT)), rest("src_port", INT)], INT), "dst_port": _placed(n, [(ports, pa.array(dport[ports], INT)), rest("dst_port", INT)], INT),
        "tcp_flags": _placed(n, [(it, FLAGS.take(pa.array(u8(body[it] + 13)))), rest("tcp_flags", TEXT)], TEXT), "length": pa.array(np.where(buf is None, 0, size), INT),
        "app": pa.StructArray.from_arrays(list(app.values()), fields=[pa.field(k, t) for k, t in APP.items()]), "malformed": _placed(n, [(np.flatnonzero(fast), pa.array(np.zeros(int(fast.sum()), bool))), rest("malformed", pa.bool_())], pa.bool_()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _single(data: bytes | None, link: int, mask_opaque: bool) -> dict:
    try:
        return pcap.decode(link, data, mask_opaque) | {"malformed": False}
    except (struct.error, IndexError, ValueError, TypeError):
        return dict.fromkeys(("src_ip", "dst_ip", "src_mac", "dst_mac", "src_port", "dst_port", "tcp_flags", *APP)) | {"proto": "OTHER", "malformed": True}
