"""Packet captures as a Spark data source: ``spark.read.format("pcap").load(path)``.

Both the classic format (either byte order, micro- or nanoseconds) and the block format are
read.  A capture is cut into spans of bytes, a task each.  A task reads chunks, finds the
records in them, and decodes a chunk's packets at once, as columns (``columnar``); only
payloads that must be parsed are decoded one by one.  Secrets are masked in the decoder, and
raw bytes never become a column.

Where a span begins, no record may: its first one is looked for among all chains of headers
that look like records, each leading to the next.  If one chain alone survives a stretch of
the file, it gives the boundary, a little further on; else there is none, and the span
before goes on.  Both tasks at a boundary find it in the same way, and the one before must
come to it record by record, or the read fails.  So all spans are proven from the first.

A row's ``seq`` is the byte at which its record begins.  A record that can't be decoded is
a row with ``malformed`` set; a file that breaks off ends there.  Formats and header layouts
are those of the public specifications.
"""

from __future__ import annotations

import base64
import binascii
import glob
import io
import ipaddress
import json
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewire.functions.network import FLAG_LETTERS
from tidewire.schema import PACKETS, REDACTED

#: Fixed values of the formats: magic numbers with byte order and ticks a second, block types, link types.
CLASSIC = {b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\x3c\x4d": (">", 10**9), b"\x4d\x3c\xb2\xa1": ("<", 10**9)}
SECTION, INTERFACE, PACKET, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 2, 3, 6
ETHERNET, RAW_IP, LOOPBACK, LINUX_SLL = 1, (12, 14, 101), 0, 113
#: A record of more bytes counts as malformed and is read over.
LARGEST = 1 << 26
#: Bytes of a span, of a chunk, and of the stretch in which a boundary is looked for; records in that have a quarter of it at most.
SPLIT, CHUNK, REACH = 1 << 27, 1 << 22, 1 << 20

#: The header of HTTP Basic credentials and the FTP commands of a login.
_BASIC = re.compile(r"Authorization:\s*Basic\s+([A-Za-z0-9+/=]+)", re.I)
_LOGIN = re.compile(r"(USER|PASS)\s+(.*)", re.I)


class BadHeader(ValueError):
    """The file is not a capture."""


@dataclass
class Format:
    """What a file's records look like: byte order, ticks a second and link type; of block files, the interfaces so far."""

    order: str
    ticks: int
    link: int = 0
    blocks: bool = False
    faces: list[tuple[int, int]] = field(default_factory=list)  # link type and ticks a second


def opened(f: BinaryIO) -> tuple[Format, int]:
    """The format of a capture, and where its first record begins."""
    f.seek(0)
    head = f.read(24)
    if head[:4] in CLASSIC and len(head) == 24:
        order, ticks = CLASSIC[head[:4]]
        return Format(order, ticks, struct.unpack(order + "HHiIII", head[4:])[5] & 0xFFFF), 24
    if len(head) >= 4 and struct.unpack("<I", head[:4])[0] == SECTION:
        return Format("<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">", 10**6, blocks=True), 0
    raise BadHeader("unable to read capture header")


@dataclass
class Found:
    """Records of a buffer: where each begins, its bytes and their number, microseconds, link type."""

    head: list[int] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    us: list[int] = field(default_factory=list)
    link: list[int] = field(default_factory=list)


def _classic(buf: bytes, at: int, stop: int, fmt: Format) -> tuple[Found, int, int | None]:
    """Records that begin before ``stop`` and are whole; where the next begins; its size if it is too large."""
    out, n, kept_of, large = Found(), len(buf), struct.Struct(fmt.order + "I").unpack_from, None
    while at < stop and at + 16 <= n:
        kept = kept_of(buf, at + 8)[0]
        if kept > LARGEST:
            large = 16 + kept
            break
        if at + 16 + kept > n:
            break
        out.head.append(at)
        at += 16 + kept
    head = np.asarray(out.head, np.int64)
    words = np.frombuffer(buf, np.uint8)[(head[:, None] + np.arange(12)).reshape(-1)].view(fmt.order + "u4").reshape(-1, 3).astype(np.int64)
    out.us, out.at, out.size = words[:, 0] * 10**6 + words[:, 1] * 10**6 // fmt.ticks, head + 16, words[:, 2]
    return out, at, large


def _options(body: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == 0:
            return
        yield code, body[at + 4 : at + 4 + size]
        at += 4 + (size + 3) // 4 * 4


def _interface(body: bytes, order: str) -> tuple[int, int]:
    """Link type and ticks a second of an interface's block."""
    ticks = 10**6
    for code, value in _options(body[8:], order):
        if code == 9 and value:
            ticks = 2 ** (value[0] & 127) if value[0] & 128 else 10 ** value[0]
    return struct.unpack_from(order + "H", body)[0], ticks


def _time(fmt: Format, face: int, high: int, low: int) -> tuple[int, int]:
    link, ticks = fmt.faces[face] if face < len(fmt.faces) else (ETHERNET, 10**6)
    return min((high << 32 | low) * 10**6 // ticks, 1 << 62), link


def _blocks(buf: bytes, at: int, stop: int, fmt: Format) -> tuple[Found, int, int | None]:
    """As ``_classic``, of blocks; ``fmt`` takes in sections and interfaces."""
    out, n = Found(), len(buf)
    while at < stop and at + 12 <= n:
        if struct.unpack_from("<I", buf, at)[0] == SECTION:
            fmt.order, fmt.faces = "<" if buf[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">", []
        o = fmt.order
        kind, size = struct.unpack_from(o + "II", buf, at)
        if size < 12:
            return out, n + LARGEST, None  # nothing can be read from here on
        if size > LARGEST:
            return out, at, size
        if at + size > n:
            break
        body, end = at + 8, at + size - 4
        if kind == INTERFACE and size >= 20:
            fmt.faces.append(_interface(buf[body:end], o))
        elif kind in (ENHANCED, PACKET) and end - body >= 20:
            if kind == ENHANCED:
                face, high, low, kept, _ = struct.unpack_from(o + "IIIII", buf, body)
            else:
                face, _, high, low, kept, _ = struct.unpack_from(o + "HHIIII", buf, body)
            us, link = _time(fmt, face, high, low)
            for own, v in ((out.head, at), (out.at, body + 20), (out.size, max(0, min(kept, end - body - 20))), (out.us, us), (out.link, link)):
                own.append(v)
        elif kind == SIMPLE and end - body >= 4 and fmt.faces:
            kept = struct.unpack_from(o + "I", buf, body)[0]
            for own, v in ((out.head, at), (out.at, body + 4), (out.size, max(0, min(kept, end - body - 4))), (out.us, 0), (out.link, fmt.faces[0][0])):
                own.append(v)
        at += size
    return out, at, None


def _oversized(f: BinaryIO, at: int, fmt: Format) -> tuple[int, int] | None:
    """Microseconds and link type of a record that is read over; None if it holds no packet."""
    f.seek(at)
    head = f.read(28)
    if not fmt.blocks:
        s, part = struct.unpack_from(fmt.order + "II", head)
        return s * 10**6 + part * 10**6 // fmt.ticks, fmt.link
    kind = struct.unpack_from(fmt.order + "I", head)[0]
    if kind in (ENHANCED, PACKET) and len(head) >= 20:
        face = struct.unpack_from(fmt.order + ("I" if kind == ENHANCED else "H"), head, 8)[0]
        return _time(fmt, face, *struct.unpack_from(fmt.order + "II", head, 12))
    return (0, ETHERNET) if kind == SIMPLE else None


def chunks(f: BinaryIO, fmt: Format, start: int, stop: int | None, path: str = "") -> Iterator[tuple[bytes | None, int, Found]]:
    """(buffer, its place in the file, its records) of the records that begin from ``start`` on and before ``stop``.

    A record that is read over comes with None for the buffer.  ValueError if the records
    don't come to ``stop`` exactly.
    """
    size = f.seek(0, 2)
    at, buf, base = start, b"", start
    walk = _blocks if fmt.blocks else _classic
    while stop is None or at < stop:
        f.seek(base + len(buf))
        more = f.read(CHUNK)
        buf += more
        found, next_, large = walk(buf, 0, len(buf) if stop is None else stop - base, fmt)
        if len(found.head):
            yield buf, base, found
        at = base + next_
        if large is not None:
            if at + large > size:
                break
            if (who := _oversized(f, at, fmt)) is not None:
                yield None, at, Found([0], [0], [0], [who[0]], [who[1]])
            at += large
            buf, base = b"", at
        else:
            buf, base = buf[next_:], at
            if not more:
                break
    if stop is not None and at != stop:
        raise ValueError(f"{path}: records don't meet at byte {stop}; the file is damaged, or must be read whole (splitBytes 0)")


def boundary(f: BinaryIO, offset: int, fmt: Format, reach: int = REACH) -> int | None:
    """A place soon after ``offset`` at which a record begins; None if that can't be told.

    Of every byte of a stretch is told whether it may begin a record, and where the next one
    then is.  Followed at once, such chains break or leave the stretch.  The chains that
    begin in its first half and leave it must all pass the same first place in its second.
    """
    offset += -offset % 4 if fmt.blocks else 0
    f.seek(offset)
    raw = np.frombuffer(f.read(reach), np.uint8)
    if len(raw) < reach:
        return None
    step, usual = 4 if fmt.blocks else 1, reach // 4
    at = np.arange(0, reach - 16, step)
    word = lambda k: np.lib.stride_tricks.sliding_window_view(raw, 4)[at + k].reshape(-1, 4).copy().view(fmt.order + "u4").reshape(-1).astype(np.int64)
    if fmt.blocks:
        size = word(4)
        ok = (size % 4 == 0) & (size >= 12) & (size <= usual)
        last = np.where(ok & (at + size <= reach), at + size - 4, 0)
        closing = np.lib.stride_tricks.sliding_window_view(raw, 4)[last].copy().view(fmt.order + "u4").reshape(-1).astype(np.int64)
        ok &= (last == 0) | (closing == size)
    else:
        kept, whole = word(8), word(12)
        size = kept + 16
        ok = (word(4) < fmt.ticks) & (kept > 0) & (kept <= usual) & (kept <= whole) & (whole <= LARGEST)
    n = len(at)
    left, dead, half = n, n + 1, n // 2
    follow = np.r_[np.where(ok, np.minimum((at + size) // step, left), dead), left, dead]
    middle = np.where(np.arange(n + 2) >= half, np.arange(n + 2), follow)  # stays where it first is in the second half
    for _ in range(int(n).bit_length()):
        follow, middle = follow[follow], middle[middle]
    lives = np.flatnonzero(follow[:half] == left)
    first = np.unique(middle[lives])
    return offset + int(first[0]) * step if len(first) == 1 and first[0] < n else None


def _mac(b: bytes) -> str:
    return b.hex(":")


def dns_message(data: bytes) -> dict | None:
    """Header fields and first question of a DNS message; null if it is no such."""
    if len(data) < 12:
        return None
    _, bits, questions = struct.unpack_from(">HHH", data)
    out = {"qr": bits >> 15, "opcode": bits >> 11 & 15, "rcode": bits & 15, "qname": None, "qtype": None}
    if questions:
        labels, at, after, hops = [], 12, None, 0
        while at < len(data) and data[at]:
            n = data[at]
            if n >= 192:
                if at + 1 >= len(data) or (hops := hops + 1) > 32:
                    break
                after = at + 2 if after is None else after
                at = (n & 63) << 8 | data[at + 1]
            else:
                labels.append(data[at + 1 : at + 1 + n])
                at += n + 1
        end = (at + 1) if after is None else after
        if end + 2 <= len(data):
            out["qname"] = b".".join(labels).decode("utf-8", "ignore").rstrip(".")
            out["qtype"] = struct.unpack_from(">H", data, end)[0]
    return out


def credentials(payload: bytes, sport: int | None, dport: int | None, mask_opaque: bool = False) -> tuple[dict | None, dict | None]:
    """HTTP Basic and FTP logins in a payload, with passwords masked."""
    text = payload.decode("latin-1")
    http = ftp = None
    if found := _BASIC.search(text):
        user = "unknown"
        try:
            user, colon, _ = base64.b64decode(found[1]).decode("utf-8", "ignore").partition(":")
            if mask_opaque and not colon:
                user = REDACTED
        except (binascii.Error, ValueError):
            pass
        http = {"username": user, "password": REDACTED}
    if 21 in (sport, dport) or text.startswith(("USER ", "PASS ", "user ", "pass ")):
        for line in text.splitlines():
            if login := _LOGIN.match(line):
                cmd = login[1].upper()
                ftp = {"cmd": cmd, "arg": REDACTED if cmd == "PASS" else login[2].strip()}
    return http, ftp


def decode(link: int, data: bytes, mask_opaque: bool = False) -> dict:
    """The columns of one packet that come from its bytes."""
    out: dict = dict.fromkeys(("src_ip", "dst_ip", "src_mac", "dst_mac", "src_port", "dst_port", "tcp_flags", "dns", "arp", "http_auth", "ftp_cmd"))
    out |= {"proto": "OTHER", "length": len(data)}
    kind, at = None, 0
    if link == ETHERNET:
        out["dst_mac"], out["src_mac"] = _mac(data[:6]), _mac(data[6:12])
        kind, at = struct.unpack_from(">H", data, 12)[0], 14
    elif link == LINUX_SLL:
        kind, at = struct.unpack_from(">H", data, 14)[0], 16
    elif link in RAW_IP or link == LOOPBACK:
        at = 4 if link == LOOPBACK else 0
        kind = {4: 0x0800, 6: 0x86DD}.get(data[at] >> 4)
    while kind in (0x8100, 0x88A8):
        kind, at = struct.unpack_from(">H", data, at + 2)[0], at + 4
    if kind == 0x0806:
        op, hwsrc, psrc, hwdst, pdst = struct.unpack_from(">H6s4s6s4s", data, at + 6)
        arp = {"op": op, "hwsrc": _mac(hwsrc), "psrc": str(ipaddress.IPv4Address(psrc)), "hwdst": _mac(hwdst), "pdst": str(ipaddress.IPv4Address(pdst))}
        arp["is_gratuitous"] = op == 2 and (arp["psrc"] == arp["pdst"] or arp["hwdst"] in ("ff:ff:ff:ff:ff:ff", "00:00:00:00:00:00"))
        out |= {"proto": "ARP", "src_ip": arp["psrc"], "dst_ip": arp["pdst"], "arp": arp, "src_mac": out["src_mac"] or arp["hwsrc"], "dst_mac": out["dst_mac"] or arp["hwdst"]}
        return out
    if kind == 0x0800:
        size, total = (data[at] & 15) * 4, struct.unpack_from(">H", data, at + 2)[0]
        fragment, protocol = struct.unpack_from(">H", data, at + 6)[0] & 0x1FFF, data[at + 9]
        out["src_ip"], out["dst_ip"] = (str(ipaddress.IPv4Address(data[at + k : at + k + 4])) for k in (12, 16))
        end = min(len(data), at + total) if total else len(data)
        at += size
        if fragment:
            return out
    elif kind == 0x86DD:
        total, protocol = struct.unpack_from(">HB", data, at + 4)
        out["src_ip"], out["dst_ip"] = (str(ipaddress.IPv6Address(data[at + k : at + k + 16])) for k in (8, 24))
        end, at = min(len(data), at + 40 + total) if total else len(data), at + 40
        while protocol in (0, 43, 60):  # hop-by-hop, routing, destination options
            protocol, at = data[at], at + 8 + data[at + 1] * 8
        if protocol == 44:
            offset, protocol, at = struct.unpack_from(">H", data, at + 2)[0] >> 3, data[at], at + 8
            if offset:
                return out
    else:
        return out
    payload = b""
    if protocol == 6:
        sport, dport = struct.unpack_from(">HH", data, at)
        bits = data[at + 13]
        out |= {"proto": "TCP", "src_port": sport, "dst_port": dport, "tcp_flags": "".join(c for n, c in enumerate(FLAG_LETTERS) if bits >> n & 1)}
        payload = data[at + (data[at + 12] >> 4) * 4 : end]
    elif protocol == 17:
        sport, dport = struct.unpack_from(">HH", data, at)
        out |= {"proto": "UDP", "src_port": sport, "dst_port": dport}
        payload = data[at + 8 : end]
    elif protocol == 1 and kind == 0x0800:
        out["proto"] = "ICMP"
        return out
    if 53 in (out["src_port"], out["dst_port"]) or 5353 in (out["src_port"], out["dst_port"]):
        out["dns"] = dns_message(payload[2:] if out["proto"] == "TCP" else payload)
    if payload and not out["dns"]:
        out["http_auth"], out["ftp_cmd"] = credentials(payload, out["src_port"], out["dst_port"], mask_opaque)
    return out


def batches(f: BinaryIO, capture: str, fmt: Format, start: int, stop: int | None, mask_opaque: bool = False) -> Iterator[pa.RecordBatch]:
    """The packets of a span of a capture."""
    from tidewire.sources.columnar import packet_batch

    for buf, base, found in chunks(f, fmt, start, stop, path=capture):
        head, at, size, us = (np.asarray(x, np.int64) for x in (found.head, found.at, found.size, found.us))
        link = np.asarray(found.link, np.int64) if len(found.link) else np.full(len(head), fmt.link, np.int64)
        yield packet_batch(capture, buf, head + base, at, size, us, link, mask_opaque)


class _Span(InputPartition):
    def __init__(self, path: str, starts: list[int], k: int, faces: list):
        self.path, self.starts, self.k, self.faces = path, starts, k, faces

    def ends(self, f: BinaryIO, fmt: Format, first: int, reach: int) -> tuple[int | None, int | None]:
        """Where the span's first record begins (None if it has none) and where the next span's does (None: it goes to the end)."""
        start = first if self.k == 0 else boundary(f, self.starts[self.k], fmt, reach)
        if start is None:
            return None, None
        after = (boundary(f, s, fmt, reach) for s in self.starts[self.k + 1 :])
        return start, next((b for b in after if b is not None), None)


def spans(path: str, split: int, faces: list | None) -> list[_Span]:
    """A file's spans; a block file whose interfaces aren't known is one."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        known = size > split > 0 and (not opened(f)[0].blocks or faces is not None)
    starts = list(range(0, size, split)) if known else [0]
    return [_Span(path, starts, k, faces or []) for k in range(len(starts))]


class PcapReader(DataSourceReader):
    def __init__(self, options: dict):
        own = {k.lower(): v for k, v in options.items()}
        self.mask = str(own.get("maskopaqueusername", "false")).lower() == "true"
        paths = json.loads(own["paths"]) if "paths" in own else [own["path"]]
        self.split, self.reach = int(own.get("splitbytes", SPLIT)), int(own.get("reachbytes", REACH))
        self.faces = json.loads(own.get("faces", "{}"))
        self.files = [f for p in paths for f in find_captures(p)]

    def partitions(self) -> list[InputPartition]:
        return [s for p in self.files for s in spans(p, self.split, self.faces.get(p))]

    def read(self, partition: _Span) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            fmt, first = opened(f)
            start, stop = partition.ends(f, fmt, first, self.reach)
            if start is not None:
                fmt.faces = _faces_before(partition.faces, start)
                yield from batches(f, partition.path, fmt, start, stop, self.mask)


def _faces_before(changes: list, at: int) -> list[tuple[int, int]]:
    """The interfaces at a place, given where sections (null) and interfaces are."""
    out: list[tuple[int, int]] = []
    for place, face in changes:
        if place < at:
            out = [] if face is None else [*out, tuple(face)]
    return out


class PcapDataSource(DataSource):
    """Captures in a file system that all executors mount: a file, a folder or a pattern.

    Options: ``splitBytes`` of a span (0: a file is one), ``maskOpaqueUsername``, and, as
    ``read_captures`` sets them, ``paths`` (a JSON list) and ``faces``, without which a block
    file is one span.
    """

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return PACKETS

    def reader(self, schema) -> DataSourceReader:
        return PcapReader(dict(self.options))


def find_captures(path: str) -> list[str]:
    """FileNotFoundError unless the path names at least one file."""
    local = path.removeprefix("file://")
    found = [local] if os.path.isfile(local) else sorted(glob.glob(os.path.join(local, "*.pcap*") if os.path.isdir(local) else local))
    if not found:
        raise FileNotFoundError(f"no capture at {path}")
    return found


def interfaces(spark: SparkSession, files: list[str], split: int = SPLIT, reach: int = REACH) -> dict[str, list]:
    """Where sections and interfaces are in block files of more than a span: [place, null or (link type, ticks)], in order.

    Spans are walked side by side, from header to header; only these few blocks come to the driver.
    """
    large = []
    for p in files:
        with open(p, "rb") as f:
            if os.path.getsize(p) > split > 0 and opened(f)[0].blocks:
                large.append(p)
    if not large:
        return {}
    rows = [(p, k) for p in large for k in range(-(-os.path.getsize(p) // split))]

    def walk(parts):
        for b in parts:
            out = []
            for p, k in zip(b["path"].to_pylist(), b["k"].to_pylist()):
                with open(p, "rb") as f:
                    fmt, first = opened(f)
                    start, stop = _Span(p, list(range(0, os.path.getsize(p), split)), k, []).ends(f, fmt, first, reach)
                    at = start
                    while at is not None and (stop is None or at < stop):
                        f.seek(at)
                        head = f.read(12)
                        if len(head) < 12:
                            break
                        if struct.unpack_from("<I", head)[0] == SECTION:
                            fmt.order = "<" if head[8:] == b"\x4d\x3c\x2b\x1a" else ">"
                            out.append((p, at, None, None))
                        kind, size = struct.unpack_from(fmt.order + "II", head)
                        if size < 12:
                            break
                        if kind == INTERFACE and 20 <= size <= LARGEST:
                            f.seek(at + 8)
                            out.append((p, at, *_interface(f.read(size - 12), fmt.order)))
                        at += size
            columns = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["path", "at", "link", "ticks"])

    found = spark.createDataFrame(rows, "path string, k int").repartition(len(rows)).mapInArrow(walk, "path string, at long, link long, ticks long").collect()
    out: dict[str, list] = {p: [] for p in large}
    for r in sorted(found):
        out[r.path].append((r.at, None if r.link is None else (r.link, r.ticks)))
    return out


def read_captures(spark: SparkSession, *paths: str, mask_opaque: bool = False, split: int = SPLIT, reach: int = REACH) -> DataFrame:
    """Packets of all captures, in one scan; a task for each ``split`` bytes of a file, or for each file if that is 0."""
    spark.dataSource.register(PcapDataSource)
    files = [f for p in paths for f in find_captures(str(p))]
    faces = interfaces(spark, files, split, reach)
    options = {"paths": json.dumps(files), "maskOpaqueUsername": str(mask_opaque).lower(), "splitBytes": str(split), "reachBytes": str(reach), "faces": json.dumps(faces)}
    return spark.read.format("pcap").options(**options).load()


def read_captures_anywhere(spark: SparkSession, path: str, mask_opaque: bool = False) -> DataFrame:
    """Packets of captures in any store that Spark reads, such as an object store.

    Spark fetches each file as a whole, which bounds it to what a task can hold; use
    ``read_captures`` for larger ones on a mounted file system.
    """
    return decode_captures(spark.read.format("binaryFile").load(path).select("path", "content"), mask_opaque)


def small_batches(files: Iterator[tuple[str, bytes]], mask_opaque: bool = False) -> Iterator[pa.RecordBatch]:
    """The packets of captures of at most a chunk each; of as many files as fill a chunk they are decoded at once."""
    from tidewire.sources.columnar import packet_batch

    def done() -> pa.RecordBatch:
        head, at, size, us, link = (np.concatenate(x) if len(x) > 1 else x[0] for x in columns)
        names = pa.array(paths, pa.string()).take(pa.array(np.repeat(np.arange(len(paths)), counts)))
        return packet_batch(names, b"".join(held), head, at, size, us, link, mask_opaque)

    held, paths, counts, columns, base = [], [], [], ([], [], [], [], []), 0
    for path, content in files:
        if base + len(content) > CHUNK and paths:
            yield done()
            held, paths, counts, columns, base = [], [], [], ([], [], [], [], []), 0
        fmt, first = opened(io.BytesIO(content))
        found, _, _ = (_blocks if fmt.blocks else _classic)(content, first, len(content), fmt)
        n = len(found.head)
        if n:
            head, at, size, us = (np.asarray(x, np.int64) for x in (found.head, found.at, found.size, found.us))
            link = np.asarray(found.link, np.int64) if len(found.link) else np.full(n, fmt.link, np.int64)
            for own, x in zip(columns, (head, at + base, size, us, link)):
                own.append(x)
            held.append(content)
            paths.append(path)
            counts.append(n)
            base += len(content)
    if paths:
        yield done()


def decode_captures(files: DataFrame, mask_opaque: bool = False) -> DataFrame:
    """Packets of captures given as (path, content); small files are decoded many at a time, larger ones chunk by chunk."""

    def run(parts):
        for b in parts:
            size = pc.binary_length(b["content"]).to_numpy(zero_copy_only=False)
            small = (k for k in range(b.num_rows) if size[k] <= CHUNK)
            yield from small_batches(((b["path"][k].as_py(), b["content"][k].as_py()) for k in small), mask_opaque)
            for k in range(b.num_rows):
                if size[k] > CHUNK:
                    f = io.BytesIO(b["content"][k].as_py())
                    fmt, first = opened(f)
                    yield from batches(f, b["path"][k].as_py(), fmt, first, None, mask_opaque)

    return files.select("path", "content").mapInArrow(run, PACKETS)


def capture_stats(packets: DataFrame) -> DataFrame:
    """Per capture: records, malformed ones, first and last positive time, duration."""
    good = F.when((F.col("us") > 0) & ~F.coalesce("malformed", F.lit(False)), F.col("us"))
    out = packets.groupBy("capture").agg(F.count("*").alias("total_packets"), F.count_if(F.coalesce("malformed", F.lit(False))).alias("malformed_packets"), F.min(good).alias("a"), F.max(good).alias("b"))
    return out.select(
        "capture", "total_packets", (F.col("total_packets") - F.col("malformed_packets")).alias("valid_packets"), "malformed_packets", (F.col("a") / 1e6).alias("start_time"), (F.col("b") / 1e6).alias("end_time"),
        F.coalesce((F.col("b") - F.col("a")) / 1e6, F.lit(0.0)).alias("duration_seconds"),
    )
