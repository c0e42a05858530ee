"""A capture read packet by packet, which the columnar, splittable reader must equal."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

from tidewire.sources.pcap import BadHeader, CLASSIC, decode
from tidewire.sources import pcap

SECTION, INTERFACE, PACKET, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 2, 3, 6
ETHERNET = 1


def _skipped(f: BinaryIO, n: int) -> bool:
    """Read over ``n`` bytes; whether they were there."""
    while n and (got := len(f.read(min(n, 1 << 20)))):
        n -= got
    return not n


def records(f: BinaryIO) -> Iterator[tuple[int, int, bytes | None]]:
    """(microseconds, link type, bytes) of each record; ends quietly where the file breaks off.

    A record of more than LARGEST bytes has None for its bytes and is read over, so it
    counts as malformed and hides nothing that follows.
    """
    magic = f.read(4)
    if magic in CLASSIC:
        yield from _classic(f, *CLASSIC[magic])
    elif len(magic) == 4 and struct.unpack("<I", magic)[0] == SECTION:
        yield from _blocks(f)
    else:
        raise BadHeader("unable to read capture header")


def _classic(f: BinaryIO, order: str, ticks: int) -> Iterator[tuple[int, int, bytes]]:
    head = f.read(20)
    if len(head) < 20:
        raise BadHeader("unable to read capture header")
    link = struct.unpack(order + "HHiIII", head)[5] & 0xFFFF
    while len(head := f.read(16)) == 16:
        s, part, kept, _ = struct.unpack(order + "IIII", head)
        data = None
        if kept > pcap.LARGEST:
            if not _skipped(f, kept):
                return
        elif len(data := f.read(kept)) < kept:
            return
        yield s * 10**6 + part * 10**6 // ticks, link, data


def _options(body: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == 0:
            return
        yield code, body[at + 4 : at + 4 + size]
        at += 4 + (size + 3) // 4 * 4


def _blocks(f: BinaryIO) -> Iterator[tuple[int, int, bytes]]:
    order, faces, kind_raw = "<", [], struct.pack("<I", SECTION)
    while len(kind_raw) == 4:
        size_raw = f.read(4)
        if len(size_raw) < 4:
            return
        if struct.unpack("<I", kind_raw)[0] == SECTION:
            mark = f.read(4)
            order = "<" if mark == b"\x4d\x3c\x2b\x1a" else ">"
            faces, done = [], 4
        else:
            done = 0
        kind, size = struct.unpack(order + "I", kind_raw)[0], struct.unpack(order + "I", size_raw)[0]
        rest = size - 8 - done
        if rest < 4:
            return
        if rest > pcap.LARGEST:
            head = f.read(20)
            if not _skipped(f, rest - len(head)):
                return
            if kind in (ENHANCED, PACKET):
                high, low = struct.unpack_from(order + "II", head, 4)
                yield (high << 32 | low) * 10**6 // (faces[0][1] if faces else 10**6), ETHERNET, None
            elif kind == SIMPLE:
                yield 0, ETHERNET, None
            kind_raw = f.read(4)
            continue
        if len(body := f.read(rest)) < rest:
            return
        body = body[:-4]
        if kind == INTERFACE and len(body) >= 8:
            ticks = 10**6
            for code, value in _options(body[8:], order):
                if code == 9 and value:
                    ticks = 2 ** (value[0] & 127) if value[0] & 128 else 10 ** value[0]
            faces.append((struct.unpack_from(order + "H", body)[0], ticks))
        elif kind == ENHANCED and len(body) >= 20:
            face, high, low, kept, _ = struct.unpack_from(order + "IIIII", body)
            link, ticks = faces[face] if face < len(faces) else (ETHERNET, 10**6)
            yield (high << 32 | low) * 10**6 // ticks, link, body[20 : 20 + kept]
        elif kind == PACKET and len(body) >= 20:
            face, _, high, low, kept, _ = struct.unpack_from(order + "HHIIII", body)
            link, ticks = faces[face] if face < len(faces) else (ETHERNET, 10**6)
            yield (high << 32 | low) * 10**6 // ticks, link, body[20 : 20 + kept]
        elif kind == SIMPLE and len(body) >= 4 and faces:
            yield 0, faces[0][0], body[4 : 4 + struct.unpack_from(order + "I", body)[0]]
        kind_raw = f.read(4)


def packet_rows(f: BinaryIO, capture: str, mask_opaque: bool = False) -> Iterator[tuple]:
    for seq, (us, link, data) in enumerate(records(f)):
        try:
            d, bad = decode(link, data, mask_opaque), False
        except (struct.error, IndexError, ValueError, TypeError):
            d, bad = dict.fromkeys(("src_ip", "dst_ip", "src_mac", "dst_mac", "src_port", "dst_port", "tcp_flags", "dns", "arp", "http_auth", "ftp_cmd")) | {"proto": "OTHER", "length": len(data or b"")}, True
        app = tuple(tuple(d[k].values()) if d[k] else None for k in ("dns", "arp", "http_auth", "ftp_cmd"))
        yield (capture, seq, us / 1e6, us, d["src_ip"], d["dst_ip"], d["src_mac"], d["dst_mac"], d["proto"], d["src_port"], d["dst_port"], d["tcp_flags"], d["length"], app, bad)
