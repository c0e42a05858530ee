"""Writers of small captures, and packets relations from rows."""

from __future__ import annotations

import base64
import struct
from pathlib import Path

T0 = 1_700_000_000_000_000


def mac(s: str) -> bytes:
    return bytes.fromhex(s.replace(":", ""))


def ip(s: str) -> bytes:
    return bytes(map(int, s.split(".")))


def ethernet(kind: int, body: bytes, src="00:11:22:33:44:55", dst="66:77:88:99:aa:bb") -> bytes:
    return mac(dst) + mac(src) + struct.pack(">H", kind) + body


def ipv4(src: str, dst: str, protocol: int, body: bytes) -> bytes:
    return ethernet(0x0800, struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 1, 0, 64, protocol, 0, ip(src), ip(dst)) + body)


def tcp(src, dst, sport, dport, flags, payload=b"") -> bytes:
    return ipv4(src, dst, 6, struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 8192, 0, 0) + payload)


def udp(src, dst, sport, dport, payload=b"") -> bytes:
    return ipv4(src, dst, 17, struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload)


def arp(op, hwsrc, psrc, hwdst, pdst) -> bytes:
    return ethernet(0x0806, struct.pack(">HHBBH6s4s6s4s", 1, 0x0800, 6, 4, op, mac(hwsrc), ip(psrc), mac(hwdst), ip(pdst)), src=hwsrc)


def dns_query(name: str, qtype: int) -> bytes:
    labels = b"".join(bytes([len(x)]) + x.encode() for x in name.split("."))
    return struct.pack(">HHHHHH", 7, 0x0100, 1, 0, 0, 0) + labels + b"\0" + struct.pack(">HH", qtype, 1)


def classic(packets, order="<", nanos=False) -> bytes:
    magic = 0xA1B23C4D if nanos else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for us, data in packets:
        out += struct.pack(order + "IIII", us // 10**6, us % 10**6 * (1000 if nanos else 1), len(data), len(data)) + data
    return out


def blocks(packets) -> bytes:
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535))
    for us, data in packets:
        out += block(6, struct.pack("<IIIII", 0, us >> 32, us & 0xFFFFFFFF, len(data), len(data)) + data)
    return out


def fixtures() -> dict[str, list]:
    s = lambda x: T0 + round(x * 1e6)
    token = base64.b64encode(b"admin:s3cretpw").decode()
    exfil = [f"{n:02x}" * 8 + f"{n * 7919 % 1048576:05x}" + "0a1b2c3d4e5f67a" for n in range(12)]
    return {
        "syn_scan": [(s(0.05 * i), tcp("192.168.56.10", "192.168.56.20", 40000, 1000 + i, 0x02)) for i in range(25)],
        "xmas_scan": [(s(0.05 * i), tcp("192.168.56.15", "192.168.56.20", 40000, 2000 + i, 0x29)) for i in range(25)],
        "cleartext_creds": [
            (s(1), tcp("192.168.56.30", "192.168.56.40", 50000, 80, 0x18, f"GET / HTTP/1.1\r\nAuthorization: Basic {token}\r\n\r\n".encode())),
            (s(2), tcp("192.168.56.30", "192.168.56.50", 50001, 21, 0x18, b"USER dev\r\n")), (s(2.5), tcp("192.168.56.30", "192.168.56.50", 50001, 21, 0x18, b"PASS hunter2\r\n")),
        ],
        "benign": [x for i in range(20) for x in ((s(0.5 * i), tcp("192.168.56.5", "93.184.216.34", 51000, 443, 0x18, b"x")), (s(0.5 * i + 0.05), tcp("93.184.216.34", "192.168.56.5", 443, 51000, 0x18, b"y")))],
        "arp_spoof": [(s(1), arp(2, "00:50:56:c0:00:01", "192.168.56.1", "66:77:88:99:aa:bb", "192.168.56.9")), (s(3), arp(2, "00:0c:29:ab:cd:ef", "192.168.56.1", "66:77:88:99:aa:bb", "192.168.56.9"))],
        "dns_tunnel": [(s(0.2 * i), udp("192.168.56.99", "8.8.8.8", 5555, 53, dns_query(f"{exfil[i]}.tunnel.exfil.org", 16))) for i in range(12)],
    }


def write(folder: Path) -> dict[str, str]:
    out = {}
    for n, (name, packets) in enumerate(fixtures().items()):
        path = folder / f"{name}.pcap"
        path.write_bytes(blocks(packets) if n % 3 == 2 else classic(packets, order="<>"[n % 2], nanos=n == 3))
        out[name] = str(path)
    return out


COLUMNS = ("src_ip", "dst_ip", "src_mac", "dst_mac", "proto", "src_port", "dst_port", "tcp_flags", "length", "dns", "arp", "http_auth", "ftp_cmd")


def packets(spark, rows):
    """A packets relation of (microseconds, columns) pairs."""
    from tidewire.schema import PACKETS

    out = []
    for seq, (us, c) in enumerate(rows):
        v = {"proto": "TCP", "length": 60} | c
        app = (v.get("dns"), v.get("arp"), v.get("http_auth"), v.get("ftp_cmd"))
        out.append((v.get("capture", "c"), seq, us / 1e6, us, v.get("src_ip"), v.get("dst_ip"), None, None, v["proto"], v.get("src_port"), v.get("dst_port"), v.get("tcp_flags"), v["length"], app, False))
    return spark.createDataFrame(out, PACKETS)
