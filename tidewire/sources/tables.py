"""Packets from ordinary tables: an adapter that gives events and pages the packets schema.

Columns are derived by plain expressions, so the scans stay columnar, prune and push down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import network as N


def _app(**parts: Column) -> Column:
    types = {
        "dns": "struct<qr:int,opcode:int,rcode:int,qname:string,qtype:int>", "arp": "struct<op:int,hwsrc:string,psrc:string,hwdst:string,pdst:string,is_gratuitous:boolean>",
        "http_auth": "struct<username:string,password:string>", "ftp_cmd": "struct<cmd:string,arg:string>",
    }
    return F.struct(*((parts[k] if k in parts else F.lit(None)).cast(t).alias(k) for k, t in types.items()))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with typed columns: us, k (of the JSON properties), user_id, event_type, value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def _packet(df: DataFrame, **columns: Column) -> DataFrame:
    base = {
        "capture": F.lit("events"), "seq": F.col("event_id"), "ts": F.col("us") / 1e6, "us": F.col("us"), "src_ip": F.concat(F.lit("10.0."), (F.col("user_id") / 256).cast("int").cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string")),
        "dst_ip": F.concat(F.lit("10.1.0."), (F.col("k") % 8).cast("string")), "src_mac": F.lit(None).cast("string"), "dst_mac": F.lit(None).cast("string"), "proto": F.lit("TCP"),
        "src_port": (F.lit(40000) + F.col("user_id") % 100).cast("int"), "dst_port": (F.lit(1000) + F.col("k")).cast("int"), "tcp_flags": F.lit(None).cast("string"), "length": (F.lit(40) + F.floor("value")).cast("int"), "app": _app(), "malformed": F.lit(False),
    }
    return df.select(*((columns[k] if k in columns else v).alias(k) for k, v in base.items()))


def tcp_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as TCP packets: clicks and views are SYN, sign-ups FIN, purchases without flags, errors SYN and ACK."""
    t = F.col("event_type")
    flags = F.when(t.isin("click", "view"), "S").when(t == "signup", "F").when(t == "error", "SA").otherwise("")
    return _packet(events(spark, sf_dir), tcp_flags=flags)


def arp_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ARP replies in which four MACs contend for twenty addresses."""
    ip = F.concat(F.lit("10.9.0."), (F.col("k") % 20).cast("string"))
    mac = F.concat(F.lit("00:00:00:00:00:0"), (F.col("user_id") % 4).cast("string"))
    arp = F.struct(F.lit(2).alias("op"), mac.alias("hwsrc"), ip.alias("psrc"), F.lit("00:00:00:00:00:09").alias("hwdst"), F.when(F.col("event_type") == "view", ip).otherwise("10.9.1.1").alias("pdst"), (F.col("event_type") == "view").alias("is_gratuitous"))
    return _packet(events(spark, sf_dir), src_ip=ip, dst_ip=F.lit("10.9.1.1"), proto=F.lit("ARP"), src_port=F.lit(None).cast("int"), dst_port=F.lit(None).cast("int"), app=_app(arp=arp))


def login_payload() -> Column:
    """An HTTP request for clicks and views; FTP lines for the rest."""
    user = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    basic = F.concat(F.lit("GET / HTTP/1.1\r\nAuthorization: Basic "), F.base64(F.concat(user, F.lit(":pw"), F.col("k").cast("string")).cast("binary")))
    return F.when(F.col("event_type").isin("click", "view"), basic).when(F.col("event_type").isin("signup", "error"), F.concat(F.lit("USER u"), F.col("k").cast("string"), F.lit("\r\n"))).otherwise(F.concat(F.lit("PASS s"), F.col("k").cast("string"), F.lit("\r\n")))


def login_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logins, decoded and masked by the column functions."""
    e = events(spark, sf_dir).withColumn("payload", login_payload())
    app = _app(http_auth=N.http_basic(F.col("payload")), ftp_cmd=N.ftp_command(F.col("payload"), F.lit(50000), F.lit(21)))
    return _packet(e, dst_ip=F.concat(F.lit("10.1.0."), (F.col("user_id") % 8).cast("string")), dst_port=F.lit(21), app=app)


def dns_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as DNS queries for their hosts, one a second, from a source a language."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    parts = F.split("url", "/")
    e = p.select(F.col("page_id").alias("event_id"), (F.col("page_id") * 1_000_000).alias("us"), F.element_at(parts, 3).alias("host"), F.try_element_at(parts, F.lit(4)).alias("lang"), F.length("url").alias("n"))
    dns = F.struct(F.lit(0).alias("qr"), F.lit(0).alias("opcode"), F.lit(0).alias("rcode"), F.col("host").alias("qname"), F.when(F.col("event_id") % 3 == 0, 16).otherwise(1).alias("qtype"))
    return _packet(e, capture=F.lit("pages"), src_ip=F.concat(F.lit("lang-"), F.coalesce("lang", F.lit("none"))), dst_ip=F.lit("10.2.0.53"), proto=F.lit("UDP"), src_port=F.lit(5353), dst_port=F.lit(53), length=F.col("n").cast("int"), app=_app(dns=dns))


def _be(n: Column, size: int) -> Column:
    """A number as hex digits of ``size`` bytes, largest first."""
    return F.lpad(F.hex(n.cast("long")), 2 * size, "0")


def _le(n: Column) -> Column:
    """A number as hex digits of four bytes, smallest first."""
    h = _be(n, 4)
    return F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1)))


def _ip(protocol: int, source: Column, target: Column, body: Column) -> Column:
    h = F.lit
    return F.concat(h("4500"), _be(20 + F.length(body) / 2, 2), h("0001000040"), _be(h(protocol), 1), h("0000"), source, target, body)


def capture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a capture of one packet an event: TCP segments, DNS queries and ARP replies in turn."""
    h = F.lit
    e = events(spark, sf_dir).repartition("event_id").withColumn("kind", F.col("event_id") % 3)  # a file of events may be one task
    k, user, seq = F.col("k"), F.col("user_id"), F.col("event_id")
    mac = F.concat(h("0000000000"), _be(user % 4, 1))
    source, target = F.concat(h("0A00"), _be(F.floor(user / 256) % 256, 1), _be(user % 256, 1)), F.concat(h("0A0100"), _be(k % 8, 1))
    ports = F.concat(_be(40000 + user % 100, 2), F.when(F.col("kind") == 0, _be(1000 + k, 2)).otherwise(_be(h(53), 2)))
    segment = F.concat(ports, h("0000000000000000"), h("50"), _be(seq % 256, 1), h("200000000000"))
    label = F.concat(h("k"), k.cast("string"))
    question = F.concat(h("000701000001000000000000"), _be(F.length(label), 1), F.hex(label.cast("binary")), h("076578616D706C65036F726700"), _be(F.when(F.col("event_type") == "view", 16).otherwise(1), 2), h("0001"))
    datagram = F.concat(ports, _be(8 + F.length(question) / 2, 2), h("0000"), question)

    claimed = F.concat(h("0A0900"), _be(k % 20, 1))
    arp = F.concat(h("0001080006040002"), mac, claimed, h("000000000009"), F.when(F.col("event_type") == "view", claimed).otherwise("0A090101"))
    body = F.when(F.col("kind") == 0, F.concat(h("0800"), _ip(6, source, target, segment))).when(F.col("kind") == 1, F.concat(h("0800"), _ip(17, source, target, datagram))).otherwise(F.concat(h("0806"), arp))
    frame = F.concat(h("000000000009"), mac, body)
    size = F.length(frame) / 2
    us = F.col("us")
    content = F.concat(h("D4C3B2A1020004000000000000000000FFFF000001000000"), _le(F.floor(us / 1_000_000)), _le(us % 1_000_000), _le(size), _le(size), frame)
    return e.select(F.concat(h("event-"), seq.cast("string")).alias("path"), F.unhex(content).alias("content"))


def login_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a capture of one login an event, in turn in the block format and in the classic one with nanoseconds, largest byte first."""
    h = F.lit
    e = events(spark, sf_dir).repartition("event_id").withColumn("payload", login_payload())  # a file of events may be one task
    user, seq, us = F.col("user_id"), F.col("event_id"), F.col("us")
    source, target = F.concat(h("0A00"), _be(F.floor(user / 256) % 256, 1), _be(user % 256, 1)), F.concat(h("0A0100"), _be(user % 8, 1))
    port = F.when(F.col("event_type").isin("click", "view"), 80).otherwise(21)
    segment = F.concat(_be(40000 + user % 100, 2), _be(port, 2), h("0000000000000000"), h("5018"), h("200000000000"), F.hex(F.col("payload").cast("binary")))
    frame = F.concat(h("0000000000090000000000010800"), _ip(6, source, target, segment))
    size = F.length(frame) / 2
    classic = F.concat(h("A1B23C4D0002000400000000000000000000FFFF00000001"), _be(F.floor(us / 1_000_000), 4), _be(us % 1_000_000 * 1000, 4), _be(size, 4), _be(size, 4), frame)
    filled = F.concat(frame, F.repeat(h("00"), ((4 - size % 4) % 4).cast("int")))
    whole = 32 + F.length(filled) / 2
    block = F.concat(
        h("0A0D0D0A1C0000004D3C2B1A01000000FFFFFFFFFFFFFFFF1C000000"), h("0100000014000000010000000000040014000000"),
        h("06000000"), _le(whole), h("00000000"), _le(F.floor(us / (1 << 32))), _le(us % (1 << 32)), _le(size), _le(size), filled, _le(whole),
    )
    return e.select(F.concat(h("login-"), seq.cast("string")).alias("path"), F.unhex(F.when(seq % 2 == 0, block).otherwise(classic)).alias("content"))
