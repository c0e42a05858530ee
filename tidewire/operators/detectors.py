"""Detectors: from packets to raw alerts.

Each takes a packets relation, the settings and the capture's sweeps.  They share a
shape: window aggregates and a predicate leave the few rows that trip, an ordered
throttle chooses the emissions, and evidence is gathered for those alone.

The sentences of alert summaries are fixed values: readers of reports match them.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.config import micros
from tidewire.functions import network as N
from tidewire.operators.temporal import COPIES, growth_throttle, joined_evidence, last_sweeps, throttle, trailing, window_evidence, with_epochs
from tidewire.schema import EVIDENCE, REDACTED

Detector = Callable[[DataFrame, dict[str, Any], DataFrame], DataFrame]

#: Fixed values of the detectors that no setting changes.
CREDS_MUTE, DNS_MUTE, ARP_MUTE, SCAN_MUTE = 60, 30, 30, 2
SCAN_GROWTH, SCAN_MAJORITY, SCAN_HIGH = 1.5, 0.6, 100
DNS_VOLUME_ENTROPY, DNS_RECORD_NAMES, DNS_RECORDS, DNS_RECORDS_HIGH = 3.0, 10, 8, 10


def evidence(**values: Column) -> Column:
    return F.struct(*(values[k].cast(t).alias(k) if k in values else F.lit(None).cast(t).alias(k) for k, t in EVIDENCE.items()))


def alerts(df: DataFrame, detector: str, prefix: str, ordinal: int, rank: Column, src: Column, dst: Column, start: Column, end: Column, score: Column, summary: Column, proof: Column) -> DataFrame:
    """The alert columns.  Ids are digests of what identifies an emission, so a task that runs again gives the same."""
    key = F.concat_ws("|", F.lit(detector), F.lit(ordinal), "capture", src, dst, F.col("seq").cast("string"))
    number = F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(F.sha2(key.cast("binary"), 256), 1, 8)))
    return df.select(
        "capture", number.alias("id"), F.lit(detector).alias("detector"), N.severity_of(rank).alias("severity"), rank.cast("int").alias("severity_rank"), src.alias("src"), dst.alias("dst"),
        start.cast("long").alias("start_us"), end.cast("long").alias("end_us"), score.cast("double").alias("score"), summary.alias("summary"), proof.alias("evidence"),
        F.col("seq").cast("long").alias("emit_seq"), F.lit(ordinal).alias("emit_ord"),
    )


def probes(packets: DataFrame) -> DataFrame:
    """TCP packets whose flags a scan would send."""
    own = packets.where("proto = 'TCP' and src_ip <> '' and dst_port is not null").where(N.is_probe(F.col("tcp_flags")))
    return own.select("capture", "seq", "us", "src_ip", N.or_default(F.col("dst_ip"), "unknown").alias("dst_ip"), "dst_port", F.coalesce("tcp_flags", F.lit("")).alias("tcp_flags"))


def lived(rows: DataFrame, keys: list[str], swept: DataFrame, ttl_us: int, longest_us: int) -> tuple[DataFrame, list[str]]:
    """Rows and keys such that state ends where an idle key was evicted.

    State older than its longest window or mute time has no effect, so eviction shows
    only if the ttl is shorter.
    """
    return (with_epochs(rows, keys, swept, ttl_us), [*keys, "epoch"]) if ttl_us < longest_us else (rows, keys)


def scan_sums() -> dict[str, Column]:
    """What is counted of a window's probes: all, and those of each kind of scan."""
    flags = F.col("tcp_flags")
    return {"probes": F.lit(1), "syn": flags == "S", "null": flags == "", "fin": flags == "F", "xmas": N.is_xmas(flags)}


def scan_windows(rows: DataFrame, cfg: dict[str, Any], keys: list[str], told: bool = False) -> DataFrame:
    """Of each probe's fast and slow window the distinct ports and, if they are to be ``told``, the hosts, the probes, and those of each kind."""
    for name, seconds in (("fast", cfg["port_scan"]["window_seconds"]), ("slow", cfg["port_scan"]["slow_window_seconds"])):
        sums = {f"{name}_{k}": c for k, c in scan_sums().items()} if told else {}
        rows = trailing(rows, keys, micros(seconds), sums=sums, distinct={f"{name}_ports": "dst_port"} | ({f"{name}_hosts": "dst_ip"} if told else {}))
    return rows


def scan_type(total: Column, syn: Column, null: Column, fin: Column, xmas: Column) -> Column:
    kind = F.lit("tcp_sweep")
    for name, n in reversed((("syn", syn), ("null", null), ("fin", fin), ("xmas", xmas))):
        kind = F.when(n / total >= SCAN_MAJORITY, name).otherwise(kind)
    return F.when(total > 0, kind).otherwise("unknown")


def scan_emissions(rows: DataFrame, cfg: dict[str, Any], keys: list[str], mute_us: int = micros(SCAN_MUTE), told: bool = False) -> DataFrame:
    """The probes at which a source is reported: ``kind`` is the window that tells it, n its distinct ports; with ``told``, hosts, probes and kinds are of that window, too."""
    ps, more = cfg["port_scan"], ("hosts", *scan_sums()) if told else ()
    seen = scan_windows(rows.select("seq", "us", *keys, "dst_port", *(("dst_ip", "tcp_flags") if told else ())), cfg, keys, told)
    fast_n = F.when(F.col("fast_ports") >= ps["min_distinct_ports"], F.col("fast_ports")).otherwise(0)
    slow_n = F.when(F.col("slow_ports") >= ps["slow_min_distinct_ports"], F.col("slow_ports")).otherwise(0)
    candidates = seen.select("seq", "us", *keys, fast_n.alias("fast_n"), slow_n.alias("slow_n"), *(f"{w}_{k}" for w in ("fast", "slow") for k in more)).where("fast_n > 0 or slow_n > 0")
    own = lambda k: F.when(F.col("kind") == "fast", F.col(f"fast_{k}")).otherwise(F.col(f"slow_{k}")).alias(k)
    return growth_throttle(candidates, keys, mute_us, SCAN_GROWTH).select("seq", "us", *keys, "kind", own("n"), *map(own, more))


def port_scan(packets: DataFrame, cfg: dict[str, Any], swept: DataFrame, mute_us: int = micros(SCAN_MUTE)) -> DataFrame:
    """Sources that probe many ports within a fast or a slow window.

    A source that is reported every mute time has each probe in so many windows as there are
    mute times in one.  If these are many, counts come from running sums and the rest from
    panes; if few, windows are joined with their probes.
    """
    fast, slow = micros(cfg["port_scan"]["window_seconds"]), micros(cfg["port_scan"]["slow_window_seconds"])
    rows, keys = lived(probes(packets), ["capture", "src_ip"], swept, micros(cfg["state_ttl_seconds"]), max(fast, slow, mute_us))
    width = F.when(F.col("kind") == "fast", fast).otherwise(slow)
    least = {"ports": (F.lpad(F.col("dst_port").cast("string"), 5, "0"), 10), "targets": (F.col("dst_ip"), 5)}
    overlap = max(fast, slow) > COPIES * mute_us
    out = scan_emissions(rows, cfg, keys, mute_us, overlap)
    if overlap:
        done = window_evidence(out, rows, keys, width, max(fast, slow), least)
    else:
        done = joined_evidence(out, rows, keys, width, max(fast, slow), least, sums=scan_sums()).withColumnRenamed("n_targets", "hosts")
    kind = F.concat(F.when(F.col("kind") == "slow", "slow_").otherwise(""), scan_type(F.col("probes"), F.col("syn"), F.col("null"), F.col("fin"), F.col("xmas")))
    n, hosts = F.col("n"), F.col("hosts")
    span = N.seconds(F.greatest(F.lit(1000), F.col("us") - F.col("first")))
    score = F.round(F.least(F.lit(0.99), F.when(F.col("kind") == "fast", 0.8).otherwise(0.7) + n / 500.0 * 0.2), 4)
    summary = F.concat(F.upper(kind), F.lit(" port scan detected from "), "src_ip", F.lit(": "), n.cast("string"), F.lit(" distinct ports targeted across "), hosts.cast("string"), F.lit(" host(s) in "), F.round(span, 2).cast("string"), F.lit("s"))
    proof = evidence(
        scan_type=kind, distinct_ports_count=n, total_probes=F.col("probes"), sample_ports=F.transform("ports", lambda p: p.cast("int")), probe_rate_per_sec=F.round(F.col("probes") / span, 2),
        window_type=F.col("kind"), target_hosts_count=hosts, sample_target_hosts=F.col("targets"),
    )
    return alerts(done, "port_scan", "SCAN", 0, F.when(n >= SCAN_HIGH, 3).otherwise(2), F.col("src_ip"), F.when(hosts == 1, F.col("targets")[0]), F.col("first"), F.col("us"), score, summary, proof)


def credentials(packets: DataFrame, cfg: dict[str, Any], swept: DataFrame | None) -> DataFrame:
    """HTTP Basic and FTP logins with their user: a password's user is that of the latest USER before it on the same connection.

    ``swept`` as in ``with_epochs``.
    """
    ttl = micros(cfg["state_ttl_seconds"])
    own = packets.where("src_ip <> ''").select("capture", "seq", "us", "src_ip", N.or_default(F.col("dst_ip"), "unknown").alias("dst_ip"), "dst_port", "app.http_auth", "app.ftp_cmd")
    http = own.where("http_auth is not null").select("capture", "seq", "us", "src_ip", "dst_ip", "dst_port", F.lit("HTTP").alias("protocol"), F.coalesce("http_auth.username", F.lit("unknown")).alias("username"))
    ftp = own.where("ftp_cmd.cmd in ('USER', 'PASS')")
    by = Window.partitionBy("capture", "src_ip", "dst_ip").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("ftp_cmd.cmd") == "USER", F.struct("us", F.coalesce("ftp_cmd.arg", F.lit("")).alias("arg"))), ignorenulls=True).over(by)
    logins = ftp.withColumn("session", last).where("ftp_cmd.cmd = 'PASS'")
    # The session is gone if it is older than the ttl at the last sweep; only logins that late need the sweep.
    if swept is None:
        logins = logins.withColumn("_sweep", F.lit(None).cast("long"))
    else:
        swept_at = last_sweeps(logins.where(F.col("us") - F.col("session.us") > ttl), swept).select(F.col("capture").alias("_c"), F.col("us").alias("_t"), F.col("sweep").alias("_sweep"))
        logins = logins.join(swept_at, (F.col("capture") == F.col("_c")) & (F.col("us") == F.col("_t")), "left")
    alive = F.coalesce(F.col("session.us") >= F.col("_sweep") - ttl, F.col("session").isNotNull())
    ftp = logins.select("capture", "seq", "us", "src_ip", "dst_ip", "dst_port", F.lit("FTP").alias("protocol"), F.when(alive, F.col("session.arg")).otherwise("unknown").alias("username"))
    return http.unionByName(ftp)


def cleartext_creds(packets: DataFrame, cfg: dict[str, Any], swept: DataFrame | None, mute_us: int = micros(CREDS_MUTE)) -> DataFrame:
    """Logins in clear text, one alert a user and connection in a mute time; passwords never leave the decoder."""
    seen = credentials(packets, cfg, swept)
    if not cfg["cleartext_creds"].get("enabled", True):
        seen = seen.where(F.lit(False))
    out = throttle(seen, ["capture", "protocol", "src_ip", "dst_ip", "username"], mute_us)
    is_http = F.col("protocol") == "HTTP"
    what = F.when(is_http, "Cleartext HTTP Basic Authentication detected from ").otherwise("Cleartext FTP login credentials detected from ")
    proof = evidence(
        protocol=F.col("protocol"), auth_type=F.when(is_http, "Basic"), username=F.col("username"), password=F.lit(REDACTED),
        target_port=F.when(is_http, N.or_default(F.col("dst_port"), 80)).otherwise(N.or_default(F.col("dst_port"), 21)),
    )
    summary = F.concat(what, "src_ip", F.lit(" to "), "dst_ip")
    both = [alerts(out.where(c), "cleartext_creds", "CRED", n, F.lit(2), F.col("src_ip"), F.col("dst_ip"), F.col("us"), F.col("us"), F.lit(1.0), summary, proof) for n, c in ((1, is_http), (2, ~is_http))]
    return both[0].unionByName(both[1])


def arp_claims(packets: DataFrame, cfg: dict[str, Any]) -> DataFrame:
    """Claims of an address by a MAC, without those that are void or allowed."""
    a = F.col("app.arp")
    own = packets.where((F.col("proto") == "ARP") & a.isNotNull()).select("capture", "seq", "us", a["hwsrc"].alias("mac"), a["psrc"].alias("ip"), a["op"].alias("op"), F.coalesce(a["is_gratuitous"], F.lit(False)).alias("is_gratuitous"))
    own = own.where("mac <> '' and ip <> '' and ip not in ('0.0.0.0', '255.255.255.255')")
    allowed = [m.lower() for m in cfg["arp_spoof"].get("allowlist_macs", [])]
    return own.where(~F.lower("mac").isin(allowed)) if allowed else own


def arp_lives(claims: DataFrame, cfg: dict[str, Any], swept: DataFrame | None) -> DataFrame:
    """Claims with ``epoch``, which tells the lives of an address apart, and ``was``, the MAC of the claim before."""
    own = with_epochs(claims, ["capture", "ip"], swept, micros(cfg["state_ttl_seconds"]))
    return own.withColumn("was", F.lag("mac").over(Window.partitionBy("capture", "ip", "epoch").orderBy("us", "seq")))


def arp_changes(lives: DataFrame) -> DataFrame:
    """Claims that differ from the one before: ``was`` is the former MAC."""
    return lives.where("was is not null and was <> mac")


def with_known_macs(rows: DataFrame, lives: DataFrame) -> DataFrame:
    """Adds ``known`` to claims: all MACs that had claimed the address by then, from when each did so first.

    A claim meets the MACs that it tells and those that come later in the life.
    """
    key = ["capture", "ip", "epoch"]
    firsts = lives.groupBy(*key, F.col("mac").alias("other")).agg(F.min(F.struct("us", "seq")).alias("_first"))  # summed up before they are dealt
    seen = rows.select(*key, "us", "seq").join(firsts, key).where(F.col("_first") <= F.struct("us", "seq"))
    known = seen.groupBy(*key, "us", "seq").agg(F.sort_array(F.collect_list("other")).alias("known"))
    return rows.join(known, [*key, "us", "seq"])


def arp_spoof(packets: DataFrame, cfg: dict[str, Any], swept: DataFrame | None, mute_us: int = micros(ARP_MUTE)) -> DataFrame:
    """Addresses that another MAC claims than before."""
    lives = arp_lives(arp_claims(packets, cfg), cfg, swept)
    out = with_known_macs(throttle(arp_changes(lives), ["capture", "ip", "mac"], mute_us), lives)
    summary = F.concat(F.lit("ARP spoofing detected: IP "), "ip", F.lit(" was claimed by "), "mac", F.lit(" (previously mapped to "), "was", F.lit(")"))
    proof = evidence(
        victim_ip=F.col("ip"), original_mac=F.col("was"), spoofed_mac=F.col("mac"), all_known_macs=F.col("known"), is_gratuitous=F.col("is_gratuitous"),
        change_type=F.when(F.col("is_gratuitous"), "gratuitous_arp_override").otherwise("mac_binding_conflict"), arp_opcode=F.col("op"),
    )
    return alerts(out, "arp_spoof", "ARP", 3, F.lit(3), F.col("mac"), F.col("ip"), F.col("us"), F.col("us"), F.lit(0.95), summary, proof)


def dns_queries(packets: DataFrame, cfg: dict[str, Any]) -> DataFrame:
    """Queries with their parent domain and measures, without allowed domains."""
    d = F.col("app.dns")
    own = packets.where(d.isNotNull() & (F.col("src_ip") != "") & (d["qr"] == 0) & d["qname"].isNotNull())
    own = own.select("capture", "seq", "us", "src_ip", N.or_default(F.col("dst_ip"), "unknown").alias("dst_ip"), d["qname"].alias("qname"), F.coalesce(d["qtype"], F.lit(1)).alias("qtype"))
    own = own.withColumn("parent", N.parent_domain(F.col("qname"))).where("parent <> ''")
    own = N.without_allowed(own, "qname", "parent", cfg["dns_tunnel"].get("domain_allowlist", []))
    return own.withColumn("label", N.max_label_length(F.col("qname"))).withColumn("entropy", F.round(N.entropy(N.subdomain(F.col("qname"))), 3))


def dns_trips(queries: DataFrame, cfg: dict[str, Any], keys: list[str]) -> DataFrame:
    """Queries that trip, with the counts of their window."""
    c = cfg["dns_tunnel"]
    sums = {"records": F.col("qtype").isin(10, 16), "total": F.lit(1), "high": F.col("entropy") >= DNS_VOLUME_ENTROPY}
    seen = trailing(queries, keys, micros(c["window_seconds"]), sums=sums, distinct={"names": "qname"})
    single = (F.col("label") >= c["max_label_length"]) & (F.col("entropy") >= c["min_entropy"])
    volume = (F.col("names") >= c["min_unique_subdomains"]) & (F.col("high") > 0)
    record = (F.col("names") >= DNS_RECORD_NAMES) & (F.col("records") >= DNS_RECORDS) & (F.col("high") > 0)
    return seen.withColumn("single", single).withColumn("volume", volume).withColumn("record", record).where("single or volume or record")


def dns_tunnel(packets: DataFrame, cfg: dict[str, Any], swept: DataFrame, mute_us: int = micros(DNS_MUTE)) -> DataFrame:
    """Sources whose queries under one domain look like a tunnel: one telling name, many names, or many TXT and NULL records."""
    width = micros(cfg["dns_tunnel"]["window_seconds"])
    rows, keys = lived(dns_queries(packets, cfg), ["capture", "src_ip", "parent"], swept, micros(cfg["state_ttl_seconds"]), max(width, mute_us))
    out = throttle(dns_trips(rows, cfg, keys), keys, mute_us).withColumnsRenamed({"entropy": "own_entropy", "label": "own_label"})
    evidence_of = window_evidence if width > COPIES * mute_us else joined_evidence
    done = evidence_of(out, rows, keys, F.lit(width), width, {"sample": (F.col("qname"), 5)}, ("entropy", "label")).withColumnsRenamed({"entropy": "top_entropy", "label": "top_label"})
    more = F.col("volume") | F.col("record")
    score = F.when(F.col("single") & more, 0.98).when(F.col("single"), F.least(F.lit(0.95), 0.75 + F.col("top_label") / 100.0 * 0.2)).when(F.col("volume"), F.least(F.lit(0.95), 0.80 + F.col("names") / 100.0 * 0.15)).otherwise(0.80)
    rank = F.when((score >= 0.90) | (F.col("records") >= DNS_RECORDS_HIGH), 3).otherwise(2)
    summary = F.concat(F.lit("DNS tunneling / exfiltration indicator detected for domain '"), "parent", F.lit("' from "), "src_ip", F.lit(": "), F.col("names").cast("string"), F.lit(" unique subdomains, max entropy "), F.col("top_entropy").cast("string"))
    proof = evidence(
        parent_domain=F.col("parent"), unique_subdomains_count=F.col("names"), max_entropy=F.col("top_entropy"), max_label_length=F.col("top_label"), txt_null_queries_count=F.col("records"),
        total_queries_in_window=F.col("total"), sample_queries=F.col("sample"), single_query_trip=F.col("single"), volume_trip=F.col("volume"),
    )
    return alerts(done, "dns_tunnel", "DNS", 4, rank, F.col("src_ip"), F.col("dst_ip"), F.col("first"), F.col("us"), F.round(score, 4), summary, proof)


#: Registered detectors, in the order in which their alerts of one packet are emitted.
RULES: dict[str, Detector] = {"port_scan": port_scan, "cleartext_creds": cleartext_creds, "arp_spoof": arp_spoof, "dns_tunnel": dns_tunnel}
