"""Detectors over streams: the same rules as in batch, with keyed state in the state store.

Each detector is a fold of one key's rows in order of time.  State is a small document
per key; idle keys are dropped by event-time timers, exactly ``ttl`` after their last
row (in batch, at the next sweep after that).  Rows that come in one micro-batch are
sorted before they are folded; rows older than the watermark are dropped.
"""

from __future__ import annotations

import json
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewire.config import micros
from tidewire.operators import detectors as D
from tidewire.schema import FEATURES

#: A step gets the state of a key (None at first) and a row, and returns the new state and what the row emits, or None.
#: Its state is a JSON document between micro-batches; ``load`` and ``dump``, where it has them, make and read that.
Step = Callable[[dict | None, dict], tuple[dict | None, dict | None]]


class Recent:
    """Values by when they were last seen: how many were within a window is counted without looking at them all.

    A value moves to the end when it is seen again, so what has left the window is always
    at the beginning, and a row costs what it adds and what leaves.
    """

    def __init__(self, width_us: int, seen: list | None = None):
        self.width_us, self.seen = width_us, OrderedDict((v, us) for v, us in seen or [])

    def add(self, us: int, value: Any) -> int:
        self.seen[value] = us
        self.seen.move_to_end(value)
        while next(iter(self.seen.values())) < us - self.width_us:
            self.seen.popitem(last=False)
        return len(self.seen)

    def doc(self) -> list:
        return list(self.seen.items())


class KeyedFold(StatefulProcessor):
    def __init__(self, keys: list[str], out: list[str], step: Step, ttl_ms: int):
        self.keys, self.out, self.step, self.ttl_ms = keys, out, step, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "doc string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "seq"])  # one key's rows of one micro-batch
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        if hasattr(self.step, "load"):
            state = self.step.load(state)
        found = []
        for row in batch.to_dict("records"):
            state, emitted = self.step(state, row)
            if emitted is not None:
                found.append({**row, **emitted})
        if state is not None:
            self.state.update((json.dumps(self.step.dump(state) if hasattr(self.step, "dump") else state),))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(batch["us"].iloc[-1]) // 1000 + self.ttl_ms)
        yield pd.DataFrame(found, columns=self.out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame(columns=self.out)

    def close(self) -> None:
        pass


def folded(rows: DataFrame, keys: list[str], step: Step, ttl_us: int, extra: str = "", watermark: str = "1 minute") -> DataFrame:
    """Rows that a keyed fold lets pass, with the columns that it adds (``extra``: their names and types)."""
    own = rows.withColumn("event_time", F.timestamp_micros("us")).withWatermark("event_time", watermark)
    fields = [(f.name, f.dataType.simpleString()) for f in own.schema.fields] + [tuple(x.split()) for x in extra.split(", ") if x]
    out = ", ".join(f"`{n}` {t}" for n, t in fields)
    fold = KeyedFold(keys, [n for n, _ in fields], step, ttl_us // 1000)
    return own.groupBy(*keys).transformWithStateInPandas(statefulProcessor=fold, outputStructType=out, outputMode="Append", timeMode="EventTime")


def throttle_step(gap_us: int) -> Step:
    def step(state: dict | None, row: dict) -> tuple[dict, dict | None]:
        us = int(row["us"])
        return ({"last": us}, {}) if state is None or us - state["last"] > gap_us else (state, None)

    return step


def throttle(rows: DataFrame, keys: list[str], gap_us: int, ttl_us: int, watermark: str = "1 minute") -> DataFrame:
    return folded(rows, keys, throttle_step(gap_us), ttl_us, watermark=watermark)


def arp_step(mute_us: int) -> Step:
    """The binding of an address, all its MACs, and when each was last reported."""

    def step(state: dict | None, row: dict) -> tuple[dict, dict | None]:
        mac, us = row["mac"], int(row["us"])
        if state is None:
            return {"mac": mac, "macs": [mac], "said": {}}, None
        was = state["mac"]
        if mac == was:
            return state, None
        state = {**state, "mac": mac, "macs": sorted({*state["macs"], mac})}
        last = state["said"].get(mac)
        if last is not None and us - last <= mute_us:
            return state, None
        return {**state, "said": {**state["said"], mac: us}}, {"was": was, "known": ",".join(state["macs"])}

    return step


def arp_changes(packets: DataFrame, cfg: dict[str, Any], mute_us: int = micros(D.ARP_MUTE), watermark: str = "1 minute") -> DataFrame:
    return folded(D.arp_claims(packets, cfg), ["capture", "ip"], arp_step(mute_us), micros(cfg["state_ttl_seconds"]), "was string, known string", watermark)


class ScanStep:
    """The ports of a source by when each was last probed, within either window, and the last emission."""

    def __init__(self, cfg: dict[str, Any], mute_us: int):
        ps = cfg["port_scan"]
        self.widths = {"fast": micros(ps["window_seconds"]), "slow": micros(ps["slow_window_seconds"])}
        self.least = {"fast": ps["min_distinct_ports"], "slow": ps["slow_min_distinct_ports"]}
        self.mute_us = mute_us

    def load(self, doc: dict | None) -> dict:
        doc = doc or {"last": None, "n": 0, "fast": [], "slow": []}
        return {"last": doc["last"], "n": doc["n"], **{k: Recent(w, doc[k]) for k, w in self.widths.items()}}

    def dump(self, state: dict) -> dict:
        return {"last": state["last"], "n": state["n"], **{k: state[k].doc() for k in self.widths}}

    def __call__(self, state: dict, row: dict) -> tuple[dict, dict | None]:
        us = int(row["us"])
        counts = {k: state[k].add(us, int(row["dst_port"])) for k in self.widths}
        for kind, n in counts.items():
            if n >= self.least[kind] and (state["last"] is None or us - state["last"] >= self.mute_us or n >= D.SCAN_GROWTH * state["n"]):
                state["last"], state["n"] = us, n
                return state, {"kind": kind, "n": n}
        return state, None


def scan_emissions(packets: DataFrame, cfg: dict[str, Any], mute_us: int = micros(D.SCAN_MUTE), watermark: str = "1 minute") -> DataFrame:
    ttl = max(micros(cfg["state_ttl_seconds"]), micros(cfg["port_scan"]["slow_window_seconds"]))
    return folded(D.probes(packets), ["capture", "src_ip"], ScanStep(cfg, mute_us), ttl, "kind string, n long", watermark)


class DnsStep:
    """The names of a source's queries under one domain by when each was last asked, counts by time, and the last emission."""

    def __init__(self, cfg: dict[str, Any], mute_us: int):
        self.cfg, self.width_us, self.mute_us = cfg["dns_tunnel"], micros(cfg["dns_tunnel"]["window_seconds"]), mute_us

    def load(self, doc: dict | None) -> dict:
        doc = doc or {"last": None, "names": [], "times": []}
        times = deque(doc["times"])  # [us, queries, TXT and NULL records, queries of high entropy] a time
        return {"last": doc["last"], "names": Recent(self.width_us, doc["names"]), "times": times, "sums": [sum(t[k] for t in times) for k in (1, 2, 3)]}

    def dump(self, state: dict) -> dict:
        return {"last": state["last"], "names": state["names"].doc(), "times": list(state["times"])}

    def __call__(self, state: dict, row: dict) -> tuple[dict, dict | None]:
        us, c, times, sums = int(row["us"]), self.cfg, state["times"], state["sums"]
        names = state["names"].add(us, row["qname"])
        if not times or times[-1][0] != us:
            times.append([us, 0, 0, 0])
        for k, n in enumerate((1, int(row["qtype"] in (10, 16)), int(row["entropy"] >= D.DNS_VOLUME_ENTROPY))):
            times[-1][k + 1] += n
            sums[k] += n
        while times[0][0] < us - self.width_us:
            gone = times.popleft()
            for k in range(3):
                sums[k] -= gone[k + 1]
        total, records, high = sums
        single = row["label"] >= c["max_label_length"] and row["entropy"] >= c["min_entropy"]
        volume = names >= c["min_unique_subdomains"] and high > 0
        record = names >= D.DNS_RECORD_NAMES and records >= D.DNS_RECORDS and high > 0
        if not (single or volume or record) or state["last"] is not None and us - state["last"] <= self.mute_us:
            return state, None
        state["last"] = us
        return state, {"names": names, "records": records, "total": total, "single": bool(single), "volume": bool(volume), "record": bool(record)}


def dns_emissions(packets: DataFrame, cfg: dict[str, Any], mute_us: int = micros(D.DNS_MUTE), watermark: str = "1 minute") -> DataFrame:
    """Queries at which a source looks like a tunnel, with the counts of their window."""
    ttl = max(micros(cfg["state_ttl_seconds"]), micros(cfg["dns_tunnel"]["window_seconds"]), mute_us)
    extra = "names long, records long, total long, single boolean, volume boolean, record boolean"
    return folded(D.dns_queries(packets, cfg), ["capture", "src_ip", "parent"], DnsStep(cfg, mute_us), ttl, extra, watermark)


def login_step(mute_us: int, ttl_us: int) -> Step:
    """The latest FTP user of a connection, and when each user's login was last reported."""

    def step(state: dict | None, row: dict) -> tuple[dict, dict | None]:
        us, state = int(row["us"]), state or {"session": None, "said": {}}
        if row["kind"] == "USER":
            return {**state, "session": [us, row["name"]]}, None
        session = state["session"]
        alive = session is not None and us - session[0] <= ttl_us
        protocol, user = ("HTTP", row["name"]) if row["kind"] == "HTTP" else ("FTP", session[1] if alive else "unknown")
        said = {k: t for k, t in state["said"].items() if us - t <= mute_us}
        if (key := f"{protocol}:{user}") in said:
            return {**state, "said": said}, None
        return {**state, "said": {**said, key: us}}, {"protocol": protocol, "username": user}

    return step


def logins(packets: DataFrame, cfg: dict[str, Any], mute_us: int = micros(D.CREDS_MUTE), watermark: str = "1 minute") -> DataFrame:
    """Logins in clear text, one a user and connection in a mute time.  A session ends exactly the ttl after its USER."""
    ttl = micros(cfg["state_ttl_seconds"])
    a, f = F.col("app.http_auth"), F.col("app.ftp_cmd")
    own = packets.where((F.col("src_ip") != "") & (a.isNotNull() | f["cmd"].isin("USER", "PASS")))
    if not cfg["cleartext_creds"].get("enabled", True):
        own = own.where(F.lit(False))
    name = F.when(a.isNotNull(), F.coalesce(a["username"], F.lit("unknown"))).when(f["cmd"] == "USER", F.coalesce(f["arg"], F.lit("")))
    own = own.select("capture", "seq", "us", "src_ip", F.coalesce(F.when(F.col("dst_ip") != "", F.col("dst_ip")), F.lit("unknown")).alias("dst_ip"), F.when(a.isNotNull(), "HTTP").otherwise(f["cmd"]).alias("kind"), name.alias("name"))
    return folded(own, ["capture", "src_ip", "dst_ip"], login_step(mute_us, ttl), max(ttl, mute_us), "protocol string, username string", watermark)


def flow_windows(packets: DataFrame, window_seconds: int = 60, watermark: str = "1 minute") -> DataFrame:
    """Features of closed windows: a window is emitted once when the watermark has passed its end."""
    flags = F.coalesce("tcp_flags", F.lit(""))
    tcp = F.col("proto") == "TCP"
    syn, ack = F.contains(flags, F.lit("S")), F.contains(flags, F.lit("A"))
    dns = (F.col("proto") == "UDP") & (F.col("dst_port") == 53) & (F.coalesce("app.dns.qname", F.lit("")) != "") & (F.col("app.dns.qr") == 0)
    own = packets.withColumn("event_time", F.timestamp_micros("us")).withWatermark("event_time", watermark)
    roles = F.array(F.struct(F.when(F.col("src_ip") != "", F.col("src_ip")).alias("ip"), F.lit(True).alias("out")), F.struct(F.when((F.col("dst_ip") != "") & (F.coalesce("src_ip", F.lit("")) != F.col("dst_ip")), F.col("dst_ip")).alias("ip"), F.lit(False).alias("out")))
    both = own.withColumn("role", F.explode(roles)).where("role.ip is not null")
    out = F.col("role.out")
    # A distinct value is a state row of its own (kinds 0 to 2), and so are the sums (kind 3): none grows with what an endpoint does.
    value = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("value"))
    none = F.lit(None).cast("string")
    kinds = F.array(
        value(0, F.when(out, F.to_json(F.struct("proto", "dst_ip", "src_port", "dst_port")))), value(1, F.when(out & (F.col("dst_ip") != ""), F.col("dst_ip"))), value(2, F.when(out, F.col("dst_port"))), value(3, none)
    )
    flat = both.select(
        "event_time", "capture", F.col("role.ip").alias("src_ip"), out.cast("int").alias("out"), F.when(out, F.col("length")).alias("sent"), F.when(~out, F.col("length")).alias("received"),
        (out & tcp & syn & ~ack).cast("int").alias("syn"), (~out & tcp & syn & ack).cast("int").alias("synack"), F.coalesce(out & dns, F.lit(False)).cast("int").alias("dns"), F.explode(kinds).alias("k"),
    ).where("k.kind = 3 or k.value is not null")
    names = ("out", "sent", "received", "syn", "synack", "dns")
    values = flat.groupBy("capture", "src_ip", F.window("event_time", f"{window_seconds} seconds").alias("w"), "k").agg(*(F.sum(F.when(F.col("k.kind") == 3, F.col(n))).alias(n) for n in names))
    sums = values.groupBy("capture", "src_ip", F.window("w", f"{window_seconds} seconds").alias("w")).agg(
        *(F.count_if(F.col("k.kind") == n).alias(c) for n, c in enumerate(("connections", "ips", "ports"))), *(F.sum(n).alias("packets" if n == "out" else n) for n in names)
    ).where("packets > 0")
    minutes = window_seconds / 60.0
    values = (
        F.col("connections") / minutes, F.col("ips"), F.col("ports"), F.col("syn"), F.col("syn") / F.greatest("synack", F.lit(1)), F.col("sent") / F.greatest(F.coalesce("received", F.lit(0)), F.lit(1)),
        F.col("sent") / F.col("packets"), F.col("dns") / minutes,
    )
    start = F.col("w.start").cast("double")
    return sums.select("capture", "src_ip", start.alias("window_start"), (start + window_seconds).alias("window_end"), *(F.round(v.cast("double"), 6).alias(n) for n, v in zip(FEATURES, values)))
