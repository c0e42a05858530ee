"""Detectors of a user's own, with state, against a plain loop."""

import random

from tests import captures as C
from tidewire.config import load_config
from tidewire.operators.stateful import StatefulDetector
from tidewire.plans.analyze import analyse


class Repeats(StatefulDetector):
    """A source that reaches a port again within the time to live: every second time is an alert."""

    name = "repeats"

    def __init__(self, config):
        super().__init__(config)
        self.seen, self.swept = {}, 0

    def process(self, packet):
        if packet["dst_port"] == 13:
            raise RuntimeError("port 13")
        n, _ = self.seen.get(packet["dst_port"], (0, 0))
        self.seen[packet["dst_port"]] = (n + 1, packet["us"])
        if n % 2:
            return [{"src": packet["src_ip"], "dst": packet["dst_ip"], "severity": "LOW", "score": 0.25, "summary": f"{packet['dst_port']} again, {n + 1} times", "evidence": {"target_port": packet["dst_port"]}}]

    def evict(self, before_us):
        self.swept += 1
        self.seen = {k: v for k, v in self.seen.items() if v[1] >= before_us}

    def finalize(self):
        yield {"src": "end", "summary": f"{len(self.seen)} ports, swept {self.swept} times"}


def plain(rows, interval, ttl):
    """The same class for each key, with the capture's sweeps, one packet after another."""
    out, failed, made, last, now, due = [], [], {}, {}, None, {}
    for seq, (us, r) in enumerate(rows):
        if now is None:
            now = us
        elif us - now >= interval:
            now = us
            for k in made:
                due[k] = now  # a key hears of the last sweep before its next packet
        key = r["src_ip"]
        if key not in made:
            made[key] = Repeats({})
        elif due.pop(key, None) is not None:
            made[key].evict(now - ttl)
        last[key] = seq
        try:
            out += [(seq, a["src"], a["summary"]) for a in made[key].process({**r, "us": us}) or ()]
        except RuntimeError:
            failed.append(seq)
    return sorted(out + [(last[k], a["src"], a["summary"]) for k, d in made.items() for a in d.finalize()]), failed


def test_a_users_detector_runs_in_an_analysis(spark):
    rnd = random.Random(2)
    us, rows = C.T0, []
    for _ in range(400):
        us += rnd.choice([10**5, 10**6, 9 * 10**6])
        rows.append((us, {"src_ip": f"s{rnd.randrange(4)}", "dst_ip": "d", "dst_port": rnd.choice([11, 12, 13, 14, 15, 16]), "tcp_flags": "A"}))
    rows.append((us + 1, {"src_ip": None, "dst_ip": "d", "dst_port": 1, "tcp_flags": "A"}))
    cfg = load_config(overrides={"state_ttl_seconds": 60, "sweep_interval_seconds": 20})
    want, failed = plain(rows, 20 * 10**6, 60 * 10**6)
    with analyse(C.packets(spark, rows), cfg, {"repeats": Repeats}) as own:
        raw = own.raw.collect()
        assert sorted((r.emit_seq, r.src, r.summary) for r in raw) == want and any(r.evidence.target_port for r in raw) and len({r.id for r in raw}) == len(raw)
        assert sorted(r.seq for r in own.failures.collect()) == failed != [] and {(r.detector, r.step, r.error) for r in own.failures.collect()} == {("repeats", "process", "RuntimeError: port 13")}
        assert 0 < own.alerts.count() <= len(raw) and own.alerts.where("severity = 'LOW'").count() > 0
