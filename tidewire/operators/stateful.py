"""Detectors with state of a user's own, over packets in order of time.

A user's class says what it keeps for a key and what a packet does to it; Spark deals the
packets by key, sorts them, and hands each task its keys as a stream.  Idle state is told to
go at the capture's sweeps, as in the built-in detectors, and open ends are flushed where a
key's packets end.  A packet at which the class fails costs that packet: the failure is a
row of a table of its own, and the detector goes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.config import micros
from tidewire.operators.detectors import Detector
from tidewire.schema import ALERTS, EVIDENCE, SEVERITIES

#: Alerts of users' detectors come after the built-in ones of a packet.
ORDINAL = 5
FAILURES = "capture string, detector string, seq long, us long, step string, error string"
RANKS = {s: len(SEVERITIES) - n for n, s in enumerate(SEVERITIES)}


class StatefulDetector:
    """What a user writes: a class with state of one key.

    ``key`` names the columns by which packets are dealt besides the capture; with none, a
    capture is one key, and so one task.  ``process`` gets a packet as a dict (columns of
    PACKETS; ``app`` a dict) and may give alerts: dicts with ``src``, ``summary`` and, if they
    differ from the packet's or the defaults, ``dst``, ``severity``, ``score``, ``start_us``,
    ``end_us``, ``id`` and ``evidence`` (a dict of EVIDENCE's names).  ``evict`` is told at
    each sweep that falls between two packets of the key, with the time before which idle
    state should go; ``finalize`` flushes when the key's packets end.
    """

    name = "custom"
    key: tuple[str, ...] = ("src_ip",)

    def __init__(self, config: dict[str, Any]):
        self.config = config

    def process(self, packet: dict[str, Any]) -> Iterable[dict[str, Any]] | None:
        raise NotImplementedError

    def evict(self, before_us: int) -> None:
        pass

    def finalize(self) -> Iterable[dict[str, Any]] | None:
        return None


def _row(name: str, capture: str, n: int, seq: int, us: int, a: dict[str, Any]) -> tuple:
    """An alert as a row; its id follows from what identifies it, so a task that runs again gives the same."""
    severity = a.get("severity", "MEDIUM")
    if unknown := set(a.get("evidence") or {}) - set(EVIDENCE):
        raise ValueError(f"evidence has no {', '.join(sorted(unknown))}")
    own = "|".join(map(str, (name, capture, a["src"], a.get("dst"), seq, n)))
    number = a.get("id") or f"{name[:4].upper()}-{hashlib.sha256(own.encode()).hexdigest()[:8].upper()}"
    proof = {k: (a.get("evidence") or {}).get(k) for k in EVIDENCE}
    return (capture, number, name, severity, RANKS[severity], a["src"], a.get("dst"), int(a.get("start_us", us)), int(a.get("end_us", us)), float(a.get("score", 0.5)), a["summary"], proof, seq, ORDINAL)


def run(packets: DataFrame, config: dict[str, Any], swept: DataFrame, kind: type[StatefulDetector]) -> DataFrame:
    """(alert, failure): a row for each alert and each failure of a stateful detector, one of the two null.

    Sweeps travel with the packets: where a key's next packet comes after some, it carries
    the time of the last one, so a key costs no more than its packets.
    """
    from tidewire.operators.temporal import last_sweeps

    keys, ttl = ["capture", *kind.key], micros(config["state_ttl_seconds"])
    names = packets.columns
    at = last_sweeps(packets, swept).withColumnsRenamed({"capture": "_c", "us": "_t", "sweep": "_sweep"})
    own = packets.join(at, F.col("capture").eqNullSafe(F.col("_c")) & (F.col("us") == F.col("_t")), "left").select(*names, "_sweep")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, now, last, made = None, None, None, 0

        def tried(step: str, capture: str, seq: int, us: int, call, *args) -> tuple[list, list]:
            nonlocal made
            out = []
            try:
                for a in call(*args) or ():
                    made += 1
                    out.append(_row(kind.name, capture, made, seq, us, a))
                return out, []
            except Exception as e:  # one packet's failure is a row, and no more
                return out, [(capture, kind.name, seq, us, step, f"{type(e).__name__}: {e}"[:500])]

        def frame(alerts: list, failures: list) -> pd.DataFrame:
            empty = [None] * (len(alerts) + len(failures))
            out = pd.DataFrame({"alert": empty, "failure": empty}, dtype=object)
            for n, a in enumerate(alerts):
                out.at[n, "alert"] = dict(zip(ALERT_NAMES, a))
            for n, f in enumerate(failures):
                out.at[len(alerts) + n, "failure"] = dict(zip(FAILURE_NAMES, f))
            return out

        def ended() -> tuple[list, list]:
            return tried("finalize", now[0], last[0], last[1], state.finalize) if state is not None else ([], [])

        swept_at = None
        for b in batches:
            alerts, failures = [], []
            for p in b.astype(object).where(b.notna(), None).to_dict("records"):
                sweep, own_key = p.pop("_sweep"), tuple(p[k] for k in keys)
                if state is None or own_key != now:
                    for found, into in zip(ended(), (alerts, failures)):
                        into += found
                    state, now, made, swept_at = kind(config), own_key, 0, sweep
                seq, us = int(p["seq"]), int(p["us"])
                last = (seq, us)
                if sweep is not None and sweep != swept_at:
                    swept_at = sweep
                    failures += tried("evict", now[0], seq, us, lambda t: state.evict(t), int(sweep) - ttl)[1]
                p = {k: None if isinstance(v, float) and v != v else v for k, v in p.items()}
                for found, into in zip(tried("process", now[0], seq, us, state.process, p), (alerts, failures)):
                    into += found
            yield frame(alerts, failures)
        yield frame(*ended()) if state is not None else frame([], [])

    return own.repartition(*keys).sortWithinPartitions(*keys, "us", "seq").mapInPandas(fold, f"alert struct<{_typed(ALERTS)}>, failure struct<{_typed(FAILURES)}>")


def _typed(fields: str) -> str:
    """Fields of a schema in the notation of a struct."""
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(fields).simpleString()[len("struct<") : -1]


ALERT_NAMES = ("capture", "id", "detector", "severity", "severity_rank", "src", "dst", "start_us", "end_us", "score", "summary", "evidence", "emit_seq", "emit_ord")
FAILURE_NAMES = tuple(x.split()[0] for x in FAILURES.split(", "))


def detector(kind: type[StatefulDetector]) -> Detector:
    """A user's class as a detector like the built-in ones; failures are left out (``run`` tells them)."""

    def find(packets: DataFrame, config: dict[str, Any], swept: DataFrame) -> DataFrame:
        return run(packets, config, swept, kind).where("alert is not null").select("alert.*")

    find.stateful = kind
    return find
