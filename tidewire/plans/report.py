"""Reports of an analysis: JSON, Markdown, Prometheus text, and a summary for the terminal.

Counts are aggregated by Spark.  The alerts themselves are fetched partition by partition
while a report is written, line by line, so the driver holds one partition of them.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.alerts import grid, offenders, rank_order, serialised, top_scores
from tidewire.plans.analyze import Analysis, analyse_captures
from tidewire.schema import DETECTORS, SEVERITIES

VERSION = "0.1.0"
PREFIX = "tidewire"


class Report:
    def __init__(self, analysis: Analysis):
        self.analysis = analysis
        self.found = analysis.alerts
        s = analysis.stats.agg(
            F.sort_array(F.collect_list("capture")).alias("captures"), F.sum("total_packets").alias("total_packets"), F.sum("valid_packets").alias("valid_packets"), F.sum("malformed_packets").alias("malformed_packets"),
            F.sum("duration_seconds").alias("duration_seconds"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
        ).first().asDict()
        files = s.pop("captures")
        self.stats = {k: v or 0 if k not in ("start_time", "end_time") else v for k, v in s.items()}
        self.stats["filepath"] = ", ".join(files)
        self.stats["file_size_bytes"] = sum(os.path.getsize(f) for f in files if os.path.isfile(f))
        rows = self.found.groupBy("severity", "detector").count().collect()
        self.by_severity = {s: sum(r["count"] for r in rows if r["severity"] == s) for s in SEVERITIES}
        self.by_detector = {d: sum(r["count"] for r in rows if r["detector"] == d) for d in sorted({r["detector"] for r in rows})}
        self.total = sum(self.by_severity.values())

    def alerts(self) -> Iterator[dict[str, Any]]:
        for r in serialised(self.found.orderBy(*rank_order())).toLocalIterator():
            out = r.asDict()
            out.pop("capture")
            yield out | {"evidence": json.loads(out["evidence"])}

    def head(self) -> dict[str, Any]:
        """What a JSON report says besides its alerts."""
        meta = {k: self.stats[k] for k in ("filepath", "file_size_bytes", "total_packets", "valid_packets", "malformed_packets")}
        meta |= {"duration_seconds": round(self.stats["duration_seconds"], 4), "start_time": self.stats["start_time"], "end_time": self.stats["end_time"]}
        top = [{"src": r["src"], "alert_count": r["n"]} for r in offenders(self.found, 10).collect()]
        return {
            "version": VERSION, "generated_at": datetime.now(UTC).isoformat(), "capture_metadata": meta,
            "summary": {"total_alerts": self.total, "alerts_by_severity": self.by_severity, "alerts_by_detector": self.by_detector, "top_offenders": top},
            "config": self.analysis.config,
        }

    def json_lines(self) -> Iterator[str]:
        """The JSON report; each alert is a line of its own."""
        yield json.dumps(self.head(), indent=2)[:-2] + ',\n  "alerts": ['
        comma = ""
        for a in self.alerts():
            yield f"{comma}\n    {json.dumps(a)}"
            comma = ","
        yield "\n  ]\n}\n"

    def markdown_lines(self) -> Iterator[str]:
        """The Markdown report: what was read, who stands out, and a paragraph an alert."""
        s, by = self.stats, self.by_severity
        yield f"# Alerts in {s['filepath']}\n\n"
        yield f"{self.total} alerts ({', '.join(f'{by[k]} {k.lower()}' for k in SEVERITIES)}) in {s['valid_packets']:,} packets over {s['duration_seconds']:.2f} s. "
        yield f"{s['file_size_bytes']:,} bytes were read, {s['malformed_packets']} packets could not be decoded. Written on {datetime.now(UTC):%Y-%m-%d at %H:%M:%S} UTC.\n\n"
        top = offenders(self.found, 5).collect()
        if top:
            yield "## Sources\n\nsource | alerts | worst | by\n-|-|-|-\n"
            yield from (f"{r['src']} | {r['n']} | {r['severity']} | {r['detectors']}\n" for r in top)
            yield "\n## Alerts by rank\n\n"
        else:
            yield "Nothing passed the thresholds.\n\n"
        for n, a in enumerate(self.alerts(), 1):
            yield f"{n}. **{a['severity']}, {a['score']}**: {a['summary']}\n"
            yield f"   {a['detector']} `{a['id']}`, {a['src']} to {a['dst'] or 'several targets'}, {a['start_ts']:.2f} to {a['end_ts']:.2f}\n"
            for k, v in a["evidence"].items():
                more = f" and {len(v) - 12} others" if isinstance(v, list) and len(v) > 12 else ""
                yield f"   - {k}: {', '.join(map(str, v[:12])) if isinstance(v, list) else v}{more}\n"
            yield "\n"
        yield "## What this cannot show\n\nScans slower than both port windows, and logins that are encrypted. Passwords are masked while packets are decoded and stored nowhere.\n"

    def metrics(self, detectors: tuple = DETECTORS) -> str:
        names = tuple(dict.fromkeys((*detectors, *self.by_detector)))
        counts = {(r["detector"], r["severity"]): r["n"] for r in grid(self.found, names).collect()}
        best = {r["detector"]: r["score_max"] for r in top_scores(self.found, names).collect()}
        s = self.stats
        families = [
            ("packets_total", "counter", "Packets that were decoded", [("", s["valid_packets"])]), ("malformed_packets_total", "counter", "Packets that could not be decoded", [("", s["malformed_packets"])]),
            ("capture_duration_seconds", "gauge", "Seconds between first and last packet", [("", round(s["duration_seconds"], 4))]),
            ("alerts_total", "counter", "Merged alerts of a detector and severity", [(f'{{detector="{d}",severity="{v}"}}', counts[d, v]) for d in names for v in SEVERITIES]),
            ("alert_score_max", "gauge", "Largest score among the alerts of a detector", [(f'{{detector="{d}"}}', best[d]) for d in names]),
        ]
        lines = []
        for name, kind, text, values in families:
            lines += [f"# HELP {PREFIX}_{name} {text}", f"# TYPE {PREFIX}_{name} {kind}", *(f"{PREFIX}_{name}{label} {value}" for label, value in values)]
        return "\n".join(lines) + "\n"

    def summary(self, to: TextIO) -> None:
        s, by = self.stats, self.by_severity
        print(f"packets {s['valid_packets']:,}, malformed {s['malformed_packets']}, duration {round(s['duration_seconds'], 2)} s", file=to)
        print(f"alerts {self.total}: " + ", ".join(f"{k}={by[k]}" for k in SEVERITIES), file=to)
        for r in self.found.orderBy(*rank_order()).limit(5).collect():
            print(f"  [{r['severity']}] {r['score']} {r['summary']}", file=to)
        if self.total > 5:
            print(f"  and {self.total - 5} of lower rank", file=to)


def write_lines(path: str | Path, lines: Iterable[str]) -> str:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", encoding="utf-8") as f:
        f.writelines(lines)
    return str(path)


def write_reports(report: Report, out_dir: str | Path, as_json: bool = True, as_markdown: bool = True, metrics: str | Path | None = None) -> dict[str, str | None]:
    out = Path(out_dir)
    return {
        "json_report": write_lines(out / "report.json", report.json_lines()) if as_json else None,
        "markdown_report": write_lines(out / "report.md", report.markdown_lines()) if as_markdown else None,
        "metrics_file": write_lines(metrics, [report.metrics()]) if metrics else None,
    }


@dataclass(frozen=True)
class Findings:
    """What an analysis of captures came to: statistics, merged alerts with their ranks, and the files written.

    The alerts are there until ``close``, or until the context ends.
    """

    stats: dict[str, Any]
    alerts: DataFrame
    reports: dict[str, str | None]
    analysis: Analysis

    def close(self) -> None:
        self.analysis.close()

    def __enter__(self) -> Findings:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def run(
    spark: SparkSession, *paths: str, config: dict[str, Any] | None = None, out_dir: str | Path = ".", as_json: bool = True, as_markdown: bool = True, metrics: str | Path | None = None, to: TextIO | None = None, keep_going: bool = False,
) -> Findings:
    """Analyse captures and write their reports in one call; ``to`` gets a summary."""
    analysis = analyse_captures(spark, *paths, config=config, keep_going=keep_going)
    try:
        own = Report(analysis)
        if to is not None:
            own.summary(to)
        return Findings(own.stats, own.found, write_reports(own, out_dir, as_json, as_markdown, metrics), analysis)
    except BaseException:
        analysis.close()
        raise
