"""Command line: analyze, train, evaluate."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tidewire.config import load_config
from tidewire.plans import analyze, evaluate, report


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewire", description="Network traffic analytics on Spark")
    p.add_argument("--version", action="version", version=f"%(prog)s {report.VERSION}")
    commands = p.add_subparsers(dest="command")
    a = commands.add_parser("analyze", help="find threats in a capture")
    a.add_argument("capture")
    a.add_argument("--config", "-c")
    a.add_argument("--out-dir", "-o", default=".")
    a.add_argument("--min-ports", type=int)
    a.add_argument("--window", type=float)
    a.add_argument("--no-json", action="store_true")
    a.add_argument("--no-markdown", action="store_true")
    a.add_argument("--ml", action="store_true")
    a.add_argument("--model")
    a.add_argument("--metrics", metavar="FILE")
    a.add_argument("--keep-going", action="store_true", help="leave out detectors that fail, and say so")
    e = commands.add_parser("evaluate", help="score detection on labelled captures")
    e.add_argument("--labels", "-l", default="data/labels.yaml")
    e.add_argument("--config", "-c")
    e.add_argument("--dataset-dir", "-d", "--base-dir", "-b", default=".")
    e.add_argument("--out", "-o")
    e.add_argument("--ml", action="store_true")
    e.add_argument("--model")
    t = commands.add_parser("train", help="fit the anomaly model on benign captures")
    t.add_argument("--baseline", "-b", nargs="+", required=True)
    t.add_argument("--output", "-o", default="models/iforest")
    t.add_argument("--config", "-c")
    t.add_argument("--window", type=float)
    t.add_argument("--contamination", type=float)
    return p


def overrides(args: argparse.Namespace) -> dict:
    ml = {k: v for k, v in (("enabled", getattr(args, "ml", False) or None), ("model_path", getattr(args, "model", None)), ("contamination", getattr(args, "contamination", None))) if v is not None}
    scan = {}
    if args.command == "train" and args.window is not None:
        ml["window_seconds"] = args.window
    if args.command == "analyze":
        scan = {k: v for k, v in (("min_distinct_ports", args.min_ports), ("window_seconds", args.window)) if v is not None}
    return {k: v for k, v in (("ml", ml), ("port_scan", scan)) if v}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if not args.command:
        parser().print_help()
        return 1
    try:
        config = load_config(args.config, overrides(args))
        spark = spark or SparkSession.builder.appName("tidewire").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if args.command == "analyze":
            with report.run(spark, args.capture, config=config, out_dir=args.out_dir, as_json=not args.no_json, as_markdown=not args.no_markdown, metrics=args.metrics, to=sys.stdout, keep_going=args.keep_going) as found:
                for name, path in found.reports.items():
                    if path:
                        print(f"{name}: {path}")
        elif args.command == "evaluate":
            found = evaluate.evaluate_captures(spark, args.labels, config, args.dataset_dir)
            print(found.table())
            if args.out:
                print(f"saved: {found.save(args.out)}")
        else:
            done = analyze.train(spark, args.baseline, config, args.output)
            print(f"windows: {done['n_windows']}\nmodel: {done['model_path']}\nfeatures: {', '.join(done['feature_names'])}")
    except Exception as e:  # the exit status is the interface
        print(f"{args.command} failed: {e}", file=sys.stderr)
        return 1
    return 0
