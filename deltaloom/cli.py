"""Command line: `scan` one adapter, or a `batch` of them. Run with spark-submit or python -m deltaloom.cli."""

from __future__ import annotations

import argparse
import contextlib
import sys
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .functions import ids
from .plans import batch
from .plans.scan import Settings, scan
from .sinks import reports
from .sources import listing


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="deltaloom")
    sub = out.add_subparsers(dest="command", required=True)
    one = sub.add_parser("scan")
    one.add_argument("adapter")
    one.add_argument("--format", choices=["text", "json", "full-json", "sarif"], default="text")
    one.add_argument("--output")
    one.add_argument("--include-modules", action="store_true")
    one.add_argument("--include-heads", action="store_true")
    many = sub.add_parser("batch")
    source = many.add_mutually_exclusive_group(required=True)
    source.add_argument("--input-dir")
    source.add_argument("--input-list")
    many.add_argument("--run-id", default="run")
    many.add_argument("--output-dir", required=True)
    many.add_argument("--force-rescan", action="store_true")
    for p in (one, many):
        p.add_argument("--mode", choices=["fast", "full"], default="full")
        p.add_argument("--policy", choices=["default", "strict"], default="default")
        p.add_argument("--fail-on", choices=["review", "block"])
    return out


@contextlib.contextmanager
def _folder(spark: SparkSession) -> Iterator[str]:
    """A folder for intermediate tables: in the cluster's shared one, or on a local master a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        yield f"{shared.rstrip('/')}/scan-{uuid.uuid4().hex}"
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    with tempfile.TemporaryDirectory() as folder:
        yield folder


def _scan(args: argparse.Namespace, work: batch.Workspace, paths: DataFrame, settings: Settings) -> int:
    found = work.written(scan(paths, settings, written=work.written), "document")
    text = {"text": reports.as_text, "json": reports.as_json, "full-json": lambda r: reports.as_json(r, True), "sarif": reports.as_sarif}[args.format](found).first()[1]
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)
    row = found.select("status", "verdict.action").first()
    reached = args.fail_on and ids.ACTIONS.index(row["action"]) >= ids.ACTIONS.index(args.fail_on)
    return 1 if row["status"] == "failed" else 2 if reached else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("deltaloom").getOrCreate()
    if args.command == "scan":
        paths = spark.createDataFrame([(args.adapter,)], "path string")
        settings = Settings(args.mode, args.policy, include_modules=args.include_modules or args.format == "full-json", include_heads=args.include_heads)
        with _folder(spark) as folder:
            return _scan(args, batch.Workspace(spark, folder), paths, settings)
    work = batch.Workspace(spark, args.output_dir)
    if args.input_dir:
        paths = listing.scan_dir(spark, args.input_dir).selectExpr("path", "0L AS ordinal")
    else:
        paths = listing.scan_list(spark.read.text(args.input_list).selectExpr("value AS line", "monotonically_increasing_id() AS ordinal"))
    out = batch.run(work, paths, Settings(args.mode, args.policy, args.run_id, include_modules=False), force=args.force_rescan)
    for r in out.groupBy("outcome", "action").count().orderBy("outcome", "action").collect():
        print(f"{r['outcome']} {r['action']}: {r['count']}")
    code = batch.exit_code(out, args.fail_on)
    work.clear()
    return code


if __name__ == "__main__":
    sys.exit(main())
