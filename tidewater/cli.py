"""The command line: gen-data, sql, explain, profile."""

from __future__ import annotations

import argparse
import sys

from tidewater import output
from tidewater.errors import EngineError
from tidewater.operators.profile import profile_table
from tidewater.session import Session, SessionOptions
from tidewater.sources.datagen import write_demo_table
from tidewater.sources.parquet import WriteOptions


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewater", description="SQL over Parquet tables on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    gen = sub.add_parser("gen-data", help="write the demo table")
    gen.add_argument("--out", required=True)
    gen.add_argument("--rows", type=int, default=1_000_000)
    gen.add_argument("--seed", type=int, default=42)
    gen.add_argument("--special-floats", action="store_true")
    gen.add_argument("--compression", default="zstd")
    gen.add_argument("--row-group-rows", type=int, default=262_144)
    for name in ("sql", "explain", "profile"):
        q = sub.add_parser(name)
        if name != "profile":
            q.add_argument("-q", "--query", required=True)
        q.add_argument("--table", action="append", default=[], metavar="NAME=PATH")
        q.add_argument("--output", choices=output.FORMATS, default="table")
        where = q.add_mutually_exclusive_group()
        where.add_argument("--cluster", metavar="MASTER", help="a Spark master URL")
        where.add_argument("--cores", default="*")
        q.add_argument("--batch-size", type=int)
    return p


def _session(args) -> Session:
    options = SessionOptions(args.batch_size)
    quiet = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    s = Session.connect(args.cluster, options, **quiet) if args.cluster else Session.local(args.cores, options, **quiet)
    for t in args.table:
        name, eq, path = t.partition("=")
        if not eq or not name or not path:
            raise EngineError("plan", f"--table takes NAME=PATH, not {t!r}")
        s.register_parquet(name, path)
    return s


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        if args.command == "gen-data":
            options = WriteOptions(compression=args.compression, row_group_rows=args.row_group_rows, bloom_columns=["id", "k"])
            options.spark_options()
            s = Session.local(**{"spark.ui.showConsoleProgress": "false"})
            print(write_demo_table(s.spark, args.out, args.rows, args.seed, args.special_floats, options), "rows")
            return 0
        s = _session(args)
        if args.command == "sql":
            output.print_rows(s.sql(args.query), args.output)
        elif args.command == "explain":
            print(s.explain(args.query), end="")
        else:
            for name in s.tables:
                output.print_rows(profile_table(s.table(name).df), args.output)
        return 0
    except EngineError as e:
        print(f"{e.kind}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
