"""Command line: python -m notelake list | run | prepare | evaluate."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    from . import catalog
    from .operators.metrics import format_report
    from .plans import engine
    from .plans.config import load_config, parameters, put, value_of

    p = argparse.ArgumentParser(prog="notelake")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="the queries")
    run = sub.add_parser("run", help="a query over a folder of tables")
    run.add_argument("query")
    prepare = sub.add_parser("prepare", help="MIDI files to sequences of ids by split, with their vocabulary")
    evaluate = sub.add_parser("evaluate", help="a table of metrics for folders of MIDI files")
    evaluate.add_argument("--arm", action="append", default=[], metavar="LABEL=FOLDER", required=True)
    evaluate.add_argument("--reference", metavar="FOLDER")
    for x in (run, prepare, evaluate):
        x.add_argument("--config", action="append", default=[])
        x.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
        x.add_argument("--out")
    for x in (run, prepare):
        x.add_argument("--data", required=True)
    args = p.parse_args(argv)
    if args.command == "list":
        print("\n".join(catalog.QUERIES))
        return 0
    config = load_config(*args.config)
    for item in args.set:
        name, found, text = item.partition("=")
        if not found:
            p.error(f"--set {item}: NAME=VALUE is wanted")
        put(config, name, value_of(text))
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    given = parameters(config)
    if args.command == "run":
        df = engine.run(spark, args.query, args.data, **given)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(50, False)
    elif args.command == "prepare":
        from .sources.corpus import prepare as build

        print(build(spark, args.data, args.out or "processed", config))
    else:
        from .sources.corpus import evaluate as report

        text = format_report(report(spark, dict(x.split("=", 1) for x in args.arm), args.reference, **given))
        if args.out:
            with open(args.out, "w", encoding="utf-8") as f:
                f.write(text + "\n")
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
