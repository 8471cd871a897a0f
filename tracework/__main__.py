"""python -m tracework list | run NAME --data DIR [--out PATH] | explain NAME --data DIR | sql NAME: the registered queries
from the command line."""

from __future__ import annotations

import argparse
import sys

from tracework.plans import catalog


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m tracework", description="Run registered queries over a folder of tables.")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries, and whether each has an oracle")
    for name, told in (("run", "print a query's rows as JSON lines, or write them as Parquet"), ("explain", "a query's plan"), ("sql", "a query's oracle")):
        sub = commands.add_parser(name, help=told)
        sub.add_argument("query", choices=sorted(catalog.QUERIES))
        if name != "sql":
            sub.add_argument("--data", required=True, help="folder of the tables")
        if name == "run":
            sub.add_argument("--out", default="", help="Parquet path; without it rows are printed")
            sub.add_argument("--rows", type=int, default=100, help="rows that are printed")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(f"{name}{'' if name in catalog.ORACLES else '  (no oracle)'}" for name in sorted(catalog.QUERIES)))
        return 0
    if args.command == "sql":
        print(catalog.ORACLES.get(args.query, "-- no oracle"))
        return 0
    from pyspark.sql import SparkSession

    found = catalog.QUERIES[args.query](SparkSession.builder.appName("tracework").getOrCreate(), args.data)
    if args.command == "explain":
        found.explain("formatted")
    elif args.out:
        found.write.mode("overwrite").parquet(args.out)
    else:
        print("\n".join(found.toJSON().take(args.rows)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
