"""Command line: python -m citegraph QUERY FOLDER [--limit N] runs a registered query; --list names them."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> int:
    from citegraph.plans import people_queries, sync_queries  # noqa: F401  they add their queries
    from citegraph.plans.queries import QUERIES

    parser = argparse.ArgumentParser(prog="citegraph", description=__doc__)
    parser.add_argument("query", nargs="?")
    parser.add_argument("folder", nargs="?")
    parser.add_argument("--limit", type=int, default=20)
    parser.add_argument("--list", action="store_true")
    given = parser.parse_args(args)
    if given.list or not given.query:
        print(*sorted(QUERIES), sep="\n")
        return 0
    if given.query not in QUERIES:
        parser.error(f"unknown query {given.query}; known: {', '.join(sorted(QUERIES))}")
    if not given.folder:
        parser.error("a folder of tables is needed")
    spark = SparkSession.builder.appName("citegraph").getOrCreate()
    for row in QUERIES[given.query](spark, given.folder).limit(given.limit).toJSON().collect():
        print(row)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
