"""python -m spanlake NAME --tables DIR [--out DIR]: run a registered query; init, series, status and doctor look after a workspace."""

from __future__ import annotations

import argparse
import json
import sys


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spanlake", description=__doc__)
    parser.add_argument("name", help="a query, list, init, series, status or doctor")
    parser.add_argument("--tables", help="the folder of the tables that a query reads")
    parser.add_argument("--out", help="where a query's rows are put, whole or not at all; without it they are shown")
    parser.add_argument("--root", help="a workspace")
    parser.add_argument("--bind", help="the series that a workspace belongs to")
    asked = parser.parse_args(arguments)
    from pyspark.sql import SparkSession

    from .plans import catalogue
    from .sources import sinks, workspace

    if asked.name == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    spark = SparkSession.builder.appName("spanlake").getOrCreate()
    if asked.name in ("init", "series", "status", "doctor"):
        if not asked.root or (asked.name == "series" and not asked.bind):
            parser.error(f"{asked.name} needs --root" + (" and --bind" if asked.name == "series" else ""))
        try:
            told = {"init": workspace.init, "status": workspace.series_status, "doctor": workspace.doctor}[asked.name](spark, asked.root) if asked.name != "series" else workspace.bind_series(spark, asked.root, asked.bind)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        print(json.dumps(told, ensure_ascii=False))
        return 0
    if asked.name not in catalogue.QUERIES or not asked.tables:
        parser.error(f"{asked.name} is no query" if asked.name not in catalogue.QUERIES else "a query needs --tables")
    rows = catalogue.QUERIES[asked.name](spark, asked.tables)
    if asked.out:
        sinks.replace_table(rows, asked.out)
    else:
        rows.show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
