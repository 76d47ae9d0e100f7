"""Run a registered query: python -m quillspan QUERY TABLES [--out FOLDER] [--format csv|json|parquet] [--rows N]; without a query, their names."""

from __future__ import annotations

import argparse

from quillspan.plans import registry
from quillspan.sources import sinks


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quillspan", description=__doc__)
    p.add_argument("query", nargs="?")
    p.add_argument("tables", nargs="?", help="folder of the Parquet tables")
    p.add_argument("--out", help="folder for the result; without one its first rows are shown")
    p.add_argument("--format", choices=("csv", "json", "parquet"), default="csv")
    p.add_argument("--rows", type=int, default=20, help="rows to show")
    a = p.parse_args(argv)
    known = registry.queries()
    if a.query is None:
        print("\n".join(sorted(known)))
        return
    if a.query not in known or a.tables is None:
        p.error(f"unknown query {a.query}" if a.query not in known else "TABLES is missing")
    from pyspark.sql import SparkSession

    df = known[a.query](SparkSession.builder.getOrCreate(), a.tables)
    if a.out is None:
        df.show(a.rows, truncate=False)
    elif a.format == "parquet":
        df.write.parquet(a.out)
    else:
        (sinks.write_csv if a.format == "csv" else sinks.write_json)(df, a.out)


if __name__ == "__main__":
    main()
