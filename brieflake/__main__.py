"""python -m brieflake [--list | NAME FOLDER [--out PATH]]: runs a query over a folder of tables."""

from __future__ import annotations

import argparse


def main() -> None:
    from brieflake.plans.catalog import QUERIES

    p = argparse.ArgumentParser(prog="brieflake", description=__doc__)
    p.add_argument("name", nargs="?")
    p.add_argument("folder", nargs="?")
    p.add_argument("--list", action="store_true")
    p.add_argument("--out", help="write Parquet here instead of showing rows")
    a = p.parse_args()
    if a.list or not a.name or not a.folder:
        print("\n".join(sorted(QUERIES)))
        return
    from pyspark.sql import SparkSession

    df = QUERIES[a.name](SparkSession.builder.appName("brieflake").getOrCreate(), a.folder)
    df.write.mode("overwrite").parquet(a.out) if a.out else df.show(50, truncate=80)


if __name__ == "__main__":
    main()
