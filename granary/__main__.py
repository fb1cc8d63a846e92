"""spark-submit -m granary: run lake jobs by name, e.g. `python -m granary s3a://lake prices price_features`."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from granary.plans.lake import JOBS, Lake


def main() -> None:
    parser = argparse.ArgumentParser(prog="granary")
    parser.add_argument("root", help="folder or bucket that holds the layers")
    parser.add_argument("jobs", nargs="+", choices=sorted(JOBS))
    args = parser.parse_args()
    spark = SparkSession.builder.appName("granary").getOrCreate()
    lake = Lake(spark, args.root)
    for name in args.jobs:
        JOBS[name](lake)


if __name__ == "__main__":
    main()
