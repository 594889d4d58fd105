"""Command line: ``python -m earshot clean|features|reports|models INPUT OUTPUT``."""

from __future__ import annotations

import argparse
import json
from datetime import timedelta

from pyspark.sql import SparkSession

from earshot.constants import SESSION_GAP_MINUTES
from earshot.plans import runs
from earshot.sources.staging import drop_staged


def main() -> None:
    parser = argparse.ArgumentParser(prog="earshot", description=__doc__)
    parser.add_argument("step", choices=("clean", "features", "reports", "models"))
    parser.add_argument("source", help="raw CSV, cleaned table or feature table")
    parser.add_argument("out", help="folder for the results")
    parser.add_argument("--gap-minutes", type=float, default=SESSION_GAP_MINUTES)
    parser.add_argument("--leak-free", action="store_true", help="keep the current play out of rolling means")
    args = parser.parse_args()
    spark = SparkSession.builder.appName(f"earshot {args.step}").getOrCreate()
    try:
        if args.step == "clean":
            paths = runs.clean_run(spark, args.source, args.out)
        elif args.step == "features":
            paths = runs.feature_run(spark, args.source, args.out, timedelta(minutes=args.gap_minutes), args.leak_free)
        elif args.step == "reports":
            paths = runs.report_run(spark, args.source, args.out, timedelta(minutes=args.gap_minutes))
        else:
            paths = runs.model_run(spark, args.source, args.out)
        print(json.dumps(paths, indent=2))
    finally:
        drop_staged(spark)
        spark.stop()


if __name__ == "__main__":
    main()
