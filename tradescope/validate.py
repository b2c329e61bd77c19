"""Command line validation: load tables, write the required-table check and the profile.

    python -m tradescope.validate --tables <folder> --out <folder>
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tradescope.operators.quality import quality_profile, validate_required
from tradescope.registry import table_specs
from tradescope.sources.loader import load
from tradescope.sources.parquet import ParquetSource
from tradescope.sources.sinks import write_csv


def validate(spark: SparkSession, tables: str, out: str) -> None:
    ds, report = load(ParquetSource(spark, tables), keys=table_specs("validation"), profile="validation")
    write_csv(report, f"{out}/load_report")
    write_csv(validate_required(ds), f"{out}/required_tables")
    if len(ds):
        write_csv(quality_profile(ds), f"{out}/quality_profile")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--tables", required=True, help="folder with <namespace>/<table> Parquet")
    parser.add_argument("--out", required=True, help="folder for the CSV results")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("tradescope-validate").getOrCreate()
    validate(spark, args.tables, args.out)


if __name__ == "__main__":
    main()
