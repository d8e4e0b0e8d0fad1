"""Batch scoring job: ``spark-submit plumbline/score.py --model M --input I --output O [--threshold T]``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.modeling import load_model, write_scored
from plumbline.session import build_session
from plumbline.sources.readers import load_table
from plumbline.sources.tables import write_csv, write_parquet

#: unknown levels that are printed, the most frequent ones
SHOWN = 50


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--model", required=True)
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True, help="ends in .parquet for Parquet, anything else is CSV")
    parser.add_argument("--threshold", type=float)
    args = parser.parse_args(argv)
    spark = build_session(app="plumbline-score")
    model = load_model(spark, args.model)
    table = load_table(spark, args.input)

    def write(scored: DataFrame) -> None:
        if "probability" in scored.columns and "probability" not in table.columns:
            scored = scored.withColumn("probability", F.round("probability", 4))
        if args.output.rstrip("/").endswith(".parquet"):
            write_parquet(scored, args.output)
        else:
            write_csv(scored, args.output)

    report = write_scored(model, table, write, args.threshold)
    print(f"{report.rows} rows scored")
    for row in report.unseen.orderBy(F.desc("rows"), "column", "level").limit(SHOWN).collect():
        print(f"level of {row['column']} that training did not hold: {row['level']} ({row['rows']} rows)")


if __name__ == "__main__":
    main()
