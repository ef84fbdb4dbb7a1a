"""spark-submit tarja/cli.py --input PATH --output PATH [--return_type detail|position|text|mask] [--labels A,B] [--foreign_passport]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tarja.functions.patterns import Catalog
from tarja.plans.engine import Engine
from tarja.sources.files import read_markdown, read_texts, write_table


def main(argv: list[str] | None = None) -> str:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", help="a .md file or folder glob, or a .parquet or .csv table with id and text")
    p.add_argument("--text", help="a literal text")
    p.add_argument("--output", required=True)
    p.add_argument("--return_type", default="position", choices=["detail", "position", "text", "mask"])
    p.add_argument("--labels", default="")
    p.add_argument("--foreign_passport", action="store_true")
    p.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if (a.input is None) == (a.text is None):
        p.error("give either --input or --text")
    if a.text is not None:
        df = spark.createDataFrame([(0, a.text)], "id long, text string")
    else:
        df = read_markdown(spark, a.input) if a.input.endswith(".md") else read_texts(spark, a.input)
    catalog = Catalog().with_labels(a.labels.split(","), foreign_rg=True, foreign_passport=a.foreign_passport) if a.labels else Catalog.default(foreign_passport=a.foreign_passport)
    engine = Engine(catalog)
    keys = [c for c in df.columns if c != "text"]
    if a.return_type == "mask":
        out = engine.anonymize(df).select(*keys, F.col("masked").alias("text"))
    else:
        out = engine.extract(df, kind=a.return_type).select(*keys, "spans")
    return write_table(out, a.output, a.format)


if __name__ == "__main__":
    main()
