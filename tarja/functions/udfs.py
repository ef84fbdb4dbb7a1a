"""The functions by name in SQL: `register(spark)`. Check digits are SQL functions made of their Column forms; pattern_spans is a table function."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tarja.functions import checkdigits as check
from tarja.functions.patterns import BUILT_IN

SCALARS = {"is_cpf": check.cpf, "is_cnh": check.cnh, "is_pis": check.pis, "is_cns": check.cns, "is_voter": check.voter, "is_cnpj": check.cnpj}


class PatternSpans:
    """pattern_spans(text, label): the raw matches of a label's patterns, before any context."""

    def eval(self, text: str, label: str):
        for i, p in enumerate(BUILT_IN.get(label, [])):
            for m in re.finditer(p, text or ""):
                yield f"{label}:{i + 1}", m.start(), m.end(), m.group()


def sql_of(spark: SparkSession, value: Column) -> str:
    """The SQL text of an expression over a string x, for a function's body."""
    plan = spark.sql("SELECT CAST(NULL AS STRING) AS x").select(value.alias("y"))._jdf.queryExecution().analyzed()
    return plan.expressions().head().child().sql()


def register(spark: SparkSession) -> None:
    for name, f in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS BOOLEAN RETURN {sql_of(spark, f(F.col('x')))}")
    spark.udtf.register("pattern_spans", udtf(PatternSpans, returnType="pattern string, start int, end int, text string"))
