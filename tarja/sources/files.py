"""Texts, ground truth, predictions, reports, annotation lines and curriculum sets: Spark readers and writers.

Suffixes are tested before anything is read. All readers are lazy but for CSV and JSON, whose columns Spark infers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarja.operators.evaluate import KEYS, prepare, require
from tarja.operators.training import ENTITIES, named, none

#: An annotation line: labels as [[start, end, label]], or entities as objects or such lists.
LINE = "text string, labels array<string>, entities array<string>"


def _suffix(path: str, allowed: tuple[str, ...]) -> str:
    found = next((s for s in allowed if path.rstrip("/").lower().endswith("." + s)), None)
    if found is None:
        raise ValueError(f"{path}: one of {', '.join(allowed)} is needed")
    return found


def read_table(spark: SparkSession, path: str, allowed: tuple[str, ...] = ("parquet", "csv", "json")) -> DataFrame:
    kind = _suffix(path, allowed)
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')
    return spark.read.json(path, multiLine=True) if kind == "json" else spark.read.parquet(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> str:
    """Writes under `path` with the kind's suffix and returns that path. Arrays and structs become JSON text in CSV."""
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown format: {kind}")
    path = path if path.lower().endswith("." + kind) else path.rsplit(".", 1)[0] + "." + kind if path.rsplit(".", 1)[-1] in ("parquet", "csv", "json") else f"{path}.{kind}"
    if kind == "csv":
        nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")]
        df.withColumns({c: F.to_json(c) for c in nested}).write.mode(mode).csv(path, header=True, escape='"')
    else:
        getattr(df.write.mode(mode), kind)(path)
    return path


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): Markdown files, one row each. Any other suffix is an error; globs and folders of .md files are fine."""
    _suffix(path, ("md",))
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return require(read_table(spark, path, ("parquet", "csv")), ["id", "text"], "texts")


def read_truth(spark: SparkSession, path: str, mapping: dict[str, str] | None = None, normalized: bool = False) -> DataFrame:
    df = read_table(spark, path, ("parquet", "csv"))
    return prepare(df, "ground truth", mapping, normalized) if mapping is not None else prepare(df, "ground truth", normalized=normalized)


def read_predictions(spark: SparkSession, path: str, normalized: bool = False) -> DataFrame:
    return prepare(read_table(spark, path), "predictions", normalized=normalized)


def write_predictions(df: DataFrame, path: str, kind: str = "parquet") -> str:
    return write_table(require(df, KEYS, "predictions"), path, kind)


# ---- annotation lines -----------------------------------------------------------------------------------------------
def _one(x: Column) -> Column:
    """An entity of either notation, null if it is neither."""
    as_list = F.from_json(x, "array<string>")
    pick = lambda *names: F.coalesce(*[F.get_json_object(x, f"$.{n}") for n in names])
    from_list = F.struct(F.get(as_list, F.lit(0)).cast("int").alias("start"), F.get(as_list, F.lit(1)).cast("int").alias("end"), F.get(as_list, F.lit(2)).alias("label"))
    from_object = F.struct(pick("start_offset", "start").cast("int").alias("start"), pick("end_offset", "end").cast("int").alias("end"), pick("label").alias("label"))
    return F.when(F.startswith(F.ltrim(x), F.lit("[")), from_list).otherwise(from_object)


def parse_lines(lines: DataFrame) -> DataFrame:
    """(line, value) to (line, text, entities, problem): problem is bad_json, empty_text, no_entities (neither key) or null.
    `labels` wins over `entities`."""
    df = lines.withColumn("r", F.from_json("value", LINE, {"mode": "PERMISSIVE"}))
    raw = F.coalesce(F.when(F.size("r.labels") > 0, F.col("r.labels")), F.col("r.entities"), F.col("r.labels"))
    found = F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), _one), lambda e: e["start"].isNotNull() & e["end"].isNotNull() & e["label"].isNotNull())
    broken = F.col("r").isNull() | (F.col("r.text").isNull() & F.get_json_object("value", "$.text").isNull() & F.get_json_object("value", "$").isNull())
    problem = F.when(broken, "bad_json").when(F.coalesce(F.trim("r.text"), F.lit("")) == "", "empty_text").when(raw.isNull(), "no_entities")
    return df.select("line", F.col("r.text").alias("text"), found.cast(ENTITIES).alias("entities"), problem.alias("problem"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of .jsonl files with their 1-based numbers in the file; blank lines are left out. A file is
    read whole, as only its own reader knows the numbers; many files are read in parallel."""
    _suffix(path, ("jsonl",))
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.split("value", r"\r?\n", -1)).alias("pos", "value"))
    return rows.where(F.trim("value") != "").select((F.col("pos") + 1).alias("line"), "value")


def read_annotations(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    """Examples (id, text, entities) of annotation lines without a problem; lines without entities only if `keep_empty`.

    Numbers the lines only through the file's own reader; large inputs come as many files."""
    rows = parse_lines(numbered_lines(spark, path))
    good = F.col("problem").isNull() | (F.lit(keep_empty) & (F.col("problem") == "no_entities"))
    return rows.where(good).select(F.col("line").cast("long").alias("id"), "text", F.coalesce("entities", none()).alias("entities"))


def write_annotations(examples: DataFrame, path: str, layout: str = "labels") -> str:
    """JSON lines in UTF-8; layout `labels` gives [[start, end, label]], `entities` gives objects."""
    if layout == "labels":
        body = F.concat(F.lit('{"text":'), F.substring(F.to_json(F.struct("text")), 9, 2**31 - 1))
        items = F.transform("entities", lambda e: F.concat(F.lit("["), e["start"].cast("string"), F.lit(","), e["end"].cast("string"), F.lit(","), F.get(F.split(F.to_json(F.array(e["label"])), "^\\["), F.lit(1))))
        line = F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(',"labels":['), F.array_join(items, ","), F.lit("]}"))
    elif layout == "entities":
        line = F.to_json(F.struct("text", F.transform("entities", lambda e: F.struct(e["start"].alias("start_offset"), e["end"].alias("end_offset"), e["label"].alias("label"))).alias("entities")))
    else:
        raise ValueError(f"unknown layout: {layout}")
    examples.select(line.alias("value")).write.mode("overwrite").text(path)
    return path


def examples_of(spark: SparkSession, source) -> DataFrame:
    """Examples of a .jsonl path, a frame (text, entities), a frame with a row per entity, or a list of (text, {entities})."""
    if isinstance(source, str):
        return read_annotations(spark, source, keep_empty=True)
    if isinstance(source, DataFrame):
        from tarja.operators.training import from_rows

        if "entities" in source.columns:
            text = named(source, text=("text", "texto")).columns[0]
            return source.withColumnRenamed("texto", text) if "texto" in source.columns else source
        return from_rows(source)
    rows = []
    for i, item in enumerate(source):
        text, notes = item if isinstance(item, tuple) else (item["text"], item)
        found = notes.get("entities", notes.get("labels", []))
        rows.append((i + 1, text, [(e["start"], e["end"], e["label"]) if isinstance(e, dict) else tuple(e) for e in found]))
    return spark.createDataFrame(rows, f"id long, text string, entities {ENTITIES}")


# ---- curriculum and folds -------------------------------------------------------------------------------------------
def write_curriculum(df: DataFrame, path: str, name: str = "train") -> str:
    df.withColumn("conjunto", F.lit(name)).write.mode("append").partitionBy("conjunto", "janela").parquet(path)
    return path


def read_curriculum(spark: SparkSession, path: str, name: str | None = None, window: str | None = None) -> DataFrame:
    """Partition filters reach the file listing."""
    df = spark.read.parquet(path)
    df = df.where(F.col("conjunto") == name) if name else df
    return df.where(F.col("janela") == window) if window else df


def write_folds(folds: DataFrame, path: str) -> str:
    """Id lists by fold, as CSV; ids must be whole numbers."""
    folds.select(F.col("id").cast("long").alias("id"), "fold").write.mode("overwrite").partitionBy("fold").csv(path, header=True)
    return path
