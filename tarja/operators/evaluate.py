"""Predictions against ground truth: matching by overlap, metrics, sweeps, comparisons and error analysis.

Frames hold one entity a row: id, tp_entidade, start_entidade, end_entidade, and text_entidade where known. Ground truth and
predictions meet once, on (id, tp_entidade); both ranking windows reuse that distribution, thresholds and betas come after
the matching, so a sweep costs one more narrow pass. Null offsets never overlap. An empty ground truth is an error.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarja.functions.labels import ALIASES
from tarja.functions.normalize import normalize
from tarja.functions.spans import span
from tarja.operators import parts

KEYS = ["id", "tp_entidade", "start_entidade", "end_entidade"]
ALL = "TODAS"
THRESHOLDS, BETAS = (0.7, 0.8, 0.9), (1.0, 2.0)
#: Right-closed; the first bin holds its lower edge too.
BINS = (0.0, 0.1, 0.3, 0.5, 0.7, 0.8, 0.9, 1.0)


def require(df: DataFrame, columns: Iterable[str], name: str) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"columns missing in {name}: {missing}")
    return df


def drop_flagged(df: DataFrame) -> DataFrame:
    """Without the rows whose `remove` is 1; null stays."""
    return df.where(~F.col("remove").eqNullSafe(1)) if "remove" in df.columns else df


def map_labels(df: DataFrame, mapping: dict[str, str] = ALIASES, column: str = "tp_entidade") -> DataFrame:
    if not mapping:
        return df
    known = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn(column, F.coalesce(F.try_element_at(known, F.col(column)), F.col(column)))


def normalize_frame(df: DataFrame) -> DataFrame:
    """Prefixes and suffixes cut off the entities' texts, with their offsets; the text changes only where offsets do."""
    if "text_entidade" not in df.columns:
        return df
    by = F.col("detected_by") if "detected_by" in df.columns else F.lit("")
    one = normalize(F.array(span(F.col("tp_entidade"), F.col("start_entidade"), F.col("end_entidade"), F.coalesce("text_entidade", F.lit("")), F.coalesce(by, F.lit("")), F.lit(0))))[0]
    df = df.withColumn("_one", one)
    moved = (F.col("_one.start") != F.col("start_entidade")) | (F.col("_one.end") != F.col("end_entidade"))
    cases = {"text_entidade": F.when(moved, F.col("_one.text")).otherwise(F.col("text_entidade"))}
    cases |= {f"{x}_entidade": F.when(moved, F.col(f"_one.{x}")).otherwise(F.col(f"{x}_entidade")) for x in ("start", "end")}
    return df.withColumns(cases).drop("_one")


def prepare(df: DataFrame, name: str, mapping: dict[str, str] = ALIASES, normalized: bool = False) -> DataFrame:
    df = map_labels(drop_flagged(require(df, KEYS, name)), mapping)
    return normalize_frame(df) if normalized else df


def predictions(engine, texts: DataFrame) -> DataFrame:
    """The engine's spans of (id, text) as prediction rows; null texts have none."""
    require(texts, ["id", "text"], "texts")
    found = engine.spans(texts.select("id", F.col("text").cast("string").alias("text")))
    return found.select("id", F.explode("spans").alias("s")).select("id", F.col("s.label").alias("tp_entidade"), F.col("s.start").alias("start_entidade"), F.col("s.end").alias("end_entidade"), F.col("s.text").alias("text_entidade"), F.col("s.detected_by").alias("detected_by"))


def cached_predictions(engine, texts: DataFrame, path: str, force: bool = False) -> DataFrame:
    """The predictions kept at path; made and kept there first if there are none yet, or anew with `force`."""
    spark = texts.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if force or not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        predictions(engine, texts).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def iou(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Shared part over hull; 0 where they only touch, a side is null or the hull is empty."""
    shared = F.least(end_a, end_b) - F.greatest(start_a, start_b)
    hull = F.greatest(end_a, end_b) - F.least(start_a, start_b)
    whole = start_a.isNotNull() & end_a.isNotNull() & start_b.isNotNull() & end_b.isNotNull()
    return F.coalesce(F.when(whole & (shared > 0) & (hull > 0), shared / hull), F.lit(0.0)).cast("double")


def _side(df: DataFrame, side: str) -> DataFrame:
    text = F.col("text_entidade").cast("string") if "text_entidade" in df.columns else F.lit(None).cast("string")
    return df.select("id", "tp_entidade", F.col("start_entidade").cast("int").alias(f"start_entidade_{side}"), F.col("end_entidade").cast("int").alias(f"end_entidade_{side}"), text.alias(f"text_entidade_{side}"))


def match(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row per matched pair, per ground truth without and per prediction without partner; kind is pair, true or pred.

    Every prediction keeps its best ground truth, then every ground truth its best prediction left. No threshold is used, so
    one result serves all of them. The ground truth is counted (one action), as its rows say into how many partitions both
    sides are dealt."""
    n = parts.by_rows(require(truth, KEYS, "ground truth"))
    t, p = (_side(df, side).repartition(n, "id", "tp_entidade") for df, side in ((truth, "true"), (require(found, KEYS, "predictions"), "pred")))
    both = t.join(p, ["id", "tp_entidade"]).withColumn("overlap", iou(F.col("start_entidade_true"), F.col("end_entidade_true"), F.col("start_entidade_pred"), F.col("end_entidade_pred")))
    ties = [F.desc("overlap"), "start_entidade_true", "end_entidade_true", "start_entidade_pred", "end_entidade_pred", "text_entidade_true", "text_entidade_pred"]
    for side in ("pred", "true"):
        w = Window.partitionBy("id", "tp_entidade", f"start_entidade_{side}", f"end_entidade_{side}").orderBy(*ties)
        both = both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    # each side's rows and the pairs meet by the side's offsets, on the distribution of the join: a row without a pair stands alone
    values = [f"{x}_entidade_{side}" for side in ("true", "pred") for x in ("start", "end", "text")]
    none = lambda c: F.lit(None).cast("string" if c.startswith("text") else "int").alias(c)
    rows = []
    for side, mine in (("true", t), ("pred", p)):
        rows.append(mine.select("id", "tp_entidade", F.lit(side).alias("kind"), *[F.col(c) if c.endswith(side) else none(c) for c in values], F.lit(0.0).alias("overlap"), F.lit(False).alias("paired"), F.lit(side).alias("side")))
    marks = both.withColumn("side", F.explode(F.array(F.lit("true"), F.lit("pred"))))
    rows.append(marks.select("id", "tp_entidade", F.lit("pair").alias("kind"), *values, "overlap", F.lit(True).alias("paired"), "side"))
    every = reduce(DataFrame.unionAll, rows)
    start, end = (F.when(F.col("side") == "true", F.col(f"{x}_entidade_true")).otherwise(F.col(f"{x}_entidade_pred")) for x in ("start", "end"))
    every = every.withColumns({"_start": start, "_end": end})
    hit = F.max("paired").over(Window.partitionBy("id", "tp_entidade", "side", "_start", "_end")) & F.col("_start").isNotNull() & F.col("_end").isNotNull()
    every = every.withColumn("_hit", hit).where("paired and side = 'true' or not paired and not _hit")
    return every.select("id", "tp_entidade", *values, "overlap", "kind")


def cases(matched: DataFrame, threshold: float) -> DataFrame:
    """The comparison rows with y_true and y_pred; a pair below the threshold is a missed and a spurious one."""
    if not 0 <= threshold <= 1:
        raise ValueError("the overlap threshold must lie in [0, 1]")
    flag = lambda true, pred: F.struct(F.lit(true).alias("y_true"), F.lit(pred).alias("y_pred"))
    flags = (
        F.when((F.col("kind") == "pair") & (F.col("overlap") >= threshold), F.array(flag(1, 1)))
        .when(F.col("kind") == "pair", F.array(flag(1, 0), flag(0, 1)))
        .when(F.col("kind") == "true", F.array(flag(1, 0)))
        .otherwise(F.array(flag(0, 1)))
    )
    rows = matched.withColumn("_f", F.explode(flags))
    kept = lambda side: [F.when(F.col(f"_f.y_{side}") == 1, F.col(f"{x}_entidade_{side}")).alias(f"{x}_entidade_{side}") for x in ("text", "start", "end")]
    return rows.select("id", "tp_entidade", F.col("_f.y_true").alias("y_true"), F.col("_f.y_pred").alias("y_pred"), "overlap", *kept("true"), *kept("pred"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def metrics(tp: Column, fp: Column, fn: Column, beta: Column) -> list[Column]:
    square = beta * beta
    return [_ratio((1 + square) * tp, (1 + square) * tp + square * fn + fp).alias("fbeta"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall")]


def report(truth: DataFrame, matched: DataFrame, thresholds: Iterable[float] = (0.8,), betas: Iterable[float] = (2.0,)) -> DataFrame:
    """Per label of the ground truth, and for all (`TODAS`, which also counts labels only predicted), threshold and beta."""
    thresholds, betas = list(thresholds), list(betas)
    if any(not 0 <= t <= 1 for t in thresholds) or any(b <= 0 for b in betas):
        raise ValueError("thresholds must lie in [0, 1] and betas above 0")
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("overlap_threshold")
    rows = matched.select("tp_entidade", "kind", "overlap", grid)
    good = (F.col("kind") == "pair") & (F.col("overlap") >= F.col("overlap_threshold"))
    count = lambda ok: F.sum(ok.cast("long"))
    sums = rows.groupBy("overlap_threshold", "tp_entidade").agg(count(good).alias("tp"), count(~good & (F.col("kind") != "true")).alias("fp"), count(~good & (F.col("kind") != "pred")).alias("fn"))
    # a row per threshold and label is left: the total is made of them
    sums = sums.groupingSets([["overlap_threshold", "tp_entidade"], ["overlap_threshold"]], "overlap_threshold", "tp_entidade").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")], F.grouping("tp_entidade").alias("_all"))
    sums = sums.withColumn("tp_entidade", F.when(F.col("_all") == 1, ALL).otherwise(F.col("tp_entidade")))
    # documents meet in one partition and are counted there, by label and as a whole
    held = truth.select("id", "tp_entidade").repartition(parts.by_rows(truth), "id").groupBy("id", "tp_entidade").agg(F.count("*").alias("_n"))
    one = lambda rows, label: rows.agg(F.count("id").alias("qtd_ids"), F.coalesce(F.sum("_n"), F.lit(0)).alias("qtd_entidades")).select(label, "qtd_ids", "qtd_entidades")
    size = one(held.groupBy("tp_entidade"), F.col("tp_entidade")).unionAll(one(held.groupBy("id").agg(F.sum("_n").alias("_n")), F.lit(ALL).alias("tp_entidade")))
    both = sums.drop("_all").join(size, "tp_entidade").withColumn("beta", F.explode(F.array(*[F.lit(float(b)) for b in betas])))
    return both.select("tp_entidade", "overlap_threshold", "beta", "qtd_ids", "qtd_entidades", *metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.col("beta")), "tp", "fp", "fn")


def evaluate(truth: DataFrame, found: DataFrame, threshold: float = 0.8, beta: float = 2.0) -> DataFrame:
    """The report of one threshold and beta. One action tests that there is ground truth."""
    if truth.isEmpty():
        raise ValueError("the ground truth is empty")
    return report(truth, match(truth, found), [threshold], [beta])


def sweep(truth: DataFrame, found: DataFrame, thresholds: Iterable[float] = THRESHOLDS, betas: Iterable[float] = BETAS) -> DataFrame:
    return report(truth, match(truth, found), thresholds, betas)


def summary(rows: DataFrame) -> DataFrame:
    """A line of text for each row of a report."""
    line = F.format_string("%s: F-beta %.4f, precision %.4f, recall %.4f (TP %d, FP %d, FN %d)", "tp_entidade", "fbeta", "precision", "recall", "tp", "fp", "fn")
    return rows.select("tp_entidade", line.alias("line"))


def compare_reports(now: DataFrame, before: DataFrame) -> DataFrame:
    """Differences, percent changes (0 where the older value is 0 or null) and the status by F-beta."""
    values = ["fbeta", "precision", "recall"]
    for df, name in ((now, "current"), (before, "previous")):
        require(df, ["tp_entidade", *values], name)
    on = ["tp_entidade", *(["overlap_threshold", "beta"] if {"overlap_threshold", "beta"} <= set(now.columns) else [])]
    require(before, on, "previous")
    side = lambda df, tail: df.select(*on, *[F.col(c).alias(f"{c}_{tail}") for c in df.columns if c not in on])
    rows = side(now, "atual").join(side(before, "anterior"), on)
    for c in values:
        new, old = F.col(f"{c}_atual"), F.col(f"{c}_anterior")
        rows = rows.withColumns({f"{c}_diff": new - old, f"{c}_melhorou": new > old, f"{c}_perc_change": F.coalesce((new - old) / F.nullif(old, F.lit(0.0)) * 100, F.lit(0.0))})
    return rows.withColumn("status_geral", F.when(F.col("fbeta_diff") > 0, "Melhorou").when(F.col("fbeta_diff") < 0, "Piorou").otherwise("Estável"))


def classify(rows: DataFrame) -> DataFrame:
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    return rows.withColumn("case_type", F.when(t & p, "TP").when(~t & p, "FP").when(t & ~p, "FN").otherwise("TN"))


def case_listing(rows: DataFrame, labels: Iterable[str] | None = None, kinds: Iterable[str] | None = None) -> DataFrame:
    kinds = list(kinds) if kinds is not None else None
    if kinds and (bad := set(kinds) - {"TP", "FP", "FN", "TN"}):
        raise ValueError(f"unknown case types: {sorted(bad)}")
    rows = classify(rows)
    if labels is not None:
        rows = rows.where(F.col("tp_entidade").isin(list(labels)))
    if kinds is not None:
        rows = rows.where(F.col("case_type").isin(kinds))
    return rows.withColumns({"has_gt_text": F.col("text_entidade_true").isNotNull(), "has_pred_text": F.col("text_entidade_pred").isNotNull()}).repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id", "tp_entidade").sortWithinPartitions("id", "tp_entidade")


def error_counts(rows: DataFrame) -> DataFrame:
    return classify(rows).groupBy("tp_entidade").pivot("case_type", ["TP", "FP", "FN"]).count().na.fill(0)


def error_examples(rows: DataFrame, most: int = 10) -> DataFrame:
    """The first cases of each label and kind, by id and offsets."""
    start, end = F.coalesce("start_entidade_true", "start_entidade_pred"), F.coalesce("end_entidade_true", "end_entidade_pred")
    w = Window.partitionBy("tp_entidade", "case_type").orderBy("id", start, end)
    return classify(rows).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def overlap_histogram(rows: DataFrame) -> DataFrame:
    """(bin, low, high, n) of the overlaps; empty bins stay."""
    at = F.size(F.filter(F.array(*[F.lit(b) for b in BINS[1:-1]]), lambda b: b < F.col("overlap")))
    counts = rows.select(at.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    edges = rows.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(BINS, BINS[1:]))], "bin int, low double, high double")
    return edges.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
