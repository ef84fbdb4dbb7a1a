"""A trainable tagger and what surrounds it: preparation, phases, training, prediction, saving, cross-validation.

Tokens get string features of a window around them, hashed into sparse vectors; a multinomial logistic regression gives each
a tag (O, or B-, I-, L-, U- and the label). Features are built inside each row's arrays, training and prediction are Spark
jobs over a row per token; the driver holds the coefficients (classes x `width`) and the list of tags only. Null texts and
texts without a token get no spans; unknown tags cannot be predicted; training without a tagged token is an error.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarja.functions.spans import SPAN, bound, span
from tarja.operators import evaluate as ev
from tarja.operators import parts
from tarja.operators import training as tr

BY = "modelo"
PHASES = ("w00", "w0", "w1", "w2", "full")


# ---- preparation ----------------------------------------------------------------------------------------------------
def prepare(examples: DataFrame, labels: Iterable[str] | None = None, conflicts: str = "coerce", strict: bool = False, keep_empty: bool = True, on_loss: str = "ignore") -> DataFrame:
    """Clean and valid examples (id, text, entities) of rows (id, text, entities): lines split, edges trimmed, entities aligned
    with tokens, conflicts settled; rows that still have a fault are left out. on_loss='raise' counts the entities before and
    after (one action) and fails if there are fewer."""
    if on_loss not in ("ignore", "raise"):
        raise ValueError("on_loss is ignore or raise")
    cleaned = tr.clean(examples.where("text is not null"), conflicts, strict, keep_empty).where("reason = 'kept'")
    valid = cleaned.where(F.size(tr.diagnose(F.col("text"), F.col("entities"), labels)) == 0).select("id", "text", "entities")
    if on_loss == "raise":
        count = lambda df: df.agg(F.sum(F.size(F.coalesce("entities", tr.none())))).first()[0] or 0
        before, after = count(examples), count(valid)
        if after < before:
            raise ValueError(f"{before - after} of {before} entities were lost")
    return valid


def resolve_phases(wanted: Iterable[str | tuple[str, float]], ready: dict[str, DataFrame] | None = None, texts: DataFrame | None = None, entities: DataFrame | None = None) -> list[tuple[str, DataFrame, float]]:
    """(name, examples, weight) in order. A phase is a window's name, or that and its weight; its examples come from `ready`
    or are cut from texts and entities."""
    out = []
    for phase in wanted:
        name, weight = (phase, 1.0) if isinstance(phase, str) else phase
        if weight <= 0:
            raise ValueError(f"the weight of phase {name} is not above 0")
        if ready and name in ready:
            rows = ready[name]
        elif name not in PHASES:
            raise ValueError(f"unknown phase {name}: one of {PHASES} or of the ready ones")
        elif texts is None or entities is None:
            raise ValueError(f"phase {name} is not ready and there are no texts and entities to cut it from")
        else:
            rows = tr.curriculum(texts, entities, [name])
        out.append((name, ev.require(rows, ["text", "entities"], name), float(weight)))
    if not out:
        raise ValueError("no phase is given")
    return out


# ---- features -------------------------------------------------------------------------------------------------------
def _shape(word: Column) -> Column:
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, r"\p{Lu}", "A"), r"\p{Ll}", "a"), r"\p{Nd}", "0")
    return F.regexp_replace(kinds, r"(A|a|0)\1{3,}", "$1$1$1+")


def features(words: Column) -> Column:
    """array<array<string>>: of each word its own form, ends and shape, and the forms and shapes of two words on each side."""

    def one(word: Column, i: Column) -> Column:
        low = F.lower(word)
        own = [F.concat(F.lit("w="), low), F.concat(F.lit("p="), F.substring(low, 1, 3)), F.concat(F.lit("s="), F.substring(low, -3, 3)), F.concat(F.lit("h="), _shape(word))]
        for k in (-2, -1, 1, 2):
            beside = F.coalesce(F.get(words, F.greatest(i + k, F.lit(-1))), F.lit(""))
            own += [F.concat(F.lit(f"{k}w="), F.lower(beside)), F.concat(F.lit(f"{k}h="), _shape(beside))]
        return F.array(F.lit("bias"), *own)

    return F.transform(words, one)


def token_rows(rows: DataFrame, tagged: bool) -> DataFrame:
    """A row per token: the columns of rows but text and entities, start, end, grams, and the tag. rows: text, ..., entities."""
    bounds = tr.token_bounds(F.col("text"))
    words = F.transform(tr.tokens(F.col("text")), lambda w: F.regexp_replace(w, r"(?U)\s+$", ""))
    rest = [c for c in rows.columns if c not in ("text", "entities")]
    df = bound(bound(rows.where("text is not null"), "_b", bounds), "_w", words)
    df = bound(df, "_g", features(F.col("_w")))
    df = bound(df, "_t", tr.biluo(F.col("text"), F.col("entities"), F.col("_b"))) if tagged else df
    zipped = F.arrays_zip(F.col("_b.starts").alias("start"), F.col("_b.ends").alias("end"), F.col("_g").alias("grams"), *([F.col("_t").alias("tag")] if tagged else []))
    return df.select(*rest, F.explode(zipped).alias("t")).select(*rest, "t.*")


# ---- the model ------------------------------------------------------------------------------------------------------
@dataclass
class Tagger:
    model: PipelineModel
    tags: list[str]

    def annotate(self, df: DataFrame, text: str = "text", out: str = "model_spans") -> DataFrame:
        """df with an array of spans, as `Engine(model_spans=...)` takes it. Rows meet again by a number of their own. They are
        dealt out by their texts' length (one action), as a row per token is far larger than its text."""
        numbered = df.repartition(parts.by_chars(df, text)).withColumn("_row", F.monotonically_increasing_id()).persist()
        tokens = token_rows(numbered.select("_row", F.col(f"`{text}`").alias("text")), False)
        names = F.array(*map(F.lit, self.tags))
        scored = self.model.transform(tokens).select("_row", "start", "end", F.get(names, F.col("prediction").cast("int")).alias("tag")).where("tag <> 'O'")
        gathered = scored.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "tag"))).alias("t"))

        def step(acc: Column, t: Column) -> Column:
            last, label = F.try_element_at(acc, F.lit(-1)), F.substring(t["tag"], 3, 200)
            goes_on = F.substring(t["tag"], 1, 2).isin("I-", "L-") & (last["label"] == label) & last["open"]
            new = lambda start: F.struct(label.alias("label"), start.alias("start"), t["end"].alias("end"), F.substring(t["tag"], 1, 2).isin("B-", "I-").alias("open"))
            return F.when(F.coalesce(goes_on, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(new(last["start"])))).otherwise(F.concat(acc, F.array(new(t["start"]))))

        joined = F.aggregate("t", F.array().cast("array<struct<label:string,start:int,end:int,open:boolean>>"), step)
        found = gathered.select("_row", joined.alias("_s"))
        cut = lambda s: F.substring(F.col(f"`{text}`"), s["start"] + 1, s["end"] - s["start"])
        spans = F.transform("_s", lambda s: span(s["label"], s["start"], s["end"], cut(s), F.lit(BY), F.lit(0)))
        return numbered.join(found, "_row", "left").withColumn(out, F.coalesce(spans, F.array().cast(f"array<{SPAN}>"))).drop("_row", "_s")

    def predict(self, texts: DataFrame) -> DataFrame:
        """Prediction rows of (id, text)."""
        rows = self.annotate(ev.require(texts, ["id", "text"], "texts").select("id", "text")).select("id", F.explode("model_spans").alias("s"))
        return rows.select("id", F.col("s.label").alias("tp_entidade"), F.col("s.start").alias("start_entidade"), F.col("s.end").alias("end_entidade"), F.col("s.text").alias("text_entidade"), F.col("s.detected_by").alias("detected_by"))

    def save(self, path: str) -> str:
        spark = SparkSession.getActiveSession()
        self.model.write().overwrite().save(f"{path}/model")
        spark.createDataFrame(list(enumerate(self.tags)), "at int, tag string").coalesce(1).write.mode("overwrite").json(f"{path}/tags")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Tagger:
        tags = spark.read.schema("at int, tag string").json(f"{path}/tags").orderBy("at").collect()  # a row per tag
        return cls(PipelineModel.load(f"{path}/model"), [r["tag"] for r in tags])


def train(examples: DataFrame, width: int = 1 << 14, rounds: int = 25, penalty: float = 1e-3) -> Tagger:
    """A tagger of examples (text, entities and, if there is one, weight)."""
    return train_phases([("all", examples, 1.0)], width, rounds, penalty)


def train_phases(phases: list[tuple[str, DataFrame, float]], width: int = 1 << 14, rounds: int = 25, penalty: float = 1e-3) -> Tagger:
    """A tagger of a curriculum: the phases' examples together, each with its phase's weight. Examples are dealt out by their
    texts' length (one action for each phase), so that a task holds the features of about a million characters."""
    weight = lambda df, w: (F.col("weight") if "weight" in df.columns else F.lit(1.0)) * w
    rows = reduce(DataFrame.unionAll, [token_rows(df.select("text", "entities", weight(df, w).cast("double").alias("weight")).repartition(parts.by_chars(df, "text")), True).select("grams", "weight", "tag") for _, df, w in phases])
    rows = rows.where("tag <> '-'").persist()
    try:
        tags = sorted(r[0] for r in rows.select("tag").distinct().collect())  # four for each label, and O
        if not [t for t in tags if t != "O"]:
            raise ValueError("no token of the examples is tagged")
        number = F.create_map(*[x for i, t in enumerate(tags) for x in (F.lit(t), F.lit(float(i)))])
        hashing = HashingTF(numFeatures=width, binary=True, inputCol="grams", outputCol="features")
        learner = LogisticRegression(family="multinomial", maxIter=rounds, regParam=penalty, weightCol="weight", labelCol="label", standardization=False, predictionCol="prediction")
        model = learner.fit(hashing.transform(rows.withColumn("label", number[F.col("tag")])))
        return Tagger(PipelineModel([hashing, model]), tags)
    finally:
        rows.unpersist()


# ---- cross-validation -----------------------------------------------------------------------------------------------
def cross_validate(texts: DataFrame, entities: DataFrame, n: int = 5, threshold: float = 0.8, beta: float = 2.0, seed: int = 42, stratified: bool = True, test_size: float | None = None, path: str | None = None, **options) -> DataFrame:
    """A report per fold (fold, tp_entidade, fbeta, ...): each fold's tagger learns from the other folds and is held against its
    own documents. With test_size, a holdout is set aside first and every fold's tagger is held against it too (part = holdout).
    With path, the id lists, reports, aggregates and taggers are written below it. The folds follow one another, each is a
    few Spark jobs."""
    t, e = tr.named(texts, id=tr.ID, text=tr.TEXT), tr.named(entities, id=tr.ID, start=tr.START, end=tr.END, label=tr.LABEL)
    out, held = [], None
    if test_size:
        parts = tr.holdout(e, test_size, seed, stratified).persist()
        held = parts.where("part = 'test'").select("id")
        if path:
            parts.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/holdout_ids")
        e_cv = e.join(held, "id", "left_anti")
    else:
        e_cv = e
    fold_of = (tr.stratified_folds if stratified else tr.folds)(e_cv, n, seed).select("id", "fold").persist()
    if path:
        fold_of.write.mode("overwrite").partitionBy("fold").option("header", True).csv(f"{path}/fold_ids")
    truth_of = lambda rows: rows.select("id", F.col("label").alias("tp_entidade"), F.col("start").cast("int").alias("start_entidade"), F.col("end").cast("int").alias("end_entidade"))
    for k in range(n):
        (t_train, t_own), (e_train, e_own) = tr.fold_pair(t, fold_of, k), tr.fold_pair(e_cv, fold_of, k)
        tagger = train(prepare(tr.join_entities(t_train, e_train)), **options)
        if path:
            tagger.save(f"{path}/fold={k}")
        checks = [("validation", t_own, e_own)] + ([("holdout", t.join(held, "id", "left_semi"), e.join(held, "id", "left_semi"))] if held is not None else [])
        for part, own_texts, own_entities in checks:
            truth = truth_of(own_entities)
            report = ev.report(truth, ev.match(truth, tagger.predict(own_texts)), [threshold], [beta])
            out.append(report.select(F.lit(k).alias("fold"), F.lit(part).alias("part"), "*"))
    reports = reduce(DataFrame.unionAll, out)
    if path:
        reports.write.mode("overwrite").partitionBy("part").parquet(f"{path}/reports")
        reports = texts.sparkSession.read.parquet(f"{path}/reports").select(*reports.columns)
        tr.aggregate_folds(reports.where("part = 'validation'")).coalesce(1).write.mode("overwrite").json(f"{path}/aggregates")
    return reports
