"""Training data: adapters, annotation conflicts, cleaning, context windows, folds and holdouts.

An example is (id, text, entities: array<struct<start, end, label>>), offsets in code points. Everything here is a projection
over arrays or one grouping by document; nothing is ordered by a seeded shuffle of all rows, folds come from hashes of ids.
Null texts and empty entity lists are dropped where the docstring says so and kept elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarja.functions.spans import bound
from tarja.operators import parts

ENTITIES = "array<struct<start:int,end:int,label:string>>"
ID, TEXT, LABEL, START, END = ("id", "id_doc", "id_documento"), ("text", "texto"), ("tp_entidade", "entidade", "label"), ("start_entidade", "start"), ("end_entidade", "end")
WINDOWS = {"w0": 0, "w1": 1, "w2": 2}
TOKEN = r"[\p{L}\p{N}]+(?:[._@'/-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"


def named(df: DataFrame, **names: tuple[str, ...]) -> DataFrame:
    """The columns by their known names; ValueError where none of a column's names is there."""
    out = []
    for name, known in names.items():
        found = next((c for c in known if c in df.columns), None)
        if found is None:
            raise ValueError(f"no column for {name}: one of {known} is needed")
        out.append(F.col(f"`{found}`").alias(name))
    rest = [F.col(f"`{c}`") for c in df.columns if c in ("TEM_ERRO",)]
    return df.select(*out, *rest)


def entity(start: Column, end: Column, label: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), label.cast("string").alias("label"))


def none() -> Column:
    return F.array().cast(ENTITIES)


# ---- adapters -------------------------------------------------------------------------------------------------------
def from_rows(df: DataFrame) -> DataFrame:
    """Examples of a frame with a row per entity: grouped by text (equal texts merge), rows with nulls left out."""
    rows = named(df, text=TEXT, start=("start", "start_entidade"), end=("end", "end_entidade"), label=("entidade", "tp_entidade", "label")).dropna()
    found = F.array_sort(F.collect_set(entity(F.col("start"), F.col("end"), F.col("label"))))
    return rows.groupBy("text").agg(found.alias("entities"))


def to_rows(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts: id, text; entities: id, tp_entidade, start_entidade, end_entidade, text_entidade)."""
    e = examples.select("id", "text", F.explode("entities").alias("e"))
    cut = F.substring(F.col("text"), F.col("e.start") + 1, F.col("e.end") - F.col("e.start"))
    return examples.select("id", "text"), e.select("id", F.col("e.label").alias("tp_entidade"), F.col("e.start").alias("start_entidade"), F.col("e.end").alias("end_entidade"), cut.alias("text_entidade"))


def join_entities(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """Examples from a texts and an entities frame, by id; texts without entities have an empty list."""
    t, e = named(texts, id=ID, text=TEXT), named(entities, id=ID, start=START, end=END, label=LABEL)
    grouped = e.groupBy("id").agg(F.array_sort(F.collect_list(entity(F.col("start"), F.col("end"), F.col("label")))).alias("entities"))
    return t.join(grouped, "id", "left").withColumn("entities", F.coalesce("entities", none()))


# ---- conflicts and cleaning -----------------------------------------------------------------------------------------
def overlapping(entities: Column) -> Column:
    """Pairs (i, j), i < j, of entities that overlap; equal ones count once."""
    d = F.array_distinct(entities)
    numbered = F.transform(d, lambda e, i: F.struct(i.alias("i"), e.alias("e")))
    pairs = F.transform(numbered, lambda x: F.transform(F.filter(numbered, lambda y: (y["i"] > x["i"]) & (y["e"]["start"] < x["e"]["end"]) & (x["e"]["start"] < y["e"]["end"])), lambda y: F.struct(x["i"].alias("i"), y["i"].alias("j"))))
    return F.flatten(pairs)


def clashes(entities: Column) -> Column:
    """Do any two different entities overlap? Sorted by start, some start lies before the furthest end so far."""
    e = F.array_sort(F.array_distinct(entities))
    start = F.struct(F.lit(-1).alias("end"), F.lit(False).alias("bad"))
    return F.aggregate(e, start, lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["bad"] | (x["start"] < a["end"])).alias("bad")), lambda a: a["bad"])


def resolve_conflicts(entities: Column) -> Column:
    """Repeated entities once; none at all if two still overlap."""
    d = F.array_distinct(entities)
    return F.when(clashes(d), none()).otherwise(d)


def split_lines(text: Column, entities: Column) -> Column:
    """Entities cut at line ends; empty pieces go."""

    def cut(e: Column) -> Column:
        body = F.substring(text, e["start"] + 1, e["end"] - e["start"])
        pieces, ends = F.split(body, r"\r?\n|\r", -1), F.regexp_extract_all(body, F.lit(r"\r?\n|\r"), F.lit(0))
        start = F.struct(e["start"].alias("at"), none().alias("out"))

        def step(a, x):
            n = F.length(x["p"])
            new = F.concat(a["out"], F.array(entity(a["at"], a["at"] + n, e["label"])))
            return F.struct((a["at"] + n + F.length(F.coalesce(x["s"], F.lit("")))).alias("at"), F.when(n > 0, new).otherwise(a["out"]).alias("out"))

        return F.aggregate(F.zip_with(pieces, ends, lambda p, s: F.struct(p.alias("p"), s.alias("s"))), start, step, lambda a: a["out"])

    return F.flatten(F.transform(entities, cut))


def trim_edges(text: Column, entities: Column) -> Column:
    """White space at both ends cut off; what is left empty goes."""

    def trim(e: Column) -> Column:
        body = F.substring(text, e["start"] + 1, e["end"] - e["start"])
        left = F.length(body) - F.length(F.regexp_replace(body, r"(?U)^\s+", ""))
        right = F.length(body) - F.length(F.regexp_replace(body, r"(?U)\s+$", ""))
        return entity(e["start"] + left, F.greatest(e["end"] - right, e["start"] + left), e["label"])

    return F.filter(F.transform(entities, trim), lambda e: e["start"] < e["end"])


def token_bounds(text: Column) -> Column:
    """struct(starts, ends) of the tokens: runs of letters and digits joined by one inner sign, or single signs."""
    m, g = F.regexp_extract_all(text, F.lit("(?U)" + TOKEN), F.lit(0)), F.split(text, "(?U)" + TOKEN, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"), F.array().cast("array<int>").alias("ends"))

    def step(a, x):
        s = a["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(a["starts"], F.array(s)).alias("starts"), F.concat(a["ends"], F.array(e)).alias("ends"))

    pairs = F.zip_with(F.slice(g, 1, F.size(m)), m, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    return F.aggregate(pairs, start, step, lambda a: F.struct(a["starts"].alias("starts"), a["ends"].alias("ends")))


def tokens(text: Column) -> Column:
    """The tokens with the white space behind them."""
    return F.regexp_extract_all(text, F.lit(f"(?U)(?:{TOKEN})\\s*"), F.lit(0))


def aligned(text: Column, entities: Column) -> Column:
    """Entities that begin and end with a token."""
    inside = lambda b: F.filter(entities, lambda e: F.array_contains(b["starts"], e["start"]) & F.array_contains(b["ends"], e["end"]))
    return F.transform(F.array(token_bounds(text)), inside)[0]  # the bounds are found once


def biluo(text: Column, entities: Column, bounds: Column | None = None) -> Column:
    """A tag for each token: O, or B-, I-, L-, U- and the label; - for tokens of an entity that is not aligned."""
    b = token_bounds(text) if bounds is None else bounds
    spans = F.arrays_zip(b["starts"].alias("starts"), b["ends"].alias("ends"))

    def tag(t: Column) -> Column:
        hit = F.filter(entities, lambda e: (e["start"] < t["ends"]) & (t["starts"] < e["end"]))
        e = F.try_element_at(hit, F.lit(1))
        good = F.array_contains(b["starts"], e["start"]) & F.array_contains(b["ends"], e["end"])
        first, last = t["starts"] == e["start"], t["ends"] == e["end"]
        kind = F.when(first & last, "U-").when(first, "B-").when(last, "L-").otherwise("I-")
        return F.when(F.size(hit) == 0, F.lit("O")).when(good, F.concat(kind, e["label"])).otherwise(F.lit("-"))

    return F.transform(spans, tag)


def diagnose(text: Column, entities: Column, labels: Iterable[str] | None = None) -> Column:
    """Codes of what is wrong with an example; empty if nothing."""
    n = F.length(text)
    known = F.array(*[F.lit(x) for x in labels]) if labels is not None else None
    bounds = F.exists(entities, lambda e: (e["start"] < 0) | (e["end"] > n) | (e["start"] >= e["end"]))
    checks = [
        F.when(text.isNull() | (F.trim(text) == ""), F.lit("empty_text")),
        F.when(bounds, F.lit("offsets")),
        F.when(F.size(entities) != F.size(F.array_distinct(entities)), F.lit("duplicate")),
        F.when(clashes(entities), F.lit("overlap")),
        F.when(~bounds & (F.size(aligned(text, entities)) < F.size(entities)), F.lit("alignment")),
    ]
    if known is not None:
        checks.append(F.when(F.exists(entities, lambda e: ~F.array_contains(known, e["label"])), F.lit("label")))
    return F.filter(F.array(*checks), lambda c: c.isNotNull())


def clean(examples: DataFrame, conflicts: str = "coerce", strict: bool = False, keep_empty: bool = True, align: str = "tokens") -> DataFrame:
    """Examples with lines split, edges trimmed, misaligned entities dropped and conflicts settled, and `reason`.

    conflicts: coerce (settle), ignore (leave) or raise (the job fails). reason: kept, strict (an entity was lost), conflict
    (two overlap: the document goes) or empty. Only kept rows are examples; the others tell what was dropped."""
    if conflicts not in ("coerce", "ignore", "raise") or align not in ("tokens", "none"):
        raise ValueError("conflicts is coerce, ignore or raise; align is tokens or none")
    n = F.length("text")
    inside = F.filter(F.coalesce("entities", none()), lambda e: (e["start"] >= 0) & (e["end"] <= n) & (e["start"] < e["end"]))
    df = bound(examples, "_split", split_lines(F.col("text"), inside)).withColumn("_had", F.size(F.coalesce("entities", none())) > 0)
    df = bound(df, "_out", trim_edges(F.col("text"), F.col("_split")))
    if align == "tokens":
        df = bound(df, "_out", aligned(F.col("text"), F.col("_out")))
    df = df.withColumn("_bad", clashes(F.col("_out"))).withColumn("_lost", F.size("_out") < F.size("_split"))
    if conflicts == "raise":
        df = df.withColumn("_bad", F.when(F.col("_bad"), F.raise_error(F.lit("entities overlap")).cast("boolean")).otherwise(F.lit(False)))
    if conflicts != "ignore":
        df = df.withColumn("_out", F.array_distinct("_out"))
    drop = F.col("_bad") if conflicts == "coerce" else F.lit(False)
    reason = F.when(drop, "conflict").when(F.lit(strict) & F.col("_lost"), "strict").when(F.col("text").isNull() | ((F.size("_out") == 0) & (F.col("_had") | F.lit(not keep_empty))), "empty").otherwise("kept")
    return bound(df, "reason", reason).withColumn("entities", F.col("_out")).drop("_split", "_had", "_out", "_bad", "_lost")


def clean_counts(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy("reason").agg(F.count("*").alias("n"))


def new_labels(entities: DataFrame, known: Iterable[str]) -> list[str]:
    """Labels that are not known yet, sorted; their number is that of the labels, not of the rows."""
    rows = entities.select(named(entities, label=LABEL).columns[0] if "label" in entities.columns else F.col(next(c for c in LABEL if c in entities.columns)).alias("label")).distinct()
    return sorted(r[0] for r in rows.collect() if r[0] is not None and r[0] not in set(known))


# ---- curriculum windows ---------------------------------------------------------------------------------------------
def curriculum_filter(texts: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents without an erroneous annotation; of texts with one id the last of the input stays; entities once, start before end.
    Both are counted (two actions) and dealt by id once, into partitions of as many rows at any size; all that follows stays there."""
    t, e = named(texts, id=ID, text=TEXT).withColumn("_at", F.monotonically_increasing_id()), named(entities, id=ID, start=START, end=END, label=LABEL)
    n = parts.by_rows(t, e)
    t, e = t.repartition(n, "id"), e.repartition(n, "id")
    if "TEM_ERRO" in e.columns:
        e = e.join(e.where(F.coalesce(F.col("TEM_ERRO").cast("int"), F.lit(0)) != 0).select("id").distinct(), "id", "left_anti").drop("TEM_ERRO")
    e = e.where(~F.contains("label", F.lit("_remover")) & (F.col("start") < F.col("end"))).dropDuplicates(["id", "start", "end", "label"])
    t = t.groupBy("id").agg(F.max_by("text", "_at").alias("text")).join(e.select("id").distinct(), "id", "left_semi")
    return t, e


def paragraphs(texts: DataFrame) -> DataFrame:
    """id, par_idx (dense, blank paragraphs skipped), par_start (offset in the text), paragraph. One projection."""
    parts = F.split("text", "\n", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<par_start:int,paragraph:string>>").alias("out"))
    fold = F.aggregate(parts, start, lambda a, p: F.struct((a["at"] + F.length(p) + 1).alias("at"), F.when(F.length(F.regexp_replace(p, r"(?U)\s+", "")) > 0, F.concat(a["out"], F.array(F.struct(a["at"].alias("par_start"), p.alias("paragraph"))))).otherwise(a["out"]).alias("out")), lambda a: a["out"])
    return texts.select("id", F.posexplode(fold).alias("par_idx", "p")).select("id", "par_idx", "p.par_start", "p.paragraph")


def windows(texts: DataFrame, entities: DataFrame, around: int) -> DataFrame:
    """id, par_idx, text, entities: each paragraph with `around` before and behind, joined by blank lines, where any holds an
    entity. Entities lie wholly inside a paragraph; others are left out."""
    p = paragraphs(texts)
    e = entities.select("id", "start", "end", "label").join(p.select("id", "par_idx", "par_start", F.length("paragraph").alias("n")), "id").where((F.col("start") >= F.col("par_start")) & (F.col("end") <= F.col("par_start") + F.col("n")))
    inside = e.groupBy("id", "par_idx").agg(F.array_sort(F.collect_list(entity(F.col("start") - F.col("par_start"), F.col("end") - F.col("par_start"), F.col("label")))).alias("own"))
    rows = p.join(inside, ["id", "par_idx"], "left").withColumn("own", F.coalesce("own", none()))
    w = Window.partitionBy("id").orderBy("par_idx").rowsBetween(-around, around)
    near = rows.withColumn("near", F.collect_list(F.struct("par_idx", "paragraph", "own")).over(w)).where(F.exists("near", lambda x: F.size(x["own"]) > 0))
    fold = F.aggregate("near", F.struct(F.lit(0).alias("at"), none().alias("out")), lambda a, x: F.struct((a["at"] + F.length(x["paragraph"]) + 2).alias("at"), F.concat(a["out"], F.transform(x["own"], lambda o: entity(o["start"] + a["at"], o["end"] + a["at"], o["label"]))).alias("out")), lambda a: a["out"])
    return near.select("id", "par_idx", F.array_join(F.transform("near", lambda x: x["paragraph"]), "\n\n").alias("text"), fold.alias("entities"))


def full_window(texts: DataFrame, entities: DataFrame) -> DataFrame:
    grouped = entities.groupBy("id").agg(F.array_sort(F.collect_list(entity(F.col("start"), F.col("end"), F.col("label")))).alias("entities"))
    return texts.join(grouped, "id").select("id", F.lit(0).alias("par_idx"), "text", "entities")


def pure_entities(texts: DataFrame, entities: DataFrame, factors: dict[str, int] | None = None) -> DataFrame:
    """Each entity's text alone, (0, length), as often as its label's factor (1 by default)."""
    e = entities.join(texts, "id").withColumn("cut", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")))
    times = F.lit(1)
    if factors:
        times = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in factors.items() for x in pair]), F.col("label")), F.lit(1))
    e = e.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1))))).where((F.col("copy") <= times) & (F.length("cut") > 0))
    return e.select("id", F.lit(0).alias("par_idx"), F.col("cut").alias("text"), F.array(entity(F.lit(0), F.length("cut"), F.col("label"))).alias("entities"))


def curriculum(texts: DataFrame, entities: DataFrame, names: Iterable[str] = ("w00", "w0", "w1", "w2", "full"), factors: dict[str, int] | None = None) -> DataFrame:
    """The windows asked for, each once, in one frame with the column `janela`."""
    names = list(dict.fromkeys(names))
    if bad := [n for n in names if n not in (*WINDOWS, "full", "w00")]:
        raise ValueError(f"unknown windows: {bad}")
    t, e = curriculum_filter(texts, entities)
    out = None
    for n in names:
        one = pure_entities(t, e, factors) if n == "w00" else full_window(t, e) if n == "full" else windows(t, e, WINDOWS[n])
        one = one.withColumn("janela", F.lit(n))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no window is given")
    return out


# ---- splits and folds -----------------------------------------------------------------------------------------------
def order_key(seed: int, *columns: str) -> Column:
    """A seeded pseudo-random order that other SQL engines can repeat: a linear map modulo a prime, twice."""
    x = F.pmod(F.col(columns[0]).cast("long"), F.lit(2147483647))
    for a in (48271, 69621):
        x = F.pmod(x * a + seed + 1, F.lit(2147483647))
    return x


def folds(entities: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """(id, fold): each document in one fold, sizes differing by one at most.

    Ranks come from a range partitioning of the order key and the counts of the ranges before, so no task sorts all ids."""
    if n < 2:
        raise ValueError("at least two folds")
    ids = named(entities, id=ID).dropna().distinct().withColumn("_key", order_key(seed, "id"))
    ranked = global_rank(ids, ["_key", "id"])
    total = F.broadcast(ranked.agg(F.count("*").alias("_n")))
    # as ntile: the first n % parts folds hold one more
    size, rest = F.floor(F.col("_n") / n), F.col("_n") % n
    cut = rest * (size + 1)
    fold = F.when(F.col("rank") < cut, F.floor(F.col("rank") / (size + 1))).otherwise(rest + F.floor((F.col("rank") - cut) / F.greatest(size, F.lit(1))))
    return ranked.crossJoin(total).select("id", fold.cast("int").alias("fold"))


def global_rank(df: DataFrame, by: list[str]) -> DataFrame:
    """df with `rank` from 0, by range partitions: a count per range and a rank inside it."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *by).withColumn("_range", F.spark_partition_id())
    ranged = ranged.persist()
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_c"))
    before = counts.select("_range", (F.sum("_c").over(Window.orderBy("_range")) - F.col("_c")).alias("_before"))  # a row per range
    w = Window.partitionBy("_range").orderBy(*by)
    return ranged.withColumn("_inside", F.row_number().over(w)).join(F.broadcast(before), "_range").withColumn("rank", F.col("_before") + F.col("_inside") - 1).drop("_range", "_before", "_inside")


def stratified_folds(entities: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """(id, fold): each document once, by its rarest label, so that every label spreads evenly over the folds."""
    if n < 2:
        raise ValueError("at least two folds")
    e = named(entities, id=ID, label=LABEL).dropna().distinct()
    counts = e.groupBy("label").agg(F.count("*").alias("_n"))  # a row per label
    rarest = e.join(F.broadcast(counts), "label").groupBy("id").agg(F.min_by("label", F.struct("_n", "label")).alias("label"))
    keyed = rarest.withColumn("_key", order_key(seed, "id"))
    ranked = global_rank(keyed, ["label", "_key", "id"])
    first = ranked.groupBy("label").agg(F.min("rank").alias("_first"))
    # a label starts where the one before stopped, so remainders do not pile up in fold 0
    return ranked.join(F.broadcast(first), "label").select("id", "label", (F.col("rank") % n).cast("int").alias("fold"))


def fold_pair(df: DataFrame, fold_of: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(train, validation) rows of df for fold k."""
    mine = fold_of.where(F.col("fold") == k).select("id")
    other = fold_of.where(F.col("fold") != k).select("id")
    return df.join(other, "id", "left_semi"), df.join(mine, "id", "left_semi")


def holdout(entities: DataFrame, size: float = 0.2, seed: int = 42, stratified: bool = True) -> DataFrame:
    """(id, part): `int(1 / size)` folds, of which the first is the test part."""
    if not 0 < size < 0.5:
        raise ValueError("the holdout size must lie between 0 and 0.5")
    f = (stratified_folds if stratified else folds)(entities, int(1 / size), seed)
    return f.select("id", F.when(F.col("fold") == 0, "test").otherwise("train").alias("part"))


def random_split(examples: DataFrame, ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """examples with `part` (train or test): at least one row each, `int(n * ratio)` in train. Needs an id column."""
    ranked = global_rank(examples.withColumn("_key", order_key(seed, "id")), ["_key", "id"]).drop("_key")
    total = F.broadcast(ranked.agg(F.count("*").alias("_n")))
    cut = F.least(F.greatest(F.lit(1), F.floor(F.col("_n") * ratio)), F.greatest(F.col("_n") - 1, F.lit(1)))
    return ranked.crossJoin(total).withColumn("part", F.when(F.col("rank") < cut, "train").otherwise("test")).drop("rank", "_n")


def aggregate_folds(reports: DataFrame) -> DataFrame:
    """Mean, sample deviation and best fold of each label's values. reports: fold, tp_entidade, fbeta, precision, recall."""
    values = ["fbeta", "precision", "recall"]
    return reports.groupBy("tp_entidade").agg(*[f(c).alias(f"{c}_{n}") for c in values for n, f in (("mean", F.avg), ("std", F.stddev_samp))], F.max_by("fold", F.struct(F.col("fbeta"), -F.col("fold"))).alias("best_fold"))


def label_presence(entities: DataFrame, labels: Iterable[str]) -> DataFrame:
    """A column per label: how many entities of it each document has."""
    return named(entities, id=ID, label=LABEL).groupBy("id").pivot("label", list(labels)).count().na.fill(0)
