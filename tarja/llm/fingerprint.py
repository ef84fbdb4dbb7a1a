"""Operator 10, document fingerprints: a Merkle tree over leaves of words, paragraphs and sections; Spark expressions only.

A paragraph ends with its line feed, a section is a run of paragraphs up to a blank line, a leaf is up to three words of a
paragraph with the blanks after them, or up to 24 characters of a longer run without blanks. A paragraph's digest covers
those of its leaves (64 bits each), a section's those of its paragraphs, the root's those of the sections (128 bits each), and
every character lies in a leaf, so equal roots mean equal texts, but for hash collisions. A fingerprint is
``root.section:paragraph leaf leaf...,paragraph...-section:...`` in hex, digests cut to 64 and leaves to 32 bits.
Likeness of two fingerprints descends from the roots: equal roots give 1; equal branches count with all their leaves; below
those that differ, leaves are compared by themselves. It is the leaves found equal over those of the larger side; `edits`
descends in the same way and names what differs. Null text counts as empty; an empty text has no leaf and is like only
another empty one. Equal ids go by text; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarja.llm.common import documents, null_id, partitions, table

LEAF = r"\n|(?:[^ \n]{0,24}+ ){1,3}+|[^ \n]{1,24}+"
SECTION = r"(?<=\n[ \t]{0,8}\n)(?=[^\n])"
LOW = 0xFFFFFFFF


def _with(value: Column, use) -> Column:
    """use(value), the value made once."""
    return F.transform(F.array(value), use)[0]


def tree(text: Column) -> Column:
    """array<struct<digest, paragraphs: array<struct<digest, leaves: array<long>>>>>, each digest over those below it."""

    def paragraph(p: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.xxhash64(x))
        return _with(leaves, lambda x: F.struct(F.md5(F.array_join(x.cast("array<string>"), ",")).alias("digest"), x.alias("leaves")))

    def section(s: Column) -> Column:
        return _with(F.transform(F.split(s, r"(?<=\n)"), paragraph), lambda ps: F.struct(F.md5(F.array_join(ps["digest"], "")).alias("digest"), ps.alias("paragraphs")))

    return F.transform(F.split(text, SECTION), section)


def root(t: Column) -> Column:
    return F.md5(F.array_join(t["digest"], ""))


def as_text(t: Column) -> Column:
    """The fingerprint as a string."""
    leaf = lambda x: F.right(F.concat(F.lit("0000000"), F.hex(x.bitwiseAND(F.lit(LOW)))), F.lit(8))
    paragraph = lambda p: F.concat(F.substring(p["digest"], 1, 16), F.array_join(F.transform(p["leaves"], leaf), ""))
    section = lambda s: F.concat(F.substring(s["digest"], 1, 16), F.lit(":"), F.array_join(F.transform(s["paragraphs"], paragraph), ","))
    return F.concat(root(t), F.lit("."), F.array_join(F.transform(t, section), "-"))


def branches(t: Column) -> Column:
    """Each leaf with the paragraph it hangs on, as one long: 32 bits of the paragraph's digest, 32 of its own. Two trees share
    such a number where they share the whole paragraph, alone or within an equal section."""
    of = lambda p: _with(F.shiftleft(F.hash(p["digest"]).cast("long"), 32), lambda high: F.transform(p["leaves"], lambda x: high.bitwiseOR(x.bitwiseAND(F.lit(LOW)))))
    return F.flatten(F.transform(F.flatten(t["paragraphs"]), of))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1, of two structs (root, branches)."""
    x, y = a["branches"], b["branches"]
    below = lambda one, other: F.array_distinct(F.transform(F.array_except(one, other), lambda v: v.bitwiseAND(F.lit(LOW))))

    def weigh(p: Column) -> Column:
        equal = (p["same"] + F.size(F.array_intersect(p["x"], p["y"]))).cast("double")
        return F.coalesce(F.try_divide(equal, (p["same"] + F.greatest(F.size(p["x"]), F.size(p["y"]))).cast("double")), F.lit(0.0))

    parts = F.struct(F.size(F.array_intersect(x, y)).alias("same"), below(x, y).alias("x"), below(y, x).alias("y"))
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(_with(parts, weigh))


def edits(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph, leaf>>: the places (from 0) of tree a whose leaves b has not, found by descending only
    where digests differ."""
    sections, paragraphs = b["digest"], F.flatten(b["paragraphs"])
    leaves = F.flatten(paragraphs["leaves"])

    def of_paragraph(p: Column, s: Column, i: Column) -> Column:
        new = F.filter(F.transform(p["leaves"], lambda x, k: F.struct(x.alias("x"), k.alias("k"))), lambda v: ~F.array_contains(leaves, v["x"]))
        places = F.transform(new, lambda v: F.struct(s.alias("section"), i.alias("paragraph"), v["k"].alias("leaf")))
        return F.when(F.array_contains(paragraphs["digest"], p["digest"]), F.array().cast("array<struct<section:int,paragraph:int,leaf:int>>")).otherwise(places)

    def of_section(t: Column, s: Column) -> Column:
        return F.when(F.array_contains(sections, t["digest"]), F.array().cast("array<struct<section:int,paragraph:int,leaf:int>>")).otherwise(F.flatten(F.transform(t["paragraphs"], lambda p, i: of_paragraph(p, s, i))))

    return F.flatten(F.transform(a, of_section))


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, text, next_text) in ascending (doc_id, text); the first follows the last.

    The rows are dealt into ranges of doc_id; `lead` works inside a range, and one first row per range (a count fixed by
    the partitioning, not by the data) joins them, so no task sees all rows.
    """
    cuts = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0] if buckets > 1 else None
    cuts = sorted(set(cuts or []))
    low = F.array(*map(F.lit, cuts)).cast("array<long>")
    ranged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.size(F.filter(low, lambda c: c <= F.col("doc_id"))).alias("range"))
    firsts = ranged.groupBy("range").agg(F.min("doc_id").alias("first_id"))
    ids = [r[0] for r in firsts.select("first_id").collect()]  # one per range
    heads = ranged.where(F.col("doc_id").isin(ids)).groupBy("range").agg(F.min(F.struct("doc_id", "text")).alias("head"))
    every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select(F.col("range"), F.coalesce(F.lead("head").over(Window.orderBy("range")), F.first("head").over(every))["text"].alias("after"))
    w = Window.partitionBy("range").orderBy("doc_id", "text")
    led = ranged.repartition(partitions(docs.sparkSession), "range").withColumn("next_text", F.lead("text").over(w))
    return led.join(after.hint("shuffle_merge"), "range").select("doc_id", "text", F.coalesce("next_text", "after").alias("next_text"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs, 4 * partitions(spark))
    rows = rows.select("doc_id", "text", "next_text", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"))
    trees = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("text")).alias("a"), tree(F.col("edited")).alias("b"), tree(F.col("next_text")).alias("c"))
    short = lambda t: F.struct(root(F.col(t)).alias("root"), branches(F.col(t)).alias("branches")).alias(t)
    trees = trees.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"), short("a"), short("b"), short("c"))
    return trees.select(null_id(), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))
