"""Operator 9, chat formatting: sorted turn structs, adjacent turns of one role merged, one string per conversation.

Template: ``<turn role="R">text<part/>text</turn>\\n``; ``<part/>`` parts the texts of merged turns. In texts and roles
``&``, ``<`` and ``"`` become ``&amp;``, ``&lt;`` and ``&quot;``, so no text can hold a marker and reading back is exact.
All of it is Spark expressions. Null text and null role are empty; rows of a conversation go by (turn, role, text), null
turns first; a null conversation id is a conversation of its own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarja.llm.common import table

PART, END = "<part/>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _header(role: Column) -> Column:
    return F.concat(F.lit('<turn role="'), role, F.lit('">'))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: the optimizer would copy its tree into every lambda that names it."""
    return F.transform(F.array(value), use)[0]


def _parts(items: Column) -> Column:
    """The array in parts of about the root of its size. Folds and cuts that copy what they walk over go through parts one by
    one, so that n turns of one conversation cost n to the 1.5, not its square."""
    return _let(items, lambda a: _let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(a))).cast("int")), lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(a)), c), lambda i: F.slice(a, i, c))))


def _running(steps: Column, start: Column) -> Column:
    """start plus the sums of the array up to each element."""
    first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(steps, first, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out")))["out"]


def _stops(steps: Column) -> Column:
    """The sums of the array up to each element, part by part."""

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda s, x: s + x))
        return _let(_running(totals, F.lit(0)), lambda ends: F.flatten(F.transform(parts, lambda p, k: _running(p, F.when(k == 0, 0).otherwise(F.get(ends, k - 1))))))

    return _let(_parts(steps), joined)


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, and loss_spans: code-point (start, stop) of each text of loss_role inside formatted."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), escape(F.coalesce(F.col("role").cast("string"), F.lit(""))).alias("role"), escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text")).alias("t"),
    )
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    # the numbers of the turns that begin a run of one role; a run's texts lie between its own and the next one's
    begins = lambda turns: F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i - 1)["role"] != F.get(turns, i)["role"]))

    def merge(turns: Column, at: Column) -> Column:
        texts = lambda i, k: F.transform(F.sequence(i, F.coalesce(F.get(at, k + 1), F.size(turns)) - 1), lambda j: F.get(turns, j)["text"])
        return F.transform(at, lambda i, k: F.struct(F.get(turns, i)["role"].alias("role"), texts(i, k).alias("texts")))

    def spans(turns: Column) -> Column:
        # what stands between a text and the one before, and the text
        def step(t: Column, i: Column) -> Column:
            same = (i > 0) & F.coalesce(F.get(turns, i - 1)["role"] == t["role"], F.lit(False))
            return F.when(same, len(PART)).otherwise(F.when(i > 0, len(END)).otherwise(0) + F.length(_header(t["role"]))) + F.length(t["text"])

        ended = F.zip_with(turns, _stops(F.transform(turns, step)), lambda t, e: F.struct((e - F.length(t["text"])).alias("start"), e.alias("stop"), t["role"].alias("role")))
        return F.transform(F.filter(ended, lambda s: s["role"] == escape(F.lit(loss_role))), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))

    merged = _let(F.col("turns"), lambda t: _let(begins(t), lambda at: merge(t, at)))
    body = F.transform(merged, lambda m: F.concat(_header(m["role"]), F.array_join(m["texts"], PART), F.lit(END)))
    return gathered.select("conv_id", F.array_join(body, "").alias("formatted"), _let(F.col("turns"), spans).alias("loss_spans"))


def read_chat(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) as they were before merging, loss_text: read back from formatted and loss_spans alone."""
    blocks = F.filter(F.split(F.col("formatted"), END), lambda b: b != "")

    def read(b: Column) -> Column:
        texts = F.split(F.regexp_replace(b, r'^<turn role="[^"]*">', ""), PART)
        return _let(unescape(F.regexp_extract(b, r'^<turn role="([^"]*)">', 1)), lambda role: F.transform(texts, lambda p: F.struct(role.alias("role"), unescape(p).alias("text"))))

    def cut(part: Column) -> Column:
        low, high = F.get(part, F.lit(0))["start"], F.element_at(part, -1)["stop"]
        return _let(F.substring(F.col("formatted"), low + 1, high - low), lambda own: F.array_join(F.transform(part, lambda s: unescape(F.substring(own, s["start"] - low + 1, s["stop"] - s["start"]))), ""))

    loss = F.array_join(F.transform(F.filter(_parts(F.col("loss_spans")), lambda p: F.size(p) > 0), cut), "")
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, read)).alias("turns"), loss.alias("loss_text"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("\\### Assistant: </turn> ok")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    back = read_chat(format_chat(turns.unionByName(own)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;')"
OP9_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
u AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESC.format('text')}) + CASE WHEN before = role THEN 7 ELSE 22 + length({_ESC.format('role')}) + 0 END) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id
"""
