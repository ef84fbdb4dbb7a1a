"""Span arrays: finding with offsets, splitting, trimming, resolving overlaps, masking. Offsets are code points, half open."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarja.functions.labels import GENERIC, PRIORITY

SPAN = "struct<label:string,start:int,end:int,text:string,detected_by:string,seq:int>"


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later expressions use as it is: the optimizer would copy a plain projection's whole tree into
    each of the hundreds of places that name it. A one-row generator ends that, on streams too."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def empty() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def span(label, start, end, text, by, seq) -> Column:
    return F.struct(label.alias("label"), start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"), by.alias("detected_by"), seq.cast("int").alias("seq"))


def quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def find(text: str, regex: str, label: str, by: str, seq: int, strict: bool = False) -> Column:
    """All matches in the column `text`, left to right. A span gives up one blank on each side, its text all white space
    (strict: the span too). Written as SQL, which is far cheaper to build than the same tree of Columns."""
    # a digit that must come is sought before what may not stand in front of it
    p = quoted("(?U)" + re.sub(r"^\(\?<!\\d\)(?=\\d)", r"(?=\\d)(?<!\\d)", regex))
    at = "(acc.at + length(x.gap))"
    if strict:
        low = f"{at} + length(x.hit) - length(regexp_replace(x.hit, {quoted(chr(40) + '?U)^' + chr(92) + 's+')}, ''))"
        high = f"{at} + length(regexp_replace(x.hit, {quoted(chr(40) + '?U)' + chr(92) + 's+$')}, ''))"
    else:
        low = f"{at} + cast(startswith(x.hit, ' ') as int)"
        high = f"{at} + length(x.hit) - cast(endswith(x.hit, ' ') as int)"
    bare = f"regexp_replace(x.hit, {quoted(chr(40) + '?U)^' + chr(92) + 's+|' + chr(92) + 's+$')}, '')"
    new = f"named_struct('label', {quoted(label)}, 'start', {low}, 'end', {high}, 'text', {bare}, 'detected_by', {quoted(by)}, 'seq', {seq})"
    pairs = f"zip_with(slice(split({text}, {p}, -1), 1, size(hits)), hits, (g, h) -> named_struct('gap', g, 'hit', h))"
    start = f"named_struct('at', 0, 'out', cast(array() as array<{SPAN}>))"
    fold = f"aggregate({pairs}, {start}, (acc, x) -> named_struct('at', {at} + length(x.hit), 'out', concat(acc.out, array({new}))), acc -> acc.out)"
    # the matches are bound by a lambda, so that they are extracted once
    return F.expr(f"case when {text} rlike {p} then transform(array(regexp_extract_all({text}, {p}, 0)), hits -> {fold})[0] else cast(array() as array<{SPAN}>) end")


def split_lines(spans: Column) -> Column:
    """Spans cut at line ends; empty pieces go."""

    def cut(s: Column) -> Column:
        pieces, ends = F.split(s["text"], r"\r?\n|\r", -1), F.regexp_extract_all(s["text"], F.lit(r"\r?\n|\r"), F.lit(0))

        def step(acc, x):
            n = F.length(x["piece"])
            new = span(s["label"], acc["at"], acc["at"] + n, x["piece"], s["detected_by"], s["seq"])
            return F.struct((acc["at"] + n + F.length(F.coalesce(x["end"], F.lit("")))).alias("at"), F.when(n > 0, F.concat(acc["out"], F.array(new))).otherwise(acc["out"]).alias("out"))

        zipped = F.zip_with(pieces, ends, lambda p, e: F.struct(p.alias("piece"), e.alias("end")))
        return F.aggregate(zipped, F.struct(s["start"].alias("at"), empty().alias("out")), step, lambda a: a["out"])

    return F.flatten(F.transform(spans, lambda s: F.when(s["text"].rlike(r"[\r\n]"), cut(s)).otherwise(F.array(s))))


def _rank(label: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, PRIORITY)), label)
    return F.when(at > 0, at).otherwise(999)


def resolve(spans: Column, refresh_text: Column | None = None) -> Column:
    """No two spans overlap afterwards. In order of (start, longest, priority, detection) each span meets the last one kept:
    an equal or foreign overlapping one is settled by priority, a contained one goes, a containing one replaces, and one of
    the same label that overlaps in part takes over with the earlier start (its text stays unless refresh_text is given)."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), _rank(s["label"]).alias("c"), s["seq"].alias("d"), s["text"].alias("e"), s.alias("s")))
    ordered = F.transform(F.array_sort(keyed), lambda k: k["s"])

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        head = F.slice(acc, 1, F.size(acc) - 1)
        old, new = _rank(last["label"]), _rank(s["label"])
        wins = F.when((old < 999) & (new < 999), new < old).when(old < 999, False).otherwise(True)
        same = (last["start"] == s["start"]) & (last["end"] == s["end"])
        inside = (s["start"] >= last["start"]) & (s["end"] <= last["end"])
        around = (s["start"] <= last["start"]) & (s["end"] >= last["end"])
        text = F.substring(refresh_text, last["start"] + 1, s["end"] - last["start"]) if refresh_text is not None else s["text"]
        joined = span(s["label"], last["start"], s["end"], text, s["detected_by"], s["seq"])
        over = (s["start"] < last["end"]) & (s["end"] > last["start"])
        return (
            F.when((F.size(acc) == 0) | ~F.coalesce(over, F.lit(False)), F.concat(acc, F.array(s)))
            .when(same, F.when(wins, F.concat(head, F.array(s))).otherwise(acc))
            .when(inside, acc)
            .when(around, F.concat(head, F.array(s)))
            .when(last["label"] == s["label"], F.concat(head, F.array(joined)))
            .otherwise(F.when(wins, F.concat(head, F.array(s))).otherwise(acc))
        )

    return F.aggregate(ordered, empty(), step)


def mask(text: Column, spans: Column) -> Column:
    """The text with each valid span replaced by <|LABEL|>, from the end to the beginning; generic labels are left."""
    keyed = F.transform(F.filter(spans, lambda s: ~s["label"].isin(*GENERIC)), lambda s: F.struct((-s["start"]).alias("a"), s["seq"].alias("d"), s.alias("s")))

    def step(acc: Column, k: Column) -> Column:
        s = k["s"]
        ok = (s["start"] >= 0) & (s["end"] <= F.length(acc)) & (s["start"] < s["end"])
        return F.when(ok, F.concat(F.substring(acc, F.lit(1), s["start"]), F.lit("<|"), s["label"], F.lit("|>"), F.substring(acc, s["end"] + 1, F.length(acc)))).otherwise(acc)

    return F.aggregate(F.array_sort(keyed), text, step)


def formatted(spans: Column, kind: str) -> Column:
    if kind == "detail":
        return F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in ("label", "start", "end", "text", "detected_by")]))
    if kind == "position":
        return F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in ("label", "start", "end")]))
    if kind == "text":
        return F.array_distinct(F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in ("label", "text")])))
    raise ValueError(f"unknown format: {kind}")
