"""The detection plan: scan, validate, unite, split, normalise, resolve, mask. One narrow stage, batch or streaming."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarja.functions import checkdigits as check
from tarja.functions.context import needs, verdict
from tarja.functions.normalize import normalize
from tarja.functions.patterns import Catalog, check_java
from tarja.functions.spans import bound, empty, find, formatted, mask, resolve, span, split_lines
from tarja.operators.tables import table_spans


def spread(df: DataFrame) -> DataFrame:
    """A batch source of few partitions is dealt out evenly: looking through a text costs far more than moving it. The planned
    partitions of a file do not tell how many tasks have rows, as a group of rows is read by one of them; so only sources of
    eight times as many as there are cores, and streams, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or (n := df.rdd.getNumPartitions()) >= 8 * cores else df.repartition(max(n, 2 * cores))


@dataclass(frozen=True)
class Engine:
    catalog: Catalog = field(default_factory=Catalog.default)
    use_cpf_validator: bool = True
    use_voter_validator: bool = True
    use_cnh_validator: bool = True
    normalize_entities: bool = True
    tables: bool = True
    strict_spans: bool = False
    refresh_text: bool = False
    cnpj: str = "reference"
    #: Texts of more code points have no spans, and `problem` says so; None: every text is searched.
    max_chars: int | None = None
    #: An array<span> column of the input with what a model found, or None.
    model_spans: str | None = None

    def _verdict(self, text: Column, s: Column, label: str) -> Column:
        return verdict(text, s["start"], s["end"], s["text"], label, self.use_cpf_validator, self.use_voter_validator, self.use_cnh_validator)

    def _valid(self, text: Column, spans: Column, label: str) -> Column:
        judged = F.transform(spans, lambda s: span(self._verdict(text, s, label), s["start"], s["end"], s["text"], s["detected_by"], s["seq"]))
        return F.filter(judged, lambda s: s["label"].isNotNull())

    def _guarded(self, spans: Column) -> Column:
        """Without valid company numbers."""
        return F.filter(spans, lambda s: ~check.cnpj(s["text"], self.cnpj))

    def regex_spans(self, text: str, low: str | None = None) -> Column:
        """What the patterns find in the column `text` and the context confirms, in the catalog's order. Texts without
        digit, @ or star skip all but custom patterns, and those of labels whose verdict asks for a word near the span are
        skipped where the text has none of the words. low: a column with the text in lower case."""
        arrays: dict[str, list[Column]] = {}
        for i, p in enumerate(self.catalog.patterns):
            if p.custom:
                check_java(p.regex)
            arrays.setdefault(p.label, []).append(find(text, p.regex, p.label, p.id, 1000 + i, self.strict_spans))
        custom = {p.label for p in self.catalog.patterns if p.custom}
        lowered = F.col(low) if low else F.lower(F.col(text))
        out, gated = [], []
        for label, found in arrays.items():
            checked = self._valid(F.col(text), F.flatten(F.array(*found)), label)
            words = needs(label)
            checked = F.when(reduce(or_, [F.contains(lowered, F.lit(w)) for w in words]), checked).otherwise(empty()) if words and label not in custom else checked
            (out if label in custom else gated).append(checked)
        if gated:
            out.insert(0, F.when(F.col(text).rlike(r"[\p{Nd}@*]"), F.flatten(F.array(*gated))).otherwise(empty()))
        return self._guarded(F.flatten(F.array(*out))) if out else empty()

    def spans(self, df: DataFrame, text: str = "text") -> DataFrame:
        """df with the column `spans`, and `problem` where `max_chars` is set. Null texts have none."""
        x = F.coalesce(F.col(f"`{text}`"), F.lit(""))
        if self.max_chars is not None:
            long = F.length(x) > self.max_chars
            df = df.withColumn("problem", F.when(long, F.lit(f"text longer than {self.max_chars} characters")))
            x = F.when(long, F.lit("")).otherwise(x)
        df = bound(bound(df, "_text", x), "_low", F.lower("_text"))
        df = bound(df, "_regex", self.regex_spans("_text", "_low"))
        parts = [F.col("_regex")]
        if self.model_spans:
            from tarja.functions.labels import GENERIC

            model = F.filter(F.col(self.model_spans), lambda s: s["label"].isin(self.catalog.labels) & ~s["label"].isin(*GENERIC))
            cases = lambda s: F.coalesce(*[F.when(s["label"] == x, self._verdict(F.col("_text"), s, x)) for x in self.catalog.labels])
            judged = F.transform(model, lambda s: span(cases(s), s["start"], s["end"], s["text"], F.lit("modelo"), F.lit(0)))
            parts.insert(0, self._guarded(F.coalesce(F.filter(judged, lambda s: s["label"].isNotNull()), empty())))
        if self.tables:
            parts.append(F.filter(table_spans(F.col("_text")), lambda s: s["label"].isin(self.catalog.labels)))
        df = bound(df, "_all", split_lines(F.concat(*parts)))
        if self.normalize_entities:
            df = bound(df, "_all", normalize(F.col("_all")))
        df = bound(df, "spans", resolve(F.col("_all"), F.col("_text") if self.refresh_text else None))
        return df.drop("_text", "_low", "_regex", "_all")

    def extract(self, df: DataFrame, text: str = "text", kind: str = "position") -> DataFrame:
        out = self.spans(df, text)
        return out.withColumn("spans", formatted(F.col("spans"), kind))

    def anonymize(self, df: DataFrame, text: str = "text") -> DataFrame:
        """df with `spans` and `masked`."""
        out = self.spans(df, text)
        return out.withColumn("masked", mask(F.col(f"`{text}`"), F.col("spans")))

    def regex_only(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Without model, tables, normalisation and resolution."""
        df = bound(df, "_text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
        return bound(df, "spans", self.regex_spans("_text")).drop("_text")
