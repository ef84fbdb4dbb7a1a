"""Prefixes and suffixes that belong to no identifier: cut off, with the offsets moved along."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarja.functions.spans import span

_TAIL = r"\s+[/-]?\s*[A-ZÁ-Ú]{2,}(?:\s*[/-]?\s*[A-ZÁ-Ú]{2,})*\s*$"
#: What stands before and behind identifiers, by label; the first that applies counts.
PREFIX = {
    "CID": [r"^\s*CID(?![A-Za-zÁ-Úá-ú])\s*[:-]?\s*"],
    "CNH": [r"^\s*CNH\s*n?[º°o]?\.?\s*[:-]?\s*"],
    "SIAPE": [r"^\s*SIAPE\s*n?[º°o]?\.?\s*[:-]?\s*", r"^\s*n[º°o]\.?\s*[:-]?\s*"],
    "CPF": [r"^\s*CPF\s*n?[º°o]?\.?\s*[:-]?\s*", r"^\s*n[º°o]\.?\s*[:-]?\s*"],
    "RG": [r"^\s*RG\s*n?[º°o]?\.?\s*[:-]?\s*"],
    "TITULO_ELEITOR": [r"^\s*t[íi]tulo(?:\s+de)?\s+eleitor\s*[:-]?\s*", r"^\s*n[ºo°]\.?\s*[:-]?\s*"],
    "GEO_COORD": [r"^\s*(?:(?:LAT|LONG|LOG)(?:ITUDE)?|COORDENADA[S]?)(?![A-Za-z])\s*\.?\s*(?::|-(?!\s*\d))?\s*"],
    "EMAIL": [r"^\s*E-?MAIL(?![A-Za-z@])\s*[:-]?\s*"],
}
SUFFIX = {"CPF": [r"\s+-\s*\d{1,2}\s*$", _TAIL], "RG": [_TAIL, r"/\s*[A-ZÁ-Ú]{2,}\s*$"], "CNH": [r"\s+DETRAN(?:\s*[/-]?\s*[A-ZÁ-Ú]{2})?\s*$"]}


def _rest(text: Column, k: Column, front: bool) -> Column:
    return F.substring(text, k + 1, F.length(text)) if front else F.substring(text, F.lit(1), F.length(text) - k)


def _applies(s: Column, rules: dict[str, list[str]], front: bool):
    """(pattern, number of characters that the pattern finds, if that leaves a letter or digit) of each rule, else null."""
    for label, patterns in rules.items():
        for p in patterns:
            k = F.length(F.regexp_extract(s["text"], "(?iuU)" + p, 0))
            ok = (s["label"] == label) & (k > 0) & _rest(s["text"], k, front).rlike(r"(?U)[\p{IsAlphabetic}\p{IsDigit}]")
            yield p, F.when(ok, k)


def _cut(s: Column, rules: dict[str, list[str]], front: bool) -> Column:
    """The span without what the first rule that applies finds, trimmed; as it is if none does."""

    def cut(k: Column) -> Column:
        text = _rest(s["text"], k, front)
        left, right, n = F.length(F.regexp_replace(text, r"(?U)^\s+", "")), F.length(F.regexp_replace(text, r"(?U)\s+$", "")), F.length(text)
        start, end = (s["start"] + k, s["end"]) if front else (s["start"], s["end"] - k)
        new = span(s["label"], start + n - left, end - (n - right), F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), s["detected_by"], s["seq"])
        return F.when(k.isNotNull(), new).otherwise(s)

    # the number is bound by a lambda, so that the rules are tried once
    return F.transform(F.array(F.coalesce(*[k for _, k in _applies(s, rules, front)])), cut)[0]


def rule(s: Column) -> Column:
    """The patterns by which `normalize` cuts the span, parted by " | ", or null if none does."""
    first = lambda x, rules, front: F.coalesce(*[F.when(k.isNotNull(), F.lit(p)) for p, k in _applies(x, rules, front)])
    return F.nullif(F.concat_ws(" | ", first(s, PREFIX, True), first(_cut(s, PREFIX, True), SUFFIX, False)), F.lit(""))


def normalize(spans: Column) -> Column:
    """Of each label the first prefix rule, then the first suffix rule, that leaves a letter or digit. Table spans stay."""
    done = F.transform(F.transform(spans, lambda s: F.when(s["detected_by"] != "tabela_markdown", _cut(s, PREFIX, True)).otherwise(s)), lambda s: F.when(s["detected_by"] != "tabela_markdown", _cut(s, SUFFIX, False)).otherwise(s))
    return done
