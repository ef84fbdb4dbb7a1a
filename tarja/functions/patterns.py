"""The patterns, and the immutable catalog of those that are active."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession

from tarja.functions.labels import COUNCILS, ISSUERS, LABELS, STATES

_UF, _COUNCIL, _ISSUER = f"(?:{STATES})", f"(?:{COUNCILS})", f"(?:{ISSUERS})"
_RNE = r"\b(?:Registro\s+Nacional\s+(?:de\s+Estrangeiro|Migrat[oó]rio))"
_MONTHS = "janeiro|fevereiro|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro"

#: What each label looks like. The order within a label counts where spans tie.
BUILT_IN: dict[str, list[str]] = {
    "CPF": [
        r"(?<!\d)\d{3}\.\d{3}\.\d{3}-\d{2}(?!\d)",
        r"(?<!\d)\d{9}[-/]\d{2}(?!\d)",
        r"(?<!\d)\d{11}(?!\d)",
        r"\bnº:?\s*\d{9}[-/]\d{2}(?!\d)",
        r"\bnº:?\s*\d{11}(?!\d)",
        r"(?<!\*)\*{3}\.\d{3}\.\d{3}[-/]\*{2}(?!\*)",
        r"(?<!\*)\*{3}\d{6}[-/]\*{2}(?!\*)",
        r"(?<!\*)\*{3}\d{6}\*{2}(?!\*)",
        r"(?<!\d)\d{3}\.\*{3}\.\*{3}[-/]\d{2}(?!\d)",
        r"(?<!\d)\d{3}\*{6}[-/]\d{2}(?!\d)",
        r"(?<!\d)\d{3}\*{6}\d{2}(?!\d)",
    ],
    "RG": [
        rf"(?<!\d)\d{{6,9}}\s*-\s*{_UF}\b",
        rf"(?<!\d)\d{{1,2}}\.\d{{3}}\.\d{{3}}-[\dXx]\s+{_UF}(?!\w)",
        r"(?<!\d)\d{1,2}\.\d{3}\.\d{3}-?\w{1,2}(?!\d)",
        r"(?<!\d)\d{1,2}\.\d{3}\.\d{3}-[\dXx](?!\d)",
        r"(?<!\d)\d{2}\.\d{3}\.\d{3}-\d/[\dXx](?!\d)",
        r"MG-\d{2}\.\d{3}\.\d{3}(?!\d)",
        r"(?<!\d)\d{2}\.\d{3}\.\d{3}-[\dXx]{2}(?!\d)",
        r"(?i)\brg\s*n?[ºo°]?\s*[:-]?\s*\d{5,10}(?!\d)",
        rf"(?<!\d)\d{{1,2}}\.?\d{{3}}\.?\d{{3}}[-.]?\d?\s*[-/]?\s*{_ISSUER}\s*/?\s*{_UF}(?!\w)",
        rf"(?i){_COUNCIL}[-/\s]*{_UF}[-/\s]*\d{{2,10}}",
        rf"(?i)\d{{2,10}}\s*[-/]\s*{_COUNCIL}\s*/?\s*{_UF}",
        rf"(?i){_COUNCIL}[-:\s]*\d{{2,10}}(?!\d)",
    ],
    "TITULO_ELEITOR": [
        r"(?i)\bt[íi]tulo(?:\s+de)?\s+eleitor\s*[:-]?\s*\d{10,12}(?!\d)",
        r"(?<!\d):?\d{4}\s\d{4}\s\d{4}(?!\d)",
        r"(?<!\d)\d{4}\s?\d{4}\s?\d{2}[\s-]?\d{2}(?!\d)",
        r"(?<!\d):?\d{12}(?!\d)",
        r"(?i)(?:t[íi]tulo(?:\s+de)?\s+eleitor\s*[:-]?\s*|n[ºo°]\s*)?(?:\d{4}\s?\d{4}\s?\d{4}|\d{12}|\d{4}\s?\d{4}\s?\d{2}[\s-]?\d{2})",
    ],
    "PASSAPORTE": [r"[a-zA-Z]{2}\d{5,6}\s?"],
    "SIAPE": [r"(?<!\d)\d{7}(?!\d)", r"\bSIAPE[\s-]?[nº°o]?\s*\d{7}(?!\d)", r"(?<!\d)\d{6}[/-]\d(?!\d)"],
    "CNH": [r"(?<!\d)\d{11}(?!\d)", r"(?<!\d)\d{10}(?!\d)", r"(?<!\d)\d{3}\s?\d{3}\s?\d{3}\s?-?\d{2}(?!\d)", r"(?i)\bcnh\b[\s:°º-]*\d{10,11}(?!\d)"],
    "DADOS_BANCARIOS": [
        r"(?<!\d)\d{4,6}-\d(?!\d)",
        r"(?<!\d)\d{3,5}-\d{6,9}(?:-\d)?(?!\d)",
        r"\b[A-Za-z]{2}\d{2}(?:\s?\d{4}){4,6}\b",
        r"(?<!\d)\d{8,12}-\d(?!\d)",
        r"\b\d{3}-\d{6}-\d\b",
    ],
    "EMAIL": [r"\b[a-zA-Z0-9_.+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"],
    "TELEFONE": [
        r"(?<!\d)\(\d{2}\)\s?\d{4,5}[-\s]?\d{4}(?!\d)",
        r"(?<!\d)\d{2}\s\d{4,5}[-\s]?\d{4}(?!\d)",
        r"\+\d{1,3}\s?\(?\d{2}\)?\s?\d{4,5}[-\s]?\d{4}(?!\d)",
        r"(?<!\d)\d{10,11}(?!\d)",
        r"(?<!\d)(?:\+?55)?\s?\(?\d{2}\)?[\s-]?\d{4,5}[\s-]?\d{4}(?!\d)",
        r"(?<!\d)\(\d{2,3}\)\s?\d{4,5}[\s.-]?\d{4}(?!\d)",
        r"(?<!\d)\(\d{2,3}\)\s?\d\s?\d{4}[\s.-]?\d{4}(?!\d)",
        r"(?<!\d)\d{2,3}\s\d{4,5}[\s.-]?\d{4}(?!\d)",
        r"\+55[\s-]?\d{2,3}[\s-]?\d{4,5}[\s.-]?\d{4}(?!\d)",
        r"\+55\d{10,11}(?!\d)",
        r"(?<!\d)(?:\+?55[\s-]?)?\(?\d{2,3}\)?[\s.-]?\d{1}?\s?\d{4}[\s.-]?\d{4}(?!\d)",
        r"(?<!\d)\d{2}\s?\d{4}\s?\d{7}(?!\d)",
        r"(?<!\d)(?:\+?55[\s-]?)?\(?\d{2,3}\)?[\s.-]?\d{4,5}[\s.-]\d{4}(?!\d)",
        r"(?<!\d)\d{4}[-.\s]?\d{4}(?!\d)",
        r"(?<!\d)\(\d{2}\)\d{4,5}[-.\s]?\d{4}(?!\d)",
        r"(?<!\d)\(\d{2}\)\d{9}(?!\d)",
        r"(?<!\d)\(\+?55\)\s?\d{2}\s?\d{4,5}[-.\s]?\d{4}(?!\d)",
    ],
    "DATA_NASCIMENTO": [r"\d{2}[-/.]\d{2}[-/.]\d{2}(?:\d{2})?\b", r"\d{4}-\d{2}-\d{2}\b", rf"(?i)\b(?:0?[1-9]|[12][0-9]|3[01])\s+de\s+(?:{_MONTHS})\s+de\s+(?:19|20)\d{{2}}\b"],
    "ENDEREÇO": [r"(?<!\d)\d{5}-\d{3}(?!\d)", r"(?<!\d)\d{2}\.\d{3}-\d{3}(?!\d)", r"(?<!\d)\d{8}(?!\d)"],
    "GEO_COORD": [
        r"(?<!\d)\d{1,3}°\d{1,2}\.?\d*'?\s*[NSEWnsew](?!\d)",
        r"(?:Lat|Long)\.?\d{1,3}[NSEWnsew]\d{6}[a-z]?",
        r"(?<!\d)-?\d{1,3},\d+\s+-?\d{1,3},\d+(?!\d)",
        r"(?<!\d)\d{1,3}°\d{1,2}'?\d{1,2}\.?\d*\"?[NSEWnsew](?!\d)",
        r"(?<!\d)\d{1,3}°[NSEWnsew]\s+\d{1,2}'?\s*\d{1,2}\.?\d*\"?(?!\d)",
        r"(?i)(?:coordenada|latitude|longitude|lat|long|log)[\s:]*-?\s?\d{1,3}[°.,]\d+",
        r"(?<!\d)\d{1,3}[°º][NSEWnsew]\d{1,2}'?\d{1,2}[.,]\d+['\"]{0,2}(?!\d)",
        r"(?<!\d)-?\d{1,3}\.\d{3,}[°º][NSEWnsew](?!\w)",
        r"(?<!\d)\d{2}[NSEWnsew]\d{6}(?!\d)",
        r"(?<!\d)-?\d{1,3}\.\d+\s*,\s*-?\d{1,3}\.\d+(?!\d)",
    ],
    "CID": [
        r"\b[A-TV-Za-tv-z]\d{2}\b",
        r"\b[A-TV-Za-tv-z]\d{2}\.[0-9Xx]{1,3}\b",
        r"(?i)\bcid[-\s]*(?:10|11)?[:\s]*[A-TV-Za-tv-z]\d{2}(?:\.[0-9Xx]{1,3})?\b",
        r"(?i)(?:diagnóstico|diagnostic[ao]?|código|code)[:\s-]*[A-TV-Za-tv-z]\d{2}(?:\.[0-9Xx]{1,3})?\b",
        r"\b[A-TV-Za-tv-z]\d{2}(?:\.[0-9Xx]{1,3})?\b",
    ],
    "PIS": [r"(?<!\d)\d{11}(?!\d)", r"(?<!\d)\d{10}-\d(?!\d)", r"(?<!\d)\d{3}\.\d{5}\.\d{2}-\d\b"],
    "CNS": [r"(?<!\d)[12789]\d{14}(?!\d)", r"(?<!\d)[12789]\d{14}-\d(?!\d)"],
    "RESERVISTA": [r"(?<!\d)(?:\d{6}\s*[-/]\s*\d{12,13}|\d{12,13}\s*[-/]\s*\d{6})(?!\d)"],
}
FOREIGN = {
    "RG": [
        r"\b(?:RNE|CRNM)\s*[:-]?\s*\d{6,9}\b",
        r"\b(?:RNE|CRNM)\s*[:-]?\s*\d{1,3}(?:\.\d{3}){1,2}\b",
        _RNE + r"\s*(?:[:-]|[Nn][ºo°]|[Nn]úmero)?\s*\d{6,9}\b",
        _RNE + r"\s*[:-]?\s*\d{1,3}(?:\.\d{3}){1,2}\b",
        r"\b(?:N[ºo]|Número)\s*(?:do\s*)?(?:RNE|CRNM)\s*[:-]?\s*\d{6,9}\b",
        r"\b(?:RNE|CRNM)[^\d]{0,3}\d{6,9}\b",
        r"\b(?:RNE|CRNM)[^\d]{0,3}\d{1,3}(?:\.\d{3}){1,2}\b",
    ],
    "PASSAPORTE": [
        r"(?<!\w)[A-Z]\d{8}(?!\w)",
        r"(?<!\w)\d{9}(?!\w)",
        r"(?<!\w)[CFGHJK][A-Z0-9]{8}(?!\w)",
        r"(?<!\w)[A-Z]\d{6}(?!\w)",
        r"(?<!\w)\d{2}[A-Z]{2}\d{5}(?!\w)",
        r"(?<!\w)[A-Z]{1,2}\d{7}(?!\w)",
        r"(?<!\w)[A-Z0-9]{6,9}(?!\w)",
        r"(?i)(?:passaporte?|passport)\s*n[ºo°]?\s*[:-]?\s*[A-Z0-9]{6,9}",
    ],
}


@dataclass(frozen=True)
class Pattern:
    label: str
    regex: str
    id: str
    custom: bool = False
    description: str = ""


def check_java(regex: str) -> None:
    """ValueError if the engine that runs the patterns does not take the regex; before there is a session, nothing is known."""
    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile("(?U)" + regex)
        except (IllegalArgumentException, Py4JJavaError) as e:
            raise ValueError(f"the regex does not compile in Java: {e}") from e


def custom(label: str, regex: str, description: str = "") -> Pattern:
    """A user's pattern: label upper-cased; the regex must compile and must not match the empty string."""
    if not label or not label.strip() or not regex or not regex.strip():
        raise ValueError("a pattern needs a label and a regex")
    try:
        found = re.compile(regex)
    except re.error as e:
        raise ValueError(f"the regex does not compile: {e}") from e
    if found.match(""):
        raise ValueError("the regex matches the empty string")
    check_java(regex)
    name = label.strip().upper()
    return Pattern(name, regex, f"custom:{name}", True, description)


@dataclass(frozen=True)
class Catalog:
    """The active patterns, in the order of detection. Adding labels adds their patterns, again if they are there."""

    patterns: tuple[Pattern, ...] = ()
    model_labels: frozenset[str] = frozenset()

    @classmethod
    def default(cls, foreign_rg: bool = True, foreign_passport: bool = False) -> Catalog:
        return cls().with_labels(LABELS, foreign_rg=foreign_rg, foreign_passport=foreign_passport)

    def with_labels(self, labels=None, customs=(), replace_patterns: bool = False, use_model_labels: bool = False, foreign_passport: bool = False, foreign_rg: bool = False) -> Catalog:
        if not labels and not use_model_labels:
            raise ValueError("give labels, or use the model's")
        wanted = list(labels or [])
        if unknown := [x for x in wanted if x not in BUILT_IN and x != "FISTEL"]:
            raise ValueError(f"unknown labels: {unknown}")
        wanted += sorted(x for x in self.model_labels if use_model_labels and x in BUILT_IN and x not in wanted)
        if "FISTEL" in wanted:  # an older name that stands for tax numbers
            wanted = [x for x in wanted if x != "FISTEL"] + ([] if "CPF" in wanted else ["CPF"])
        new: list[Pattern] = []
        for label in wanted:
            if (label == "RG" and foreign_rg) or (label == "PASSAPORTE" and foreign_passport):
                new += [Pattern(label, r, f"{label}:foreign{i + 1}") for i, r in enumerate(FOREIGN[label])]
            new += [Pattern(label, r, f"{label}:{i + 1}") for i, r in enumerate(BUILT_IN[label])]
        kept = () if replace_patterns else self.patterns
        return replace(self, patterns=(*kept, *new, *customs))

    def with_custom(self, *patterns: Pattern) -> Catalog:
        return replace(self, patterns=(*self.patterns, *patterns))

    @property
    def labels(self) -> list[str]:
        return list(dict.fromkeys([*sorted(self.model_labels), *(p.label for p in self.patterns)]))

    def frame(self, spark: SparkSession) -> DataFrame:
        """label, regex, id, built_in: split by whether the label is one of the model's."""
        known = self.model_labels or frozenset(LABELS)
        return spark.createDataFrame([(p.label, p.regex, p.id, p.label in known) for p in self.patterns], "label string, regex string, id string, built_in boolean")
