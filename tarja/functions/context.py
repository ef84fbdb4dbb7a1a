"""Verdicts: is a candidate span what its label says? Null rejects, a label accepts (perhaps another label)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarja.functions import checkdigits as check
from tarja.functions.labels import CID_TRAPS, COUNCILS, ISSUERS, STATES, WINDOWS, WORDS
from tarja.functions.spans import strip


def window(text: Column, start: Column, end: Column, back: int, ahead: int) -> Column:
    a = F.greatest(start - back, F.lit(0))
    return F.lower(F.substring(text, a + 1, end + ahead - a))


def has(context: Column, words: list[str]) -> Column:
    """Does the context hold one of the words, anywhere?"""
    return context.rlike("|".join(re.escape(w) for w in words))


_HINTS = ["identidade", "rg", "registro geral", "ssp"]
_DIGIT_HINTS = ["identidade", "rg", "registro geral"]


def _rg(text, s, e, span, near) -> Column:
    exact = F.substring(text, s + 1, e - s)
    upper, plain = F.upper(strip(span)), F.regexp_replace(exact, r"[\s./-]", "")
    n = F.length(check.digits(upper))
    short = window(text, s, e, 60, 0)
    hint = lambda words: has(near, words) | has(short, words)
    issuer = upper.rlike(rf"\b(?:{ISSUERS}|{COUNCILS})[-\s/]*[A-Z]{{2}}\b") & upper.rlike(r"[A-Z]{2}$|/[A-Z]{2}|[A-Z]{2}\s+[0-9]")
    yes, no = F.lit(True), F.lit(False)
    stages = [
        F.when(upper.rlike(COUNCILS) & (n >= 2), yes),
        F.when(issuer & (n >= 5), yes),
        F.when(strip(exact).rlike(rf"^\d{{1,2}}\.\d{{3}}\.\d{{3}}-[\dXx]\s+(?:{STATES})\z"), yes).when(F.replace(exact, F.lit(" "), F.lit("")).rlike(r"\d{1,3}(?:\.\d{3}){1,2}[/-]?\w?\z"), hint(_HINTS)),
        F.when(exact.rlike(rf"^\d{{6,9}}\s*[/-]\s*(?:{STATES})\z"), hint(_HINTS)),
        F.when(plain.rlike(r"^\d{7,9}\z"), hint(_DIGIT_HINTS)).when(plain.rlike(r"^\d{6}\z"), has(near, _DIGIT_HINTS)),
    ]
    return has(near, WORDS["RG"] + WORDS["RNE"]) | F.coalesce(*stages, no)


def _email(text, s, e, span) -> Column:
    mail = F.regexp_replace(strip(span), r"[.,;:!?)]+$", "")
    before, after = F.lower(F.substring(text, F.greatest(s - 50, F.lit(0)) + 1, F.least(s, F.lit(50)))), F.substring(text, e + 1, F.lit(1))
    url = has(before, ["http", "://", "www."]) | F.startswith(mail, F.lit("www.")) | (after == "/")
    return mail.rlike(r"(?U)^[^@/]+@[^@/]*\.\p{IsAlphabetic}{2,}\z") & ~url


def _geo(text, s, e, near, span) -> Column:
    x = strip(span)
    # digits and a letter inside a longer word, as in hexadecimal secrets, are no coordinate, whatever stands around; a name right before may touch them
    before = F.substring(text, F.greatest(s - 11, F.lit(0)) + 1, F.least(s, F.lit(11)))
    glued = x.rlike(r"^\d{2}[NSEWnsew]\d{6}\z") & (F.substring(text, e + 1, F.lit(1)).rlike(r"(?U)\w") | (before.rlike(r"(?U)\w\z") & ~before.rlike(r"(?iU)\b(?:lat|long|log|latitude|longitude|coordenada)\z")))
    marked = reduce(lambda a, b: a | b, [F.contains(x, F.lit(m)) for m in ("°", "'", '"', "Lat", "Long", "Log")])
    shaped = x.rlike(r"^\d{2}[NSEWnsew]\d{6}\z|^-?\d{1,3}\.\d+\s*,\s*-?\d{1,3}\.\d+\z")
    return (F.length(x) >= 3) & ~glued & (marked | shaped | has(near, WORDS["GEO_COORD"]))


def _cid(near, span) -> Column:
    x, medical = F.upper(strip(span)), has(near, WORDS["CID"])
    return medical | (~x.isin(*CID_TRAPS) & x.rlike(r"^[A-TV-Z](?:\d{2}(?:\.\d+)?[X\d]?|\s?\d{2}(?:\.\d+)?(?:-[A-Z\d]+)?)\z"))


def needs(label: str) -> list[str]:
    """Words of which a text must hold one for any verdict of the label; empty if there are none."""
    if label == "EMAIL":
        return ["@"]
    return [] if label in ("CPF", "FISTEL", "RG", "GEO_COORD", "CID") else WORDS.get(label, [])


def verdict(text: Column, s: Column, e: Column, span: Column, label: str, use_cpf: bool = True, use_voter: bool = True, use_cnh: bool = True) -> Column:
    """The final label or null. The context is cut from the original text around the span as found. The guard against
    company numbers is the caller's, as it is the same for all labels."""
    back, ahead = WINDOWS.get(label, (0, 0))
    near = window(text, s, e, back, ahead)
    digits = check.digits(span)
    n = F.length(digits)
    word = has(near, WORDS[label]) if label in WORDS else None
    name = F.lit(label)
    accept = lambda ok: F.when(ok, name)
    if label in ("CPF", "FISTEL"):
        ok = check.cpf(span) if use_cpf else F.lit(True)
        found = F.when(has(near, WORDS["CPF"]), F.when(F.length(span).between(9, 16) & ok, name)).when(F.contains(near, F.lit("cnh")), F.lit("CNH")).when(ok, name)
    elif label == "RG":
        found = accept(_rg(text, s, e, span, near))
    elif label == "EMAIL":
        found = accept(_email(text, s, e, span))
    elif label == "GEO_COORD":
        found = accept(_geo(text, s, e, near, span))
    elif label == "CID":
        found = accept(_cid(near, span))
    elif label == "DATA_NASCIMENTO":
        found = accept(~has(near, WORDS["DATA_EXCLUDE"]) & word)
    elif label == "PASSAPORTE":
        found = accept(F.length(strip(span)).between(6, 9) & word)
    elif label == "TITULO_ELEITOR":
        same = F.replace(digits, F.substring(digits, 1, 1), F.lit("")) == ""
        found = accept(word & (check.voter(span) | (n.between(10, 12) & ~same)) if use_voter else word)
    elif label in ("PIS", "CNS"):
        found = accept(word & check.CHECKS[label.lower()](span))
    elif word is not None:
        found = accept(word)
    else:
        found = name
    return found
