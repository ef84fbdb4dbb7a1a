"""Check digits as Column predicates: unrolled weighted sums, so they stay in generated code. Null in, false out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9]", "")


def _dot(d: Column, weights) -> Column:
    return reduce(lambda a, b: a + b, [F.substring(d, i + 1, 1).cast("int") * w for i, w in enumerate(weights)])


def _at(d: Column, i: int) -> Column:
    return F.substring(d, i, 1).cast("int")


def _equal(d: Column) -> Column:
    return F.replace(d, F.substring(d, 1, 1), F.lit("")) == ""


def _low(rest: Column) -> Column:
    """Rests 0 and 1 give 0, others 11 - rest."""
    return F.when(rest < 2, 0).otherwise(11 - rest)


def _test(ok: Column) -> Column:
    return F.coalesce(ok, F.lit(False))


def cpf(x: Column) -> Column:
    d = digits(x)
    one = _dot(d, range(10, 1, -1)) * 10 % 11 % 10
    two = _dot(d, range(11, 1, -1)) * 10 % 11 % 10
    shaped = ~x.rlike("[*xX]") & (F.length(d) == 11) & ~_equal(d)
    return _test(F.when(shaped, (one == _at(d, 10)) & (two == _at(d, 11))))


def voter(x: Column) -> Column:
    d = digits(x)
    rest = lambda c: F.when(c % 11 == 10, 0).otherwise(c % 11)
    state = F.substring(d, 9, 2).cast("int")
    one = rest(_dot(d, range(2, 10)))
    two = rest(_at(d, 9) * 7 + _at(d, 10) * 8 + one * 9)
    return _test(F.when((F.length(d) == 12) & state.between(1, 28), (one == _at(d, 11)) & (two == _at(d, 12))))


def cnh(x: Column) -> Column:
    d = digits(x)
    one = _low(_dot(d, range(9, 0, -1)) % 11)
    two = _low((_dot(d, range(1, 10)) + one * 10) % 11)
    return _test(F.when(F.length(d) == 11, (one == _at(d, 10)) & (two == _at(d, 11))).when(F.length(d) == 10, one == _at(d, 10)))


def cnpj(x: Column, variant: str = "reference") -> Column:
    """variant: 'reference' has the weights that the reference's tests pin, 'official' the tax office's."""
    d = digits(x)
    if variant == "official":
        first, second = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
    elif variant == "reference":
        first = (6, 7, 8, 9, *range(2, 10))
        second = (5, *first)
    else:
        raise ValueError(f"unknown variant: {variant}")
    one, two = _low(_dot(d, first) % 11), _low(_dot(d, second) % 11)
    return _test(F.when((F.length(d) == 14) & ~_equal(d), (one == _at(d, 13)) & (two == _at(d, 14))))


def pis(x: Column) -> Column:
    d = digits(x)
    return _test(F.when((F.length(d) == 11) & ~_equal(d), _low(_dot(d, (3, 2, *range(9, 1, -1))) % 11) == _at(d, 11)))


def cns(x: Column) -> Column:
    d = digits(x)
    return _test(F.when((F.length(d) == 15) & d.rlike("^[12789]") & ~_equal(d), _low(_dot(d, range(15, 1, -1)) % 11) == _at(d, 15)))


CHECKS = {"cpf": cpf, "voter": voter, "cnh": cnh, "cnpj": cnpj, "pis": pis, "cns": cns}
