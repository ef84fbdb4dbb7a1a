"""Markdown tables: header names give the labels of the cells below. A fold over lines, then one over cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarja.functions import checkdigits as check
from tarja.functions.labels import LABELS, TABLE_WORDS
from tarja.functions.spans import SPAN, empty, span, strip

BY = "tabela_markdown"


def _pipes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))


def find_tables(text: Column) -> Column:
    """array<array<string>>: runs of lines with a pipe that begin with three pipes and have three lines at least."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now"))

    def close(acc):
        return F.when(F.size(acc["now"]) >= 3, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])

    def step(acc: Column, line: Column) -> Column:
        goes = F.when(F.size(acc["now"]) > 0, _pipes(line) > 0).otherwise(_pipes(line) >= 3)
        return F.when(goes, F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.array(line)).alias("now"))).otherwise(F.struct(close(acc).alias("done"), F.array().cast("array<string>").alias("now")))

    return F.aggregate(F.split(text, "\n", -1), start, step, close)


def _cells(line: Column) -> Column:
    return F.transform(F.split(line, r"\|", -1), strip)


def _separator(line: Column) -> Column:
    return (strip(F.translate(line, "|-:", "   ")) == "") & F.contains(line, F.lit("-"))


def _heads(line: Column) -> Column:
    """The labels of a header row: empty cells removed, numbering cut, null where no keyword is in it."""
    full = F.filter(_cells(line), lambda c: c != "")
    bare = F.transform(full, lambda c: strip(F.regexp_replace(c, r"^[\d.]+\s*", "")))
    known = lambda c: F.exists(F.array(*map(F.lit, TABLE_WORDS)), lambda k: F.contains(F.lower(c), k))
    return F.transform(bare, lambda c: F.when(known(c), F.upper(c)))


def _row_cells(line: Column) -> Column:
    """A row's cells; of the outermost ones those that are blank, outside the outer pipes, are left out."""
    blank = lambda cells, i: F.coalesce(F.try_element_at(cells, F.lit(i)) == "", F.lit(False))
    cells = _cells(line)
    cells = F.when(blank(cells, 1), F.slice(cells, F.lit(2), F.size(cells))).otherwise(cells)
    return F.when(blank(cells, -1), F.slice(cells, F.lit(1), F.size(cells) - 1)).otherwise(cells)


def _relabel(head: Column, cell: Column) -> Column:
    n = F.length(check.digits(cell))
    free = F.translate(head, "-", "").isin("EMAIL", "TELEFONE", "ENDEREÇO")
    found = F.when(check.cpf(cell), F.lit("CPF")).when(check.cnh(cell) & n.isin(10, 11), F.lit("CNH")).when(F.contains(head, F.lit("FISTEL")) | F.contains(head, F.lit("CNPJ")), F.lit(None)).when(free | (n >= 2), head)
    return F.when(found.isin([x for x in LABELS]), found)


def table_spans(text: Column) -> Column:
    """Spans of the personal cells of all tables, in their order. A table's cells are sought from the text's begin on, each
    at or behind the one before."""

    def of_table(lines: Column) -> Column:
        # one header, or, without a separator or with a second one, every other line
        rule = lambda i: F.coalesce(_separator(F.get(lines, i)), F.lit(False))
        plain = rule(F.lit(1))
        many = ~plain | rule(F.lit(3))
        n = F.size(lines)

        def of_header(acc: Column, i: Column) -> Column:
            heads = _heads(F.get(lines, i))
            first = i + F.when(plain & rule(i + 1), 2).otherwise(1)
            rows = F.slice(lines, first + 1, F.when(many, 1).otherwise(n))
            stop = F.array_position(F.transform(rows, lambda x: F.startswith(strip(x), F.lit("|"))), False).cast("int")  # such a row ends the data
            rows = F.when(stop > 0, F.slice(rows, F.lit(1), stop - 1)).otherwise(rows)

            def one(a: Column, p: Column) -> Column:
                found = F.call_function("locate", p["cell"], text, a["at"])
                end = found - 1 + F.length(p["cell"])
                label = _relabel(p["head"], p["cell"])
                new = F.when(label.isNotNull() & (found > 0), F.array(span(label, found - 1, end, p["cell"], F.lit(BY), F.lit(100000)))).otherwise(empty())
                return F.struct(F.when(found > 0, end + 1).otherwise(a["at"]).cast("int").alias("at"), F.concat(a["out"], new).alias("out"))

            def step(a: Column, line: Column) -> Column:
                pairs = F.filter(F.zip_with(heads, _row_cells(line), lambda h, c: F.struct(h.alias("head"), c.alias("cell"))), lambda p: p["head"].isNotNull() & p["cell"].isNotNull() & (p["cell"] != ""))
                return F.aggregate(pairs, a, one)

            return F.aggregate(rows, acc, step)

        headers = F.when(many, F.sequence(F.lit(0), n - 1, F.lit(2))).otherwise(F.array(F.lit(0)))
        return F.aggregate(headers, F.struct(F.lit(1).alias("at"), empty().alias("out")), of_header, lambda a: a["out"])

    found = F.flatten(F.transform(find_tables(text), of_table))
    return F.when(F.contains(text, F.lit("|")), found).otherwise(empty()).cast(f"array<{SPAN}>")
