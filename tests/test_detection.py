"""Every pattern on texts of its own, tables row by row, and what detection must not miss."""

import re

import pytest
from pyspark.sql import functions as F

from tarja.functions.patterns import Catalog, custom
from tarja.functions.spans import find
from tarja.operators import evaluate as ev
from tarja.plans.engine import Engine

#: A text that each pattern finds, in the catalog's order.
SHAPES = {
    "CPF": ["529.982.247-25", "529982247-25", "52998224725", "nº: 529982247-25", "nº 52998224725", "***.982.247-**", "***982247-**", "***982247**", "529.***.***-25", "529******-25", "529******25"],
    "RG": ["1234567 - SP", "12.345.678-X SP", "12.345.6789", "12.345.678-9", "12.345.678-9/X", "MG-12.345.678", "12.345.678-99", "RG nº: 1234567", "1.234.567-8 SSP/DF", "CRM/SP 12345", "12345-OAB/RJ", "CREA: 12345"],
    "TITULO_ELEITOR": ["Título de eleitor: 123456789012", ":1234 5678 9012", "123456781201", ":123456789012", "nº 1234 5678 9012"],
    "PASSAPORTE": ["AB123456"],
    "SIAPE": ["1234567", "SIAPE n 1234567", "123456-7"],
    "CNH": ["12345678901", "1234567890", "123 456 789-01", "CNH: 12345678901"],
    "DADOS_BANCARIOS": ["12345-6", "1234-1234567-8", "BR12 1234 1234 1234 1234", "12345678-9", "123-123456-7"],
    "EMAIL": ["ana.b+c@mail.org"],
    "TELEFONE": ["(11) 91234-5678", "11 91234-5678", "+55 (11) 91234-5678", "11912345678", "55 (11) 91234 5678", "(011) 91234.5678", "(011) 9 1234-5678", "011 91234.5678", "+55 011 91234.5678", "+5511912345678", "011.91234.5678", "11 1234 1234567", "(11) 91234.5678", "1234-5678", "(11)91234.5678", "(11)912345678", "(+55) 11 91234-5678"],
    "DATA_NASCIMENTO": ["12/05/1980", "1980-05-12", "12 de maio de 1980"],
    "ENDEREÇO": ["12345-678", "12.345-678", "12345678"],
    "GEO_COORD": ["15°47' S", "Lat.15S123456", "-15,123 -47,123", "15°47'12.5\"S", "15°S 47'12.5\"", "latitude: -15.78", "15°S47'12,5\"", "-15.789°S", "15S123456", "-15.7801, -47.9292"],
    "CID": ["F32", "F32.1", "CID-10: F32.1", "diagnóstico: F32", "F32.1"],
    "PIS": ["19020525177", "1902052517-7", "190.20525.17-7"],
    "CNS": ["898004614875795", "898004614875795-1"],
    "RESERVISTA": ["123456-123456789012"],
}
FOREIGN = {
    "RG": ["CRNM: 1234567", "RNE 123.456.789", "Registro Nacional Migratório nº 1234567", "Registro Nacional de Estrangeiro: 123.456", "Número do RNE: 1234567", "CRNM nº1234567", "RNE n.123.456"],
    "PASSAPORTE": ["A12345678", "123456789", "CF1234567", "A123456", "12AB34567", "AB1234567", "AB12C3", "Passaporte nº: AB123456"],
}


def test_every_pattern_finds_its_shape_and_leaves_others(spark):
    catalog = Catalog.default(foreign_passport=True)
    shapes = {f"{label}:{i + 1}": x for label, xs in SHAPES.items() for i, x in enumerate(xs)} | {f"{label}:foreign{i + 1}": x for label, xs in FOREIGN.items() for i, x in enumerate(xs)}
    assert set(shapes) == {p.id for p in catalog.patterns}
    rows = []
    for p in catalog.patterns:
        good = f"ver {shapes[p.id]} fim"
        rows += [(p.id, good), (p.id, re.sub(r"[\d*@]", "~", good).lower()), (p.id, f"{good} e {good}\n")]
    df = spark.createDataFrame(rows, "id string, text string").repartition(1).cache()
    for p in catalog.patterns:
        for r in df.where(F.col("id") == p.id).select("text", find("text", p.regex, p.label, p.id, 0).alias("s")).collect():
            want = [(m.start() + (m.group()[0] == " "), m.end() - (m.group()[-1] == " ")) for m in re.finditer(p.regex, r["text"])]
            assert [(s["start"], s["end"]) for s in r["s"]] == want, (p.id, r["text"])
            assert bool(want) == ("ver " in r["text"] and shapes[p.id] in r["text"]), (p.id, r["text"])


def _found(spark, text, engine):
    df = spark.createDataFrame([(text,)], "text string")
    return [(s["label"], s["text"]) for s in engine.spans(df).first()["spans"]]


def test_a_short_number_behind_an_area_code_is_its_own(spark):
    assert _found(spark, "telefone 011.23456789", Engine(Catalog().with_labels(["TELEFONE"]))) == [("TELEFONE", "23456789")]


def test_digits_of_other_scripts(spark):
    number = "".join(chr(0x660 + int(c)) for c in "12345") + "-" + "".join(chr(0x660 + int(c)) for c in "678")
    assert _found(spark, f"Rua CEP {number} fim", Engine(Catalog().with_labels(["ENDEREÇO"]))) == [("ENDEREÇO", number)]


def test_long_texts_are_searched_or_say_why_not(spark):
    df = spark.createDataFrame([(1, "x" * 5000 + " ana@x.org"), (2, "ana@x.org"), (3, None)], "id long, text string")
    labels = Catalog().with_labels(["EMAIL"])
    assert [len(r["spans"]) for r in Engine(labels).spans(df).orderBy("id").collect()] == [1, 1, 0]
    got = Engine(labels, max_chars=100).spans(df).orderBy("id").collect()
    assert [(len(r["spans"]), r["problem"] is None) for r in got] == [(0, False), (1, True), (0, True)]


def test_custom_patterns_compile_where_they_run(spark):
    with pytest.raises(ValueError):
        custom("X", "(?P<a>ab)c")


TABLES = [
    ("| Nome | Email |\n| --- | --- |\n| Ana | ana@x.org\n| Bia | bia@x.org |", ["ana@x.org", "bia@x.org"]),  # a row without its last pipe
    ("| Nome | Email |\n| --- | --- |\n| Ana | ana@x.org |\nBia | bia@x.org | z\n| Eva | eva@x.org |", ["ana@x.org"]),  # a row without its first pipe ends the data
    ("| Nome | Email |\n| Ana | ana@x.org |\n| Nome | Email |\n| Bia | bia@x.org |", ["ana@x.org", "bia@x.org"]),  # every other line a header
    ("| Nome | Email |\n| --- | --- |\n| Ana | ana@x.org |\n| --- | --- |\n| Bia | bia@x.org |", ["ana@x.org"]),  # a second separator: every other line
    ("| Nome | Email |\n| --- | --- |", []),
    ("| Nome | Email | |\n| --- | --- | --- |\n|  | ana@x.org | |", ["ana@x.org"]),
]


@pytest.mark.parametrize("text, want", TABLES)
def test_table_rows(spark, text, want):
    from tarja.operators.tables import table_spans

    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(table_spans(F.col("text")).alias("s")).first()["s"]
    assert [s["text"] for s in got] == want and all(text[s["start"] : s["end"]] == s["text"] for s in got)


def test_matching_keeps_repeated_rows_and_null_offsets(spark):
    schema = "id long, tp_entidade string, start_entidade int, end_entidade int, text_entidade string"
    truth = spark.createDataFrame([(1, "CPF", 0, 9, "a"), (1, "CPF", 20, 29, "b"), (1, "CPF", 20, 29, "b"), (2, "RG", None, None, "n")], schema)
    found = spark.createDataFrame([(1, "CPF", 1, 9, "a"), (1, "CPF", 2, 9, "c"), (3, "RG", 0, 4, "d")], schema)
    got = sorted((r["id"], r["kind"], r["start_entidade_true"] or -1, r["start_entidade_pred"] or -1) for r in ev.match(truth, found).collect())
    assert got == [(1, "pair", -1, 1), (1, "pred", -1, 2), (1, "true", 20, -1), (1, "true", 20, -1), (2, "true", -1, -1), (3, "pred", -1, -1)]


@pytest.mark.parametrize("text, want", [("token 7fcb6e3e39e793795 lat", []), ("39e793795ab gps", []), ("Ponto 47W561530.", ["47W561530"]), ("lat02s380200", ["02s380200"]), ("Lat02S380200", ["02S380200"])])
def test_a_coordinate_is_no_part_of_a_word(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    assert [s["text"] for s in Engine(Catalog().with_labels(["GEO_COORD"])).spans(df).first()["spans"]] == want
