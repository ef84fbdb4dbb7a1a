"""Literal vectors of check digits, spans and files."""

import pytest
from pyspark.sql import functions as F

from tarja.functions import checkdigits as check
from tarja.functions.patterns import Catalog, custom
from tarja.operators import evaluate as ev
from tarja.operators import training as tr
from tarja.plans.engine import Engine
from tarja.sources import files

VECTORS = {
    "cpf": (["529.982.247-25", "123.456.789-09"], ["123.456.789-00", "000.000.000-00", "***.456.789-**", "123.456.789-x0", None]),
    "cnpj": (["12.345.678/0001-23", "18781203000196"], ["12.345.678/0001-95", "", None]),
    "pis": (["19020525177", "12096379549", "13151959279", "190.20525.17-7"], ["11111111111", None]),
    "cns": (["898004614875795", "898001423896809"], ["398004614875795", None]),
}


@pytest.mark.parametrize("kind", VECTORS)
def test_check_digits(spark, kind):
    good, bad = VECTORS[kind]
    df = spark.createDataFrame([(x, True) for x in good] + [(x, False) for x in bad], "x string, ok boolean")
    assert df.where(check.CHECKS[kind](F.col("x")) != F.col("ok")).count() == 0


def test_masking_and_context(spark):
    df = spark.createDataFrame([(1, "O CPF 529.982.247-25 e o e-mail ana@exemplo.com.br."), (2, "valor 529.982.247-99"), (3, None), (4, "")], "id long, text string")
    got = {r["id"]: r["masked"] for r in Engine(Catalog().with_labels(["CPF", "EMAIL"])).anonymize(df).select("id", "masked").collect()}
    assert got[1] == "O CPF <|CPF|> e o e-mail <|EMAIL|>." and got[2] == "valor 529.982.247-99" and got[3] is None and got[4] == ""


def test_catalog_errors():
    with pytest.raises(ValueError):
        Catalog().with_labels(["NADA"])
    with pytest.raises(ValueError):
        Catalog().with_labels([])
    with pytest.raises(ValueError):
        custom("X", "a*")
    assert len(Catalog().with_labels(Catalog.default().labels).patterns) == 86 and len(Catalog.default().patterns) == 93


def test_iou(spark):
    df = spark.createDataFrame([(0, 10, 5, 15, 1 / 3), (5, 8, 0, 10, 0.3), (0, 5, 5, 9, 0.0)], "a int, b int, c int, d int, o double")
    assert df.where(F.abs(ev.iou(F.col("a"), F.col("b"), F.col("c"), F.col("d")) - F.col("o")) > 1e-9).count() == 0


def test_evaluation_errors(spark):
    truth = spark.createDataFrame([(1, "CPF", 0, 5)], "id long, tp_entidade string, start_entidade int, end_entidade int")
    with pytest.raises(ValueError):
        ev.evaluate(truth.where("false"), truth)
    with pytest.raises(ValueError):
        ev.cases(ev.match(truth, truth), 1.5)
    r = ev.evaluate(truth, truth).collect()
    assert {x["tp_entidade"] for x in r} == {"CPF", "TODAS"} and all(x["fbeta"] == 1.0 for x in r)


def test_annotation_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"text": "Olá Ana", "labels": [[4, 7, "PER"]]}\n\n{"text": "Rua B", "entities": [{"start_offset": 0, "end_offset": 3, "label": "LOC"}]}\nnot json\n{"text": ""}\n{"text": "só"}\n', encoding="utf-8")
    got = [(r["id"], r["text"], [tuple(e) for e in r["entities"]]) for r in files.read_annotations(spark, str(path)).orderBy("id").collect()]
    assert got == [(1, "Olá Ana", [(4, 7, "PER")]), (3, "Rua B", [(0, 3, "LOC")])]
    problems = {r["line"]: r["problem"] for r in files.parse_lines(files.numbered_lines(spark, str(path))).collect()}
    assert problems == {1: None, 3: None, 4: "bad_json", 5: "empty_text", 6: "no_entities"}


def test_tables_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([(1, "CPF", 0, 5, 'a "b",\nc')], "id long, tp_entidade string, start_entidade int, end_entidade int, text_entidade string")
    for kind in ("parquet", "csv", "json"):
        path = files.write_predictions(df, str(tmp_path / "p"), kind)
        assert [r["text_entidade"] for r in files.read_predictions(spark, path).collect()] == ['a "b",\nc']
    with pytest.raises(ValueError):
        files.read_markdown(spark, "x.txt")


def test_tags_and_tokens(spark):
    df = spark.createDataFrame([("Ana Lima, RG 12", [(0, 8, "PER"), (13, 15, "RG")])], f"text string, entities {tr.ENTITIES}")
    r = df.select(tr.biluo(F.col("text"), F.col("entities")).alias("t"), tr.tokens(F.col("text")).alias("k"), tr.diagnose(F.col("text"), F.col("entities")).alias("d")).first()
    assert r["t"] == ["B-PER", "L-PER", "O", "O", "U-RG"] and "".join(r["k"]) == "Ana Lima, RG 12" and r["d"] == []
