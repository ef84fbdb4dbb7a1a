"""A task's share of the rows stays the same at any size."""

import pytest
from pyspark.sql import functions as F

from tarja.operators import evaluate as ev
from tarja.operators import parts
from tarja.operators import tagger as tg
from tarja.operators import training as tr


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(parts, "ROWS", 100)
    monkeypatch.setattr(parts, "CHARS", 100)


def _entities(spark, n):
    return spark.range(n).select("id", F.when(F.col("id") >= 0, "CPF").otherwise("RG").alias("tp_entidade"), F.lit(3).alias("start_entidade"), F.lit(9).alias("end_entidade"))


def test_matching_is_dealt_out_once_by_its_rows(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    truth = _entities(spark, 2000)
    matched = ev.match(truth, truth)
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    assert matched.rdd.getNumPartitions() == 20 and matched.where("kind = 'pair'").count() == 2000
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reports_count_documents_and_entities(spark, small):
    truth = _entities(spark, 300).unionAll(_entities(spark, 100).withColumn("tp_entidade", F.lit("RG"))).unionAll(_entities(spark, 50))
    got = {r["tp_entidade"]: (r["qtd_ids"], r["qtd_entidades"]) for r in ev.report(truth, ev.match(truth, truth)).collect()}
    assert got == {"CPF": (300, 350), "RG": (100, 100), "TODAS": (300, 450)}


def test_curriculum_filter_is_dealt_out_by_its_rows(spark, small):
    texts = spark.range(1000).select("id", F.lit("a").alias("text"))
    entities = spark.range(1000).select("id", F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("X").alias("label"), (F.col("id") % 10 == 0).cast("int").alias("TEM_ERRO"))
    for df in tr.curriculum_filter(texts, entities):
        assert df.rdd.getNumPartitions() == 20 and df.count() == 900


def test_taggers_deal_out_texts_by_their_length(spark, small, monkeypatch):
    said = []
    monkeypatch.setattr(parts, "by_chars", lambda df, text, f=parts.by_chars: said.append(f(df, text)) or said[-1])
    rows = spark.range(200).select("id", F.lit("Sr. Ana Lima").alias("text"), F.array(tr.entity(F.lit(4), F.lit(12), F.lit("P"))).alias("entities")).coalesce(1)
    tagger = tg.train(rows, width=1 << 6, rounds=2)
    assert tagger.annotate(rows.select("id", "text")).count() == 200 and said == [26, 26]


def test_rows_of_one_group_reach_all_tasks(spark, tmp_path):
    from tarja.plans.engine import spread

    path, name = "file://" + str(tmp_path / "p"), "spark.sql.files.maxPartitionBytes"
    spark.range(20000).select(F.concat(F.lit("CPF "), "id").alias("text")).coalesce(1).write.parquet(path)
    before = spark.conf.get(name)
    spark.conf.set(name, "8k")
    try:
        df = spark.read.parquet(path)
        filled = lambda x: x.select(F.spark_partition_id().alias("p")).distinct().count()
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and filled(df) == 1
        assert filled(spread(df)) >= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set(name, before)
