"""The engine's own queries, each with SQL that another engine can run on the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarja.functions import checkdigits as check
from tarja.functions.labels import ALIASES, WORDS
from tarja.functions.normalize import normalize
from tarja.functions.patterns import Catalog, custom
from tarja.functions.spans import SPAN, find, formatted, resolve, span, split_lines
from tarja.functions.udfs import register
from tarja.operators import evaluate as ev
from tarja.operators import tagger as tg
from tarja.operators import training as tr
from tarja.plans import fixtures as fx
from tarja.plans.engine import Engine, spread
from tarja.sources import files
from tarja.sources.scratch import scratch

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_TABLE = re.compile(r"\{(region|nation|customer|supplier|part|orders|lineitem|events|documents)\}")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture as a DataFrame."""
    return spark.sql(sql, **{t: _table(spark, sf_dir, t) for t in set(_TABLE.findall(sql))})


def _plain(sql: str) -> str:
    return _TABLE.sub(r"\1", sql)


def _wide(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, as other engines count."""
    return df.select(*[F.col(f"`{f.name}`").cast("long").alias(f.name) if f.dataType.typeName() in ("integer", "short", "byte") else F.col(f"`{f.name}`") for f in df.schema])


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        _Q[name or f.__name__] = lambda spark, sf_dir: _wide(f(spark, sf_dir))
        if sql:
            _SQL[name or f.__name__] = _plain(sql)
        return f

    return add


def _listed(df: DataFrame) -> DataFrame:
    """A row per span: id, label, start, end, text."""
    return df.select("id", F.explode("spans").alias("s")).select("id", F.col("s.label").alias("label"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("text"))


def _only(*labels: str, **options) -> Engine:
    return Engine(Catalog().with_labels(list(labels), **options))


# ---- e-mail over real text ------------------------------------------------------------------------------------------
EMAIL = r"\b[a-zA-Z0-9_.+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data masked, all labels."""
    out = Engine().anonymize(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return _wide(out.select("doc_id", F.size("spans").alias("n_spans"), F.sha2("masked", 256).alias("masked_sha256")))


_Q["mask_documents"] = flagship
#: All labels are sought; in the documents of sf0.1 and below only e-mail addresses are personal data, which the SQL finds by itself.
_SQL["mask_documents"] = _plain(f"""SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '{EMAIL}')), 0) AS BIGINT) AS n_spans, sha256(regexp_replace(text, '{EMAIL}', '<|EMAIL|>', 'g')) AS masked_sha256
FROM {{documents}}""")


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{EMAIL}')) AS BIGINT) AS n, array_to_string(regexp_extract_all(text, '{EMAIL}'), ',') AS found FROM {{documents}} WHERE regexp_matches(text, '{EMAIL}')")
def email_scan(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").where(F.contains("text", F.lit("@")))
    spans = docs.withColumn("s", find("text", EMAIL, "EMAIL", "EMAIL:1", 0)).where(F.size("s") > 0)
    return spans.select("doc_id", F.size("s").alias("n"), F.array_join(F.transform("s", lambda x: x["text"]), ",").alias("found"))


@query(f"""SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '{EMAIL}')), 0) AS BIGINT) AS n_spans, sha256(regexp_replace(text, '{EMAIL}', '<|EMAIL|>', 'g')) AS masked_sha256
FROM {{documents}}""")
def email_masked(spark, sf_dir):
    out = _only("EMAIL").anonymize(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", F.size("spans").alias("n_spans"), F.sha2("masked", 256).alias("masked_sha256"))


@query(f"SELECT lang, count(*) AS n_docs, CAST(sum(CAST(regexp_matches(text, '{EMAIL}') AS INT)) AS BIGINT) AS n_masked FROM {{documents}} GROUP BY lang")
def masked_share_by_lang(spark, sf_dir):
    out = _only("EMAIL").spans(spread(_table(spark, sf_dir, "documents").select("lang", "text")))
    return out.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum((F.size("spans") > 0).cast("long")).alias("n_masked"))


@query("SELECT CAST(length(r) AS BIGINT) AS run_length, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[0-9]+')) AS r FROM {documents}) x WHERE length(r) BETWEEN 7 AND 15 GROUP BY 1")
def digit_run_profile(spark, sf_dir):
    runs = _table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("r"))
    return runs.groupBy(F.length("r").alias("run_length")).agg(F.count("*").alias("n")).where("run_length between 7 and 15")


#: A word that the verdict asks for, and the shape not far behind it.
_NEAR = lambda label, back, shape: f"(?i)(?:{'|'.join(re.escape(w) for w in WORDS[label])})[\\s\\S]{{0,{back}}}(?:{shape})"


@query(f"""SELECT CAST(sum(len(regexp_extract_all(text, '[a-zA-Z]{{2}}[0-9]{{5,6}}'))) AS BIGINT) AS n_shapes,
  CAST(sum(len(regexp_extract_all(text, '{_NEAR("PASSAPORTE", 100, "[a-zA-Z]{2}[0-9]{5,6}")}'))) AS BIGINT) AS n_passports,
  CAST(sum(len(regexp_extract_all(text, '{_NEAR("DATA_NASCIMENTO", 80, "[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{4}-[0-9]{2}-[0-9]{2}")}'))) AS BIGINT) AS n_birth_dates FROM {{documents}}""")
def false_positive_rejection(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("text")
    out = _only("PASSAPORTE", "DATA_NASCIMENTO").spans(spread(docs))
    count = lambda label: F.coalesce(F.sum(F.size(F.filter("spans", lambda s: s["label"] == label))), F.lit(0)).cast("long")
    return out.agg(F.sum(F.coalesce(F.regexp_count("text", F.lit("[a-zA-Z]{2}[0-9]{5,6}")), F.lit(0))).alias("n_shapes"), count("PASSAPORTE").alias("n_passports"), count("DATA_NASCIMENTO").alias("n_birth_dates"))


# ---- check digits ---------------------------------------------------------------------------------------------------
def _check(name: str, sql: str, test: Callable[[Column], Column]) -> None:
    _Q[f"{name}_check"] = lambda spark, sf_dir: _rows(spark, sf_dir, sql).select("id", "raw", test(F.col("raw")).alias("valid"))
    _SQL[f"{name}_check"] = _plain(f"SELECT id, raw, good AS valid FROM ({sql}) q")


_check("cpf", fx.CPF, check.cpf)
for _name, _sql in fx.NUMBERS.items():
    _check(_name, _sql, (lambda x, v=_name.partition("_")[2]: check.cnpj(x, v)) if _name.startswith("cnpj") else check.CHECKS[_name])


@query(" UNION ALL ".join(f"SELECT id, '{n}' AS name, good AS valid FROM ({sql}) q" for n, sql in [("is_cpf", fx.CPF), *((f"is_{n}", fx.NUMBERS[n]) for n in ("pis", "cns", "cnh", "voter"))]))
def sql_functions(spark, sf_dir):
    register(spark)
    every = [("is_cpf", fx.CPF), *((f"is_{n}", fx.NUMBERS[n]) for n in ("pis", "cns", "cnh", "voter"))]
    return reduce(DataFrame.unionAll, [_rows(spark, sf_dir, sql).select("id", F.lit(n).alias("name"), F.expr(f"{n}(raw)").alias("valid")) for n, sql in every])


@query(f"SELECT id, CAST(length(name) + 14 AS BIGINT) AS start, cpf AS text FROM ({fx.CPF}) q")
def pattern_spans(spark, sf_dir):
    """The table function: raw matches, before any context."""
    register(spark)
    _rows(spark, sf_dir, f"SELECT id, 'Cliente ' || name || ', CPF ' || cpf AS text FROM ({fx.CPF}) q").createOrReplaceTempView("tarja_texts")
    return spark.sql("SELECT id, s.start, s.text FROM tarja_texts t, LATERAL pattern_spans(t.text, 'CPF') s WHERE s.pattern = 'CPF:1'")


# ---- detectors over templates ---------------------------------------------------------------------------------------
def _detect(name: str, label: str, sql: str) -> None:
    def run(spark, sf_dir):
        rows = _rows(spark, sf_dir, sql).select("id", F.concat("head", "body", "tail").alias("text"))
        return _wide(_listed(_only(label, foreign_rg=name == "rg_foreign_detect", foreign_passport=name == "passport_foreign_detect").spans(spread(rows))))

    _Q[name] = run
    _SQL[name] = _plain(f"SELECT id, '{'CNH' if name == 'cpf_relabel' else label}' AS label, CAST(length(head) AS BIGINT) AS start, CAST(length(head) + length(body) AS BIGINT) AS \"end\", body AS text FROM ({sql}) q WHERE good")


for _name, (_label, _sql) in fx.TEMPLATES.items():
    _detect(_name, _label, _sql)


@query(f"SELECT id, 'Cliente ' || name || ', CPF ' || CASE WHEN good THEN '<|CPF|>' ELSE cpf END AS masked FROM ({fx.CPF}) q")
def mask_templates(spark, sf_dir):
    rows = _rows(spark, sf_dir, f"SELECT id, 'Cliente ' || name || ', CPF ' || cpf AS text FROM ({fx.CPF}) q")
    return Engine().anonymize(spread(rows)).select("id", "masked")


@query(f"SELECT label, count(*) AS n FROM (SELECT 'CPF' AS label FROM ({fx.CPF}) q WHERE good UNION ALL SELECT 'TELEFONE' FROM ({fx.TEMPLATES['phone_gate'][1]}) p WHERE good) x GROUP BY label")
def spans_per_label(spark, sf_dir):
    a = _rows(spark, sf_dir, f"SELECT 'Cliente ' || name || ', CPF ' || cpf AS text FROM ({fx.CPF}) q")
    b = _rows(spark, sf_dir, fx.TEMPLATES["phone_gate"][1]).select(F.concat("head", "body").alias("text"))
    out = _only("CPF", "TELEFONE").spans(spread(a.unionAll(b)))
    return out.select(F.explode("spans").alias("s")).groupBy(F.col("s.label").alias("label")).agg(F.count("*").alias("n"))


@query(f"""SELECT id, 'CPF' AS label, CAST(instr(text, cpf) - 1 AS BIGINT) AS start, CAST(instr(text, cpf) - 1 + 14 AS BIGINT) AS "end", cpf AS text FROM ({fx.TABLE}) q
UNION ALL SELECT id, 'EMAIL', CAST(instr(text, mail) - 1 AS BIGINT), CAST(instr(text, mail) - 1 + length(mail) AS BIGINT), mail FROM ({fx.TABLE}) q""")
def table_entities(spark, sf_dir):
    return _listed(_only("CPF", "EMAIL").spans(spread(_rows(spark, sf_dir, fx.TABLE).select("id", "text"))))


@query("SELECT s_suppkey AS id, 'PROTOCOLO' AS label, CAST(5 AS BIGINT) AS start, CAST(5 + length(s_name) AS BIGINT) AS \"end\", s_name AS text FROM {supplier}")
def custom_pattern(spark, sf_dir):
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Ver: "), "s_name", F.lit(" .")).alias("text"))
    return _listed(Engine(Catalog().with_custom(custom("protocolo", r"Supplier#\d+"))).spans(spread(rows)))


@query(f"SELECT id, 'CPF' AS label, cpf AS text FROM ({fx.CPF}) q WHERE good")
def label_text_distinct(spark, sf_dir):
    rows = _rows(spark, sf_dir, f"SELECT id, 'CPF ' || cpf || ' e CPF ' || cpf AS text FROM ({fx.CPF}) q")
    out = _only("CPF").extract(spread(rows), kind="text")
    return out.select("id", F.explode("spans").alias("s")).select("id", "s.label", "s.text")


@query(f"SELECT id, 'MODELO' AS source, CAST(8 + length(name) + 6 AS BIGINT) AS start FROM ({fx.CPF}) q WHERE good")
def model_plugin(spark, sf_dir):
    """Spans that come as a column from any model take part like the patterns' own, first in order."""
    rows = _rows(spark, sf_dir, f"SELECT id, 'Cliente ' || name || ', CPF ' || cpf AS text, length(name) + 14 AS at, cpf FROM ({fx.CPF}) q")
    rows = rows.withColumn("found", F.array(span(F.lit("CPF"), F.col("at"), F.col("at") + 14, F.col("cpf"), F.lit("modelo"), F.lit(0))))
    out = Engine(Catalog().with_labels(["CPF"]), model_spans="found").spans(spread(rows))
    return out.select("id", F.explode("spans").alias("s")).select("id", F.when(F.col("s.detected_by") == "modelo", "MODELO").otherwise("OUTRO").alias("source"), F.col("s.start").alias("start"))


# ---- span transformations over literals -----------------------------------------------------------------------------
def _literal(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(case, label, start, end, text) rows as arrays of spans by case."""
    df = spark.createDataFrame([(c, (label, s, e, t, "x", i)) for i, (c, label, s, e, t) in enumerate(rows)], f"case_id long, s {SPAN}")
    return df.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("s.seq", "s"))).alias("x")).select("case_id", F.transform("x", lambda y: y["s"]).alias("spans"))


def _values(rows: list[tuple]) -> str:
    show = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)
    return f"SELECT CAST(a AS BIGINT) AS case_id, b AS label, CAST(c AS BIGINT) AS start, CAST(d AS BIGINT) AS \"end\", e AS text FROM (VALUES {body}) v(a, b, c, d, e)"


def _cased(df: DataFrame) -> DataFrame:
    return _listed(df.withColumnRenamed("case_id", "id")).withColumnRenamed("id", "case_id")


@query(_values([(1, "RG", 4, 12, "12345678"), (2, "RG", 0, 7, "3990139"), (3, "RG", 4, 11, "3990139"), (4, "CPF", 4, 18, "529.982.247-25"), (5, "EMAIL", 8, 15, "a@b.com"), (6, "SIAPE", 3, 10, "1234567")]))
def normalize_spans(spark, sf_dir):
    rows = [(1, "RG", 0, 12, "RG: 12345678"), (2, "RG", 0, 14, "3990139 SSP/DF"), (3, "RG", 0, 18, "RG: 3990139 SSP/DF"), (4, "CPF", 0, 18, "CPF 529.982.247-25"), (5, "EMAIL", 0, 15, "E-mail: a@b.com"), (6, "SIAPE", 0, 10, "nº 1234567")]
    return _cased(_literal(spark, rows).withColumn("spans", normalize(F.col("spans"))))


@query(_values([(1, "CPF", 0, 3, "123"), (1, "CPF", 4, 6, "45"), (2, "RG", 2, 5, "abc"), (2, "RG", 7, 9, "de")]))
def newline_split(spark, sf_dir):
    return _cased(_literal(spark, [(1, "CPF", 0, 6, "123\n45"), (2, "RG", 2, 9, "abc\r\nde")]).withColumn("spans", split_lines(F.col("spans"))))


@query(_values([(1, "CPF", 8, 15, "b"), (2, "CPF", 0, 10, "long"), (3, "RG", 0, 9, "y"), (4, "CPF", 0, 5, "a"), (4, "EMAIL", 5, 9, "b"), (5, "CNH", 0, 11, "n")]))
def overlap_resolve(spark, sf_dir):
    rows = [
        (1, "EMAIL", 5, 10, "a"), (1, "CPF", 8, 15, "b"), (2, "CPF", 0, 10, "long"), (2, "RG", 2, 6, "in"), (3, "RG", 0, 5, "x"), (3, "RG", 3, 9, "y"),
        (4, "CPF", 0, 5, "a"), (4, "EMAIL", 5, 9, "b"), (5, "PIS", 0, 11, "n"), (5, "CNH", 0, 11, "n"),
    ]
    return _cased(_literal(spark, rows).withColumn("spans", resolve(F.col("spans"))))


@query("SELECT label, CAST(n AS BIGINT) AS n FROM (VALUES ('CPF', 11), ('RG', 19), ('TITULO_ELEITOR', 5), ('PASSAPORTE', 1), ('SIAPE', 3), ('CNH', 4), ('DADOS_BANCARIOS', 5), ('EMAIL', 1), ('TELEFONE', 17), ('DATA_NASCIMENTO', 3), ('ENDEREÇO', 3), ('GEO_COORD', 10), ('CID', 5), ('PIS', 3), ('CNS', 2), ('RESERVISTA', 1)) v(label, n)")
def pattern_catalog_counts(spark, sf_dir):
    return Catalog.default().frame(spark).groupBy("label").agg(F.count("*").alias("n"))


# ---- evaluation -----------------------------------------------------------------------------------------------------
def _both(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return _rows(spark, sf_dir, fx.TRUTH), _rows(spark, sf_dir, fx.FOUND)


_PAIR = f"""
t AS ({fx.TRUTH}), p AS ({fx.FOUND}),
j AS (SELECT t.id, t.tp_entidade, t.start_entidade AS st, t.end_entidade AS et, p.start_entidade AS sp, p.end_entidade AS ep,
  CASE WHEN least(t.end_entidade, p.end_entidade) > greatest(t.start_entidade, p.start_entidade)
    THEN CAST(least(t.end_entidade, p.end_entidade) - greatest(t.start_entidade, p.start_entidade) AS DOUBLE) / (greatest(t.end_entidade, p.end_entidade) - least(t.start_entidade, p.start_entidade)) ELSE 0.0 END AS o
  FROM t JOIN p ON t.id = p.id AND t.tp_entidade = p.tp_entidade),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, tp_entidade, sp, ep ORDER BY o DESC, st, et, sp, ep) AS r FROM j) x WHERE r = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, tp_entidade, st, et ORDER BY o DESC, st, et, sp, ep) AS q FROM a) x WHERE q = 1),
m AS (SELECT id, tp_entidade, 'pair' AS kind, o, st, et, sp, ep FROM b
  UNION ALL SELECT id, tp_entidade, 'true', 0.0, start_entidade, end_entidade, NULL, NULL FROM t LEFT JOIN (SELECT id AS i, tp_entidade AS l, st, et FROM b) x ON i = t.id AND l = t.tp_entidade AND st = t.start_entidade AND et = t.end_entidade WHERE i IS NULL
  UNION ALL SELECT id, tp_entidade, 'pred', 0.0, NULL, NULL, start_entidade, end_entidade FROM p LEFT JOIN (SELECT id AS i, tp_entidade AS l, sp, ep FROM b) x ON i = p.id AND l = p.tp_entidade AND sp = p.start_entidade AND ep = p.end_entidade WHERE i IS NULL)
"""
_REPORT = f"""{_PAIR},
g AS (SELECT CAST(x AS DOUBLE) AS overlap_threshold FROM (VALUES (0.7), (0.8), (0.9)) v(x)),
s AS (SELECT overlap_threshold, CASE WHEN grouping(tp_entidade) = 1 THEN 'TODAS' ELSE tp_entidade END AS tp_entidade,
  sum(CASE WHEN kind = 'pair' AND o >= overlap_threshold THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN kind = 'pred' OR kind = 'pair' AND o < overlap_threshold THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN kind = 'true' OR kind = 'pair' AND o < overlap_threshold THEN 1 ELSE 0 END) AS fn
  FROM m, g GROUP BY GROUPING SETS ((overlap_threshold, tp_entidade), (overlap_threshold))),
n AS (SELECT CASE WHEN grouping(tp_entidade) = 1 THEN 'TODAS' ELSE tp_entidade END AS tp_entidade, count(DISTINCT id) AS qtd_ids, count(*) AS qtd_entidades FROM t GROUP BY ROLLUP (tp_entidade)),
e AS (SELECT CAST(x AS DOUBLE) AS beta FROM (VALUES (1.0), (2.0)) v(x)),
f AS (SELECT s.tp_entidade, overlap_threshold, beta, qtd_ids, qtd_entidades,
  CASE WHEN (1 + beta * beta) * tp + beta * beta * fn + fp = 0 THEN 0.0 ELSE (1 + beta * beta) * tp / ((1 + beta * beta) * tp + beta * beta * fn + fp) END AS fbeta,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS "precision", CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall, tp, fp, fn
  FROM s JOIN n ON s.tp_entidade = n.tp_entidade, e)
"""
_SHOW = 'tp_entidade, overlap_threshold, beta, qtd_ids, qtd_entidades, round(fbeta, 9) AS fbeta, round("precision", 9) AS "precision", round(recall, 9) AS recall, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn'


def _round(df: DataFrame, *more: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("fbeta", "precision", "recall", *more)})


@query(f"WITH {_PAIR} SELECT id, tp_entidade, kind, round(o, 9) AS overlap, CAST(st AS BIGINT) AS start_true, CAST(et AS BIGINT) AS end_true, CAST(sp AS BIGINT) AS start_pred, CAST(ep AS BIGINT) AS end_pred FROM m")
def match_pairs(spark, sf_dir):
    m = ev.match(*_both(spark, sf_dir))
    return m.select("id", "tp_entidade", "kind", F.round("overlap", 9).alias("overlap"), *[F.col(f"{a}_entidade_{b}").alias(f"{a}_{b}") for b in ("true", "pred") for a in ("start", "end")])


@query(f"WITH {_REPORT} SELECT {_SHOW} FROM f WHERE overlap_threshold = 0.8 AND beta = 2.0")
def eval_report(spark, sf_dir):
    truth, found = _both(spark, sf_dir)
    return _round(ev.report(truth, ev.match(truth, found)))


@query(f"WITH {_REPORT} SELECT {_SHOW} FROM f")
def threshold_sweep(spark, sf_dir):
    return _round(ev.sweep(*_both(spark, sf_dir)))


@query(f"""WITH {_REPORT}, c AS (SELECT tp_entidade, overlap_threshold, beta, fbeta, lead(fbeta) OVER (PARTITION BY tp_entidade, beta ORDER BY overlap_threshold) AS older FROM f)
SELECT tp_entidade, beta, round(fbeta - older, 9) AS fbeta_diff, round(CASE WHEN older = 0 THEN 0.0 ELSE (fbeta - older) / older * 100 END, 6) AS fbeta_perc_change,
  CASE WHEN fbeta > older THEN 'Melhorou' WHEN fbeta < older THEN 'Piorou' ELSE 'Estável' END AS status_geral FROM c WHERE overlap_threshold = 0.7""")
def compare_reports(spark, sf_dir):
    truth, found = _both(spark, sf_dir)
    both = ev.report(truth, ev.match(truth, found), [0.7, 0.8], [1.0, 2.0])
    now, before = both.where("overlap_threshold = 0.7").withColumn("overlap_threshold", F.lit(0.0)), both.where("overlap_threshold = 0.8").withColumn("overlap_threshold", F.lit(0.0))
    return ev.compare_reports(now, before).select("tp_entidade", "beta", F.round("fbeta_diff", 9).alias("fbeta_diff"), F.round("fbeta_perc_change", 6).alias("fbeta_perc_change"), "status_geral")


_CASES = f"""{_PAIR},
k AS (SELECT id, tp_entidade, 'TP' AS case_type, o, st, et, sp, ep FROM m WHERE kind = 'pair' AND o >= 0.8
  UNION ALL SELECT id, tp_entidade, 'FN', o, st, et, NULL, NULL FROM m WHERE kind = 'true' OR kind = 'pair' AND o < 0.8
  UNION ALL SELECT id, tp_entidade, 'FP', o, NULL, NULL, sp, ep FROM m WHERE kind = 'pred' OR kind = 'pair' AND o < 0.8)
"""


@query(f"WITH {_CASES} SELECT id, tp_entidade, case_type, round(o, 9) AS overlap, CAST(st AS BIGINT) AS start_true, CAST(sp AS BIGINT) AS start_pred FROM k WHERE case_type IN ('FP', 'FN')")
def case_listing(spark, sf_dir):
    rows = ev.case_listing(ev.cases(ev.match(*_both(spark, sf_dir)), 0.8), kinds=["FP", "FN"])
    return rows.select("id", "tp_entidade", "case_type", F.round("overlap", 9).alias("overlap"), F.col("start_entidade_true").alias("start_true"), F.col("start_entidade_pred").alias("start_pred"))


@query(f"WITH {_CASES} SELECT tp_entidade, CAST(sum(CASE WHEN case_type = 'TP' THEN 1 ELSE 0 END) AS BIGINT) AS \"TP\", CAST(sum(CASE WHEN case_type = 'FP' THEN 1 ELSE 0 END) AS BIGINT) AS \"FP\", CAST(sum(CASE WHEN case_type = 'FN' THEN 1 ELSE 0 END) AS BIGINT) AS \"FN\" FROM k GROUP BY tp_entidade")
def error_counts(spark, sf_dir):
    return ev.error_counts(ev.cases(ev.match(*_both(spark, sf_dir)), 0.8))


@query(f"""WITH {_CASES} SELECT tp_entidade, case_type, CAST(r AS BIGINT) AS "rank", id, CAST(a AS BIGINT) AS start FROM (
  SELECT *, coalesce(st, sp) AS a, row_number() OVER (PARTITION BY tp_entidade, case_type ORDER BY id, coalesce(st, sp), coalesce(et, ep)) AS r FROM k) x WHERE r <= 10""")
def error_examples(spark, sf_dir):
    rows = ev.error_examples(ev.cases(ev.match(*_both(spark, sf_dir)), 0.8))
    return rows.select("tp_entidade", "case_type", "rank", "id", F.coalesce("start_entidade_true", "start_entidade_pred").alias("start"))


@query(f"""WITH {_CASES}, h AS (SELECT * FROM (VALUES (0, -1.0, 0.1), (1, 0.1, 0.3), (2, 0.3, 0.5), (3, 0.5, 0.7), (4, 0.7, 0.8), (5, 0.8, 0.9), (6, 0.9, 1.0)) v(bin, a, b))
SELECT CAST(bin AS BIGINT) AS bin, count(o) AS n FROM h LEFT JOIN k ON o > a AND o <= b GROUP BY bin""")
def overlap_histogram(spark, sf_dir):
    return ev.overlap_histogram(ev.cases(ev.match(*_both(spark, sf_dir)), 0.8)).select("bin", "n")


@query("SELECT l_orderkey AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'CPF' ELSE 'PIS' END AS tp_entidade, CAST(l_linenumber AS BIGINT) AS start_entidade FROM {lineitem} WHERE l_linenumber % 4 <> 1")
def label_mapping(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, "FISTEL").otherwise("PASEP").alias("tp_entidade"), F.col("l_linenumber").alias("start_entidade"), F.col("l_linenumber").alias("end_entidade"), (F.col("l_linenumber") % 4).alias("remove"))
    return ev.prepare(rows, "ground truth", ALIASES).select("id", "tp_entidade", "start_entidade")


# ---- training data --------------------------------------------------------------------------------------------------
def _annotated(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = _rows(spark, sf_dir, fx.PARAGRAPHS)
    one = F.array(F.struct(F.lit(9).alias("start"), (F.lit(9) + F.col("n")).alias("end"), F.lit("PER1").alias("label")), F.struct((F.lit(27) + F.col("n")).alias("start"), (F.lit(27) + 2 * F.col("n")).alias("end"), F.lit("PER2").alias("label")))
    return p.select("id", "text"), p.select("id", F.explode(one).alias("e")).select("id", "e.*")


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", "par_idx", "text", F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["start"], e["end"], e["label"])), ",").alias("entities"))


_SIZED = f"SELECT id, n, substr(text, 10, n) AS name, text FROM ({fx.PARAGRAPHS}) q"
_AT = lambda a, b, label: f"CAST({a} AS STRING) || ':' || CAST({b} AS STRING) || ':{label}'"
_WINDOWS = {
    "w0": f"SELECT id, CAST(0 AS BIGINT) AS par_idx, 'Primeiro ' || name AS text, {_AT('9', '9 + n', 'PER1')} AS entities FROM ({_SIZED}) s UNION ALL SELECT id, 2, 'Terceiro ' || name, {_AT('9', '9 + n', 'PER2')} FROM ({_SIZED}) s",
    "w1": f"""SELECT id, CAST(0 AS BIGINT) AS par_idx, 'Primeiro ' || name || chr(10) || chr(10) || 'Segundo' AS text, {_AT('9', '9 + n', 'PER1')} AS entities FROM ({_SIZED}) s
UNION ALL SELECT id, 1, 'Primeiro ' || name || chr(10) || chr(10) || 'Segundo' || chr(10) || chr(10) || 'Terceiro ' || name, {_AT('9', '9 + n', 'PER1')} || ',' || {_AT('29 + n', '29 + 2 * n', 'PER2')} FROM ({_SIZED}) s
UNION ALL SELECT id, 2, 'Segundo' || chr(10) || chr(10) || 'Terceiro ' || name, {_AT('18', '18 + n', 'PER2')} FROM ({_SIZED}) s""",
    "full": f"SELECT id, CAST(0 AS BIGINT) AS par_idx, text, {_AT('9', '9 + n', 'PER1')} || ',' || {_AT('27 + n', '27 + 2 * n', 'PER2')} AS entities FROM ({_SIZED}) s",
    "w00": f"SELECT id, CAST(0 AS BIGINT) AS par_idx, name AS text, {_AT('0', 'n', 'PER1')} AS entities FROM ({_SIZED}) s UNION ALL SELECT id, 0, name, {_AT('0', 'n', 'PER2')} FROM ({_SIZED}) s, (VALUES (1), (2)) v(x)",
}
_WINDOWS["w2"] = " UNION ALL ".join(f"SELECT id, {k} AS par_idx, 'Primeiro ' || name || chr(10) || chr(10) || 'Segundo' || chr(10) || chr(10) || 'Terceiro ' || name AS text, {_AT('9', '9 + n', 'PER1')} || ',' || {_AT('29 + n', '29 + 2 * n', 'PER2')} AS entities FROM ({_SIZED}) s" for k in ("CAST(0 AS BIGINT)", "1", "2"))
for _name, _sql in _WINDOWS.items():
    query(_sql, f"windows_{_name}")(lambda spark, sf_dir, w=_name: _shown(tr.curriculum(*_annotated(spark, sf_dir), [w], {"PER2": 2})))


@query("SELECT l_orderkey AS id, 'u' AS text, count(DISTINCT l_linenumber) AS n, CAST(max(l_linenumber) AS BIGINT) AS last FROM {lineitem} WHERE l_linenumber % 5 <> 4 AND l_orderkey NOT IN (SELECT l_orderkey FROM {lineitem} WHERE l_quantity > 45 AND l_linenumber = 1) GROUP BY 1")
def curriculum_filter(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    e = rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"), F.when(F.col("l_linenumber") % 5 == 4, "X_remover").otherwise("RG").alias("label"), ((F.col("l_quantity") > 45) & (F.col("l_linenumber") == 1)).cast("int").alias("TEM_ERRO"))
    texts = rows.select(F.col("l_orderkey").alias("id"), F.lit("t").alias("text")).unionAll(rows.select(F.col("l_orderkey").alias("id"), F.lit("u").alias("text")))
    t, e = tr.curriculum_filter(texts, e)
    return e.join(t, "id").groupBy("id", "text").agg(F.count("*").alias("n"), F.max("start").alias("last"))


#: Entities of an order: lines as long as their quantity, so that some overlap.
_SPANS = "SELECT l_orderkey AS id, CAST(l_linenumber * 20 AS INT) AS start, CAST(l_linenumber * 20 + l_quantity AS INT) AS e, 'L' || CAST(l_linenumber % 3 AS STRING) AS label FROM {lineitem}"


def _examples(spark, sf_dir) -> DataFrame:
    e = _rows(spark, sf_dir, _SPANS).select("id", "start", F.col("e").alias("end"), "label")
    return e.groupBy("id").agg(F.array_sort(F.collect_list(tr.entity(F.col("start"), F.col("end"), F.col("label")))).alias("entities")).withColumn("text", F.repeat(F.lit("abcde fghi "), 40))


@query(f"SELECT a.id, count(*) AS n_pairs FROM (SELECT DISTINCT * FROM ({_SPANS}) x) a JOIN (SELECT DISTINCT * FROM ({_SPANS}) x) b ON a.id = b.id AND (a.start, a.e, a.label) < (b.start, b.e, b.label) AND a.start < b.e AND b.start < a.e GROUP BY a.id")
def conflict_pairs(spark, sf_dir):
    return _examples(spark, sf_dir).select("id", F.size(tr.overlapping(F.col("entities"))).cast("long").alias("n_pairs")).where("n_pairs > 0")


@query(f"SELECT id, count(*) AS n FROM (SELECT DISTINCT * FROM ({_SPANS}) x) y WHERE id NOT IN (SELECT a.id FROM ({_SPANS}) a JOIN ({_SPANS}) b ON a.id = b.id AND (a.start, a.e, a.label) <> (b.start, b.e, b.label) AND a.start < b.e AND b.start < a.e) GROUP BY id")
def drop_conflicting(spark, sf_dir):
    return _examples(spark, sf_dir).select("id", F.size(tr.resolve_conflicts(F.col("entities"))).cast("long").alias("n")).where("n > 0")


@query(f"SELECT id, count(*) AS n_outside FROM ({_SPANS}) x WHERE e > 120 GROUP BY id")
def validate_offsets(spark, sf_dir):
    rows = _examples(spark, sf_dir).withColumn("text", F.substring("text", 1, 120))
    bad = F.size(F.filter("entities", lambda e: (e["start"] < 0) | (e["end"] > F.length("text")) | (e["start"] >= e["end"]))).cast("long")
    return rows.where(F.array_contains(tr.diagnose(F.col("text"), F.col("entities")), "offsets")).select("id", bad.alias("n_outside"))


@query(f"SELECT reason, count(*) AS n FROM (SELECT DISTINCT id, CASE WHEN id IN (SELECT a.id FROM ({_SPANS}) a JOIN ({_SPANS}) b ON a.id = b.id AND (a.start, a.e, a.label) <> (b.start, b.e, b.label) AND a.start < b.e AND b.start < a.e) THEN 'conflict' ELSE 'kept' END AS reason FROM ({_SPANS}) x) y GROUP BY reason")
def clean_batch(spark, sf_dir):
    return tr.clean_counts(tr.clean(_examples(spark, sf_dir).withColumn("text", F.repeat(F.lit("x"), 400)), align="none"))


@query(f"SELECT id, {', '.join(f'''CAST(sum(CASE WHEN label = 'L{k}' THEN 1 ELSE 0 END) AS BIGINT) AS "L{k}"''' for k in range(3))} FROM ({_SPANS}) x GROUP BY id")
def label_presence(spark, sf_dir):
    return tr.label_presence(_rows(spark, sf_dir, _SPANS).select("id", "label"), ["L0", "L1", "L2"])


_KEY = "((id * 48271 + 43) % 2147483647 * 69621 + 43) % 2147483647"


@query(f"SELECT id, CAST(ntile(5) OVER (ORDER BY {_KEY}, id) - 1 AS BIGINT) AS fold FROM (SELECT DISTINCT l_orderkey AS id FROM {{lineitem}}) x")
def folds(spark, sf_dir):
    return tr.folds(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")), 5)


@query(f"SELECT id, CASE WHEN ntile(3) OVER (ORDER BY {_KEY}, id) = 1 THEN 'test' ELSE 'train' END AS part FROM (SELECT DISTINCT l_orderkey AS id FROM {{lineitem}}) x")
def holdout_split(spark, sf_dir):
    return tr.holdout(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")), 0.3, stratified=False)


@query(f"""WITH e AS (SELECT DISTINCT id, label FROM ({_SPANS}) x), c AS (SELECT label, count(*) AS n FROM e GROUP BY label),
r AS (SELECT id, label FROM (SELECT e.*, row_number() OVER (PARTITION BY id ORDER BY n, e.label) AS k FROM e JOIN c ON e.label = c.label) y WHERE k = 1)
SELECT id, label, CAST((row_number() OVER (ORDER BY label, {_KEY}, id) - 1) % 5 AS BIGINT) AS fold FROM r""")
def stratified_folds(spark, sf_dir):
    return tr.stratified_folds(_rows(spark, sf_dir, _SPANS).select("id", "label"), 5)


@query(f"""SELECT CAST(fold AS BIGINT) AS fold, CASE WHEN f = fold THEN 'validation' ELSE 'train' END AS part, count(*) AS n
FROM (SELECT CAST(ntile(5) OVER (ORDER BY {_KEY}, id) - 1 AS BIGINT) AS f, id FROM (SELECT DISTINCT l_orderkey AS id FROM {{lineitem}}) x) y, (VALUES (0), (1), (2), (3), (4)) v(fold) GROUP BY ALL""")
def fold_pairs(spark, sf_dir):
    ids = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    f = tr.folds(ids, 5)
    pairs = [(k, *tr.fold_pair(ids, f, k)) for k in range(5)]
    count = lambda df, k, name: df.agg(F.lit(k).alias("fold"), F.lit(name).alias("part"), F.count_distinct("id").alias("n"))
    return reduce(DataFrame.unionAll, [count(df, k, name) for k, *both in pairs for df, name in zip(both, ("train", "validation"))])


@query("""SELECT tp_entidade, round(avg(x), 9) AS fbeta_mean, round(stddev_samp(x), 9) AS fbeta_std, CAST(arg_max(fold, x * 1000000 - fold) AS BIGINT) AS best_fold
FROM (SELECT l_returnflag AS tp_entidade, l_linenumber % 5 AS fold, round(avg(l_discount), 4) AS x FROM {lineitem} GROUP BY 1, 2) y GROUP BY tp_entidade""")
def fold_aggregation(spark, sf_dir):
    x = F.round(F.avg("l_discount"), 4)
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("tp_entidade"), (F.col("l_linenumber") % 5).alias("fold")).agg(x.alias("fbeta"), x.alias("precision"), x.alias("recall"))
    return tr.aggregate_folds(rows).select("tp_entidade", F.round("fbeta_mean", 9).alias("fbeta_mean"), F.round("fbeta_std", 9).alias("fbeta_std"), "best_fold")


# ---- the tagger -----------------------------------------------------------------------------------------------------
def _tagged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = _rows(spark, sf_dir, f"SELECT id, 'Cliente ' || name || ', CPF ' || cpf || ' em dia' AS text, length(name) + 14 AS at FROM ({fx.CPF}) q")
    return rows.select("id", "text"), rows.select("id", F.col("at").alias("start"), (F.col("at") + 14).alias("end"), F.lit("CPF").alias("label"))


@query(f"""SELECT CAST(fold AS BIGINT) AS fold, tp_entidade, count(*) AS qtd_ids, CAST(1 AS DOUBLE) AS fbeta
FROM (SELECT CAST(ntile(2) OVER (ORDER BY {_KEY}, id) - 1 AS BIGINT) AS fold, id FROM ({fx.CPF}) q) x, (VALUES ('CPF'), ('TODAS')) v(tp_entidade) GROUP BY ALL""")
def cross_validation(spark, sf_dir):
    """A tagger for each fold, held against the fold's own documents."""
    reports = tg.cross_validate(*_tagged(spark, sf_dir), n=2, stratified=False, path=scratch(spark, "folds"), width=1 << 10, rounds=6)
    return reports.select("fold", "tp_entidade", "qtd_ids", F.round("fbeta", 6).alias("fbeta"))


@query(f"SELECT id, 'Cliente ' || name || ', CPF <|CPF|> em dia' AS masked FROM ({fx.CPF}) q")
def tagger_roundtrip(spark, sf_dir):
    """A tagger that was saved and loaded, as the engine's model; the numbers need no check digits here."""
    texts, entities = _tagged(spark, sf_dir)
    path = tg.train(tg.prepare(tr.join_entities(texts, entities)), width=1 << 10, rounds=6).save(scratch(spark, "tagger"))
    rows = tg.Tagger.load(spark, path).annotate(texts)
    return Engine(Catalog().with_labels(["CPF"]), model_spans="model_spans", use_cpf_validator=False).anonymize(rows).select("id", "masked")


# ---- files and streams ----------------------------------------------------------------------------------------------
@query(f"SELECT text, {_AT('9', '9 + n', 'PER1')} || ',' || {_AT('27 + n', '27 + 2 * n', 'PER2')} AS entities FROM ({_SIZED}) s")
def annotation_roundtrip(spark, sf_dir):
    path = files.write_annotations(tr.join_entities(*_annotated(spark, sf_dir)), scratch(spark, "annotations") + ".jsonl")
    back = files.read_annotations(spark, path)
    return back.select("text", F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["start"], e["end"], e["label"])), ",").alias("entities"))


@query(f"SELECT text, CAST(count(*) * 2 AS BIGINT) AS n FROM ({_SIZED}) s GROUP BY text")
def row_per_entity(spark, sf_dir):
    t, e = _annotated(spark, sf_dir)
    return tr.from_rows(t.join(e, "id").drop("id")).select("text", F.size("entities").alias("n"))


@query(f"SELECT id, 'Cliente ' || name || ', CPF ' || CASE WHEN good THEN '<|CPF|>' ELSE cpf END AS masked FROM ({fx.CPF}) q")
def streaming_mask(spark, sf_dir):
    from tarja.streaming.detect import mask_stream, text_stream

    root = scratch(spark, "stream")
    _rows(spark, sf_dir, f"SELECT id, 'Cliente ' || name || ', CPF ' || cpf AS text FROM ({fx.CPF}) q").write.parquet(f"{root}/in")
    mask_stream(text_stream(spark, f"{root}/in"), _only("CPF"), f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("id", "masked")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["flagship", "formatted", "oracle_sql", "queries"]
