from pyspark.sql import functions as F

import corpus_pipeline as cp
from tarja.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_act(spark):
    docs = table(spark, SF, "documents").withColumns({"own": F.col("n_chars"), "row": F.col("n_chars")})
    sizes = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        docs = cp.written(stage(spark, docs, SF), name)
        assert docs.columns == cp.COLUMNS
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_rows_of_null_and_repeated_ids_are_documents_of_their_own(spark):
    words = lambda a: " ".join(f"{chr(97 + a)}{a * 1000 + i}" for i in range(60))
    a, b, c, d, e = map(words, range(5))
    rows = [(None, a), (None, b), (None, None), (5, a), (9, b), (7, c), (7, d), (7, c), (8, e)]
    docs = spark.createDataFrame([(i, t, "x", "y", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    got = sorted(((r["doc_id"], r["text"]) for r in cp.drop_near_copies(spark, docs, SF).collect()), key=order)
    assert got == [(None, None), (None, a), (None, b), (7, c), (7, d), (8, e)]
    cut = cp.cut_repeats(spark, docs, SF)
    got = sorted(((r["doc_id"], r["text"]) for r in cut.collect()), key=order)
    assert cut.columns == cp.COLUMNS
    assert got == [(None, None), (None, a), (None, b), (5, ""), (7, ""), (7, c), (7, d), (8, e), (9, "")]
