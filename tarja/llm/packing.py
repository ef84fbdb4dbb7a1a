"""Operator 2, packing: length buckets that minimise padding, token-budget batches inside each bucket.

Documents longer than `max_len` tokens are cut into pieces of `max_len` (no token is lost), so the global histogram of piece
lengths has at most `max_len` bins, whatever the corpus. Dynamic programming over it finds the `buckets` upper bounds with
the least total padding. Inside a bucket, pieces stand in ascending (range of doc_id, doc_id, piece) order and
`budget // bound` of them form a batch, which may span ranges; ranks need no single task: they are ranks inside a range of
ids plus the counts of the ranges before. A document without words has one piece of length 0. Rows with equal ids are
documents of their own; a null doc_id sorts first; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarja.llm.common import WORD, documents, null_id, partitions, table, written

MAX_LEN, BUCKETS, BUDGET = 2048, 16, 65536


def bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The at most `buckets` bucket bounds with the least padding: cost[k][j], the first j lengths in k buckets, in ascending
    lengths; a bucket pads all of its pieces to its longest."""
    order = np.argsort(lengths)
    x, c = lengths[order].astype(np.float64), counts[order].astype(np.float64)
    n, k = len(x), min(buckets, len(x))
    if not n:
        return []
    number, total = np.r_[0, np.cumsum(c)], np.r_[0, np.cumsum(c * x)]
    waste = x[None, :] * (number[None, 1:] - number[:n, None]) - (total[None, 1:] - total[:n, None])  # [i, j]: lengths i..j
    waste[np.tril_indices(n, -1)] = np.inf
    best, back = waste[0], []
    for _ in range(1, k):
        cost = waste.copy()
        cost[0] = np.inf
        cost[1:] += best[:-1, None]
        pick = cost.argmin(0)
        new = cost[pick, np.arange(n)]
        worse = new >= best
        back.append(np.where(worse, -1, pick))
        best = np.where(worse, best, new)
    out, j = [], n - 1
    for step in reversed(back):
        i = step[j]
        if i < 0:
            continue
        out.append(int(x[j]))
        j = i - 1
    return sorted({*out, int(x[j])})


def pack(docs: DataFrame, n_tokens=None, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, piece, n_tokens, bucket_len, batch (within the bucket), slot (within the batch), one row per piece.

    docs: (doc_id, text); n_tokens: a column of token counts, by default the words."""
    spark = docs.sparkSession
    n = F.coalesce(n_tokens if n_tokens is not None else F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    size = docs.select("doc_id", n.alias("total"))
    pieces = size.select("doc_id", "total", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("total") / max_len).cast("int") - 1))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(max_len), F.col("total") - F.col("piece").cast("long") * max_len).alias("n_tokens"))
    ranged = pieces.repartitionByRange(partitions(spark), "doc_id").withColumn("range", F.spark_partition_id())
    kept = written(ranged, "pieces")  # ranges stay as they are
    histogram = kept.groupBy("n_tokens").count().collect()  # max_len + 1 rows at most
    tops = bounds(np.array([r[0] for r in histogram], np.int64), np.array([r[1] for r in histogram], np.int64), buckets)
    if not tops:
        return kept.select("doc_id", "piece", "n_tokens", F.lit(0).cast("long").alias("bucket_len"), F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("slot"))
    bucket = F.array_min(F.filter(F.array(*[F.lit(t).cast("long") for t in tops]), lambda t: t >= F.col("n_tokens")))
    dealt = kept.withColumn("bucket_len", bucket)
    before = dealt.groupBy("bucket_len", "range").count()  # buckets x ranges rows
    before = before.select("bucket_len", "range", (F.sum("count").over(Window.partitionBy("bucket_len").orderBy("range")) - F.col("count")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range", "bucket_len").orderBy("doc_id", "piece", "n_tokens"))
    ranked = dealt.withColumn("inside", inside).join(before, ["bucket_len", "range"])
    rank = F.col("before") + F.col("inside") - 1
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket_len")))).cast("long")
    return ranked.select("doc_id", "piece", "n_tokens", "bucket_len", F.floor(rank / per).cast("long").alias("batch"), (rank % per).cast("long").alias("slot"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pack(documents(table(spark, sf_dir, "documents")))
    return rows.select(null_id(), "piece", "n_tokens", "bucket_len", "batch", "slot")
