"""Detection on streams: the batch plan is stateless, so a stream takes the same columns. Counts by time use a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarja.plans.engine import Engine


def text_stream(spark: SparkSession, path: str, schema: str = "id long, text string", per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def mask_stream(texts: DataFrame, engine: Engine, out: str, checkpoint: str) -> StreamingQuery:
    """Masks all there is, file by file, and stops; append mode, exactly once through the checkpoint."""
    masked = engine.anonymize(texts).select("id", "masked", F.size("spans").alias("n_spans"))
    return masked.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def label_counts(spans: DataFrame, time: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Spans per label and time window; rows later than `late` are dropped and their state freed."""
    one = spans.withWatermark(time, late).select(time, F.explode("spans").alias("s"))
    return one.groupBy(F.window(time, width), F.col("s.label").alias("label")).agg(F.count("*").alias("n"))
