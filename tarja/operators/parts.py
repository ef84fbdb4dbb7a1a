"""How many partitions a step gets: by the rows or characters it holds, so that a task's share stays the same at any size.

Adaptive execution joins partitions by their compressed bytes, which say little of what sorts, features or patterns take; a
number that is given stays. Counting is one cheap action over the frames, which are read once more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS, CHARS = 1 << 18, 1 << 20


def by_rows(*frames: DataFrame, each: int | None = None) -> int:
    """Partitions for the rows of all frames together, no fewer than spark.sql.shuffle.partitions, as joins would else deal
    them anew."""
    return max(int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(df.count() for df in frames) // (each or ROWS)))


def by_chars(df: DataFrame, text: str, each: int | None = None) -> int:
    """Partitions for the characters (and ends) of a column of texts, no fewer than there are cores."""
    total = df.agg(F.sum(F.coalesce(F.length(f"`{text}`"), F.lit(0)).cast("long") + 1)).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-total // (each or CHARS)))
