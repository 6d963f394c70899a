"""Vector products as column expressions, and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """In double precision, in order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length one; zero stays zero.  Stored vectors are normalised once, at ingest."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def constant(v: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def max_sim(query: Column, document: Column) -> Column:
    """For every query vector its best product with a document vector, summed."""
    return F.aggregate(F.transform(query, lambda q: F.array_max(F.transform(document, lambda d: dot(q, d)))), F.lit(0.0), lambda s, x: s + x)


def normalised_threshold(threshold: float | None, late: bool) -> float | None:
    """Late-interaction scores take thresholds as they are; for dense ones those over 1 are shares of 37."""
    if threshold is None:
        return None
    value = max(0.0, threshold)
    return value if late or value <= 1 else min(value, 37.0) / 37.0


def normalised_thresholds(threshold: Column, late: bool) -> Column:
    """The same for a column."""
    value = F.greatest(F.lit(0.0), threshold.cast("double"))
    return F.when(threshold.isNotNull(), value if late else F.when(value <= 1, value).otherwise(F.least(value, F.lit(37.0)) / 37.0))


def contrasted(df: DataFrame, power: float = 2.5, score: str = "score") -> DataFrame:
    """Stretches scores within their range: lowest, highest and order stay.  df is a result page, which is small and in one partition, so it is found once."""
    page = Window.partitionBy(F.lit(0))
    df = df.withColumns({"_low": F.min(score).over(page), "_high": F.max(score).over(page)})
    low, width = F.col("_low"), F.col("_high") - F.col("_low")
    new = F.when(width > 0, low + F.pow((F.col(score) - low) / width, F.lit(power)) * width).otherwise(F.col(score))
    return df.withColumn(score, new).drop("_low", "_high")


def recency(score: Column, at: Column, now: Column, days: float = 1, midpoint: float = 0.5, default: str = "1970-01-01 00:00:00") -> Column:
    """score plus midpoint ** (distance in time / scale)."""
    distance = F.abs(F.unix_timestamp(now) - F.unix_timestamp(F.coalesce(at, F.lit(default).cast("timestamp"))))
    return score + F.pow(F.lit(float(midpoint)), distance / F.lit(days * 86400.0))
