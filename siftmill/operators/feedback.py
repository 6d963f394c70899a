"""Relevance feedback: statistics, exports and contrastive pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problems(rows: DataFrame) -> Column:
    """Why a row is rejected; null if it isn't."""
    c = F.col
    return (
        F.when(~F.coalesce(c("user_rating").isin(-1, 0, 1), F.lit(False)), "user_rating")
        .when(c("ranking_score").isNotNull() & ~c("ranking_score").between(1, 5), "ranking_score")
        .when(~F.coalesce(c("content_type"), F.lit("faq")).isin("faq", "document"), "content_type")
        .when(F.trim(F.coalesce(c("query"), F.lit(""))) == "", "query")
    )


def listed(rows: DataFrame, rating: int | None = None, session: str | None = None, content_type: str | None = None, limit: int = 100) -> DataFrame:
    kept = rows if rating is None else rows.where(F.col("user_rating") == rating)
    kept = kept if session is None else kept.where(F.col("rating_session_id") == session)
    kept = kept if content_type is None else kept.where(F.coalesce("content_type", F.lit("faq")) == content_type)
    return kept.orderBy("id").limit(limit)


def statistics(rows: DataFrame) -> DataFrame:
    """Counts by rating; with ten ratings or more and a negative one, the lowest score of a negative."""
    r = F.col("user_rating")
    total, negative = F.count("*"), F.count_if(r == -1)
    lowest = F.min(F.when(r == -1, F.col("search_score")))
    return rows.agg(total.alias("total"), F.count_if(r == 1).alias("positive"), F.count_if(r == 0).alias("neutral"), negative.alias("negative"), F.when((total >= 10) & (negative > 0), lowest).alias("recommended_min_score"))


def exported(rows: DataFrame, session: str | None = None, include_neutral: bool = False) -> DataFrame:
    """Rows for training, with the text that was rated."""
    kept = rows if session is None else rows.where(F.col("rating_session_id") == session)
    return kept if include_neutral else kept.where("user_rating <> 0")


def _side(rows: DataFrame, name: str, *more: str) -> DataFrame:
    return rows.select(F.col("query").alias("query"), "bucket", F.col("text").alias(name), F.col("search_score").alias(f"{name}_score"), F.col("content_type").alias(f"{name}_type"), *more)


def bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.coalesce(F.nullif("rating_session_id", F.lit("")), F.lit("legacy")))


def binary_pairs(rows: DataFrame) -> DataFrame:
    """Within a query and session: every liked text with every disliked one, of rows without stars.

    Pairs are the result itself, so their number is the operator's, not an intermediate step's; a
    large bucket is an equi-join partition that adaptive execution splits.
    """
    own = bucketed(rows).where("ranking_score is null")
    good, bad = _side(own.where("user_rating = 1"), "positive"), _side(own.where("user_rating = -1"), "negative")
    return good.join(bad, ["query", "bucket"]).withColumns({"pair_source": F.lit("binary"), "score_gap": F.lit(None).cast("int")})


def ranked_pairs(rows: DataFrame) -> DataFrame:
    """Within a query and session: texts of neighbouring stars; five pairs with three where there is no four."""
    own = bucketed(rows).where("ranking_score is not null")
    fours = own.groupBy("query", "bucket").agg(F.max((F.col("ranking_score") == 4).cast("int")).alias("has_four"))
    high = _side(own, "positive", F.col("ranking_score").alias("high")).join(fours, ["query", "bucket"])
    high = high.withColumn("star", F.when((F.col("high") == 5) & (F.col("has_four") == 0), 3).otherwise(F.col("high") - 1))
    low = _side(own, "negative", F.col("ranking_score").alias("star"))
    pairs = high.join(low, ["query", "bucket", "star"])
    return pairs.withColumns({"pair_source": F.lit("ranked"), "score_gap": (F.col("high") - F.col("star")).cast("int")}).drop("high", "star", "has_four")


def pairs(rows: DataFrame) -> DataFrame:
    return binary_pairs(rows).unionByName(ranked_pairs(rows))


def summary(rows: DataFrame, include_neutral: bool = False) -> DataFrame:
    """Counts of an export; pairs are counted from star counts, not made."""
    kept = bucketed(exported(rows, include_neutral=include_neutral))
    star = lambda k: F.count_if(F.col("ranking_score") == k)
    plain = F.col("ranking_score").isNull()
    own = kept.groupBy("query", "bucket").agg(*(star(k).alias(f"s{k}") for k in range(1, 6)), F.count_if(plain & (F.col("user_rating") == 1)).alias("good"), F.count_if(plain & (F.col("user_rating") == -1)).alias("bad"))
    ranked = F.expr("s5 * case when s4 > 0 then s4 else s3 end + s4 * s3 + s3 * s2 + s2 * s1")
    counts = own.agg(F.coalesce(F.sum(F.expr("good * bad")), F.lit(0)).alias("binary_pairs"), F.coalesce(F.sum(ranked), F.lit(0)).alias("ranked_pairs"))
    totals = rows.agg(F.count("*").alias("total"), F.count_if(F.col("user_rating") == 1).alias("positive"), F.count_if(F.col("user_rating") == -1).alias("negative"))
    return totals.crossJoin(F.broadcast(counts)).withColumn("pairs", F.expr("binary_pairs + ranked_pairs"))


def kv_rows(rows: DataFrame) -> DataFrame:
    """Feedback on key/value entries in the form of the others."""
    from ..functions.text import kv_text

    return rows.withColumns({"text": kv_text(F.col("kv_key"), F.col("kv_value")), "content_type": F.lit("kv")})


def filled_hints(options: DataFrame, hints: DataFrame) -> DataFrame:
    """options (option_id, pos) with a model's hints (option_id, n, stars, rank, reason as strings): the last hint of an option, bounded; three stars and the option's place where there is none."""
    last = hints.groupBy("option_id").agg(F.max_by(F.struct("stars", "rank", "reason"), "n").alias("h"))
    number = lambda c: F.try_to_number(c, F.lit("S999999")).cast("int")
    joined = options.join(last, "option_id", "left")
    has = F.col("h").isNotNull()
    stars = F.when(has, F.least(F.greatest(F.coalesce(number(F.col("h.stars")), F.lit(3)), F.lit(1)), F.lit(5))).otherwise(3)
    rank = F.when(has, F.greatest(F.coalesce(number(F.col("h.rank")), F.lit(1)), F.lit(1))).otherwise(F.col("pos"))
    reason = F.left(F.coalesce(F.nullif(F.trim("h.reason"), F.lit("")), F.lit("No reason provided")), F.lit(400))
    return joined.select("option_id", stars.cast("int").alias("stars"), rank.cast("int").alias("rank"), F.when(has, reason).otherwise(F.lit("No reason provided")).alias("reason"))

