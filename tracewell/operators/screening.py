"""Name screening against a watchlist and adverse media."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import INITIAL_SCORE, PHONETIC_FLOOR, THRESHOLD, metaphone_udf, normalise_udf, signatures_udf, similarity_udf, token_score_udf
from .rules import HIGH_RISK, first_listed

def _words(names: DataFrame, name: str, word: str) -> DataFrame:
    return names.select(name, F.explode(F.array_distinct(F.split(normalise_udf(name), " "))).alias(word)).filter(f"{word} <> ''")


def candidates(one: DataFrame, two: DataFrame, least: float) -> DataFrame:
    """Distinct pairs of words ``x`` and ``y`` of two sides that may score at least ``least``; none that does is missing.

    Words score by being equal, by one being the other's initial, by sounding alike, or by Jaro-Winkler similarity:
    each is an equality join, the last on keys that such words must share (``names.signatures``)."""
    left, right = one.select("x").distinct(), two.select("y").distinct()
    ways = [left.join(right, F.col("x") == F.col("y"))]
    if least <= INITIAL_SCORE:
        for short, long in (("x", "y"), ("y", "x")):
            ways.append(left.join(right, F.substring("x", 1, 1) == F.substring("y", 1, 1)).filter((F.length(short) == 1) & (F.length(long) > 1)))
    if least <= PHONETIC_FLOOR:
        a, b = left.withColumn("code", metaphone_udf("x")), right.withColumn("code", metaphone_udf("y"))
        ways.append(a.filter("code <> ''").join(b, "code").select("x", "y"))
    a, b = left.filter("length(x) > 1"), right.filter("length(y) > 1")
    a, b = a.withColumn("key", F.explode(signatures_udf(least, False)("x"))), b.withColumn("key", F.explode(signatures_udf(least, True)("y")))
    ways.append(a.join(b, "key").select("x", "y"))
    return reduce(DataFrame.unionByName, ways).distinct()


def _alike(one: DataFrame, two: DataFrame, least: float) -> DataFrame:
    """Distinct words ``x`` and ``y`` of two sides whose score is at least ``least``."""
    return candidates(one, two, least).filter(token_score_udf("x", "y") >= least)


def scored_pairs(names: DataFrame, others: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``name``, ``other``, ``score`` of the distinct names of both at or over the threshold.

    A score is a mean of words' scores, so some words of such names score no less (but for the
    rounding of the mean): names are compared that share such a pair of words, and no pair is lost."""
    left = _words(names.select("name").filter("name is not null").distinct(), "name", "x")
    right = _words(others.select(F.col("name").alias("other")).filter("other is not null").distinct(), "other", "y")
    met = left.join(_alike(left, right, threshold - 1e-4), "x").join(right, "y").select("name", "other").distinct()
    return met.withColumn("score", similarity_udf("name", "other")).filter(F.col("score") >= threshold)


def screen_customers(customers: DataFrame, watchlist: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``customer_id``, ``matched_name``, ``list_type``, ``score`` over customers' ``full_name``."""
    pairs = scored_pairs(customers.select(F.col("full_name").alias("name")), watchlist, threshold)
    hit = customers.join(pairs, customers["full_name"] == pairs["name"]).drop("name")
    entries = watchlist.select(F.col("name").alias("other"), F.col("type").alias("list_type"), "position")
    return hit.join(entries, "other").select("customer_id", F.col("other").alias("matched_name"), "list_type", "score", "position")


def screen_media(articles: DataFrame, customers: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``article_id``, ``customer_id``, ``category``, ``score`` of adverse articles."""
    adverse = articles.filter("category <> 'none'")
    pairs = scored_pairs(adverse.select(F.col("mentioned_name").alias("name")), customers.select(F.col("full_name").alias("name")), threshold)
    hit = adverse.join(pairs, adverse["mentioned_name"] == pairs["name"])
    return hit.join(customers, hit["other"] == customers["full_name"]).select("article_id", "customer_id", "category", "headline", "score")


def screen_names(names: DataFrame, watchlist: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``name``, ``matches``, ``best``, ``geography`` and the decision, ``REVIEW`` or ``NO_HIT``, for each of distinct names."""
    geo = first_listed(F.col("name"), HIGH_RISK)
    hits = scored_pairs(names, watchlist, threshold).groupBy("name").agg(F.count("*").alias("matches"), F.max("score").alias("best"))
    out = names.select("name").join(hits, "name", "left").withColumn("geography", geo)
    review = F.col("matches").isNotNull() | F.col("geography").isNotNull()
    return out.withColumn("decision", F.when(review, "REVIEW").otherwise("NO_HIT"))


def screen_name(spark, name: str, watchlist: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The decision on one name."""
    return screen_names(spark.createDataFrame([(name,)], "name string"), watchlist, threshold)
