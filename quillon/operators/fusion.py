"""Weighted reciprocal-rank fusion of ranked hit lists, and the signals read off it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import constants as K


def weight(strategy: Column) -> Column:
    w = F.lit(1.0)
    for name, value in K.WEIGHTS.items():
        w = F.when(strategy == name, value).otherwise(w)
    return w


def fuse(hits: DataFrame, k: int = 24) -> DataFrame:
    """``hits`` (query_id, strategy, id, score, rank) to (query_id, id, fused, agreement, best_score, best_strategy, mask, strategies, place).

    A strategy counts once for a passage, by its best rank. Of equal best scores the strategy first in weight order wins.
    """
    names = list(K.WEIGHTS)
    first = hits.groupBy("query_id", "strategy", "id").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    place = F.lit(len(names))
    for i, name in enumerate(names):
        place = F.when(F.col("strategy") == name, i).otherwise(place)
    x = first.withColumn("at", place).withColumn("part", weight(F.col("strategy")) / (K.RANK_CONSTANT + F.col("rank")))
    out = x.groupBy("query_id", "id").agg(
        F.round(F.sum("part"), 6).alias("fused"),
        F.count("*").alias("agreement"),
        F.max("score").alias("best_score"),
        F.max_by("strategy", F.struct("score", -F.col("at"))).alias("best_strategy"),
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at"))).alias("mask"),
        F.array_join(F.array_sort(F.collect_list("strategy")), ",").alias("strategies"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("fused"), "id")
    return out.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


def margin(fused: DataFrame) -> DataFrame:
    """(query_id, hits, top, margin): (first - second) / first; 1 for one hit, 0 if the first is not above 0."""
    one = fused.groupBy("query_id").agg(F.count("*").alias("hits"), F.max(F.when(F.col("place") == 1, F.col("fused"))).alias("top"), F.max(F.when(F.col("place") == 2, F.col("fused"))).alias("second"))
    m = F.when(F.col("hits") < 2, 1.0).when(F.col("top") <= 0, 0.0).otherwise((F.col("top") - F.col("second")) / F.col("top"))
    return one.select("query_id", "hits", "top", F.round(m, 6).alias("margin"))
