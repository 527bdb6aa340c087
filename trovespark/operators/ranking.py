"""Ranking: fusion, normalisation, deduplication and top-k per group.

Ranks use row_number with a bound, which Spark turns into a limit per group before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovespark.functions.text import is_test_path

RRF_K = 60
WEIGHTS = {"bm25": 1.0, "symbol": 1.5, "vector": 5.0}
TEST_DEMOTION = 0.25


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in order."""
    return top_k(df, key, order, 1, "_first").drop("_first")


def first_of_lists(asked: DataFrame, lists: DataFrame, group: list[str], key: str, order: list[str], k: int, copies: int = 1) -> DataFrame:
    """(group, order): the first k distinct rows, in order, of all the lists (key, order) that each group (group, key) asks for.

    No list gives more than its first k rows. The heads of a group's lists that hold k rows together give a bound: what
    lies behind it isn't joined to the group. copies: of how many of a group's lists a row tends to be; a wrong guess costs time only.
    """
    ascending, place = [F.asc(c) for c in order], F.struct(*order)
    ranked = top_k(lists.select(key, *order).distinct(), [key], ascending, k, "_r")
    sizes = asked.groupBy(*group).agg(F.count("*").alias("_n"))
    heads = asked.join(sizes, group).join(ranked, key).where((F.col("_r") - 1) * F.col("_n") < copies * k).select(*group, *order)
    nth = F.dense_rank().over(Window.partitionBy(*group).orderBy(*ascending))
    bounds = heads.withColumn("_h", nth).where(F.col("_h") <= k).where(F.col("_h") == k).select(*group, place.alias("_bound")).distinct()
    near = asked.join(bounds, group, "left").join(ranked, key).where(F.col("_bound").isNull() | (place <= F.col("_bound"))).select(*group, *order)
    return near.withColumn("_h", nth).where(F.col("_h") <= k).drop("_h").distinct()


def normalised(df: DataFrame, group: list[str], score: str = "score") -> DataFrame:
    """score scaled to 0..1 within each group, 1 where all are equal; for groups a top-k has bounded, whose partitioning it reuses."""
    w = Window.partitionBy(*group)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(score, F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).otherwise(F.lit(1.0)))


def reciprocal_rank_fusion(lists: DataFrame, group: list[str], key: list[str], k: int = RRF_K) -> DataFrame:
    """Weighted fusion of ranked lists (group, key, list_kind, weight, rank): the sum of weight / (k + rank) and a trail of evidence."""
    trail = F.format_string("%s@rank=%d(+%.5f)", F.col("list_kind"), F.col("rank"), F.col("weight") / (k + F.col("rank")))
    return lists.groupBy(*group, *key).agg(
        F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"),
        F.array_sort(F.collect_list(trail)).alias("evidence"),
        F.count("*").alias("n_lists"),
    )


def demote_tests(df: DataFrame, file: str = "file", intent: Column | None = None) -> DataFrame:
    """Scores of test paths count a quarter, unless tests are what is asked for."""
    test = is_test_path(F.col(file))
    test = test if intent is None else test & (intent != "test_add")
    return df.withColumn("score", F.when(test, F.col("score") * TEST_DEMOTION).otherwise(F.col("score")))


def citation_order(score: str = "score") -> list[Column]:
    return [F.desc(score), F.asc("file"), F.asc("start_line")]


def confidence(df: DataFrame, group: list[str], score: str = "score") -> DataFrame:
    """The share of the best score in the sum of each group's scores."""
    return df.groupBy(*group).agg(F.when(F.sum(score) > 0, F.max(score) / F.sum(score)).otherwise(F.lit(0.0)).alias("confidence"))
