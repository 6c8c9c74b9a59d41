"""Ranked lists: W1 rank, W2 top-k, L3 custom order, L4 listing, A19 agreement.

Ranks follow ``round(score, 6)`` descending with ``doc_id`` as tie-break, so
runs are deterministic and equal across engines that differ in the last bits.
``row_number() <= k`` lets Catalyst insert a partial window-group-limit before
the shuffle on ``topic_id`` (k up to spark.sql.optimizer.windowGroupLimitThreshold).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_DECIMALS = 6


def rank_order(score: str = "score", doc_id: str = "doc_id", order_by=None) -> list[Column]:
    if order_by is not None:
        return [F.col(c) if isinstance(c, str) else c for c in order_by]
    return [F.round(F.col(score), SCORE_DECIMALS).desc(), F.col(doc_id).asc()]


def rank_run(scores: DataFrame, k: int | None = None, topic_id: str = "topic_id", score: str = "score",
             doc_id: str = "doc_id", order_by=None, partition_extra=()) -> DataFrame:
    """Add ``rank`` (1-based) per topic; keep ranks ``<= k`` when k is given."""
    w = Window.partitionBy(*partition_extra, topic_id).orderBy(*rank_order(score, doc_id, order_by))
    ranked = scores.withColumn("rank", F.row_number().over(w).cast("long"))
    if k is not None:
        ranked = ranked.where(F.col("rank") <= k)
    return ranked


def top_k(scores: DataFrame, k: int = 1000, **kw) -> DataFrame:
    """The k best documents per topic (the reference's return size, default 1000)."""
    return rank_run(scores, k=k, **kw)


def select_ids(run: DataFrame) -> DataFrame:
    """Ids, rank and score only."""
    return run.select("topic_id", "doc_id", "rank", "score")


def rank_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per topic, share of positions at which both runs hold the same document."""
    j = (a.select("topic_id", "rank", F.col("doc_id").alias("doc_a"))
         .join(b.select("topic_id", "rank", F.col("doc_id").alias("doc_b")), ["topic_id", "rank"], "full_outer"))
    return (j.groupBy("topic_id")
            .agg(F.count(F.lit(1)).alias("n_positions"),
                 F.sum(F.when(F.col("doc_a") == F.col("doc_b"), 1).otherwise(0)).alias("n_same"))
            .withColumn("agreement", F.round(F.col("n_same") / F.col("n_positions"), SCORE_DECIMALS)))


def exclude(run: DataFrame, pairs: DataFrame) -> DataFrame:
    """Drop the listed (topic, doc) pairs from a run (left anti join), ranks untouched."""
    return run.join(pairs.select("topic_id", "doc_id"), ["topic_id", "doc_id"], "left_anti")


def concat_examples(*dfs: DataFrame) -> DataFrame:
    """Concatenate datasets (UNION ALL by column name, no de-duplication)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out
