"""Audits of an embedding table over labelled pairs (no training).

``pairs``: one row per pair with vector columns ``a`` and ``b`` and a 0/1 ``label``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.functions.vectors import cosine, distance, dot
from rankspark.operators.ordering import average_ranks, running_sums

DECIMALS = 6


def contrastive_loss(pairs: DataFrame, metric: str = "cosine", margin: float = 0.5) -> DataFrame:
    """``½(y·d² + (1−y)·max(0, m−d)²)``; one row with n, mean and sum."""
    d = distance("a", "b", metric)
    y = F.col("label").cast("double")
    loss = F.lit(0.5) * (y * d * d + (F.lit(1.0) - y) * F.pow(F.greatest(F.lit(margin) - d, F.lit(0.0)), 2))
    return pairs.select(loss.alias("loss")).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("loss"), DECIMALS).alias("loss_mean"),
        F.round(F.sum("loss"), DECIMALS).alias("loss_sum"))


def supcon_loss(views: DataFrame, batch_col: str = "batch", sample_col: str = "sample_id", view_col: str = "view",
                label_col: str | None = "label", temperature: float = 1.0, base_temperature: float = 1.0,
                mode: str = "all") -> DataFrame:
    """Supervised contrastive loss per batch (Khosla et al. 2020).

    ``views``: (batch, sample_id, view, label, vec). Anchors are all views
    (``mode="all"``) or view 0 (``"one"``); the contrast set is every other view
    of the batch. Positives share the label (or the sample when ``label_col`` is
    None). Anchors without positives are left out. Returns (batch, n_anchors, loss).

    No pair rows are made: each batch's views (bounded by the batch size, which
    the caller chooses) are gathered into one array, joined to the anchors of the
    batch, and the max-shifted log-sum-exp and the positive sum are folded over
    that array per anchor.
    """
    lab = F.col(label_col) if label_col else F.col(sample_col)
    v = views.select(F.col(batch_col).alias("__b"), F.col(sample_col).alias("s"), F.col(view_col).alias("v"),
                     lab.alias("l"), "vec")
    members = v.groupBy("__b").agg(F.collect_list(F.struct("s", "v", "l", "vec")).alias("__m"))
    anchors = v if mode == "all" else v.where(F.col("v") == 0)
    a = anchors.join(members, "__b")
    t = F.lit(float(temperature))
    others = F.filter("__m", lambda c: (c["s"] != F.col("s")) | (c["v"] != F.col("v")))
    logits = F.transform(others, lambda c: F.struct((dot("vec", c["vec"]) / t).alias("x"),
                                                    (c["l"] == F.col("l")).alias("pos")))
    a = a.select("__b", "s", "v", logits.alias("lg"))
    a = a.withColumn("m", F.array_max(F.transform("lg", lambda e: e["x"])))
    se = F.aggregate("lg", F.lit(0.0), lambda acc, e: acc + F.exp(e["x"] - F.col("m")))
    pos_sum = F.aggregate("lg", F.lit(0.0), lambda acc, e: acc + F.when(e["pos"], e["x"]).otherwise(0.0))
    n_pos = F.size(F.filter("lg", lambda e: e["pos"]))
    per_anchor = a.select("__b", (pos_sum / n_pos - (F.col("m") + F.log(se))).alias("mlp"), n_pos.alias("n_pos"))
    loss = -(F.lit(temperature / base_temperature)) * F.col("mlp")
    return (per_anchor.where(F.col("n_pos") > 0).select(F.col("__b").alias(batch_col), loss.alias("l"))
            .groupBy(batch_col).agg(F.count(F.lit(1)).alias("n_anchors"), F.round(F.avg("l"), DECIMALS).alias("loss")))


def similarity_eval(pairs: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Pearson and Spearman correlation of a pair score with the label (one row)."""
    r = average_ranks(average_ranks(pairs.select(score, label), score, "__rs"), label, "__rl")
    return r.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr(score, label), DECIMALS).alias("pearson"),
                 F.round(F.corr("__rs", "__rl"), DECIMALS).alias("spearman"))


def binary_eval(pairs: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Best-threshold accuracy and F1, and average precision (one row).

    [decision] A threshold t predicts "same" for score ≥ t, t ranges over the
    distinct scores; ties in the best value go to the highest threshold. AP is
    Σ over distinct scores (descending) of recall gain × precision. Rows are
    first aggregated by distinct score; running counts use ``running_sums``.
    """
    per = (pairs.groupBy(score)
           .agg(F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).cast("long").alias("p"),
                F.sum(F.when(F.col(label) > 0, 0).otherwise(1)).cast("long").alias("q")))
    cum = running_sums(per, [F.col(score).desc()], ["p", "q"])
    tot = per.agg(F.sum("p").alias("P"), F.sum("q").alias("Q")).first()  # two scalars
    tp, fp = F.col("cum_p").cast("double"), F.col("cum_q").cast("double")
    P, Q = F.lit(float(tot["P"] or 0)), F.lit(float(tot["Q"] or 0))
    x = cum
    acc = (tp + (Q - fp)) / (P + Q)
    f1 = F.when(tp > 0, 2 * tp / (2 * tp + fp + (P - tp))).otherwise(F.lit(0.0))
    ap_part = F.when(P > 0, (F.col("p") / P) * (tp / (tp + fp))).otherwise(F.lit(0.0))
    x = x.select(score, acc.alias("acc"), f1.alias("f1"), ap_part.alias("ap"))
    return x.agg(
        F.round(F.max("acc"), DECIMALS).alias("best_accuracy"),
        F.round(F.max_by(score, F.struct("acc", score)), DECIMALS).alias("accuracy_threshold"),
        F.round(F.max("f1"), DECIMALS).alias("best_f1"),
        F.round(F.max_by(score, F.struct("f1", score)), DECIMALS).alias("f1_threshold"),
        F.round(F.sum("ap"), DECIMALS).alias("average_precision"))


def cosine_pairs(pairs: DataFrame) -> DataFrame:
    """Adds ``score``: cosine of a and b, rounded to 9 decimals so ties agree across engines."""
    return pairs.withColumn("score", F.round(cosine("a", "b"), 9))
