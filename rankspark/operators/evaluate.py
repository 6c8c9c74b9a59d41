"""Run evaluation as one join, one bounded window and one aggregate.

Metric definitions [decision] (the reference calls an outside evaluator):
* ``p@k``       relevant in the top k / k
* ``recall@k``  relevant in the top k / R   (``r@k`` is the same measure)
* ``rprec@d``   relevant in the top min(R, d) / R
* ``ndcg@k``    Σ rel/log2(rank+1) over the top k, divided by the ideal from the qrels
* ``bpref@d``   1/R Σ_rel (1 − min(n_above, R)/min(R, N)), judged documents only;
                a relevant document with no judged non-relevant one above counts 1
* ``map@d``     average precision at depth d
* ``recip_rank@d`` 1/rank of the first relevant document
Relevant means ``rel > 0``; judged non-relevant means ``rel <= 0``. Topics with
R = 0 are left out; topics missing from the run are left out unless
``complete=True`` (then they score 0).

Scale: the run is cut at the largest depth first, so each topic's window holds
at most that many rows. The ideal DCG is computed from per-grade counts with a
bounded ``sequence`` (≤ k terms), so no window ever spans a topic's judgements.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.operators.runs import exclude as drop_pairs

DECIMALS = 6
_ALIASES = {"r": "recall", "P": "p", "precision": "p", "Rprec": "rprec"}
KNOWN = ("p", "recall", "rprec", "ndcg", "bpref", "map", "recip_rank")


def parse_metric(spec: str) -> tuple[str, int]:
    m = re.fullmatch(r"([A-Za-z_]+)@(\d+)", spec.strip())
    if not m:
        raise ValueError(f"metric must look like name@depth: {spec!r}")
    name = _ALIASES.get(m.group(1), m.group(1).lower())
    if name not in KNOWN:
        raise ValueError(f"unknown metric {m.group(1)!r}")
    return name, int(m.group(2))


def topic_totals(qrels: DataFrame) -> DataFrame:
    """(topic_id, R, N): relevant and judged non-relevant counts, topics with R > 0."""
    return (qrels.groupBy("topic_id")
            .agg(F.sum(F.when(F.col("rel") > 0, 1).otherwise(0)).cast("long").alias("R"),
                 F.sum(F.when(F.col("rel") <= 0, 1).otherwise(0)).cast("long").alias("N"))
            .where(F.col("R") > 0))


def attach_judgements(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Run ⟕ qrels on (topic, doc); unjudged documents get a null ``rel``."""
    return run.join(qrels.select("topic_id", "doc_id", "rel"), ["topic_id", "doc_id"], "left")


def ideal_dcg(qrels: DataFrame, depths) -> DataFrame:
    """(topic_id, idcg_<k>...) from the count of each grade; positions summed with bounded sequences."""
    grades = qrels.where(F.col("rel") > 0).groupBy("topic_id", "rel").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("topic_id").orderBy(F.col("rel").desc())
    # start position of each grade in the ideal order (one row per topic and grade: tiny window)
    grades = grades.withColumn("start", F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                                   F.lit(0)) + 1)
    aggs = []
    for k in depths:
        end = F.least(F.col("start") + F.col("c") - 1, F.lit(k))
        seq = F.when(F.col("start") <= F.lit(k), F.sequence(F.col("start"), end)).otherwise(F.array().cast("array<long>"))
        part = F.col("rel") * F.aggregate(seq, F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / F.log2(i + 1.0))
        aggs.append(F.sum(part).alias(f"idcg_{k}"))
    return grades.groupBy("topic_id").agg(*aggs)


def _metric_expr(name: str, k: int, rel: Column, rank: Column, above: Column, R: Column, N: Column) -> Column:
    is_rel = rel > 0
    within = rank <= k
    hits = F.sum(F.when(within & is_rel, 1).otherwise(0))
    if name == "p":
        return hits / F.lit(float(k))
    if name == "recall":
        return hits / F.first(R)
    if name == "rprec":
        return F.sum(F.when((rank <= F.least(R, F.lit(k))) & is_rel, 1).otherwise(0)) / F.first(R)
    if name == "ndcg":
        return F.sum(F.when(within & is_rel, rel / F.log2(rank + 1.0)).otherwise(0.0)) / F.first(F.col(f"idcg_{k}"))
    if name == "bpref":
        denom = F.least(R, N)
        term = F.when(above > 0, F.lit(1.0) - F.least(above, R) / denom).otherwise(F.lit(1.0))
        return F.sum(F.when(within & is_rel, term).otherwise(0.0)) / F.first(R)
    if name == "map":
        return F.sum(F.when(within & is_rel, F.col("rel_upto") / rank).otherwise(0.0)) / F.first(R)
    if name == "recip_rank":
        return F.coalesce(F.max(F.when(within & is_rel, F.lit(1.0) / rank)), F.lit(0.0))
    raise ValueError(name)


def evaluate(run: DataFrame, qrels: DataFrame, metrics, complete: bool = False,
             run_name: str | None = None, keys=(), decimals: int | None = DECIMALS) -> DataFrame:
    """A1: (topic_id, metric, depth, value) for every ``metric@depth`` asked for.

    ``keys`` are extra run columns (e.g. a setting id) evaluated separately.
    ``decimals=None`` keeps full precision (for values that are aggregated further).
    """
    keys = list(keys)
    specs = [parse_metric(m) for m in metrics]
    max_depth = max(k for _, k in specs)
    totals = topic_totals(qrels)
    ndcg_depths = sorted({k for n, k in specs if n == "ndcg"})
    j = attach_judgements(run.where(F.col("rank") <= max_depth).select(*keys, "topic_id", "doc_id", "rank"), qrels)
    w = Window.partitionBy(*keys, "topic_id").orderBy("rank")
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    j = (j.withColumn("above", F.coalesce(F.sum(F.when(F.col("rel") <= 0, 1).otherwise(0)).over(prior), F.lit(0)))
         .withColumn("rel_upto", F.sum(F.when(F.col("rel") > 0, 1).otherwise(0)).over(upto)))
    j = j.join(totals, "topic_id")
    if ndcg_depths:
        j = j.join(ideal_dcg(qrels, ndcg_depths), "topic_id", "left")
    rel = F.coalesce(F.col("rel"), F.lit(0)).cast("double")
    rank = F.col("rank").cast("double")
    R, N = F.col("R").cast("double"), F.col("N").cast("double")
    cols = [_metric_expr(n, k, rel, rank, F.col("above").cast("double"), R, N).alias(f"m{i}")
            for i, (n, k) in enumerate(specs)]
    wide = j.groupBy(*keys, "topic_id").agg(*cols)
    if complete:
        wanted = totals.select("topic_id")
        if keys:  # every setting that the run names, for every judged topic: the grid is the result's size
            wanted = wanted.crossJoin(run.select(*keys).distinct())
        wide = wanted.join(wide, [*keys, "topic_id"], "left")
    long = wide.select(*keys, "topic_id", F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.lit(k).alias("depth"),
                 F.coalesce(F.col(f"m{i}"), F.lit(0.0)).alias("value"))
        for i, (n, k) in enumerate(specs)])).alias("m"))
    out = long.select(*keys, "topic_id", "m.metric", F.col("m.depth").cast("int").alias("depth"),
                      (F.round(F.col("m.value"), decimals) if decimals is not None else F.col("m.value")).alias("value"))
    if run_name is not None:
        out = out.withColumn("run_name", F.lit(run_name))
    return out


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Mean of every metric over topics."""
    keys = ["run_name", "metric", "depth"] if "run_name" in metrics.columns else ["metric", "depth"]
    return (metrics.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_topics"), F.round(F.avg("value"), DECIMALS).alias("mean_value")))


def trec_summary(run: DataFrame, qrels: DataFrame, depth: int = 1000, cutoffs=(5, 10, 15, 20, 30, 100)) -> DataFrame:
    """The usual summary numbers over all topics, one row per measure."""
    cut = run.where(F.col("rank") <= depth)
    totals = topic_totals(qrels)
    per_topic = evaluate(cut, qrels, [f"map@{depth}", f"rprec@{depth}", f"bpref@{depth}", f"recip_rank@{depth}"]
                         + [f"p@{k}" for k in cutoffs], decimals=None)
    means = per_topic.groupBy("metric", "depth").agg(F.avg("value").alias("value"))
    label = (F.when(F.col("metric") == "p", F.concat(F.lit("P_"), F.col("depth").cast("string")))
             .when(F.col("metric") == "rprec", F.lit("Rprec"))
             .otherwise(F.col("metric")))
    means = means.select(label.alias("measure"), "value")
    judged = attach_judgements(cut.select("topic_id", "doc_id"), qrels).join(totals.select("topic_id"), "topic_id")
    counts = judged.agg(F.countDistinct("topic_id").cast("double").alias("num_q"),
                        F.count(F.lit(1)).cast("double").alias("num_ret"),
                        F.sum(F.when(F.col("rel") > 0, 1).otherwise(0)).cast("double").alias("num_rel_ret"))
    num_rel = (totals.join(cut.select("topic_id").distinct(), "topic_id")
               .agg(F.sum("R").cast("double").alias("value")).select(F.lit("num_rel").alias("measure"), "value"))
    counts_long = counts.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("measure"), F.col(n).alias("value"))
        for n in ("num_q", "num_ret", "num_rel_ret")])).alias("m")).select("m.measure", "m.value")
    counts_long = counts_long.unionByName(num_rel)
    return counts_long.unionByName(means).select("measure", F.round("value", DECIMALS).alias("value"))


def evaluate_residual(run: DataFrame, qrels: DataFrame, exclude: DataFrame, metrics,
                      rerank: bool = False, reduce_qrels: bool = False, decimals: int | None = DECIMALS,
                      keys=()) -> DataFrame:
    """A10: drop the listed (topic, doc) pairs, keep the original ranks, evaluate.

    ``rerank=True`` renumbers the remaining documents; ``reduce_qrels=True`` also
    removes the pairs from the judgements.
    """
    keep = drop_pairs(run, exclude)
    if rerank:
        w = Window.partitionBy(*keys, "topic_id").orderBy("rank")
        keep = keep.withColumn("rank", F.row_number().over(w).cast("long"))
    if reduce_qrels:
        qrels = qrels.join(exclude.select("topic_id", "doc_id"), ["topic_id", "doc_id"], "left_anti")
    return evaluate(keep, qrels, metrics, decimals=decimals, keys=keys)



def pair_metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per-topic values of two runs side by side (topics evaluated in both)."""
    return (a.select("topic_id", "metric", "depth", F.col("value").alias("a"))
            .join(b.select("topic_id", "metric", "depth", F.col("value").alias("b")), ["topic_id", "metric", "depth"]))


def paired_t(a: DataFrame, b: DataFrame, with_p: bool = False) -> DataFrame:
    """Paired t-test per metric of run b − run a over common topics.

    Columns: metric, depth, n, mean_diff, sd, t, dof (and p, two-sided, when asked).
    """
    from rankspark.functions.stats import t_pvalue
    d = pair_metrics(a, b).withColumn("d", F.col("b") - F.col("a"))
    s = (d.groupBy("metric", "depth")
         .agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd")))
    t = F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt(F.col("n"))))
    s = s.withColumns({"full_t": t, "dof": F.col("n") - 1})
    if with_p:
        s = s.withColumn("p", F.round(t_pvalue(F.col("full_t"), F.col("dof")), DECIMALS))
    return s.select("metric", "depth", "n", F.round("mean_diff", DECIMALS).alias("mean_diff"),
                    F.round("sd", DECIMALS).alias("sd"), F.round("full_t", DECIMALS).alias("t"), "dof", *(["p"] if with_p else []))
