"""Parameter grids, sweeps and their summaries as Spark jobs.

Settings are generated from a seed with md5-based uniforms, so the same grid
comes out on every executor and in SQL; a grid can be a DataFrame or an
``array<struct>`` Column that is exploded into the (small) query side, which
scores every setting in one pass over the postings without a join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.operators import bm25 as bm25_ops
from rankspark.operators.evaluate import evaluate
from rankspark.operators.folds import seeded_uniform
from rankspark.operators.hybrid import Variant, hybrid_variants
from rankspark.operators.index import Index
from rankspark.operators.runs import rank_run


def _param_value(name: str, spec, i: Column, seed: int) -> Column:
    if not isinstance(spec, dict):  # constant
        return F.lit(spec)
    u = seeded_uniform(F.md5(F.concat(F.lit(f"{seed}|{name}|"), i.cast("string"))))
    kind = spec.get("type", "float")
    if kind == "categorical":
        choices = spec["choices"]
        return F.element_at(F.array(*[F.lit(c) for c in choices]), (F.floor(u * len(choices)) + 1).cast("int"))
    low, high = float(spec["low"]), float(spec["high"])
    log = kind == "loguniform" or spec.get("log")
    step = spec.get("q") if kind == "discrete_uniform" else spec.get("step")
    if log and step:
        raise ValueError(f"parameter {name!r}: log and step exclude each other")
    if kind == "discrete_uniform" and not step:
        raise ValueError(f"parameter {name!r}: discrete_uniform needs q")
    if log:
        v = F.exp(F.lit(math.log(low)) + u * F.lit(math.log(high) - math.log(low)))
    elif step:
        step = float(step)
        n_steps = int(math.floor((high - low) / step + 1e-9)) + 1
        v = F.lit(low) + F.floor(u * n_steps) * F.lit(step)
    else:
        v = F.lit(low) + u * F.lit(high - low)
    if kind in ("int", "discrete_uniform_int"):
        if spec.get("step") or spec.get("log"):
            return F.floor(v).cast("long")
        return F.floor(F.lit(low) + u * F.lit(high - low + 1)).cast("long")
    return v


def param_grid_column(space: dict, n: int, seed: int = 42) -> Column:
    """G2 as a Column: ``array<struct<setting, <params>...>>`` of n seeded settings."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
        i.cast("long").alias("setting"), *[_param_value(k, v, i, seed).alias(k) for k, v in space.items()]))


def param_grid(spark: SparkSession, space: dict, n: int, seed: int = 42) -> DataFrame:
    """(setting, <params>...) — float/int (with log or step), categorical, constant."""
    i = F.col("id")
    return spark.range(n).select(i.alias("setting"), *[_param_value(k, v, i, seed).alias(k) for k, v in space.items()])


def sweep(index: Index, topics: DataFrame, qrels: DataFrame, space: dict, n: int, metrics, seed: int = 42,
          fields=("body",), depth: int = 1000) -> DataFrame:
    """BM25 under n seeded (k1, b) settings, evaluated per setting and topic."""
    settings = F.transform(param_grid_column(space, n, seed), lambda s: F.struct(
        s["setting"].alias("setting"), s["k1"].cast("double").alias("k1"), s["b"].cast("double").alias("b")))
    scores = bm25_ops.bm25_settings(index, topics, settings, fields, k=depth)
    run = rank_run(scores, k=depth, partition_extra=("setting",))
    return evaluate(run, qrels, metrics, keys=("setting",), decimals=None)


def sweep_summary(results: DataFrame, params: DataFrame, metric: str, depth: int, maximize: bool = True) -> DataFrame:
    """Number of trials, best mean value and the best setting's parameters (one row)."""
    means = (results.where((F.col("metric") == metric) & (F.col("depth") == depth))
             .groupBy("setting").agg(F.avg("value").alias("mean_value")))
    # compare at 9 decimals: settings with the same ranking tie exactly, whatever the summation order
    order = F.round("mean_value", 9) if maximize else -F.round("mean_value", 9)
    best_key = F.struct(order, -F.col("setting"))
    pcols = [c for c in params.columns if c != "setting"]
    joined = means.join(params, "setting")
    return joined.agg(F.count(F.lit(1)).alias("n_trials"),
                      F.round(F.max_by("mean_value", best_key), 6).alias("best_value"),
                      F.max_by("setting", best_key).alias("best_setting"),
                      *[F.max_by(c, best_key).alias(f"best_{c}") for c in pcols])


def sweep_cv(results: DataFrame, topic_folds: DataFrame, metric: str, depth: int, k: int) -> DataFrame:
    """Per held-out fold, the setting best on the other folds and its held-out mean.

    ``topic_folds``: (topic_id, fold). Each result row is counted for every fold
    it trains (fold ≠ f) and for the fold it tests, by exploding the fold list.
    """
    r = (results.where((F.col("metric") == metric) & (F.col("depth") == depth))
         .join(topic_folds, "topic_id")
         .select("setting", "fold", "value", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("test_fold")))
    agg = (r.groupBy("test_fold", "setting")
           .agg(F.avg(F.when(F.col("fold") != F.col("test_fold"), F.col("value"))).alias("train_mean"),
                F.avg(F.when(F.col("fold") == F.col("test_fold"), F.col("value"))).alias("test_mean")))
    key = F.struct(F.round("train_mean", 9), -F.col("setting"))
    return (agg.where(F.col("train_mean").isNotNull()).groupBy("test_fold")
            .agg(F.max_by("setting", key).alias("best_setting"),
                 F.round(F.max_by("train_mean", key), 6).alias("train_mean"),
                 F.round(F.max_by("test_mean", key), 6).alias("test_mean")))


def ablation_grid(index: Index, topics: DataFrame, field_sets: dict, k: int = 10, facets: str = "first",
                  k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """G1: BM25 per field once, summed per named field set, top k per (variant, topic)."""
    sets = {name: {f: float(list(fs).count(f)) for f in fs} for name, fs in field_sets.items()}
    return rank_run(bm25_ops.bm25_sets(index, topics, sets, k, k1, b, facets), k=k, partition_extra=("variant",))


def ablation_variants(lexical_sets: dict, embed_sets: dict, query_types=("baseline", "embedding"), facets: str = "first") -> list:
    """The variants of an ablation: each query type with each lexical field set, ``embedding`` also with each embedding field set.

    ``baseline`` is plain BM25 over the lexical fields, ``embedding`` the hybrid score with an automatic z.
    Names are ``baseline-<lexical set>`` and ``embedding-<lexical set>-<embedding set>``.
    """
    out = []
    for q in query_types:
        if q not in ("baseline", "embedding"):
            raise ValueError("query types are 'baseline' and 'embedding'")
        for lex, fields in lexical_sets.items():
            boosts = {f: 1.0 for f in fields}
            if q == "baseline":
                out.append(Variant(f"baseline-{lex}", boosts, {}, facets, z=-1.0))
            else:
                out += [Variant(f"embedding-{lex}-{emb}", boosts, {e: 1.0 for e in vectors}, facets) for emb, vectors in embed_sets.items()]
    return out


def ablation_hybrid(index: Index, topics: DataFrame, topic_vectors: DataFrame, doc_vectors: DataFrame, lexical_sets: dict,
                    embed_sets: dict, query_types=("baseline", "embedding"), k: int = 10, facets: str = "first") -> DataFrame:
    """G1 in full: top k per (variant, topic) of every ``ablation_variants``, scored together in one pass over the corpus."""
    return hybrid_variants(index, topics, topic_vectors, doc_vectors, ablation_variants(lexical_sets, embed_sets, query_types, facets), k)


def sweep_hybrid(index: Index, topics: DataFrame, topic_vectors: DataFrame, doc_vectors: DataFrame, qrels: DataFrame, settings,
                 metrics, fields=("body",), embed_fields=("embedding",), depth: int = 1000) -> DataFrame:
    """G3 over z and embedding weights: ``settings`` is a list of ``{"z": number, "weights": {field: weight}}``.

    All settings are scored in one pass over the corpus and evaluated per setting (its place in the list) and
    topic; a topic without hits under a setting counts 0.
    """
    variants = [Variant(str(i), {f: 1.0 for f in fields}, {e: float((s.get("weights") or {}).get(e, 1.0)) for e in embed_fields}, z=s.get("z", "auto"))
                for i, s in enumerate(settings)]
    runs = hybrid_variants(index, topics, topic_vectors, doc_vectors, variants, depth)
    runs = runs.select(F.col("variant").cast("long").alias("setting"), "topic_id", "doc_id", "rank")
    return evaluate(runs, qrels, metrics, keys=("setting",), decimals=None, complete=True)
