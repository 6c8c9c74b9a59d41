"""Registered queries: name → (Spark job over the driver's tables, DuckDB twin).

Every job reads whole tables at ``sf_dir`` and runs through the library's
operators; the SQL twin restates the same definitions for the oracle check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.functions import columns as colf
from rankspark.functions.text import clean_whitespace, max_token_length, sentences
from rankspark.functions.vectors import cosine as cosine_col
from rankspark.operators import bm25 as bm25_ops
from rankspark.operators import dense as dense_ops
from rankspark.operators import evaluate as ev
from rankspark.operators import folds as fold_ops
from rankspark.operators import hybrid as hybrid_ops
from rankspark.operators import pairs as pair_ops
from rankspark.operators import rerank as rr
from rankspark.operators import sweep as sweep_ops
from rankspark.operators.index import Index, fields_long
from rankspark.operators.runs import rank_agreement, rank_run
from rankspark.operators.sizing import broadcast_if_bounded
from rankspark.plans import inputs
from rankspark.plans import oracle as sql
from rankspark.session import scratch_path
from rankspark.sources import corpus as corpus_src
from rankspark.sources import topics as topic_src
from rankspark.sources import trec
from rankspark.streaming import incremental as inc

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


# ---------------------------------------------------------------- step 0: BM25 top-k
TOPK = 10
EVAL_DEPTH = 1000


def stored(spark, run: DataFrame) -> DataFrame:
    """A run written once (at most its depth of rows a topic): what follows reads it several times without scoring anew."""
    path = scratch_path(spark, "ranked")
    run.write.parquet(path)
    return spark.read.schema(run.schema).parquet(path)


def body_run(spark, sf_dir, k=EVAL_DEPTH, index=None):
    index = index or inputs.corpus_index(spark, sf_dir, ("body",))
    scores = bm25_ops.bm25(index, inputs.topics(spark, sf_dir), ("body",), k=k)
    return stored(spark, rank_run(scores, k=k))


@register("bm25_topk", sql.with_(sql.corpus_ctes(), sql.topics_cte(), sql.bm25_ctes(),
                                  sql.rank_cte("run", "scores", TOPK))
          + "SELECT topic_id, doc_id, rank, round(score, 6) AS score FROM run")
def q_bm25_topk(spark, sf_dir):
    """BM25 (k1 1.2, b 0.75) of every benchmark topic over the whole corpus body, top 10."""
    return _round(body_run(spark, sf_dir, TOPK), "score").select("topic_id", "doc_id", "rank", "score")


# ---------------------------------------------------------------- step 1: evaluation
def _eval_sql(metrics) -> str:
    specs = [ev.parse_metric(m) for m in metrics]
    return (sql.with_(sql.corpus_ctes(), sql.topics_cte(), sql.bm25_ctes(), sql.rank_cte("run", "scores", EVAL_DEPTH),
                      sql.qrels_ctes(), sql.eval_ctes("run", max(k for _, k in specs)))
            + sql.metrics_union(specs))


def _eval_query(metrics, decimals=6):
    def run(spark, sf_dir):
        index = inputs.corpus_index(spark, sf_dir, ("body",))
        return ev.evaluate(body_run(spark, sf_dir, index=index), inputs.qrels(spark, sf_dir, index), metrics,
                           decimals=decimals)
    return run


EVAL_SETS = {
    "eval_precision": ["p@1", "p@5", "p@10", "p@15", "p@20"],
    "eval_recall": ["recall@10", "recall@100", "recall@1000"],
    "eval_rprec": ["rprec@10", "rprec@1000"],
    "eval_ndcg": ["ndcg@10", "ndcg@20", "ndcg@100"],
    "eval_bpref": ["bpref@10", "bpref@1000"],
    "eval_map": ["map@1000", "recip_rank@1000"],
}
for _name, _metrics in EVAL_SETS.items():
    register(_name, _eval_sql(_metrics))(_eval_query(_metrics))

MEAN_METRICS = ["ndcg@10", "ndcg@20", "ndcg@100", "rprec@1000", "p@1", "p@5", "p@10", "p@15", "p@20",
                "bpref@1000", "recall@1000"]


@register("eval_means", sql.with_(sql.corpus_ctes(), sql.topics_cte(), sql.bm25_ctes(),
                                   sql.rank_cte("run", "scores", EVAL_DEPTH), sql.qrels_ctes(),
                                   sql.eval_ctes("run", EVAL_DEPTH),
                                   "per_topic AS (" + sql.metrics_union([ev.parse_metric(m) for m in MEAN_METRICS], rnd=False) + ")")
          + "SELECT metric, depth, count(*) AS n_topics, round(avg(value), 6) AS mean_value FROM per_topic GROUP BY metric, depth")
def q_eval_means(spark, sf_dir):
    """Mean over topics of the metric list of the reference's tests."""
    return ev.mean_metrics(_eval_query(MEAN_METRICS, decimals=None)(spark, sf_dir))


@register("qrels_build", sql.with_(sql.corpus_ctes(), sql.qrels_ctes()) + "SELECT topic_id, doc_id, rel FROM qrels")
def q_qrels(spark, sf_dir):
    """The judgement table the evaluation queries use (verbatim containment join)."""
    return inputs.qrels(spark, sf_dir)


_SUMMARY_CUTS = (5, 10, 15, 20, 30, 100)
_SUMMARY_SPECS = [("map", 1000), ("rprec", 1000), ("bpref", 1000), ("recip_rank", 1000)] + [("p", k) for k in _SUMMARY_CUTS]


@register("trec_summary", sql.with_(
    sql.corpus_ctes(), sql.topics_cte(), sql.bm25_ctes(), sql.rank_cte("run", "scores", EVAL_DEPTH), sql.qrels_ctes(),
    sql.eval_ctes("run", EVAL_DEPTH), "per_topic AS (" + sql.metrics_union(_SUMMARY_SPECS, rnd=False) + ")")
    + """SELECT measure, round(value, 6) AS value FROM (
    SELECT 'num_q' AS measure, count(DISTINCT topic_id)::DOUBLE AS value FROM ej JOIN totals USING (topic_id)
    UNION ALL SELECT 'num_ret', count(*)::DOUBLE FROM ej JOIN totals USING (topic_id)
    UNION ALL SELECT 'num_rel_ret', sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END)::DOUBLE FROM ej JOIN totals USING (topic_id)
    UNION ALL SELECT 'num_rel', sum(R)::DOUBLE FROM totals WHERE topic_id IN (SELECT topic_id FROM run)
    UNION ALL SELECT CASE WHEN metric = 'p' THEN 'P_' || depth WHEN metric = 'rprec' THEN 'Rprec' ELSE metric END,
                     avg(value) FROM per_topic GROUP BY metric, depth)""")
def q_trec_summary(spark, sf_dir):
    """Summary measures of the BM25 run at depth 1000."""
    index = inputs.corpus_index(spark, sf_dir, ("body",))
    return ev.trec_summary(body_run(spark, sf_dir, index=index), inputs.qrels(spark, sf_dir, index), EVAL_DEPTH,
                           _SUMMARY_CUTS)


# ---------------------------------------------------------------- step 2: statistics, encoder, hybrid

LEX_FIELDS = ("title", "body")
EMB_FIELDS = ("title_embedding", "body_embedding")
DIM = 64


@register("index_stats", sql.with_(sql.corpus_ctes(LEX_FIELDS))
          + """SELECT field, n_docs, round(avgdl, 6) AS avgdl, n_terms, n_postings FROM fstats
               JOIN (SELECT field, count(*) AS n_terms, CAST(sum(df) AS BIGINT) AS n_postings FROM tstats GROUP BY field)
               USING (field)""")
def q_index_stats(spark, sf_dir):
    """Per field N, avgdl, vocabulary size and posting count."""
    idx = inputs.corpus_index(spark, sf_dir, LEX_FIELDS)
    per_field = idx.term_stats.groupBy("field").agg(F.count(F.lit(1)).alias("n_terms"),
                                                    F.sum("df").cast("long").alias("n_postings"))
    return (idx.field_stats.join(per_field, "field")
            .select("field", "n_docs", F.round("avgdl", 6).alias("avgdl"), "n_terms", "n_postings"))


@register("hash_encode", sql.with_(sql.corpus_ctes(("body",)), sql.hash_vec_ctes("hv", "corpus", "doc_id", "body"))
          + """SELECT doc_id, len(list_filter(vec, lambda x: x > 0)) AS nnz, round(list_max(vec), 6) AS max_weight,
                      round(list_sum(list_transform(range(64), lambda i: i * vec[i + 1])), 6) AS checksum FROM hv""")
def q_hash_encode(spark, sf_dir):
    """The hash encoder over every document body; per-vector summary."""
    v = dense_ops.hash_encode(inputs.corpus(spark, sf_dir), "body", DIM, keep=["doc_id"])
    idx = F.sequence(F.lit(0), F.lit(DIM - 1))
    return v.select("doc_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("nnz"),
                    F.round(F.array_max("embedding"), 6).alias("max_weight"),
                    F.round(F.aggregate(F.zip_with(idx, "embedding", lambda i, x: i * x), F.lit(0.0),
                                        lambda a, x: a + x), 6).alias("checksum"))


def _doc_hash_vectors(spark, sf_dir):
    return dense_ops.hash_encode_columns(inputs.corpus(spark, sf_dir), {"title": "title_embedding",
                                                                        "body": "body_embedding"}, DIM,
                                         keep=["doc_id"])


def _run_hash_vectors(spark, sf_dir, run: DataFrame) -> DataFrame:
    """Title and body vectors of the documents that the run names, and of no others."""
    docs = inputs.corpus(spark, sf_dir).join(run.select("doc_id").distinct(), "doc_id", "left_semi")
    return dense_ops.hash_encode_columns(docs, {"title": "title_embedding", "body": "body_embedding"}, DIM, keep=["doc_id"])


def _topic_hash_vectors(spark, sf_dir, topics=None):
    t = topics if topics is not None else inputs.topics(spark, sf_dir)
    return dense_ops.hash_encode(t, "text", DIM, keep=["topic_id", "facet", "facet_pos"])


def _hybrid_query(k=10, z="auto", use_bm25=True, missing=False, ceiling=None):
    def run(spark, sf_dir):
        index = inputs.corpus_index(spark, sf_dir, LEX_FIELDS)
        topics = inputs.topics(spark, sf_dir)
        if missing:
            dv, emb = inputs.doc_vectors(spark, sf_dir).select("doc_id", "embedding"), ("embedding",)
        else:
            dv, emb = _doc_hash_vectors(spark, sf_dir), EMB_FIELDS
        run_df = hybrid_ops.hybrid(index, topics, _topic_hash_vectors(spark, sf_dir), dv, LEX_FIELDS, emb,
                                   z=z, use_bm25=use_bm25, ceiling=ceiling, k=k)
        return _round(run_df.select("topic_id", "doc_id", "rank", "score", "bm25", "embed", "z"),
                      "score", "bm25", "embed", "z")
    return run


def _hybrid_sql(k=10, z="auto", use_bm25=True, missing=False, ceiling=None, boosts=None, weights=None,
                facets="all", topics_cte=None, log=None, final=None) -> str:
    """``log`` and ``final`` replace the log term and the final score: templates over ``{bm25} {z} {log} {embed}``."""
    emb = ("embedding",) if missing else EMB_FIELDS
    weights = weights or {}
    used = "WHERE facet_pos = 0" if facets == "first" else ""
    ctes = [sql.corpus_ctes(LEX_FIELDS), topics_cte or sql.topics_cte(),
            f"used AS (SELECT * FROM topics {used})",
            sql.bm25_ctes(LEX_FIELDS, boosts=boosts, facets=facets, prefix="u_"),
            sql.bm25_ctes(LEX_FIELDS, boosts=boosts, facets="first", prefix="f_"),
            """cand AS (SELECT u.topic_id, u.doc_id, u.score AS bm25, coalesce(f.score, 0.0) AS bm25_first
                        FROM u_scores u LEFT JOIN f_scores f USING (topic_id, doc_id))""",
            "nf AS (SELECT topic_id, count(*) AS n_facets FROM used GROUP BY topic_id)",
            sql.hash_vec_ctes("tv", "used", "topic_id, facet", "text")]
    if missing:
        ctes.append("dv AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS embedding FROM embeddings)")
    else:
        ctes += [sql.hash_vec_ctes("hdoc", "flong", "doc_id, field", "text"),
                 """dv AS (SELECT c.doc_id, t.vec AS title_embedding, b.vec AS body_embedding FROM corpus c
                           LEFT JOIN hdoc t ON t.doc_id = c.doc_id AND t.field = 'title'
                           LEFT JOIN hdoc b ON b.doc_id = c.doc_id AND b.field = 'body')"""]
    ceil = f"{float(ceiling)}" if ceiling is not None else f"({float(len(emb))} * n_facets)"
    zexpr = "zt.z" if z == "auto" else f"{float(z)}::DOUBLE"
    plain = z != "auto" and float(z) < 0
    per_facet = " + ".join(
        f"(CASE WHEN dv.{e} IS NULL THEN 0.0 ELSE {float(weights.get(e, 1.0))} * {sql.cos('tv.vec', 'dv.' + e)} + 1.0 END)"
        for e in emb if float(weights.get(e, 1.0)) != 0.0)
    only = "WHERE zt.z IS NOT NULL" if z == "auto" and use_bm25 else ""
    log_sql = (log or "ln({bm25}) / ln({z})").format(bm25="c.bm25", z=zexpr)
    score = f"CASE WHEN {zexpr} < 0 THEN c.bm25 ELSE {log_sql} + e.embed END" if use_bm25 else "e.embed"
    score = final.format(bm25="c.bm25", z=zexpr, log=log_sql, embed="e.embed") if final else score
    score = "c.bm25" if plain and use_bm25 else score
    ctes += ["""top AS (SELECT topic_id, max(bm25_first) AS top FROM cand GROUP BY topic_id)""",
             f"""zt AS (SELECT topic_id, CASE WHEN top > {ceil} THEN pow(top, 1.0 / {ceil}) END AS z
                        FROM top JOIN nf USING (topic_id))""",
             f"""emb AS (SELECT c.topic_id, c.doc_id, coalesce(sum({per_facet}), 0.0) AS embed FROM cand c
                         LEFT JOIN tv ON tv.topic_id = c.topic_id LEFT JOIN dv ON dv.doc_id = c.doc_id
                         GROUP BY c.topic_id, c.doc_id)""",
             f"""sc AS (SELECT c.topic_id, c.doc_id, c.bm25, e.embed, {zexpr} AS z, {score} AS score
                        FROM cand c JOIN emb e USING (topic_id, doc_id) LEFT JOIN zt USING (topic_id) {only})""",
             sql.rank_cte("run", "sc", k)]
    return (sql.with_(*ctes) + """SELECT topic_id, doc_id, rank, round(score, 6) AS score, round(bm25, 6) AS bm25,
                                  round(embed, 6) AS embed, round(z, 6) AS z FROM run""")


@register("top_bm25_z", sql.with_(sql.corpus_ctes(LEX_FIELDS), sql.topics_cte(),
                                   sql.bm25_ctes(LEX_FIELDS, facets="first"))
          + """SELECT topic_id, round(max(score), 6) AS top_bm25, 2.0 AS ceiling,
                      round(CASE WHEN max(score) > 2.0 THEN pow(max(score), 1.0 / 2.0) END, 6) AS z
               FROM scores GROUP BY topic_id""")
def q_top_bm25_z(spark, sf_dir):
    """Best first-facet BM25 per topic and z for a ceiling of 2 (2 embedding fields × 1 facet)."""
    index = inputs.corpus_index(spark, sf_dir, LEX_FIELDS)
    top = hybrid_ops.best_bm25(index, inputs.topics(spark, sf_dir), LEX_FIELDS)
    return top.select("topic_id", F.round("top_bm25", 6).alias("top_bm25"), F.lit(2.0).alias("ceiling"),
                      F.round(hybrid_ops.z_value(F.col("top_bm25"), F.lit(2.0)), 6).alias("z"))


register("hybrid_auto", _hybrid_sql())(_hybrid_query())
register("hybrid_fixed_z", _hybrid_sql(z=2.15))(_hybrid_query(z=2.15))
register("embedding_only", _hybrid_sql(use_bm25=False))(_hybrid_query(use_bm25=False))
register("hybrid_missing_vectors", _hybrid_sql(missing=True))(_hybrid_query(missing=True))


# ---------------------------------------------------------------- step 3: fields, boosts, settings, ablation
BOOSTS = {"title": 2.0, "body": 1.0}
SETTINGS = [(0, 1.2, 0.75), (1, 0.9, 0.4), (2, 2.0, 1.0), (3, 1.2, 0.0)]


def _bm25_fields_query(boosts=None):
    def run(spark, sf_dir):
        index = inputs.corpus_index(spark, sf_dir, LEX_FIELDS)
        scores = bm25_ops.bm25(index, inputs.topics(spark, sf_dir), LEX_FIELDS, boosts=boosts, k=TOPK)
        return _round(rank_run(scores, k=TOPK), "score").select("topic_id", "doc_id", "rank", "score")
    return run


def _bm25_fields_sql(boosts=None):
    return (sql.with_(sql.corpus_ctes(LEX_FIELDS), sql.topics_cte(), sql.bm25_ctes(LEX_FIELDS, boosts=boosts),
                      sql.rank_cte("run", "scores", TOPK))
            + "SELECT topic_id, doc_id, rank, round(score, 6) AS score FROM run")


register("bm25_multifield", _bm25_fields_sql())(_bm25_fields_query())
register("bm25_boosted", _bm25_fields_sql(BOOSTS))(_bm25_fields_query(BOOSTS))


def _settings_sql() -> str:
    vals = ", ".join(f"({s}, {k1}::DOUBLE, {b}::DOUBLE)" for s, k1, b in SETTINGS)
    return (sql.with_(sql.corpus_ctes(("body",)), sql.topics_cte(),
                      f"""qt AS (SELECT topic_id, term, count(*) AS qtf FROM (SELECT topic_id, unnest({sql.tok('text')}) AS term
                                 FROM topics WHERE facet_pos = 0) GROUP BY topic_id, term)""",
                      f"""weights AS (SELECT s.setting, s.k1, s.b, q.topic_id, 'body' AS field, q.term, f.avgdl,
                                      q.qtf * ln(1 + (f.n_docs - t.df + 0.5) / (t.df + 0.5)) AS wt
                                      FROM qt q JOIN tstats t ON t.field = 'body' AND t.term = q.term
                                      JOIN fstats f ON f.field = 'body', (VALUES {vals}) s(setting, k1, b))""",
                      """scores AS (SELECT w.setting, w.topic_id, p.doc_id,
                                    sum(w.wt * (p.tf * (w.k1 + 1)) / (p.tf + w.k1 * (1 - w.b + w.b * p.dl / w.avgdl))) AS score
                                    FROM postings p JOIN weights w USING (field, term) GROUP BY w.setting, w.topic_id, p.doc_id)""",
                      sql.rank_cte("run", "scores", TOPK, part="setting, topic_id"))
            + "SELECT setting, topic_id, doc_id, rank, round(score, 6) AS score FROM run")


@register("bm25_params", _settings_sql())
def q_bm25_params(spark, sf_dir):
    """Four (k1, b) settings scored in one pass over the postings, top 10 per setting and topic."""
    index = inputs.corpus_index(spark, sf_dir, ("body",))
    scores = bm25_ops.bm25_settings(index, inputs.topics(spark, sf_dir), SETTINGS, k=TOPK)
    return _round(rank_run(scores, k=TOPK, partition_extra=("setting",)), "score").select(
        "setting", "topic_id", "doc_id", "rank", "score")


@register("bm25_ablation", sql.with_(sql.corpus_ctes(LEX_FIELDS), sql.conversation_topics_cte(),
                                      sql.bm25_ctes(LEX_FIELDS, facets="all", by_field=True),
                                      sql.rank_cte("run", "scores", TOPK, part="field, topic_id"))
          + "SELECT field, topic_id, doc_id, rank, round(score, 6) AS score FROM run")
def q_bm25_ablation(spark, sf_dir):
    """Each document field on its own, the query being all facets of a conversation, top 10."""
    index = inputs.corpus_index(spark, sf_dir, LEX_FIELDS)
    scores = bm25_ops.bm25_ablation(index, inputs.conversation_topics(spark, sf_dir), LEX_FIELDS, k=TOPK)
    return _round(rank_run(scores, k=TOPK, partition_extra=("field",)), "score").select(
        "field", "topic_id", "doc_id", "rank", "score")


EMB_WEIGHTS = {"title_embedding": 0.5, "body_embedding": 1.0}


@register("hybrid_fieldsets", _hybrid_sql(TOPK, boosts=BOOSTS, weights=EMB_WEIGHTS, facets="first"))
def q_hybrid_fieldsets(spark, sf_dir):
    """First facet, boosted lexical fields, weighted embedding fields, offset 1, auto z (ceiling 2)."""
    index = inputs.corpus_index(spark, sf_dir, LEX_FIELDS)
    run_df = hybrid_ops.hybrid(index, inputs.topics(spark, sf_dir), _topic_hash_vectors(spark, sf_dir),
                               _doc_hash_vectors(spark, sf_dir), LEX_FIELDS, EMB_FIELDS, boosts=BOOSTS,
                               weights=EMB_WEIGHTS, facets="first", k=TOPK)
    return _round(run_df.select("topic_id", "doc_id", "rank", "score", "bm25", "embed", "z"),
                  "score", "bm25", "embed", "z")


@register("hybrid_multifacet", _hybrid_sql(TOPK, topics_cte=sql.conversation_topics_cte()))
def q_hybrid_multifacet(spark, sf_dir):
    """Conversation topics, every facet × every field; z from the first facet, ceiling 2 × #facets."""
    index = inputs.corpus_index(spark, sf_dir, LEX_FIELDS)
    topics = inputs.conversation_topics(spark, sf_dir)
    run_df = hybrid_ops.hybrid(index, topics, _topic_hash_vectors(spark, sf_dir, topics),
                               _doc_hash_vectors(spark, sf_dir), LEX_FIELDS, EMB_FIELDS, k=TOPK)
    return _round(run_df.select("topic_id", "doc_id", "rank", "score", "bm25", "embed", "z"),
                  "score", "bm25", "embed", "z")


# ---------------------------------------------------------------- step 4: second stage

RERANK_DEPTH = 100
MV_DEPTH = 20


@register("dense_topk", sql.with_("e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)",
                                   f"sc AS (SELECT q.vec_id AS topic_id, d.vec_id AS doc_id, {sql.cos('q.v', 'd.v')} AS score FROM e q, e d)",
                                   sql.rank_cte("run", "sc", TOPK))
          + "SELECT topic_id, doc_id, rank, round(score, 6) AS score FROM run")
def q_dense_topk(spark, sf_dir):
    """Every embedding as a query against all embeddings, cosine, top 10 (blocked matrix products)."""
    e = inputs.doc_vectors(spark, sf_dir)
    q = e.select(F.col("doc_id").alias("topic_id"), "embedding")
    return _round(dense_ops.dense_topk(q, e, k=TOPK), "score").select("topic_id", "doc_id", "rank", "score")


def _rerank_sql(dense: bool) -> str:
    sim = " + ".join(f"(CASE WHEN dv.{e} IS NULL THEN 0.0 ELSE 1.0 * {sql.cos('tv.vec', 'dv.' + e)} END)" for e in EMB_FIELDS)
    ctes = [sql.corpus_ctes(LEX_FIELDS), sql.topics_cte(), sql.bm25_ctes(("body",)),
            sql.rank_cte("first", "scores", RERANK_DEPTH),
            sql.hash_vec_ctes("hdoc", "flong", "doc_id, field", "text"),
            """dv AS (SELECT c.doc_id, t.vec AS title_embedding, b.vec AS body_embedding FROM corpus c
                      LEFT JOIN hdoc t ON t.doc_id = c.doc_id AND t.field = 'title'
                      LEFT JOIN hdoc b ON b.doc_id = c.doc_id AND b.field = 'body')""",
            sql.hash_vec_ctes("tv", "topics", "topic_id, facet", "text"),
            f"""j AS (SELECT f.topic_id, f.doc_id, f.score AS first_score, {sim} AS sim_sum FROM first f
                      LEFT JOIN dv ON dv.doc_id = f.doc_id LEFT JOIN tv ON tv.topic_id = f.topic_id)"""]
    if dense:
        ctes += ["sc AS (SELECT topic_id, doc_id, first_score, sim_sum AS score FROM j)",
                 sql.rank_cte("run", "sc", None)]
        return sql.with_(*ctes) + ("SELECT topic_id, doc_id, rank, round(score, 6) AS score, "
                                   "round(first_score, 6) AS first_score FROM run")
    ctes += ["""j2 AS (SELECT *, max(first_score) OVER (PARTITION BY topic_id) AS top_score,
                              max(sim_sum) OVER (PARTITION BY topic_id) AS top_sim FROM j)""",
             """j3 AS (SELECT topic_id, doc_id, first_score, sim_sum,
                              CASE WHEN top_sim > 0 AND top_score > top_sim THEN pow(top_score, 1.0 / top_sim) END AS z FROM j2)""",
             "sc AS (SELECT *, ln(first_score) / ln(z) + sim_sum AS score FROM j3)",
             sql.rank_cte("run", "sc", None)]
    return sql.with_(*ctes) + ("SELECT topic_id, doc_id, rank, round(score, 6) AS score, round(first_score, 6) AS first_score, "
                               "round(sim_sum, 6) AS sim_sum, round(z, 6) AS z FROM run")


@register("rerank_hybrid", _rerank_sql(False))
def q_rerank_hybrid(spark, sf_dir):
    """BM25 top 100 re-ranked by log_z(score) + cosine sum over title and body vectors."""
    first = body_run(spark, sf_dir, RERANK_DEPTH)
    out = rr.rerank_hybrid(first, _run_hash_vectors(spark, sf_dir, first), _topic_hash_vectors(spark, sf_dir), EMB_FIELDS)
    return _round(out.select("topic_id", "doc_id", "rank", "score", "first_score", "sim_sum", "z"),
                  "score", "first_score", "sim_sum", "z")


@register("rerank_dense", _rerank_sql(True))
def q_rerank_dense(spark, sf_dir):
    """BM25 top 100 re-ranked by the cosine sum alone."""
    first = body_run(spark, sf_dir, RERANK_DEPTH)
    out = rr.rerank_dense(first, _run_hash_vectors(spark, sf_dir, first), _topic_hash_vectors(spark, sf_dir), EMB_FIELDS)
    return _round(out.select("topic_id", "doc_id", "rank", "score", "first_score"), "score", "first_score")


@register("multi_vector_agg", sql.with_(
    sql.corpus_ctes(LEX_FIELDS), sql.conversation_topics_cte(), sql.bm25_ctes(("body",), facets="all"),
    sql.rank_cte("first", "scores", MV_DEPTH), sql.hash_vec_ctes("tv", "topics", "topic_id, facet", "text"),
    sql.hash_vec_ctes("hdoc", "flong", "doc_id, field", "text"),
    f"""pairs AS (SELECT f.topic_id, f.doc_id, {sql.cos('tv.vec', 'hdoc.vec')} AS sim FROM first f
                  JOIN tv ON tv.topic_id = f.topic_id JOIN hdoc ON hdoc.doc_id = f.doc_id)""",
    """agg AS (SELECT topic_id, doc_id, max(sim) AS max_sim, min(sim) AS min_sim, sum(sim) AS sum_sim,
                      avg(sim) AS avg_sim FROM pairs GROUP BY topic_id, doc_id)""",
    sql.rank_cte("run", "(SELECT *, sum_sim AS score FROM agg)", None))
    + """SELECT topic_id, doc_id, rank, round(max_sim, 6) AS max_sim, round(min_sim, 6) AS min_sim,
                round(sum_sim, 6) AS sum_sim, round(avg_sim, 6) AS avg_sim FROM run""")
def q_multi_vector_agg(spark, sf_dir):
    """Conversation candidates keyed ``topic_doc``; every facet vector × title/body vector, ranked by sum."""
    index = inputs.corpus_index(spark, sf_dir, ("body",))
    topics = inputs.conversation_topics(spark, sf_dir)
    first = stored(spark, rank_run(bm25_ops.bm25(index, topics, ("body",), facets="all", k=MV_DEPTH), k=MV_DEPTH))
    dataset = first.select(F.concat_ws("_", F.col("topic_id").cast("string"), F.col("doc_id").cast("string")).alias("id"))
    dv_long = dense_ops.hash_encode(fields_long(inputs.corpus(spark, sf_dir), LEX_FIELDS), "text", DIM,
                                    keep=["doc_id", "field"])
    out = rr.rank_by_embeddings(dataset, _topic_hash_vectors(spark, sf_dir, topics), dv_long, agg="sum")
    return _round(out.select("topic_id", "doc_id", "rank", "max_sim", "min_sim", "sum_sim", "avg_sim"),
                  "max_sim", "min_sim", "sum_sim", "avg_sim")


@register("kmax_pool", sql.with_(
    sql.corpus_ctes(("body",)), sql.topics_cte(), sql.bm25_ctes(("body",)), sql.rank_cte("first", "scores", MV_DEPTH),
    """pas AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS ptext,
                      generate_subscripts(string_split(text, chr(10)), 1) AS passage
               FROM documents WHERE doc_id IN (SELECT doc_id FROM first)),
       pas2 AS (SELECT * FROM pas WHERE length(ptext) > 0)""",
    sql.hash_vec_ctes("pv", "pas2", "doc_id, passage", "ptext"), sql.hash_vec_ctes("tv", "topics", "topic_id", "text"),
    f"""ps AS (SELECT f.topic_id, f.doc_id, pv.passage, {sql.cos('tv.vec', 'pv.vec')} AS score FROM first f
               JOIN pv ON pv.doc_id = f.doc_id JOIN tv ON tv.topic_id = f.topic_id)""",
    """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, doc_id ORDER BY score DESC, passage) AS r
                                FROM ps) WHERE r <= 3)""")
    + """SELECT topic_id, doc_id, round(sum(score), 6) AS kmax_sum, round(avg(score), 6) AS kmax_mean,
                count(*) AS n_used FROM best GROUP BY topic_id, doc_id""")
def q_kmax_pool(spark, sf_dir):
    """Lines of the BM25 top-20 documents scored by cosine with the topic; best 3 per (topic, doc) pooled."""
    first = body_run(spark, sf_dir, MV_DEPTH).select("topic_id", "doc_id")
    docs = inputs.table(spark, sf_dir, "documents").join(first.select("doc_id").distinct(), "doc_id", "left_semi")
    passages = (docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("passage", "ptext"))
                .where(F.length("ptext") > 0))
    pv = dense_ops.hash_encode(passages, "ptext", DIM, keep=["doc_id", "passage"])
    tv = _topic_hash_vectors(spark, sf_dir).select("topic_id", F.col("embedding").alias("qvec"))
    ps = (first.join(pv, "doc_id").join(broadcast_if_bounded(tv), "topic_id")
          .select("topic_id", "doc_id", "passage", cosine_col("qvec", "embedding").alias("score")))
    out = rr.kmax_pool(ps, k=3)
    return _round(out, "kmax_sum", "kmax_mean")


@register("rank_agreement", sql.with_(
    sql.corpus_ctes(LEX_FIELDS), sql.topics_cte(), sql.bm25_ctes(("body",), prefix="a_"), sql.bm25_ctes(LEX_FIELDS, prefix="b_"),
    sql.rank_cte("ra", "a_scores", TOPK), sql.rank_cte("rb", "b_scores", TOPK))
    + """SELECT coalesce(ra.topic_id, rb.topic_id) AS topic_id, count(*) AS n_positions,
                CAST(sum(CASE WHEN ra.doc_id = rb.doc_id THEN 1 ELSE 0 END) AS BIGINT) AS n_same,
                round(sum(CASE WHEN ra.doc_id = rb.doc_id THEN 1 ELSE 0 END) / count(*), 6) AS agreement
         FROM ra FULL OUTER JOIN rb ON ra.topic_id = rb.topic_id AND ra.rank = rb.rank GROUP BY 1""")
def q_rank_agreement(spark, sf_dir):
    """Position-by-position agreement of BM25 over body and BM25 over title + body, top 10."""
    index = inputs.corpus_index(spark, sf_dir, LEX_FIELDS)
    topics = inputs.topics(spark, sf_dir)
    a, b = _body_and_all_fields(index, topics, TOPK)
    return rank_agreement(a, b)


# ---------------------------------------------------------------- step 5: significance, residual evaluation
PAIRED_METRICS = ["ndcg@10", "p@10", "bpref@1000", "map@1000"]


def _two_run_metrics(spark, sf_dir):
    index = inputs.corpus_index(spark, sf_dir, LEX_FIELDS)
    topics = inputs.topics(spark, sf_dir)
    qrels = inputs.qrels(spark, sf_dir, index)
    a, b = _body_and_all_fields(index, topics, EVAL_DEPTH)
    return (ev.evaluate(a, qrels, PAIRED_METRICS, decimals=None), ev.evaluate(b, qrels, PAIRED_METRICS, decimals=None))


def _body_and_all_fields(index, topics, k):
    """Two runs from one pass: BM25 per field, the body component alone and the sum over fields."""
    sets = bm25_ops.bm25_sets(index, topics, {"body": {"body": 1.0}, "both": {f: 1.0 for f in LEX_FIELDS}}, k)
    runs = stored(topics.sparkSession, rank_run(sets, k=k, partition_extra=("variant",)))
    return tuple(runs.where(F.col("variant") == name).drop("variant") for name in ("body", "both"))


_P_SQL = """CASE WHEN n > 1 AND sd > 0 THEN greatest(0.0, 1 - CASE
    WHEN n - 1 = 1 THEN 2 / pi() * th
    WHEN (n - 1) % 2 = 1 THEN 2 / pi() * (th + sin(th) * list_sum(list_transform(range(0, (n - 4) // 2 + 1),
         lambda j: exp(lgamma(j + 1) - lgamma(j + 1.5)) * sqrt(pi()) / 2 * pow(cos(th), 2 * j + 1))))
    ELSE sin(th) * list_sum(list_transform(range(0, (n - 3) // 2 + 1),
         lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow(cos(th), 2 * j))) END) END"""


def _paired_sql(with_p: bool = False) -> str:
    specs = [ev.parse_metric(m) for m in PAIRED_METRICS]
    return (sql.with_(sql.corpus_ctes(LEX_FIELDS), sql.topics_cte(), sql.bm25_ctes(("body",), prefix="a_"),
                      sql.bm25_ctes(LEX_FIELDS, prefix="b_"), sql.rank_cte("ra", "a_scores", EVAL_DEPTH),
                      sql.rank_cte("rb", "b_scores", EVAL_DEPTH), sql.qrels_ctes(),
                      sql.eval_ctes("ra", EVAL_DEPTH, "a_"), sql.eval_ctes("rb", EVAL_DEPTH, "b_"),
                      "ma AS (" + sql.metrics_union(specs, "a_", rnd=False) + ")",
                      "mb AS (" + sql.metrics_union(specs, "b_", rnd=False) + ")",
                      """d AS (SELECT ma.topic_id, ma.metric, ma.depth, mb.value - ma.value AS d FROM ma
                               JOIN mb USING (topic_id, metric, depth))""",
                      """s AS (SELECT metric, depth, count(*) AS n, avg(d) AS mean_diff, stddev_samp(d) AS sd
                               FROM d GROUP BY metric, depth)""")
            + """SELECT metric, depth, n, round(mean_diff, 6) AS mean_diff, round(sd, 6) AS sd,
                        round(CASE WHEN sd > 0 THEN mean_diff / (sd / sqrt(n)) END, 6) AS t, n - 1 AS dof"""
            + (f", round({_P_SQL}, 6) AS p FROM (SELECT *, atan(abs(mean_diff / (sd / sqrt(n))) / sqrt(n - 1)) AS th FROM s)" if with_p else " FROM s"))


@register("paired_t", _paired_sql())
def q_paired_t(spark, sf_dir):
    """BM25 title+body against BM25 body, paired over topics, four metrics (t statistic)."""
    a, b = _two_run_metrics(spark, sf_dir)
    return ev.paired_t(a, b)


@register("paired_t_p", _paired_sql(with_p=True))
def q_paired_t_p(spark, sf_dir):
    """A9 with the two-sided p-value (a finite sum for whole degrees of freedom)."""
    a, b = _two_run_metrics(spark, sf_dir)
    return ev.paired_t(a, b, with_p=True)


RESIDUAL_METRICS = ["ndcg@10", "p@10", "bpref@1000"]


@register("residual_eval", sql.with_(
    sql.corpus_ctes(), sql.topics_cte(), sql.bm25_ctes(), sql.rank_cte("run0", "scores", EVAL_DEPTH),
    """run AS (SELECT * FROM run0 r WHERE NOT EXISTS (SELECT 1 FROM run0 x WHERE x.rank <= 3
               AND x.topic_id = r.topic_id AND x.doc_id = r.doc_id))""",
    sql.qrels_ctes(), sql.eval_ctes("run", EVAL_DEPTH))
    + sql.metrics_union([ev.parse_metric(m) for m in RESIDUAL_METRICS]))
def q_residual_eval(spark, sf_dir):
    """A10: the BM25 run without its top-3 documents per topic (already assessed), original ranks kept."""
    index = inputs.corpus_index(spark, sf_dir, ("body",))
    run = body_run(spark, sf_dir, index=index)
    seen = run.where(F.col("rank") <= 3).select("topic_id", "doc_id")
    return ev.evaluate_residual(run, inputs.qrels(spark, sf_dir, index), seen, RESIDUAL_METRICS)


# ---------------------------------------------------------------- step 6: data preparation, sources and sinks

@register("topics_wide", "SELECT conv_id AS topic_id, count(*) AS n_facets, string_agg(concat(facet, '=', text), '|' ORDER BY facet) AS facets FROM ("
                         "SELECT conv_id, concat_ws('_', role, CAST(turn AS VARCHAR)) AS facet, arg_max(text, turn) AS text FROM conversations "
                         "WHERE text IS NOT NULL GROUP BY ALL) GROUP BY conv_id")
def q_topics_wide(spark, sf_dir):
    """Conversation topics (one facet per turn) as one column per facet, all facets of the table; each row's filled columns by name."""
    wide = topic_src.topics_to_wide(inputs.conversation_topics(spark, sf_dir).where(F.col("text").isNotNull()))
    names = sorted(c for c in wide.columns if c != "topic_id")
    filled = F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}="), F.col(f"`{c}`"))) for c in names]))
    return wide.select("topic_id", F.size(filled).cast("long").alias("n_facets"), F.array_join(filled, "|").alias("facets"))


@register("docs_xml_names", "SELECT CAST(item_id AS VARCHAR) AS doc_id, text FROM benchmark WHERE trim(text) <> ''")
def q_docs_xml_names(spark, sf_dir):
    """Every benchmark item as an XML file of its own, named by its id; read back with the id from the file name."""
    path = scratch_path(spark, "docs-named")
    items = inputs.table(spark, sf_dir, "benchmark").where(F.trim("text") != "")
    items.repartition("item_id").write.partitionBy("item_id").format("xml").option("rowTag", "doc").option("rootTag", "docs").save(path)
    named = [(f"{path}/{r[0]}", f"{path}/named/{r[1]}.xml") for r in
             spark.read.format("binaryFile").load(path).select(F.concat_ws("/", F.concat(F.lit("item_id="), F.col("item_id").cast("string")), "_metadata.file_name"),
                                                               F.col("item_id").cast("string")).collect()]  # a name per file written above
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{path}/named"))
    for old, new in named:
        files.rename(jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new))
    return corpus_src.read_docs_xml(spark, f"{path}/named", "doc", ("text",)).select("doc_id", "text")


@register("topics_tsv", "SELECT CAST(item_id AS VARCHAR) AS topic_id, 'text' AS facet, 0 AS facet_pos, text "
                        "FROM benchmark WHERE text IS NOT NULL")
def q_topics_tsv(spark, sf_dir):
    """The benchmark table written as a TSV topic file with a header, read back as long topics."""
    path = scratch_path(spark, "topics-tsv")
    (inputs.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text").write
     .option("header", True).option("sep", "\t").option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return topic_src.read_topics_csv(spark, path, "id", ("text",), sep="\t")


@register("jsonl_fields", """SELECT * FROM (
      SELECT concat_ws('_', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR)) AS topic_id, 'event_type' AS facet,
             0 AS facet_pos, event_type AS text FROM events
      UNION ALL
      SELECT concat_ws('_', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR)), 'value', 1, CAST(value AS VARCHAR)
      FROM events) WHERE text IS NOT NULL""")
def q_jsonl_fields(spark, sf_dir):
    """S3: events written as JSON lines; id ``event_user``, keys matching "type" / "value" kept as facets."""
    path = scratch_path(spark, "events-jsonl")
    inputs.table(spark, sf_dir, "events").write.json(path)
    return topic_src.read_topics_jsonl(spark, path, "event_id", ["type", "value"], secondary_id="user_id")


@register("topics_xml", f"SELECT CAST(item_id AS VARCHAR) AS topic_id, 'query' AS facet, 0 AS facet_pos, "
                        f"{sql.strip_ws('text')} AS text FROM benchmark WHERE text IS NOT NULL")
def q_topics_xml(spark, sf_dir):
    """Benchmark written as ``<topic number=".."><query>..</query></topic>``; read with listed fields."""
    path = scratch_path(spark, "topics-xml")
    (inputs.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("_number"), F.col("text").alias("query"))
     .write.format("xml").option("rowTag", "topic").option("rootTag", "topics").save(path))
    return topic_src.read_topics_xml(spark, path, "topic", "number", fields=["query", "question"])


@register("flatten", """SELECT event_id, event_type AS ev_type, value AS ev_detail_value,
                               TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS ev_detail_props_k FROM events""")
def q_flatten(spark, sf_dir):
    """A nested struct (type, detail{value, props{k}}) flattened with ``_``."""
    e = inputs.table(spark, sf_dir, "events")
    nested = e.select("event_id", F.struct(F.col("event_type").alias("type"), F.struct(
        "value", F.from_json("props", "k BIGINT").alias("props")).alias("detail")).alias("ev"))
    return colf.flatten_structs(nested, "_")


_CLEAN_SQL = ("regexp_replace(replace(replace(text, chr(13) || chr(10) || chr(13) || chr(10), chr(10)), "
              "chr(13) || chr(10), ' '), ' {2,}', ' ', 'g')")


@register("clean_text", f"SELECT doc_id, length({_CLEAN_SQL}) AS n_chars, md5({_CLEAN_SQL}) AS text_md5 FROM documents")
def q_clean_text(spark, sf_dir):
    """Whitespace clean of every document; length and md5 of the result."""
    d = inputs.table(spark, sf_dir, "documents").select("doc_id", clean_whitespace("text").alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


_SENT_SQL = (f"list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'), "
             f"lambda s: trim(regexp_replace(s, '{sql.WS}+', ' ', 'g'))), lambda s: length(s) > 0)")


@register("sentence_split", f"""SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS sent_md5
                                FROM (SELECT doc_id, {_SENT_SQL} AS s FROM documents WHERE text IS NOT NULL)""")
def q_sentence_split(spark, sf_dir):
    """R2: sentences of every document (count and md5 of the joined sentences)."""
    d = inputs.table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", sentences("text").alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_sentences"),
                    F.md5(F.array_join("s", "|")).alias("sent_md5"))


@register("label_remap", """SELECT doc_id, CAST(floor((quality * 2 + toxic - 1) / 2.0) AS INTEGER) AS label FROM labels
                            WHERE floor((quality * 2 + toxic - 1) / 2.0) <> -1""")
def q_label_remap(spark, sf_dir):
    """A four-grade label (quality·2 + toxic − 1 ∈ {−1..2}) mapped by ``// 2`` and −1 dropped."""
    l = inputs.table(spark, sf_dir, "labels")
    return colf.remap_labels(l.select("doc_id", (F.col("quality") * 2 + F.col("toxic") - 1).alias("label")))


@register("trec_lines", sql.with_(sql.corpus_ctes(), sql.topics_cte(), sql.bm25_ctes(), sql.rank_cte("run", "scores", TOPK))
          + """SELECT topic_id, rank, concat_ws(chr(9), CAST(topic_id AS VARCHAR), 'Q0', CAST(doc_id AS VARCHAR),
                      CAST(rank AS VARCHAR), printf('%.6f', score), 'bm25') AS value FROM run""")
def q_trec_lines(spark, sf_dir):
    """The BM25 top-10 run as TREC lines named ``bm25``."""
    return trec.format_run(body_run(spark, sf_dir, TOPK), resort=False, run_name="bm25")


@register("run_file_roundtrip", sql.with_(sql.corpus_ctes(), sql.topics_cte(), sql.bm25_ctes(),
                                           sql.rank_cte("run", "scores", TOPK))
          + """SELECT CAST(topic_id AS VARCHAR) AS topic_id, CAST(doc_id AS VARCHAR) AS doc_id, rank,
                      round(score, 6) AS score, 'bm25' AS run_name FROM run""")
def q_run_file_roundtrip(spark, sf_dir):
    """S12 → S9: the BM25 top-10 run written as a TREC file and read back."""
    path = scratch_path(spark, "run")
    trec.write_run(body_run(spark, sf_dir, TOPK), path, run_name="bm25")
    return _round(trec.read_run(spark, path), "score")


@register("qrels_file", sql.with_(sql.corpus_ctes(), sql.qrels_ctes())
          + "SELECT CAST(topic_id AS VARCHAR) AS topic_id, '0' AS iter, CAST(doc_id AS VARCHAR) AS doc_id, rel FROM qrels")
def q_qrels_file(spark, sf_dir):
    """The judgements written as TREC qrels text and read back."""
    path = scratch_path(spark, "qrels")
    q = inputs.qrels(spark, sf_dir)
    q.select(F.concat_ws(" ", F.col("topic_id").cast("string"), F.lit("0"), F.col("doc_id").cast("string"),
                         F.col("rel").cast("string"))).write.text(path)
    return trec.read_qrels(spark, path)


@register("examples_columns", f"""SELECT CAST(c1.conv_id AS VARCHAR) || '_' || CAST(c1.turn AS VARCHAR) AS id,
                                        {sql.strip_ws('c1.text')} AS text_a, {sql.strip_ws('c2.text')} AS text_b, 1.0 AS label
                                 FROM conversations c1 JOIN conversations c2 ON c2.conv_id = c1.conv_id AND c2.turn = c1.turn + 1
                                 WHERE c1.role = 'user'""")
def q_examples_columns(spark, sf_dir):
    """(user turn, next turn) pairs as examples with a constant label, then text_a / text_b columns."""
    c = inputs.table(spark, sf_dir, "conversations")
    a = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("q"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("r"))
    pairs = a.join(b, ["conv_id", "turn"]).withColumn(
        "id", F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    ex = colf.to_examples(pairs, ["q", "r"], "id", label=1.0)
    return colf.examples_to_columns(ex, n=2)


# ---------------------------------------------------------------- step 7: folds, pair audits, sweeps


def _md5_int(expr: str, start: int, n: int) -> str:
    return f"('0x' || substr({expr}, {start}, {n}))::BIGINT"


_KFOLD_KEY = "md5('42|' || CAST(doc_id AS VARCHAR))"


@register("kfolds", f"SELECT doc_id, CAST({_md5_int(_KFOLD_KEY, 1, 8)} % 5 AS INTEGER) AS fold FROM documents")
def q_kfolds(spark, sf_dir):
    """Every document in one of 5 seeded folds."""
    return fold_ops.kfolds(inputs.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 5, 42)


@register("stratified_folds", f"""WITH x AS (SELECT vec_id, label, md5('42|' || CAST(vec_id AS VARCHAR)) AS key FROM embeddings),
    p AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_md5_int('key', 9, 8)} % {fold_ops.FOLD_BUCKETS}, key, vec_id) - 1 AS pos FROM x)
    SELECT vec_id, label, CAST(pos % 5 AS INTEGER) AS fold FROM p""")
def q_stratified_folds(spark, sf_dir):
    """Every embedding in one of 5 folds, stratified by label, seed 42."""
    e = inputs.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return fold_ops.stratified_folds(e, "vec_id", "label", 5, 42)


@register("contiguous_folds", """SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) * 3
                                        / (SELECT count(*) FROM documents)) AS INTEGER) AS fold FROM documents""")
def q_contiguous_folds(spark, sf_dir):
    """Documents in doc_id order cut into exactly 3 contiguous folds."""
    return fold_ops.contiguous_folds(inputs.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 3)


def _pairs(spark, sf_dir):
    """Labelled pairs: each embedding with the next id; label 1 when the classes agree."""
    e = inputs.table(spark, sf_dir, "embeddings")
    a = e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"), F.col("label").alias("la"))
    b = e.select((F.col("vec_id") - 1).alias("a_id"), F.col("embedding").alias("b"), F.col("label").alias("lb"))
    return a.join(b, "a_id").select("a_id", "a", "b", (F.col("la") == F.col("lb")).cast("int").alias("label"))


_PAIRS_SQL = """pairs AS (SELECT a.vec_id AS a_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b,
                                 CAST(a.label = b.label AS INTEGER) AS label
                          FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def _dist_sql(metric):
    if metric == "cosine":
        return f"(1.0 - {sql.cos('a', 'b')})"
    if metric == "euclidean":
        return "sqrt(list_sum(list_transform(list_zip(a, b), lambda t: (t[1] - t[2]) * (t[1] - t[2]))))"
    return "list_sum(list_transform(list_zip(a, b), lambda t: abs(t[1] - t[2])))"


@register("contrastive_loss", sql.with_(_PAIRS_SQL) + "\nUNION ALL\n".join(
    f"""SELECT '{m}' AS metric, count(*) AS n_pairs,
               round(avg(0.5 * (label * d * d + (1 - label) * pow(greatest(0.5 - d, 0.0), 2))), 6) AS loss_mean,
               round(sum(0.5 * (label * d * d + (1 - label) * pow(greatest(0.5 - d, 0.0), 2))), 6) AS loss_sum
        FROM (SELECT label, {_dist_sql(m)} AS d FROM pairs)""" for m in ("cosine", "euclidean", "manhattan")))
def q_contrastive_loss(spark, sf_dir):
    """Contrastive loss (margin 0.5) of neighbouring embedding pairs under three distances."""
    p = _pairs(spark, sf_dir)
    out = None
    for m in ("cosine", "euclidean", "manhattan"):
        one = pair_ops.contrastive_loss(p, m, 0.5).select(F.lit(m).alias("metric"), "*")
        out = one if out is None else out.unionByName(one)
    return out


SUPCON_BATCH = 32


@register("supcon_loss", f"""WITH v AS (SELECT CAST(floor(vec_id / {SUPCON_BATCH}) AS BIGINT) AS batch, vec_id AS s, label AS l,
                                        embedding::DOUBLE[] AS vec FROM embeddings),
    pr AS (SELECT a.batch, a.s AS a_s, list_dot_product(a.vec, c.vec) / 1.0 AS logit, a.l = c.l AS pos
           FROM v a JOIN v c ON a.batch = c.batch AND a.s <> c.s),
    pa AS (SELECT batch, a_s, max(logit) AS m FROM pr GROUP BY batch, a_s),
    agg AS (SELECT pr.batch, pr.a_s, any_value(pa.m) AS m, sum(exp(logit - pa.m)) AS se,
                   sum(CASE WHEN pos THEN logit ELSE 0.0 END) AS pos_sum, sum(CASE WHEN pos THEN 1 ELSE 0 END) AS n_pos
            FROM pr JOIN pa USING (batch, a_s) GROUP BY pr.batch, pr.a_s HAVING sum(CASE WHEN pos THEN 1 ELSE 0 END) > 0)
    SELECT batch, count(*) AS n_anchors, round(avg(-1.0 * (pos_sum / n_pos - (m + ln(se)))), 6) AS loss FROM agg GROUP BY batch""")
def q_supcon_loss(spark, sf_dir):
    """Supervised contrastive loss (temperature 1) in batches of 32 consecutive embeddings."""
    e = inputs.table(spark, sf_dir, "embeddings")
    views = e.select(F.floor(F.col("vec_id") / SUPCON_BATCH).cast("long").alias("batch"),
                     F.col("vec_id").alias("sample_id"), F.lit(0).alias("view"), "label", F.col("embedding").alias("vec"))
    return pair_ops.supcon_loss(views)


_SCORED_SQL = f"scored AS (SELECT round({sql.cos('a', 'b')}, 9) AS score, label FROM pairs)"


@register("similarity_eval", sql.with_(_PAIRS_SQL, _SCORED_SQL,
                                        """r AS (SELECT score, label,
                                               rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rs,
                                               rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2.0 AS rl
                                               FROM scored)""")
          + "SELECT count(*) AS n, round(corr(score, label), 6) AS pearson, round(corr(rs, rl), 6) AS spearman FROM r")
def q_similarity_eval(spark, sf_dir):
    """Pearson and Spearman correlation of pair cosine with the same-class label."""
    return pair_ops.similarity_eval(pair_ops.cosine_pairs(_pairs(spark, sf_dir)))


@register("binary_eval", sql.with_(
    _PAIRS_SQL, _SCORED_SQL,
    """per AS (SELECT score, sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN label > 0 THEN 0 ELSE 1 END) AS q
               FROM scored GROUP BY score)""",
    """cum AS (SELECT score, p, sum(p) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
                      sum(q) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM per)""",
    "tot AS (SELECT sum(p)::DOUBLE AS n_pos, sum(q)::DOUBLE AS n_neg FROM per)",
    """x AS (SELECT score, (tp + (n_neg - fp)) / (n_pos + n_neg) AS acc,
                    CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + (n_pos - tp)) ELSE 0.0 END AS f1,
                    CASE WHEN n_pos > 0 THEN (p / n_pos) * (tp / (tp + fp)) ELSE 0.0 END AS ap FROM cum, tot)""")
    + """SELECT round(max(acc), 6) AS best_accuracy,
                round((SELECT score FROM x ORDER BY acc DESC, score DESC LIMIT 1), 6) AS accuracy_threshold,
                round(max(f1), 6) AS best_f1,
                round((SELECT score FROM x ORDER BY f1 DESC, score DESC LIMIT 1), 6) AS f1_threshold,
                round(sum(ap), 6) AS average_precision FROM x""")
def q_binary_eval(spark, sf_dir):
    """Best-threshold accuracy / F1 and average precision of pair cosine for the same-class label."""
    return pair_ops.binary_eval(pair_ops.cosine_pairs(_pairs(spark, sf_dir)))


@register("max_seq_length", sql.with_(sql.corpus_ctes(LEX_FIELDS))
          + f"SELECT max(greatest(len({sql.tok('title')}), len({sql.tok('body')}))) AS max_seq_length FROM corpus")
def q_max_seq_length(spark, sf_dir):
    """The longest token count over the title and body of all documents."""
    c = inputs.corpus(spark, sf_dir)
    return c.agg(F.max(max_token_length("title", "body")).cast("long").alias("max_seq_length"))


SPACE = {"k1": {"type": "float", "low": 0.5, "high": 2.0, "step": 0.1},
         "b": {"type": "float", "low": 0.0, "high": 1.0, "step": 0.05}}
N_SETTINGS = 6
SWEEP_METRICS = ["ndcg@10", "map@1000"]


def _grid_sql() -> str:
    u = lambda name: f"({_md5_int(f'md5({chr(39)}42|{name}|{chr(39)} || CAST(i AS VARCHAR))', 1, 13)} / 4503599627370496.0)"
    return (f"grid AS (SELECT i AS setting, 0.5::DOUBLE + floor({u('k1')} * 16) * 0.1::DOUBLE AS k1, "
            f"0.0::DOUBLE + floor({u('b')} * 21) * 0.05::DOUBLE AS b FROM range({N_SETTINGS}) r(i))")


def _sweep_ctes() -> list[str]:
    specs = [ev.parse_metric(m) for m in SWEEP_METRICS]
    return [sql.corpus_ctes(("body",)), sql.topics_cte(), _grid_sql(),
            f"""qt AS (SELECT topic_id, term, count(*) AS qtf FROM (SELECT topic_id, unnest({sql.tok('text')}) AS term
                       FROM topics WHERE facet_pos = 0) GROUP BY topic_id, term)""",
            """weights AS (SELECT g.setting, g.k1, g.b, q.topic_id, 'body' AS field, q.term, f.avgdl,
                                  q.qtf * ln(1 + (f.n_docs - t.df + 0.5) / (t.df + 0.5)) AS wt
                           FROM qt q JOIN tstats t ON t.field = 'body' AND t.term = q.term
                           JOIN fstats f ON f.field = 'body', grid g)""",
            """scores AS (SELECT w.setting, w.topic_id, p.doc_id,
                                 sum(w.wt * (p.tf * (w.k1 + 1)) / (p.tf + w.k1 * (1 - w.b + w.b * p.dl / w.avgdl))) AS score
                          FROM postings p JOIN weights w USING (field, term) GROUP BY w.setting, w.topic_id, p.doc_id)""",
            sql.rank_cte("run", "scores", EVAL_DEPTH, part="setting, topic_id"), sql.qrels_ctes(),
            sql.eval_ctes("run", EVAL_DEPTH, keys="setting, "),
            "results AS (" + sql.metrics_union(specs, keys="setting, ", rnd=False) + ")"]


def _sweep_results(spark, sf_dir):
    index = inputs.corpus_index(spark, sf_dir, ("body",))
    return sweep_ops.sweep(index, inputs.topics(spark, sf_dir), inputs.qrels(spark, sf_dir, index), SPACE,
                           N_SETTINGS, SWEEP_METRICS, seed=42)


@register("param_sweep", sql.with_(*_sweep_ctes())
          + "SELECT setting, topic_id, metric, depth, round(value, 6) AS value FROM results")
def q_param_sweep(spark, sf_dir):
    """Six seeded (k1, b) settings scored in one pass and evaluated per setting and topic."""
    return _round(_sweep_results(spark, sf_dir), "value")


@register("sweep_best", sql.with_(*_sweep_ctes(), """means AS (SELECT setting, avg(value) AS mean_value FROM results
                                                                WHERE metric = 'ndcg' AND depth = 10 GROUP BY setting)""",
                                   "best AS (SELECT * FROM means JOIN grid USING (setting) ORDER BY round(mean_value, 9) DESC, setting LIMIT 1)")
          + """SELECT (SELECT count(*) FROM means) AS n_trials, round(mean_value, 6) AS best_value, setting AS best_setting,
                      k1 AS best_k1, b AS best_b FROM best""")
def q_sweep_best(spark, sf_dir):
    """Number of settings, best mean ndcg@10 and the best setting's k1 and b."""
    params = sweep_ops.param_grid(spark, SPACE, N_SETTINGS, 42)
    return sweep_ops.sweep_summary(_sweep_results(spark, sf_dir), params, "ndcg", 10)


@register("sweep_cv", sql.with_(*_sweep_ctes(), f"""tf AS (SELECT item_id AS topic_id,
                                    CAST({_md5_int("md5('42|' || CAST(item_id AS VARCHAR))", 1, 8)} % 3 AS INTEGER) AS fold FROM benchmark)""",
                                 """r AS (SELECT setting, fold, value, f.test_fold FROM results JOIN tf USING (topic_id),
                                          range(3) f(test_fold) WHERE metric = 'ndcg' AND depth = 10)""",
                                 """agg AS (SELECT test_fold, setting, avg(CASE WHEN fold <> test_fold THEN value END) AS train_mean,
                                                   avg(CASE WHEN fold = test_fold THEN value END) AS test_mean
                                            FROM r GROUP BY test_fold, setting)""",
                                 """b AS (SELECT *, row_number() OVER (PARTITION BY test_fold ORDER BY round(train_mean, 9) DESC, setting) AS rn
                                          FROM agg WHERE train_mean IS NOT NULL)""")
          + """SELECT CAST(test_fold AS INTEGER) AS test_fold, setting AS best_setting, round(train_mean, 6) AS train_mean,
                      round(test_mean, 6) AS test_mean FROM b WHERE rn = 1""")
def q_sweep_cv(spark, sf_dir):
    """Per held-out fold of 3 seeded topic folds, the setting best on the other folds and its held-out ndcg@10."""
    folds = fold_ops.kfolds(inputs.topics(spark, sf_dir).select("topic_id"), "topic_id", 3, 42)
    return sweep_ops.sweep_cv(_sweep_results(spark, sf_dir), folds, "ndcg", 10, 3).withColumn(
        "test_fold", F.col("test_fold").cast("int"))


FIELD_SETS = {"title": ["title"], "body": ["body"], "title+body": ["title", "body"]}


@register("ablation_grid", sql.with_(sql.corpus_ctes(LEX_FIELDS), sql.topics_cte(), sql.bm25_ctes(LEX_FIELDS, by_field=True),
                                      "v AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{f}')" for n, fs in FIELD_SETS.items() for f in fs)
                                      + ") t(variant, field))",
                                      "vs AS (SELECT v.variant, s.topic_id, s.doc_id, sum(s.score) AS score FROM scores s JOIN v USING (field) GROUP BY 1, 2, 3)",
                                      sql.rank_cte("run", "vs", TOPK, part="variant, topic_id"))
          + "SELECT variant, topic_id, doc_id, rank, round(score, 6) AS score FROM run")
def q_ablation_grid(spark, sf_dir):
    """G1: per-field BM25 computed once, summed per field set (title, body, title+body), top 10 per variant."""
    index = inputs.corpus_index(spark, sf_dir, LEX_FIELDS)
    out = sweep_ops.ablation_grid(index, inputs.topics(spark, sf_dir), FIELD_SETS, k=TOPK)
    return _round(out, "score").select("variant", "topic_id", "doc_id", "rank", "score")


# ---------------------------------------------------------------- step 8: incremental work

#: Micro-batches that the files of one arrival are dealt over; a batch's files are read in parallel.
STREAM_BATCHES = 4


@register("encode_incremental", sql.with_(
    sql.corpus_ctes(LEX_FIELDS),
    "store AS (SELECT DISTINCT sha256(title) AS text_key FROM corpus WHERE title IS NOT NULL)",
    """fresh AS (SELECT DISTINCT body FROM corpus WHERE body IS NOT NULL
                 AND sha256(body) NOT IN (SELECT text_key FROM store))""",
    sql.hash_vec_ctes("hv", "fresh", "body", "body"))
    + """SELECT sha256(body) AS text_key, len(list_filter(vec, lambda x: x > 0)) AS nnz,
                round(list_max(vec), 6) AS max_weight FROM hv""")
def q_encode_incremental(spark, sf_dir):
    """A store holds the vectors of every title; bodies are encoded only when their text is unseen."""
    corpus = inputs.corpus(spark, sf_dir)
    enc_id = f"hash-md5-{DIM}"
    titles = corpus.select(F.col("title").alias("text")).where(F.col("text").isNotNull()).distinct()
    store = dense_ops.hash_encode(titles.withColumn("encoder_id", F.lit(enc_id))
                                  .withColumn("text_key", dense_ops.text_key("text")), "text", DIM,
                                  keep=["encoder_id", "text_key"])
    new = dense_ops.encode_incremental(corpus.select(F.col("body").alias("text")), store, enc_id, "text", DIM)
    return new.select("text_key", F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("nnz"),
                      F.round(F.array_max("embedding"), 6).alias("max_weight"))


def _streamed(spark, *arrivals: DataFrame) -> str:
    """Index the arrivals, one after the other, each in several micro-batches; the index's folder."""
    out, ckpt = scratch_path(spark, "stream-index"), scratch_path(spark, "stream-index-ckpt")
    folder = scratch_path(spark, "docs-stream")
    for docs in arrivals:
        docs.write.option("parquet.block.size", 8 << 20).mode("append").parquet(folder)  # row groups enough for all cores in each micro-batch
        files = max(1, -(-len(spark.read.parquet(folder).inputFiles()) // STREAM_BATCHES))
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files).parquet(folder)
        inc.stream_index(stream, out, ckpt, "version", LEX_FIELDS, dim=DIM).awaitTermination()
    return out


@register("stream_index_stats", ORACLE["index_stats"])
def q_stream_index_stats(spark, sf_dir):
    """Documents arrive as files in several micro-batches; the streamed index's statistics."""
    idx = inc.read_stream_index(spark, _streamed(spark, inputs.corpus(spark, sf_dir).select("doc_id", "title", "body")
                                                 .withColumn("version", F.lit(1).cast("long"))))
    per_field = idx.term_stats.groupBy("field").agg(F.count(F.lit(1)).alias("n_terms"),
                                                    F.sum("df").cast("long").alias("n_postings"))
    return (idx.field_stats.join(per_field, "field")
            .select("field", "n_docs", F.round("avgdl", 6).alias("avgdl"), "n_terms", "n_postings"))


@register("stream_topics_bm25", ORACLE["bm25_topk"])
def q_stream_topics_bm25(spark, sf_dir):
    """Topics arrive as a stream of files; each micro-batch ranked (BM25 top 10) against a stored index."""
    idx_path = scratch_path(spark, "index")
    inputs.corpus_index(spark, sf_dir, ("body",)).write(idx_path)
    index = Index.read(spark, idx_path)
    src = scratch_path(spark, "topics-stream")
    inputs.topics(spark, sf_dir).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    out, ckpt = scratch_path(spark, "topic-runs"), scratch_path(spark, "topic-runs-ckpt")
    inc.score_topic_stream(stream, index, out, ckpt, ("body",), k=TOPK).awaitTermination()
    return _round(inc.read_topic_runs(spark, out), "score").select("topic_id", "doc_id", "rank", "score")
