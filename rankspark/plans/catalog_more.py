"""More registered queries: readers, reshaping helpers and options that the first catalogue does not run.

Same form as ``catalog``: name → (Spark job over the driver's tables, DuckDB twin).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.functions import columns as colf
from rankspark.functions.vectors import dot
from rankspark.operators import dense as dense_ops
from rankspark.operators import evaluate as ev
from rankspark.operators import folds as fold_ops
from rankspark.operators import hybrid as hybrid_ops
from rankspark.operators import rerank as rr
from rankspark.operators import sweep as sweep_ops
from rankspark.operators.runs import concat_examples, select_ids
from rankspark.plans import catalog as base
from rankspark.plans import inputs
from rankspark.plans import oracle as sql
from rankspark.plans.catalog import (DIM, EMB_FIELDS, EVAL_DEPTH, LEX_FIELDS, RERANK_DEPTH, TOPK, _hybrid_query, _hybrid_sql,
                                     _round, body_run, register)
from rankspark.session import scratch_path
from rankspark.sources import corpus as corpus_src
from rankspark.sources import topics as topic_src
from rankspark.sources import trec
from rankspark.streaming import incremental as inc

# ---------------------------------------------------------------- readers and writers


@register("docs_xml", """SELECT doc_id, 'document ' || doc_id AS "summary.textblock", source || ' ' || coalesce(lang, '') AS keyword, lang
                         FROM documents WHERE lang IS NOT NULL""")
def q_docs_xml(spark, sf_dir):
    """Documents written as XML with a nested section and a repeated tag, read back flattened and unwrapped.

    Spark names the files, so the id from the file name is checked in a unit test; the row carries its own.
    """
    path = scratch_path(spark, "docs-xml")
    d = inputs.table(spark, sf_dir, "documents").where(F.col("lang").isNotNull())
    (d.select(F.struct(F.concat(F.lit("document "), "doc_id").alias("textblock")).alias("summary"), F.array("source", "lang").alias("keyword"),
              "lang", F.col("doc_id").alias("own_id")).write.format("xml").option("rowTag", "doc").option("rootTag", "docs").save(path))
    out = corpus_src.read_docs_xml(spark, path, "doc", ["summary", "keyword", "lang", "own_id", "absent"])
    return out.select(F.col("own_id").cast("long").alias("doc_id"), F.col("`summary.textblock`"), "keyword", "lang")


_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


@register("topics_positional", "SELECT CAST(item_id AS VARCHAR) AS topic_id, 'text' AS facet, 0 AS facet_pos, text FROM benchmark WHERE text IS NOT NULL")
def q_topics_positional(spark, sf_dir):
    """Topics by position from a CSV file whose header names say nothing."""
    path = scratch_path(spark, "topics-pos")
    inputs.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("whatever"), F.col("text").alias("header")).write.options(**_CSV).csv(path)
    return topic_src.read_topics_csv(spark, path, positional=True)


@register("posts_csv", "SELECT CAST(doc_id AS VARCHAR) AS id, sha256(text) AS text_key FROM documents WHERE text IS NOT NULL AND text <> ''")
def q_posts_csv(spark, sf_dir):
    """Documents written as forum submissions (CSV) and read back, keyed by id."""
    path = scratch_path(spark, "posts-csv")
    d = inputs.table(spark, sf_dir, "documents").where(F.length("text") > 0)
    d.select(F.col("doc_id").alias("id"), F.col("text").alias("body")).write.options(**_CSV).csv(path)
    return corpus_src.read_posts(spark, path).select("id", F.sha2("text", 256).alias("text_key"))


@register("corpus_scan", "SELECT lang, source, count(*) AS n_docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang, source")
def q_corpus_scan(spark, sf_dir):
    """Full scan of the corpus, documents and characters per language and source."""
    d = corpus_src.read_corpus(spark, f"{sf_dir}/documents.parquet")
    return d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).cast("long").alias("chars"))


@register("pairs_first", """SELECT doc_id, quality, CAST(floor(toxic / 2.0) AS INTEGER) AS toxic FROM
                            (SELECT * FROM labels ORDER BY doc_id LIMIT 100) WHERE floor(toxic / 2.0) <> -1""")
def q_pairs_first(spark, sf_dir):
    """The first 100 labelled rows by id (the limit is the feature), label halved, -1 dropped."""
    return corpus_src.load_pairs(inputs.table(spark, sf_dir, "labels"), ["quality"], "toxic", "doc_id", limit=100)


@register("run_lines_custom", sql.with_(sql.corpus_ctes(), sql.topics_cte(), sql.bm25_ctes(), sql.rank_cte("r", "scores", TOPK))
          + """SELECT topic_id, rank, concat_ws(chr(9), topic_id, 'Q0', doc_id, rank, printf('%.6f', score), 'NO_RUN_NAME') AS value
               FROM (SELECT topic_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY topic_id ORDER BY doc_id DESC) AS rank FROM r)""")
def q_run_lines_custom(spark, sf_dir):
    """Run lines renumbered in a custom order (document id, descending)."""
    run = _round(body_run(spark, sf_dir, TOPK), "score")
    return trec.format_run(run, order_by=[F.col("doc_id").desc()])


# ---------------------------------------------------------------- reshaping helpers

@register("facet_path", "SELECT event_id, value AS ev_detail_value FROM events")
def q_facet_path(spark, sf_dir):
    """A nested value by its underscored path."""
    detail = F.struct(F.col("value").alias("value"), F.lit("x").alias("Textblock")).alias("detail")
    df = inputs.table(spark, sf_dir, "events").select("event_id", F.struct(F.col("event_type").alias("kind"), detail).alias("ev"))
    return df.select("event_id", colf.facet(df, "ev_detail_value"))


@register("public_facets", "SELECT event_id, event_type FROM events")
def q_public_facets(spark, sf_dir):
    """P5: columns that do not start with an underscore."""
    return colf.public_facets(inputs.table(spark, sf_dir, "events").select("event_id", "event_type", F.col("value").alias("_value")))


@register("unwrap", """SELECT conv_id, string_agg(role, ' ' ORDER BY role) AS "r.oles" FROM (SELECT DISTINCT conv_id, role FROM conversations) GROUP BY conv_id""")
def q_unwrap(spark, sf_dir):
    """P10: arrays of one element become the element, longer ones are joined (column name with a dot)."""
    df = inputs.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_set("role")).alias("r.oles"))
    return colf.unwrap_singletons(df)


@register("field_text", "SELECT event_id, 'block ' || event_type AS ev_text FROM events WHERE event_type IS NOT NULL AND event_id % 2 = 1")
def q_field_text(spark, sf_dir):
    """The ``Textblock`` child is the text to encode; rows that have a vector are skipped."""
    df = inputs.table(spark, sf_dir, "events").select(
        "event_id", F.struct(F.lit(1).alias("n"), F.concat(F.lit("block "), "event_type").alias("Textblock")).alias("ev"),
        F.when(F.col("event_id") % 2 == 0, F.array(F.lit(1.0))).alias("ev_embedding"))
    return colf.texts_to_encode(df, "ev", "ev_embedding").select("event_id", "ev_text")


@register("text_facets", "SELECT vec_id, label FROM embeddings")
def q_text_facets(spark, sf_dir):
    """The columns that are not embedding columns."""
    df = inputs.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("body_Embedding"))
    return df.select(*colf.text_facets(df))


@register("relevance_scale", "SELECT doc_id, quality / 2.0 AS relevance FROM labels")
def q_relevance_scale(spark, sf_dir):
    """Graded labels scaled to 0-1 (highest grade 2)."""
    return inputs.table(spark, sf_dir, "labels").select("doc_id", colf.relevance("quality", 2.0).alias("relevance"))


@register("concat_examples", """SELECT 'b' || item_id AS id, text, 1.0 AS label FROM benchmark
                                UNION ALL SELECT 'b' || item_id, text, 1.0 FROM benchmark UNION ALL SELECT 'd' || doc_id, source, quality::DOUBLE
                                FROM documents JOIN labels USING (doc_id)""")
def q_concat_examples(spark, sf_dir):
    """Example sets with a constant and a column label, concatenated without dropping repeats."""
    b = inputs.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("i"), "text")
    d = inputs.table(spark, sf_dir, "documents").join(inputs.table(spark, sf_dir, "labels"), "doc_id").select(
        F.concat(F.lit("d"), "doc_id").alias("i"), "source", "quality")
    x, y = colf.to_examples(b, ["text"], "i", label=1.0), colf.to_examples(d, ["source"], "i", "quality")
    return concat_examples(x, x, y).select("id", F.col("texts")[0].alias("text"), "label")


@register("topics_numeric", "SELECT item_id AS topic_id, 'text' AS facet, 0 AS facet_pos, text FROM benchmark WHERE text IS NOT NULL")
def q_topics_numeric(spark, sf_dir):
    """topic ids made of digits only become numbers."""
    return topic_src.numeric_ids(base.q_topics_tsv(spark, sf_dir))


@register("enrich_corpus", sql.with_(
    "docs AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(13) || chr(10) || chr(13) || chr(10), chr(10)), '\\r\\n', ' ', 'g'), ' {2,}', ' ', 'g') AS body FROM documents)",
    sql.hash_vec_ctes("hv", "docs", "doc_id", "body"))
    + """SELECT doc_id, sha256(body) AS text_key, len(list_filter(vec, lambda x: x > 0)) AS nnz, round(list_max(vec), 6) AS max_weight
         FROM docs JOIN hv USING (doc_id)""")
def q_enrich_corpus(spark, sf_dir):
    """A new corpus version with cleaned text and its vector, written and read back."""
    path = scratch_path(spark, "corpus-v2")
    corpus_src.enrich_corpus(inputs.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body")), ["body"], path, dim=DIM)
    return _vector_summary(spark.read.parquet(path))


def _vector_summary(df, text="body", vec="body_embedding"):
    return df.select("doc_id", F.sha2(text, 256).alias("text_key"), F.size(F.filter(vec, lambda x: x > 0)).cast("long").alias("nnz"),
                     F.round(F.array_max(vec), 6).alias("max_weight"))


@register("encode_object", base.ORACLE["hash_encode"])
def q_encode_object(spark, sf_dir):
    """The same vectors through a pluggable encoder object (one call per Arrow batch)."""
    v = dense_ops.encode(inputs.corpus(spark, sf_dir), "body", dense_ops.HashEncoder(DIM), keep=["doc_id"])
    idx = F.sequence(F.lit(0), F.lit(DIM - 1))
    return v.select("doc_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("nnz"), F.round(F.array_max("embedding"), 6).alias("max_weight"),
                    F.round(F.aggregate(F.zip_with(idx, "embedding", lambda i, x: i * x), F.lit(0.0), lambda a, x: a + x), 6).alias("checksum"))


_FIRST = """first AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'),
              lambda s: trim(regexp_replace(s, '[ \\t\\n\\f\\r\\x0B]+', ' ', 'g'))), lambda s: length(s) > 0)[1] AS s FROM documents)"""


@register("encode_first", sql.with_(_FIRST, sql.hash_vec_ctes("hv", "first", "doc_id", "s"))
          + "SELECT doc_id, len(list_filter(vec, lambda x: x > 0)) AS nnz, round(list_max(vec), 6) AS max_weight FROM hv")
def q_encode_first(spark, sf_dir):
    """First-sentence pooling."""
    v = dense_ops.hash_encode(inputs.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", DIM, keep=["doc_id"], pooling="first")
    return v.where(F.col("embedding").isNotNull()).select("doc_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("nnz"),
                                                          F.round(F.array_max("embedding"), 6).alias("max_weight"))


# ---------------------------------------------------------------- folds

@register("contiguous_folds_wide", """SELECT *, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) * 3 / (SELECT count(*) FROM documents)) AS INTEGER) AS fold FROM documents""")
def q_contiguous_folds_wide(spark, sf_dir):
    """Whole documents, all columns kept, cut into exactly 3 contiguous folds."""
    return fold_ops.contiguous_folds(inputs.table(spark, sf_dir, "documents"), "doc_id", 3, "doc_id")


@register("split_fold", f"""SELECT doc_id, CAST({base._md5_int(base._KFOLD_KEY, 1, 8)} % 5 AS INTEGER) = 2 AS validation FROM documents""")
def q_split_fold(spark, sf_dir):
    """Train and validation tables of fold 2, told apart by a flag."""
    train, valid = fold_ops.split_fold(fold_ops.kfolds(inputs.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 5, 42), 2)
    return train.select("doc_id", F.lit(False).alias("validation")).unionAll(valid.select("doc_id", F.lit(True).alias("validation")))


# ---------------------------------------------------------------- runs and scores

@register("run_ids", sql.with_(sql.corpus_ctes(), sql.topics_cte(), sql.bm25_ctes(), sql.rank_cte("run", "scores", TOPK))
          + "SELECT topic_id, doc_id, rank, round(score, 6) AS score FROM run")
def q_run_ids(spark, sf_dir):
    """Ids, rank and score of a run that carries more columns, topics in order."""
    run = _round(body_run(spark, sf_dir, TOPK), "score").withColumn("snippet", F.lit("..."))
    return select_ids(run).orderBy("topic_id", "rank")


register("hybrid_negative_z", _hybrid_sql(z=-1.0))(_hybrid_query(z=-1.0))
#: Above the best BM25 of some topics and below that of others in every table.
CEILING = 60.0
register("hybrid_low_top", _hybrid_sql(ceiling=CEILING))(_hybrid_query(ceiling=CEILING))

GUARD_BOOSTS = {"title": 1.0, "body": -1.0}


@register("hybrid_guard", _hybrid_sql(z=2.15, boosts=GUARD_BOOSTS, log="CASE WHEN {bm25} <= 0 THEN 0.0 ELSE ln({bm25}) / ln({z}) END"))
def q_hybrid_guard(spark, sf_dir):
    """Guarded log with a fixed z; the body counts against the title, so most sums are negative and the guard acts."""
    run = hybrid_ops.hybrid(inputs.corpus_index(spark, sf_dir, LEX_FIELDS), inputs.topics(spark, sf_dir), base._topic_hash_vectors(spark, sf_dir),
                            base._doc_hash_vectors(spark, sf_dir), LEX_FIELDS, EMB_FIELDS, z=2.15, guard=True, boosts=GUARD_BOOSTS, k=10)
    return _round(run.select("topic_id", "doc_id", "rank", "score", "bm25", "embed", "z"), "score", "bm25", "embed", "z")


@register("hybrid_score_fn", _hybrid_sql(final="{bm25} / ({bm25} + 4.0 * {z}) + 0.5 * {embed} + 0.125 * {log}"))
def q_hybrid_score_fn(spark, sf_dir):
    """U4: a user's expression over bm25, z, the log term and the embedding part replaces the score."""
    run = hybrid_ops.hybrid(inputs.corpus_index(spark, sf_dir, LEX_FIELDS), inputs.topics(spark, sf_dir), base._topic_hash_vectors(spark, sf_dir),
                            base._doc_hash_vectors(spark, sf_dir), LEX_FIELDS, EMB_FIELDS, k=10,
                            score_fn=lambda p: p["bm25"] / (p["bm25"] + 4.0 * p["z"]) + 0.5 * p["embed"] + 0.125 * p["log_bm25"])
    return _round(run.select("topic_id", "doc_id", "rank", "score", "bm25", "embed", "z"), "score", "bm25", "embed", "z")


@register("low_topics", sql.with_(sql.corpus_ctes(LEX_FIELDS), sql.topics_cte(), sql.bm25_ctes(LEX_FIELDS, facets="first"))
          + f"SELECT topic_id, round(max(score), 6) AS top_bm25 FROM scores GROUP BY topic_id HAVING max(score) <= {CEILING}")
def q_low_topics(spark, sf_dir):
    """The topics that the automatic z leaves out at a high ceiling."""
    return _round(hybrid_ops.low_topics(inputs.corpus_index(spark, sf_dir, LEX_FIELDS), inputs.topics(spark, sf_dir), CEILING, LEX_FIELDS), "top_bm25")


def _rerank_sql(score: str, weights=(1.0, 1.0)) -> str:
    sim = " + ".join(f"(CASE WHEN dv.{e} IS NULL THEN 0.0 ELSE {w} * {score.format(q='tv.vec', d='dv.' + e)} END)" for e, w in zip(EMB_FIELDS, weights) if w)
    return (sql.with_(sql.corpus_ctes(LEX_FIELDS), sql.topics_cte(), sql.bm25_ctes(("body",)), sql.rank_cte("first", "scores", RERANK_DEPTH),
                      sql.hash_vec_ctes("tv", "topics", "topic_id", "text"), sql.hash_vec_ctes("hdoc", "flong", "doc_id, field", "text"),
                      """dv AS (SELECT c.doc_id, t.vec AS title_embedding, b.vec AS body_embedding FROM corpus c
                                LEFT JOIN hdoc t ON t.doc_id = c.doc_id AND t.field = 'title' LEFT JOIN hdoc b ON b.doc_id = c.doc_id AND b.field = 'body')""",
                      f"sc AS (SELECT f.topic_id, f.doc_id, f.score AS first_score, {sim} AS score FROM first f JOIN tv USING (topic_id) JOIN dv USING (doc_id))",
                      sql.rank_cte("run", "sc", None))
            + "SELECT topic_id, doc_id, rank, round(score, 6) AS score, round(first_score, 6) AS first_score FROM run")


@register("rerank_weights", _rerank_sql(sql.cos("{q}", "{d}"), (0.0, 0.5)))
def q_rerank_weights(spark, sf_dir):
    """A zero weight drops its field, the other field weighs 0.5; only the run's documents are encoded."""
    run = body_run(spark, sf_dir, RERANK_DEPTH)
    out = rr.rerank_dense(run, base._run_hash_vectors(spark, sf_dir, run), base._topic_hash_vectors(spark, sf_dir), EMB_FIELDS,
                          {"title_embedding": 0.0, "body_embedding": 0.5})
    return _round(out.select("topic_id", "doc_id", "rank", "score", "first_score"), "score", "first_score")


@register("rerank_custom", _rerank_sql("(2.0 * list_dot_product({q}, {d}) - 1.0)"))
def q_rerank_custom(spark, sf_dir):
    """Re-ranking by a user's distance function of two Columns."""
    run = body_run(spark, sf_dir, RERANK_DEPTH)
    out = rr.rerank_dense(run, base._run_hash_vectors(spark, sf_dir, run), base._topic_hash_vectors(spark, sf_dir), EMB_FIELDS,
                          similarity_metric=lambda q, d: F.lit(2.0) * dot(q, d) - F.lit(1.0))
    return _round(out.select("topic_id", "doc_id", "rank", "score", "first_score"), "score", "first_score")


@register("rerank_generic", sql.with_(sql.corpus_ctes(), sql.topics_cte(), sql.bm25_ctes(), sql.rank_cte("first", "scores", RERANK_DEPTH),
                                      "sc AS (SELECT topic_id, doc_id, score AS first_score, score / sqrt(rank) - doc_id % 3 AS score FROM first)", sql.rank_cte("run", "sc", None))
          + "SELECT topic_id, doc_id, rank, round(score, 6) AS score, round(first_score, 6) AS first_score FROM run")
def q_rerank_generic(spark, sf_dir):
    """Re-ranking by a Column over the run's rows."""
    run = body_run(spark, sf_dir, RERANK_DEPTH).withColumn("place", F.col("rank"))
    out = rr.rerank(run, lambda r: F.col("score") / F.sqrt(F.col("place")) - F.col("doc_id") % 3)
    return _round(out.select("topic_id", "doc_id", "rank", "score", "first_score"), "score", "first_score")


@register("dense_topk_odd", sql.with_(
    """e AS (SELECT vec_id, CASE vec_id % 10 WHEN 0 THEN NULL WHEN 1 THEN list_transform(embedding, lambda x: 0.0)::DOUBLE[]
             WHEN 2 THEN list_transform(embedding, lambda x: 1.0)::DOUBLE[] ELSE embedding::DOUBLE[] END AS v FROM embeddings)""",
    f"sc AS (SELECT q.vec_id AS topic_id, d.vec_id AS doc_id, {sql.cos('q.v', 'd.v')} AS score FROM e q, e d WHERE q.v IS NOT NULL AND d.v IS NOT NULL)",
    sql.rank_cte("run", "sc", TOPK)) + "SELECT topic_id, doc_id, rank, round(score, 6) AS score FROM run")
def q_dense_topk_odd(spark, sf_dir):
    """R24 with missing, zero and equal vectors: missing ones take no part, ties are cut by id."""
    m = F.col("doc_id") % 10
    e = inputs.doc_vectors(spark, sf_dir).select("doc_id", F.when(m == 1, F.transform("embedding", lambda x: x * 0)).when(
        m == 2, F.transform("embedding", lambda x: x * 0 + 1)).when(m > 2, F.col("embedding")).alias("embedding"))
    out = dense_ops.dense_topk(e.select(F.col("doc_id").alias("topic_id"), "embedding"), e, k=TOPK)
    return _round(out, "score").select("topic_id", "doc_id", "rank", "score")


# ---------------------------------------------------------------- evaluation, sweeps, streams

_COMPLETE = [ev.parse_metric(m) for m in ("p@10", "ndcg@10")]


@register("eval_complete", sql.with_(
    sql.corpus_ctes(), sql.topics_cte(), sql.bm25_ctes(), sql.rank_cte("r0", "scores", EVAL_DEPTH),
    "run AS (SELECT 0 AS setting, * FROM r0 UNION ALL SELECT 1, * FROM r0 WHERE topic_id % 2 = 0)", sql.qrels_ctes(), sql.eval_ctes("run", 10, keys="setting, "),
    "found AS (" + sql.metrics_union(_COMPLETE, keys="setting, ") + ")",
    "wanted AS (SELECT topic_id, setting, metric, depth FROM totals, (SELECT DISTINCT setting FROM run), (VALUES ('p', 10), ('ndcg', 10)) m(metric, depth))")
    + "SELECT topic_id, setting, metric, depth, coalesce(value, 0.0) AS value FROM wanted LEFT JOIN found USING (topic_id, setting, metric, depth)")
def q_eval_complete(spark, sf_dir):
    """A1 with settings: a setting that retrieves nothing for a judged topic scores 0 there."""
    index = inputs.corpus_index(spark, sf_dir, ("body",))
    run = body_run(spark, sf_dir, index=index)
    both = run.withColumn("setting", F.lit(0)).unionByName(run.where(F.col("topic_id") % 2 == 0).withColumn("setting", F.lit(1)))
    return ev.evaluate(both, inputs.qrels(spark, sf_dir, index), ["p@10", "ndcg@10"], complete=True, keys=("setting",))


LEX_SETS = {"body": ("body",), "both": LEX_FIELDS}
EMB_SETS = {"title": EMB_FIELDS[:1], "both": EMB_FIELDS}


def _ablation_sql() -> str:
    parts = []
    for lex, fields in LEX_SETS.items():
        base_run = _hybrid_sql(TOPK, z=-1.0, boosts={f: float(f in fields) for f in LEX_FIELDS}, facets="first")
        parts.append(f"SELECT 'baseline-{lex}' AS variant, topic_id, doc_id, rank, score FROM ({base_run})")
        for emb, vectors in EMB_SETS.items():
            one = _hybrid_sql(TOPK, boosts={f: float(f in fields) for f in LEX_FIELDS}, weights={e: float(e in vectors) for e in EMB_FIELDS},
                              ceiling=len(vectors), facets="first")
            parts.append(f"SELECT 'embedding-{lex}-{emb}' AS variant, topic_id, doc_id, rank, score FROM ({one})")
    return " UNION ALL ".join(parts)


@register("ablation_hybrid", _ablation_sql())
def q_ablation_hybrid(spark, sf_dir):
    """G1: baseline and embedding queries, two lexical and two embedding field sets: the top 10 of every variant, in one pass."""
    out = sweep_ops.ablation_hybrid(inputs.corpus_index(spark, sf_dir, LEX_FIELDS), inputs.topics(spark, sf_dir), base._topic_hash_vectors(spark, sf_dir),
                                    base._doc_hash_vectors(spark, sf_dir), LEX_SETS, EMB_SETS, k=TOPK)
    return _round(out.select("variant", "topic_id", "doc_id", "rank", "score"), "score")


HYBRID_SETTINGS = [{"z": 2.0, "weights": {"title_embedding": 1.0, "body_embedding": 1.0}}, {"z": 3.5, "weights": {"title_embedding": 0.25, "body_embedding": 2.0}}]


def _sweep_hybrid_sql() -> str:
    runs = [f"r{i} AS (SELECT {i}::BIGINT AS setting, topic_id, doc_id, rank FROM ({_hybrid_sql(EVAL_DEPTH, z=s['z'], weights=s['weights'])}))"
            for i, s in enumerate(HYBRID_SETTINGS)]
    return (sql.with_(sql.corpus_ctes(), *runs, "run AS (" + " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(len(runs))) + ")", sql.qrels_ctes(),
                      sql.eval_ctes("run", 10, keys="setting, "), "found AS (" + sql.metrics_union(_COMPLETE, keys="setting, ", rnd=False) + ")",
                      "wanted AS (SELECT topic_id, setting, metric, depth FROM totals, (SELECT DISTINCT setting FROM run), (VALUES ('p', 10), ('ndcg', 10)) m(metric, depth))")
            + "SELECT topic_id, setting, metric, depth, round(coalesce(value, 0.0), 6) AS value FROM wanted LEFT JOIN found USING (topic_id, setting, metric, depth)")


@register("sweep_hybrid", _sweep_hybrid_sql())
def q_sweep_hybrid(spark, sf_dir):
    """Two settings of z and embedding weights, evaluated per topic."""
    index = inputs.corpus_index(spark, sf_dir, LEX_FIELDS)
    out = sweep_ops.sweep_hybrid(index, inputs.topics(spark, sf_dir), base._topic_hash_vectors(spark, sf_dir), base._doc_hash_vectors(spark, sf_dir),
                                 inputs.qrels(spark, sf_dir), HYBRID_SETTINGS, ["p@10", "ndcg@10"], LEX_FIELDS, EMB_FIELDS)
    return _round(out, "value")


SPACE = {"w": {"type": "discrete_uniform", "low": 0.0, "high": 1.0, "q": 0.25}, "z": {"type": "loguniform", "low": 1.1, "high": 4.0},
         "n": {"type": "int", "low": 1, "high": 5}, "s": {"type": "categorical", "choices": ["a", "b", "c"]}, "c": 7}


def _uniform(name: str) -> str:
    return f"({base._md5_int(f'''md5('42|{name}|' || d.doc_id)''', 1, 13)} / {float(16 ** 13)})"


@register("grid_types", f"""SELECT doc_id AS setting, 0.0 + floor({_uniform('w')} * 5) * 0.25 AS w,
          round(exp(ln(1.1) + {_uniform('z')} * (ln(4.0) - ln(1.1))), 6) AS z, CAST(floor(1.0 + {_uniform('n')} * 5.0) AS BIGINT) AS n,
          ['a', 'b', 'c'][CAST(floor({_uniform('s')} * 3) AS INTEGER) + 1] AS s, 7 AS c FROM documents d WHERE doc_id < (SELECT count(*) FROM documents)""")
def q_grid_types(spark, sf_dir):
    """One setting per document from discrete (with q), log-uniform, integer, categorical and constant parameters."""
    n = inputs.table(spark, sf_dir, "documents").count()
    return sweep_ops.param_grid(spark, SPACE, n).withColumn("z", F.round("z", 6))


@register("stream_index_versions", base.ORACLE["index_stats"])
def q_stream_index_versions(spark, sf_dir):
    """An older version that arrives later does not replace the newer one."""
    docs = inputs.corpus(spark, sf_dir).select("doc_id", "title", "body")
    old = docs.select("doc_id", F.concat(F.lit("old "), "title").alias("title"), F.concat_ws(" ", F.lit("old draft"), "body").alias("body"))
    path = base._streamed(spark, docs.withColumn("version", F.lit(2).cast("long")), old.withColumn("version", F.lit(1).cast("long")))
    idx = inc.read_stream_index(spark, path)
    per_field = idx.term_stats.groupBy("field").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").cast("long").alias("n_postings"))
    return idx.field_stats.join(per_field, "field").select("field", "n_docs", F.round("avgdl", 6).alias("avgdl"), "n_terms", "n_postings")


@register("stream_enrich", base.ORACLE["hash_encode"].split("SELECT doc_id, len(")[0]
          + "SELECT doc_id, len(list_filter(vec, lambda x: x > 0)) AS nnz, round(list_max(vec), 6) AS max_weight FROM hv")
def q_stream_enrich(spark, sf_dir):
    """Streamed documents are cleaned and encoded; the stored vectors of the current versions."""
    docs = inputs.corpus(spark, sf_dir).select("doc_id", "title", "body").withColumn("version", F.lit(1).cast("long"))
    out = inc.read_stream_documents(spark, base._streamed(spark, docs))
    return _vector_summary(out).drop("text_key")
