"""BM25 as a join of query terms with postings and a grouped sum.

Formula [decision] (Robertson & Zaragoza 2009), exact document lengths:
    Σ_t  qtf · boost_f · ln(1 + (N − df + 0.5)/(df + 0.5)) · tf·(k1+1) / (tf + k1·(1 − b + b·dl/avgdl))
summed over the listed fields (a boolean "should" over fields and facets).

Plan: the query vocabulary (topics × terms × fields) is small and is broadcast
after a size check; a left-semi join with it sits right after the token explode,
so only postings of query terms reach the shuffle; the per-(topic, doc) sum is a
partial + final hash aggregate. The per-field statistics are one row per field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.functions.text import explode_tokens, token_count
from rankspark.operators.index import LENGTH_MARKER, Index
from rankspark.operators.sizing import max_broadcast_rows


def select_facets(topics: DataFrame, facets: str = "first") -> DataFrame:
    """Plain BM25 uses the first facet (facet_pos 0); the hybrid uses all."""
    if facets == "first":
        return topics.where(F.col("facet_pos") == 0)
    if facets == "all":
        return topics
    raise ValueError("facets must be 'first' or 'all'")


def query_terms(topics: DataFrame, fields, boosts: dict | None = None, facets: str = "first",
                with_first: bool = False) -> DataFrame:
    """(topic_id, field, term, qw): query-term weight = count over facets × field boost.

    ``with_first=True`` adds ``qw_first``, the same weight counted on the first facet only
    (its terms are a subset of the used facets' terms, so one aggregation gives both).
    """
    boosts = boosts or {}
    t = select_facets(topics, facets)
    aggs = [F.count(F.lit(1)).alias("qtf")]
    if with_first:
        aggs.append(F.sum(F.when(F.col("facet_pos") == 0, 1).otherwise(0)).alias("qtf_first"))
    qt = (t.select("topic_id", "facet_pos", explode_tokens("text").alias("term")).where(F.col("term").isNotNull())
          .groupBy("topic_id", "term").agg(*aggs))
    fb = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(float(boosts.get(f, 1.0))).alias("boost"))
                   for f in fields])
    extra = [(F.col("qtf_first") * F.col("fb.boost")).alias("qw_first")] if with_first else []
    return (qt.select("*", F.explode(fb).alias("fb"))
            .select("topic_id", "fb.field", "term", (F.col("qtf") * F.col("fb.boost")).alias("qw"), *extra)
            .where(F.col("qw") != 0))


def query_size_bound(topics: DataFrame, n_fields: int, n_settings: int = 1) -> int:
    """An upper bound of the query-term rows: topic tokens × fields × settings (one small job)."""
    n_tok = topics.agg(F.sum(token_count("text"))).first()[0] or 0
    return int(n_tok) * n_fields * n_settings + n_fields


def _matched(index: Index, qterms: DataFrame, weights: dict, row_bound: int | None):
    """Shared core: (post, w, field_stats, fits) for the query vocabulary.

    ``post``: matched postings (field, term, doc_id, dl, tf); ``w``: (topic_id, field,
    term, avgdl, <params>, __w_<out>...) with query weight × idf.
    """
    param_cols = [c for c in qterms.columns if c not in ("topic_id", "field", "term", *weights.values())]
    # ``row_bound``: a proven upper bound of qterms' rows from the caller (saves a count job)
    n_q = row_bound if row_bound is not None else qterms.count()
    fits = n_q <= max_broadcast_rows(qterms)
    vocab = qterms.select("field", "term").distinct()
    idf = F.log(F.lit(1.0) + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    if index.raw is not None:
        # one pass: the matched rows (query terms + length markers of the asked fields) give
        # df per term, N and avgdl per field, and the postings to score. Nothing filters
        # ``m`` (a filter would be pushed below the exchange and split it in two); df reads
        # tf (Σ signum(tf) = number of postings) for the same reason, and marker rows fall
        # out of the scoring join because no query term is empty.
        markers = vocab.select("field").distinct().withColumn("term", F.lit(LENGTH_MARKER))
        keys = vocab.unionByName(markers)
        keys = F.broadcast(keys) if fits else keys  # rows <= query-term rows + #fields
        m = index.raw.join(keys, ["field", "term"], "left_semi")
        stats = m.groupBy("field", "term").agg(F.sum(F.signum("tf")).cast("long").alias("df"),
                                               F.avg("dl").alias("mean_dl"))
        is_marker = F.col("term") == LENGTH_MARKER
        field_stats = stats.groupBy("field").agg(
            F.sum(F.when(is_marker, F.col("df"))).alias("n_docs"),
            F.sum(F.when(is_marker, F.col("mean_dl"))).alias("avgdl"))
        df_t = stats.where(F.col("mean_dl") >= 0).select("field", "term", "df")  # reads mean_dl: see note below
        post = m
    else:
        # stored index: the query vocabulary stays distributed; the semi join drops other terms in the scan's task
        vocab = F.broadcast(vocab) if fits else vocab
        post = index.postings.join(vocab, ["field", "term"], "left_semi")
        df_t = index.term_stats.join(vocab, ["field", "term"], "left_semi")
        field_stats = index.field_stats
    # Every consumer of the statistics reads both n_docs and avgdl (the ``avgdl > 0`` and
    # ``n_docs > 0`` guards below never change a value: a field with postings has both
    # positive). Otherwise column pruning trims the shared aggregates differently per
    # consumer and Catalyst plans a second pass over the corpus instead of reusing one.
    w = (qterms.join(df_t, ["field", "term"])
         .join(F.broadcast(field_stats), "field")  # one row per field
         .select("topic_id", "field", "term", "avgdl", *param_cols,
                 *[F.when(F.col("avgdl") > 0, F.col(src) * idf).alias(f"__w_{out}") for out, src in weights.items()]))
    return post, w, field_stats, fits, param_cols


def _normalised(post: DataFrame, field_stats: DataFrame, k1: float, b: float) -> DataFrame:
    """(field, term, doc_id, __tfn): the tf normalisation once per posting (fixed k1, b)."""
    k1c, bc = F.lit(float(k1)), F.lit(float(b))
    avg = F.broadcast(field_stats.select("field", F.col("avgdl").alias("__avgdl"), F.col("n_docs").alias("__n")))
    tfn = (F.col("tf") * (k1c + 1.0)) / (F.col("tf") + k1c * (F.lit(1.0) - bc + bc * F.col("dl") / F.col("__avgdl")))
    return post.join(avg, "field").select("field", "term", "doc_id", F.when(F.col("__n") > 0, tfn).alias("__tfn"))


def term_contributions(index: Index, qterms: DataFrame, k1=1.2, b=0.75, weights: dict | None = None,
                       row_bound: int | None = None) -> DataFrame:
    """(topic_id, field, doc_id, <part>...): BM25 summands of every matched posting.

    ``weights`` maps output column → query-weight column of ``qterms`` (default
    ``{"part": "qw"}``), so several weightings of the same postings come out of
    one pass. ``k1`` and ``b`` may be floats or Columns of ``qterms`` (R8:
    changing them is arithmetic, not a re-index).
    """
    weights = weights or {"part": "qw"}
    post, w, field_stats, fits, param_cols = _matched(index, qterms, weights, row_bound)
    keep = [c for c in param_cols if c not in ("k1", "b")]
    wb = F.broadcast(w) if fits else w  # at most one row per query-term row (df_t, field_stats unique per key)
    if isinstance(k1, Column) or isinstance(b, Column):
        k1c = k1 if isinstance(k1, Column) else F.lit(float(k1))
        bc = b if isinstance(b, Column) else F.lit(float(b))
        tfn = (F.col("tf") * (k1c + 1.0)) / (F.col("tf") + k1c * (F.lit(1.0) - bc + bc * F.col("dl") / F.col("avgdl")))
        return (post.join(wb, ["field", "term"])
                .select("topic_id", "field", "doc_id", *keep,
                        *[(F.col(f"__w_{out}") * tfn).alias(out) for out in weights]))
    # fixed k1, b: the tf normalisation is computed once per posting, before the join fans
    # each posting out to every topic holding the term
    normed = _normalised(post, field_stats, k1, b)
    return (normed.join(wb.drop("avgdl"), ["field", "term"])
            .select("topic_id", "field", "doc_id", *keep,
                    *[(F.col(f"__w_{out}") * F.col("__tfn")).alias(out) for out in weights]))


def document_postings(index: Index, vocab: DataFrame, row_bound: int) -> DataFrame:
    """(doc_id, term_no, idf, tf, norm): the postings of the listed terms, dealt by doc_id; ``norm`` is dl / avgdl.

    ``vocab``: (field, term, term_no), at most ``row_bound`` rows. Any k1 and b are arithmetic on these rows.
    """
    q = vocab.select(F.lit(0).alias("topic_id"), "field", "term", "term_no", F.lit(1.0).alias("qw"))
    post, w, _, fits, _ = _matched(index, q, {"idf": "qw"}, row_bound)
    w = F.broadcast(w) if fits else w
    return (post.repartition("doc_id").join(w, ["field", "term"])
            .select("doc_id", "term_no", F.col("__w_idf").alias("idf"), F.col("tf").cast("int").alias("tf"),
                    (F.col("dl") / F.col("avgdl")).alias("norm")))


def match_terms(qterms: DataFrame, index: Index) -> DataFrame:
    """Query terms ⋈ postings on (field, term) — (topic_id, field, term, doc_id, tf, dl, qw)."""
    n = qterms.count()
    q = F.broadcast(qterms) if n <= max_broadcast_rows(qterms) else qterms
    return index.postings.join(q, ["field", "term"])


def bm25(index: Index, topics: DataFrame, fields=("body",), k1: float = 1.2, b: float = 0.75,
         boosts: dict | None = None, facets: str = "first", by_field: bool = False, k: int | None = None) -> DataFrame:
    """(topic_id, doc_id, score) for every document with ≥ 1 matching term.

    ``by_field=True`` keeps ``field`` in the key (one score per field, R9 / G1).
    ``k`` leaves out documents that cannot be among a topic's k best: tasks sum the pairs of their
    documents and keep k rows a topic, so no pair is shuffled (``hybrid.variant_scores``).
    """
    if k is not None:
        if by_field:
            return bm25_sets(index, topics, {f: {f: (boosts or {}).get(f, 1.0)} for f in fields}, k, k1, b, facets).withColumnRenamed("variant", "field")
        return bm25_sets(index, topics, {"": {f: (boosts or {}).get(f, 1.0) for f in fields}}, k, k1, b, facets).drop("variant")
    qterms = query_terms(topics, fields, boosts, facets)
    parts = term_contributions(index, qterms, k1, b, row_bound=query_size_bound(topics, len(fields)))
    keys = ["topic_id", "field", "doc_id"] if by_field else ["topic_id", "doc_id"]
    return parts.groupBy(*keys).agg(F.sum("part").alias("score"))


def bm25_sets(index: Index, topics: DataFrame, field_sets: dict, k: int, k1: float = 1.2, b: float = 0.75, facets: str = "first") -> DataFrame:
    """(variant, topic_id, doc_id, score): BM25 over each named set of boosted fields, the rows that can be among the k best."""
    from rankspark.operators.hybrid import Variant, variant_scores
    variants = [Variant(name, dict(boosts), {}, facets, z=-1.0) for name, boosts in field_sets.items()]
    return variant_scores(index, topics, None, None, variants, k, k1, b).select("variant", "topic_id", "doc_id", "score")


def bm25_ablation(index: Index, topics: DataFrame, fields, k1: float = 1.2, b: float = 0.75, k: int | None = None) -> DataFrame:
    """One document field at a time, the query being all facets joined by spaces.

    Tokens never span a facet boundary, so the joined query's term counts are the
    per-facet counts summed: ``facets="all"`` with ``field`` kept in the key.
    """
    return bm25(index, topics, fields, k1, b, facets="all", by_field=True, k=k)


def bm25_settings(index: Index, topics: DataFrame, settings, fields=("body",), boosts: dict | None = None,
                  facets: str = "first", k: int | None = None) -> DataFrame:
    """R8 over many settings in one job: (setting, topic_id, doc_id, score).

    ``settings`` is a list of (setting id, k1, b) or a Column holding an
    ``array<struct<setting, k1, b>>``; it is exploded into the query side, so the
    postings are read once and no join with a settings table is needed.
    ``k`` leaves out what cannot be among the k best of a (setting, topic), as in ``bm25``.
    """
    settings_list = None if isinstance(settings, Column) else list(settings)
    if settings_list is not None:
        settings = F.array(*[F.struct(F.lit(s).alias("setting"), F.lit(float(k1)).alias("k1"),
                                      F.lit(float(b)).alias("b")) for s, k1, b in settings_list])
    if k is not None:
        from rankspark.operators.hybrid import Variant, variant_scores
        grid = topics.sparkSession.range(1).select(F.explode(settings).alias("s")).select("s.setting", "s.k1", "s.b")
        fb = {f: (boosts or {}).get(f, 1.0) for f in fields}
        variants = [Variant(str(r["setting"]), fb, {}, facets, z=-1.0, k1=float(r["k1"]), b=float(r["b"])) for r in grid.collect()]  # a row a setting
        scores = variant_scores(index, topics, None, None, variants, k)
        return scores.select(F.col("variant").cast(grid.schema["setting"].dataType).alias("setting"), "topic_id", "doc_id", "score")
    q = (query_terms(topics, fields, boosts, facets)
         .select("*", F.explode(settings).alias("__s"))
         .select("topic_id", "field", "term", "qw", "__s.setting", "__s.k1", "__s.b"))
    n_settings = len(settings_list) if settings_list is not None else None
    bound = query_size_bound(topics, len(fields), n_settings) if n_settings is not None else None
    parts = term_contributions(index, q, F.col("k1"), F.col("b"), row_bound=bound)
    return parts.groupBy("setting", "topic_id", "doc_id").agg(F.sum("part").alias("score"))
