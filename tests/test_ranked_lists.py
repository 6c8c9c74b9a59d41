"""Top-k lists from the documents' term lists: same rows as all pairs ranked, and no query makes the pair table."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark.operators import bm25 as B
from rankspark.operators import hybrid as H
from rankspark.operators import sweep as S
from rankspark.operators.index import build_index
from rankspark.operators.runs import rank_run
from rankspark.operators.sizing import MAX_BROADCAST_ROWS_CONF
from rankspark.plans import catalog, catalog_more  # noqa: F401
from tests.conftest import SF_SMALL
from tests.test_hybrid_blocks import case


def rows(df, *keys):
    return sorted((tuple(repr(r[c]) for c in keys) + (repr(r["topic_id"]), r["rank"], r["doc_id"], round(r["score"], 6) + 0.0)) for r in df.collect())


@pytest.fixture
def small_rounds(spark, monkeypatch):
    """Topics past the broadcast bound, in several rounds."""
    monkeypatch.setattr(H, "TERMS_PER_ROUND", 60)
    monkeypatch.setattr(H, "CELLS", 50)
    spark.conf.set(MAX_BROADCAST_ROWS_CONF, "20")
    yield
    spark.conf.unset(MAX_BROADCAST_ROWS_CONF)


@pytest.mark.parametrize("dense", [0.0, 1.0])
def test_lists_equal_all_pairs_ranked(spark, monkeypatch, dense):
    monkeypatch.setattr(H, "DENSE", dense)
    index, t, _, _ = case(spark, 11)
    t = t.unionByName(spark.createDataFrame([(None, "f0", 0, "w1 w2 w3")], t.schema))
    fields = ("title", "body")
    kw = {"boosts": {"title": 2.0, "body": -1.0}, "facets": "all"}
    assert rows(rank_run(B.bm25(index, t, fields, k=4, **kw), k=4)) == rows(rank_run(B.bm25(index, t, fields, **kw), k=4))
    settings = [(0, 1.2, 0.75), (1, 0.5, 0.0), (2, 2.0, 1.0)]
    got, want = (rank_run(B.bm25_settings(index, t, settings, k=k), k=4, partition_extra=("setting",)) for k in (4, None))
    assert rows(got, "setting") == rows(want, "setting") and got.schema["setting"].dataType == want.schema["setting"].dataType
    got, want = (rank_run(B.bm25_ablation(index, t, fields, k=k), k=4, partition_extra=("field",)) for k in (4, None))
    assert rows(got, "field") == rows(want, "field")


def test_rounds_of_a_distributed_topic_table(spark, small_rounds):
    index, t, tv, dv = case(spark, 12)
    fields = ("title", "body")
    assert rows(rank_run(B.bm25(index, t, fields, facets="all", k=4), k=4)) == rows(rank_run(B.bm25(index, t, fields, facets="all"), k=4))
    got, want = (H.hybrid(index, t, tv, dv, fields, ("a", "b"), k=4, exhaustive=x) for x in (False, True))
    assert rows(got) == rows(want)
    got = {r["topic_id"]: round(r["top_bm25"], 6) for r in H.best_bm25(index, t, fields).collect()}
    assert got == {r["topic_id"]: round(r["m"], 6) for r in B.bm25(index, t, fields).groupBy("topic_id").agg(F.max("score").alias("m")).collect()}


def odd(p):
    """A user's score with missing values, infinities and values that are no numbers."""
    b = F.floor(p["bm25"] * 1000) % 7
    return F.when(b == 1, None).when(b == 2, float("nan")).when(b == 3, float("inf")).otherwise(p["bm25"] + p["embed"] + p["log_bm25"] * p["z"])


@pytest.mark.parametrize("options", [{}, {"z": 1.7}, {"use_bm25": False}, {"k": None}])
def test_user_scores_equal_the_exhaustive_form(spark, options):
    index, t, tv, dv = case(spark, 13)
    kw = {"k": 5, "score_fn": odd, **options}

    def ranked(exhaustive):
        out = H.hybrid(index, t, tv, dv, ("title", "body"), ("a", "b"), exhaustive=exhaustive, **kw)
        return sorted((r["topic_id"], r["rank"], r["doc_id"], repr(None if r["score"] is None else round(r["score"], 5) + 0.0), r["z_ok"]) for r in out.collect())

    assert ranked(False) == ranked(True)


def test_user_scores_are_cut_in_their_task(spark):
    """The pairs reach no exchange before each task has kept its best."""
    index, t, tv, dv = case(spark, 14)
    plan = H.hybrid(index, t, tv, dv, ("title", "body"), ("a", "b"), k=3, score_fn=lambda p: p["bm25"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "hashpartitioning(topic_id" not in plan.split("MapInArrow", 1)[1]


def test_sums_of_frequent_and_rare_terms():
    rng = np.random.default_rng(4)
    n_docs, n, words = 40, 9, 12
    pairs = [(int(w), int(x)) for w in range(words) for x in np.flatnonzero(rng.random(n) < (0.9 if w < 4 else 0.1))]
    weight = rng.integers(1, 4, len(pairs)).astype(float)
    columns = [np.array([x for _, x in pairs]), np.zeros(len(pairs), dtype=int), np.array([w for w, _ in pairs]), weight, weight]
    side = H.QuerySide(columns, list(range(n)), np.arange(words) * 2, 2 * words, [])  # every other number is asked
    held = rng.random((n_docs, 2 * words)) * (rng.random((n_docs, 2 * words)) < 0.4)
    owner, term = np.nonzero(held)
    q = np.zeros((2 * words, n))
    for (w, x), y in zip(pairs, weight):
        q[2 * w, x] = y
    got = np.full((n_docs, n), np.nan)
    for doc, topic, sums in side.sums(owner, term, {(): held[owner, term]}, n_docs, [("all", ())]):
        got[doc, topic] = sums[("all", ()), 0]
    want = held @ q
    assert np.allclose(np.nan_to_num(got), want) and (np.isnan(got) == (want == 0)).all()


QUERIES = ["hybrid_score_fn", "hybrid_multifacet", "bm25_params", "param_sweep", "bm25_ablation", "eval_rprec", "rerank_hybrid", "kmax_pool", "multi_vector_agg", "paired_t", "rank_agreement", "ablation_grid", "bm25_boosted", "top_bm25_z", "low_topics", "stream_topics_bm25"]


@pytest.mark.parametrize("name", QUERIES)
def test_queries_make_no_pair_table(spark, monkeypatch, name):
    def stop(*_, **__):
        raise AssertionError("a row a (topic, document) pair is dealt")

    for module in (B, H):
        monkeypatch.setattr(module, "term_contributions", stop)
    if name == "hybrid_multifacet":
        spark.conf.set(MAX_BROADCAST_ROWS_CONF, "100")
    try:
        assert catalog.QUERIES[name](spark, SF_SMALL).columns
    finally:
        spark.conf.unset(MAX_BROADCAST_ROWS_CONF)


def test_sweep_takes_settings_from_a_column(spark):
    index, t, _, _ = case(spark, 15)
    space = {"k1": {"type": "float", "low": 0.5, "high": 2.0, "step": 0.1}, "b": 0.4}
    grid = S.param_grid_column(space, 3)
    got, want = (rank_run(B.bm25_settings(index, t, grid, k=k), k=3, partition_extra=("setting",)) for k in (3, None))
    assert rows(got, "setting") == rows(want, "setting")


@pytest.mark.parametrize("name", ["rerank_hybrid", "kmax_pool", "rerank_generic", "rerank_weights"])
def test_runs_deal_no_postings(spark, monkeypatch, name):
    def stop(*_, **__):
        raise AssertionError("a row a posting is dealt")

    monkeypatch.setattr(H, "document_postings", stop)
    assert catalog.QUERIES[name](spark, SF_SMALL).columns


def test_counted_terms_equal_dealt_postings(spark):
    texts = [(1, "a b a", "c c"), (1, "b a a", "d"), (1, "a", None), (2, "a b", "c"), (2, "a b", "c"), (None, "b", ""), (None, "b", "a a"), (3, "", "zz"), (4, None, None)]
    index = build_index(spark.createDataFrame(texts, "doc_id long, title string, body string"), ("title", "body"))
    vocab = spark.createDataFrame([(f, w, 10 * j + i) for j, f in enumerate(("title", "body")) for i, w in enumerate("abcx")], "field string, term string, term_no int")

    def lists(index):
        found = H.document_terms(index, vocab, 20).collect()
        return sorted((repr(r["doc_id"]), sorted((t["term_no"], t["tf"], round(t["idf"], 9), round(t["norm"], 9)) for t in r["terms"])) for r in found)

    got = lists(index)
    assert got == lists(replace(index, tokens=None)) and len(got) == 3
