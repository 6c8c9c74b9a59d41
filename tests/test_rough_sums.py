"""Lists found by sums in single precision first: the same rows as from all pairs, and few pairs are summed exactly."""

import numpy as np
import pytest

from rankspark.operators import bm25 as B
from rankspark.operators import hybrid as H
from rankspark.operators.index import build_index
from rankspark.operators.runs import rank_run
from rankspark.operators.sizing import MAX_BROADCAST_ROWS_CONF
from tests.test_hybrid_blocks import case
from tests.test_ranked_lists import rows


@pytest.fixture
def rough(monkeypatch):
    monkeypatch.setattr(H, "DEEP", 0)


@pytest.mark.parametrize("dense,cells", [(0.0, 50), (1.0, 1 << 21)])
def test_lists_of_rough_sums_equal_all_pairs_ranked(spark, monkeypatch, rough, dense, cells):
    monkeypatch.setattr(H, "DENSE", dense)
    monkeypatch.setattr(H, "CELLS", cells)
    index, t, tv, dv = case(spark, 21)
    fields = ("title", "body")
    kw = {"boosts": {"title": 2.0, "body": 0.5}, "facets": "all"}
    assert rows(rank_run(B.bm25(index, t, fields, k=4, **kw), k=4)) == rows(rank_run(B.bm25(index, t, fields, **kw), k=4))
    got, want = (rank_run(B.bm25_ablation(index, t, fields, k=k), k=4, partition_extra=("field",)) for k in (4, None))
    assert rows(got, "field") == rows(want, "field")


OPTIONS = [{}, {"z": 1.7}, {"z": 0.6}, {"z": -1.0}, {"use_bm25": False}, {"weights": {"a": -1.0}, "facets": "first"}, {"keep_low": True, "ceiling": 6.0}, {"offset": 0.0, "ceiling": 3.0}]


@pytest.mark.parametrize("options", OPTIONS, ids=[str(i) for i in range(len(OPTIONS))])
def test_hybrid_of_rough_sums_equals_the_exhaustive_form(spark, monkeypatch, rough, options):
    monkeypatch.setattr(H, "DENSE", 0.05)
    monkeypatch.setattr(H, "CELLS", 200)
    index, t, tv, dv = case(spark, 22)

    def ranked(exhaustive):
        out = H.hybrid(index, t, tv, dv, ("title", "body"), ("a", "b"), k=4, exhaustive=exhaustive, **options)
        return sorted((r["topic_id"], r["rank"], r["doc_id"], *(None if r[c] is None else round(r[c], 6) + 0.0 for c in ("score", "bm25", "embed", "z"))) for r in out.collect())

    assert ranked(False) == ranked(True)


def _side(n_docs=400, n=30, words=60, fields=2, seed=5):
    rng = np.random.default_rng(seed)
    pairs = [(x, w) for w in range(words * fields) for x in np.flatnonzero(rng.random(n) < (0.8 if w % words < 5 else 0.15))]
    weight = rng.integers(1, 4, len(pairs)).astype(float)
    term = np.array([w for _, w in pairs])
    columns = [np.array([x for x, _ in pairs]), term // words, term, weight, weight * (rng.random(len(pairs)) < 0.5)]
    side = H.QuerySide(columns, list(range(n)), np.arange(words * fields), words * fields, [])
    held = rng.random((n_docs, words * fields)) * (rng.random((n_docs, words * fields)) < 0.2)
    owner, term = np.nonzero(held)
    return side, (owner, term, {(): held[owner, term]}), n_docs


def test_few_pairs_are_summed_exactly():
    side, lists, n_docs = _side()
    mode, k = ("all", ()), 3
    want = np.zeros((n_docs, side.n))
    for d, t, sums in side.sums(*lists, n_docs, [mode]):
        want[d, t] = np.nan_to_num(sums[mode, 0]) + 2 * np.nan_to_num(sums[mode, 1])
    bounds = [H.lexical_bound(mode, [("x", 1.0), ("y", 2.0)], ["x", "y"])]
    docs, topics = H.contenders(side, lists, n_docs, bounds, np.full(side.n, -np.inf), k)
    found = set(zip(docs.tolist(), topics.tolist()))
    assert all((int(d), x) in found for x in range(side.n) for d in np.argsort(-want[:, x])[:k])
    assert len(found) < 2 * k * side.n  # of 400 x 30 pairs


def test_rough_sums_of_fields_that_ask_the_same(monkeypatch):
    monkeypatch.setattr(H, "CELLS", 400)
    whole, lists, n_docs = _side(fields=1)
    n = len(whole.field_of)
    columns = [np.tile(whole.topic, 2), np.repeat([0, 1], len(whole.topic)), np.concatenate([np.repeat(np.arange(n), np.diff(whole.start)) + j * n for j in (0, 1)]), np.tile(whole.all, 2), np.tile(whole.first, 2)]
    both = H.QuerySide(columns, whole.topic_ids, np.arange(2 * n), 2 * n, [])
    owner, term, values = lists
    twice = np.repeat(owner, 2), (term[:, None] + [0, n]).ravel(), {(): (values[()][:, None] * [1.0, 0.5]).ravel()}
    for facets in ("all", "first"):
        choice = (facets, ()), ((0, 2.0), (1, 3.0))
        want = np.zeros((n_docs, both.n))
        for d, t, sums in both.sums(*twice, n_docs, [choice[0]]):
            want[d, t] = 2 * np.nan_to_num(sums[choice[0], 0]) + 3 * np.nan_to_num(sums[choice[0], 1])
        got = np.zeros((n_docs, both.n))
        for docs, sums in both.rough(*twice, n_docs, [choice]):
            got[docs] = sums[choice]
        assert both.n_words == n and np.allclose(got, want, rtol=1e-5) and ((got > 0) == (want > 0)).all()


def test_exact_sums_of_listed_pairs(monkeypatch):
    monkeypatch.setattr(H, "CELLS", 300)
    side, lists, n_docs = _side()
    modes = [("all", ()), ("first", ())]
    rng = np.random.default_rng(1)
    docs, topics = np.sort(rng.integers(0, n_docs, 500)), rng.integers(0, side.n, 500)
    got = side.exact(*lists, n_docs, docs, topics, modes)
    whole = {(m, f): np.full((n_docs, side.n), np.nan) for m in modes for f in (0, 1)}
    for d, t, sums in side.sums(*lists, n_docs, modes):
        for key, x in sums.items():
            whole[key][d, t] = x
    for key, x in got.items():
        assert np.allclose(x, whole[key][docs, topics], equal_nan=True), key


def test_a_vocabulary_past_one_broadcast_deals_no_postings(spark, monkeypatch):
    def stop(*_, **__):
        raise AssertionError("a row a posting is dealt")

    texts = [(1, "a b a", "c c"), (1, "b a a", "d"), (1, "a", None), (2, "a b", "c"), (None, "b", ""), (None, "b", "a a"), (3, "", "zz"), (4, None, None)]
    index = build_index(spark.createDataFrame(texts, "doc_id long, title string, body string"), ("title", "body"))
    vocab = spark.createDataFrame([(f, w, 70000 * j + 9 * i) for j, f in enumerate(("title", "body")) for i, w in enumerate("abcdefghix")], "field string, term string, term_no int")

    def lists():
        found = H.document_terms(index, vocab, 20).collect()
        return sorted((repr(r["doc_id"]), sorted((t["term_no"], t["tf"], round(t["idf"], 9), round(t["norm"], 9)) for t in r["terms"])) for r in found)

    want = lists()
    monkeypatch.setattr(H, "document_postings", stop)
    spark.conf.set(MAX_BROADCAST_ROWS_CONF, "18")
    try:
        assert H.count_blocks(index, vocab, 20) == 2 and lists() == want
    finally:
        spark.conf.unset(MAX_BROADCAST_ROWS_CONF)


def test_rows_are_dealt_without_the_vectors_of_topics(spark):
    from rankspark.operators.rerank import rank_by_embeddings

    dataset = spark.createDataFrame([("1_7",), ("2_7",), ("2_8",)], "id string")
    tv = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (2, [3.0, 0.0])], "topic_id long, embedding array<double>")
    dv = spark.createDataFrame([(7, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [0.0, 5.0])], "doc_id long, embedding array<double>")
    out = rank_by_embeddings(dataset, tv, dv)
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert "topic_key" in joins[0] and "doc_key" in joins[1]
    assert {(r["topic_id"], r["doc_id"], r["rank"], round(r["sum_sim"], 6)) for r in out.collect()} == {(1, 7, 1, 1.0), (2, 7, 1, 2.0), (2, 8, 2, 1.0)}
