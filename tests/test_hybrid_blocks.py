"""The block form of the hybrid score against the exhaustive one, and the pieces it is made of."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark.operators import hybrid as H
from rankspark.operators.blocks import TopK, pair_products, unit_rows, vectors
from rankspark.operators.index import build_index


def case(spark, seed, n_docs=160, n_topics=7):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)]
    docs = [(i, " ".join(rng.choices(words[:rng.choice((6, 25))], k=rng.randint(0, 12))) or None, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(n_docs)]
    docs += [(1000 + i, *docs[i % 3][1:]) for i in range(30)]  # equal documents: ties
    topics = [(t, f"f{p}", p, " ".join(rng.choices(words, k=rng.randint(0, 6)))) for t in range(n_topics) for p in range(rng.randint(1, 3))] + [(99, "f0", 0, "absent")]

    def vec(missing):
        return None if rng.random() < missing else [0.0] * 5 if rng.random() < 0.1 else [round(rng.uniform(-1, 1), 2) for _ in range(5)]

    d = spark.createDataFrame(docs, "doc_id long, title string, body string")
    t = spark.createDataFrame(topics, "topic_id long, facet string, facet_pos int, text string")
    dv = spark.createDataFrame([(i, vec(0.2), vec(0.3)) for i, _, _ in docs if rng.random() < 0.9], "doc_id long, a array<double>, b array<double>")
    tv = spark.createDataFrame([(x, f, p, vec(0.0)) for x, f, p, _ in topics if x != 3], "topic_id long, facet string, facet_pos int, embedding array<double>")
    return build_index(d, ("title", "body")), t, tv, dv


OPTIONS = [{}, {"z": 1.7}, {"z": -1.0}, {"use_bm25": False}, {"facets": "first", "weights": {"a": 0.0, "b": 2.5}}, {"ceiling": 0.4}, {"ceiling": 3.0, "offset": -0.5, "weights": {"a": -1.0}},
           {"z": 2.0, "guard": True, "boosts": {"title": 1.0, "body": -1.0}}, {"boosts": {"title": 0.0}}, {"facet_weights": {"f1": 0.25}}, {"ceiling": 6.0, "keep_low": True}]


@pytest.mark.parametrize("options", OPTIONS, ids=[str(i) for i in range(len(OPTIONS))])
def test_block_form_equals_the_exhaustive_form(spark, options, monkeypatch):
    monkeypatch.setattr(H, "CELLS", 50)
    monkeypatch.setattr(H, "PAIRS_PER_TASK", 40)  # several rounds of topics
    index, t, tv, dv = case(spark, 5)
    kw = {"k": 10, **options}

    def rows(exhaustive):
        out = H.hybrid(index, t, tv, dv, ("title", "body"), ("a", "b"), exhaustive=exhaustive, **kw)
        return sorted((r["topic_id"], r["rank"], r["doc_id"], *(None if r[c] is None else round(r[c], 6) + 0.0 for c in ("score", "bm25", "embed", "z")), r["z_ok"]) for r in out.collect())

    assert rows(False) == rows(True)


def test_all_pairs_and_variants(spark):
    index, t, tv, dv = case(spark, 6)
    every = H.hybrid(index, t, tv, dv, ("title", "body"), ("a", "b"), z=1.7, k=None)
    want = H.hybrid(index, t, tv, dv, ("title", "body"), ("a", "b"), z=1.7, k=None, exhaustive=True)
    assert every.count() == want.count() and every.join(want, ["topic_id", "doc_id", "rank"]).count() == want.count()
    variants = [H.Variant("base", {"body": 1.0}, {}, "first", z=-1.0), H.Variant("both", {"title": 2.0, "body": 1.0}, {"a": 1.0, "b": 0.5}), H.Variant("low", {"title": 1.0}, {"b": 1.0}, "first", ceiling=2.0)]
    out = H.hybrid_variants(index, t, tv, dv, variants, 5)
    options = {"base": {"fields": ("body",), "embed_fields": ("a",), "z": -1.0, "facets": "first"},
               "both": {"fields": ("title", "body"), "embed_fields": ("a", "b"), "boosts": {"title": 2.0}, "weights": {"b": 0.5}},
               "low": {"fields": ("title",), "embed_fields": ("b",), "facets": "first", "ceiling": 2.0}}
    for name, kw in options.items():
        alone = H.hybrid(index, t, tv, dv, k=5, exhaustive=True, **kw).select("topic_id", "rank", "doc_id", F.round("score", 6).alias("score")).collect()
        mine = out.where(F.col("variant") == name).select("topic_id", "rank", "doc_id", F.round("score", 6).alias("score")).collect()
        assert sorted(mine) == sorted(alone) and mine
    with pytest.raises(ValueError):
        H.hybrid_variants(index, t, tv, dv, [variants[0]] * 2)
    with pytest.raises(ValueError):
        H.hybrid(index, t, tv, dv, ("title",), ("a",), ceiling=50.0, strict=True)


def test_empty_sides(spark):
    index, t, tv, dv = case(spark, 7)
    nothing = build_index(spark.createDataFrame([], "doc_id long, title string, body string"), ("title", "body"))
    assert H.hybrid(nothing, t, tv, dv, ("title", "body"), ("a",), k=3).count() == 0
    assert H.hybrid(index, t.limit(0), tv, dv, ("title", "body"), ("a",), k=3).count() == 0
    assert H.hybrid(index, t, tv.limit(0), dv, ("title", "body"), ("a",), z=2.0, k=3).where(F.col("embed") != 0).count() == 0


def test_vectors_meet_documents_not_pairs(spark):
    """The vector join has one row a document; the exhaustive form has one a pair."""
    index, t, tv, dv = case(spark, 8)
    plan = H.hybrid(index, t, tv, dv, ("title", "body"), ("a", "b"), k=3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1 and "MapInArrow" in plan and "terms" in plan


def test_top_k_keeps_every_row_that_may_rank():
    rng = np.random.default_rng(3)
    for ids in (rng.integers(0, 500, 4000), np.array([f"d{i}" for i in rng.integers(0, 500, 4000)], dtype=object)):
        key, score = rng.integers(0, 4, 4000), np.round(rng.normal(size=4000), 1)
        score[::50] = np.nan
        best = TopK(7, 5)
        best.limit = 100
        for a in range(0, 4000, 300):
            best.add(key[a:a + 300], ids[a:a + 300], score[a:a + 300])
        got = list(zip(*(c.tolist() for c in best.take())))
        for k in range(4):
            order = sorted(((-s if s == s else np.inf), d) for x, d, s in zip(key.tolist(), ids.tolist(), score.tolist()) if x == k)
            assert sorted(((-s if s == s else np.inf), d) for x, d, s in got if x == k)[:7] == order[:7]
        assert len(got) <= 4 * 7 * 3
    assert TopK(3, 2).take() is None


def test_vectors_and_products():
    import pyarrow as pa

    m, present = vectors(pa.array([[1.0, 2.0], None, [], [3.0, 4.0]]))
    assert m.tolist() == [[1, 2], [0, 0], [0, 0], [3, 4]] and present.tolist() == [True, False, False, True]
    with pytest.raises(ValueError):
        vectors(pa.array([[1.0], [1.0, 2.0]]))
    rng = np.random.default_rng(2)
    left, right = unit_rows(rng.normal(size=(9, 4))), rng.normal(size=(6, 4))
    for n in (1, 54):
        at = np.sort(rng.choice(54, n, replace=False))
        assert np.allclose(pair_products(left, right, at // 6, at % 6, limit=8), (left @ right.T).ravel()[at])
