"""Dense top-k: the broadcast block and the grid of blocks against brute force."""

import random

import pytest

from rankspark.operators.dense import dense_topk


def brute(queries, docs, k, metric):
    out = {}
    for t, q in queries:
        if q is None:
            continue
        rows = []
        for d, v in docs:
            if v is None:
                continue
            s = sum(a * b for a, b in zip(q, v))
            if metric == "cosine":
                n = (sum(a * a for a in q) * sum(a * a for a in v)) ** 0.5
                s = s / n if n else 0.0
            rows.append((-round(s, 6) + 0.0, d))
        for r, (s, d) in enumerate(sorted(rows)[:k]):
            out[t, r + 1] = (d, round(-s, 6) + 0.0)
    return out


@pytest.mark.parametrize("metric", ["cosine", "dot"])
@pytest.mark.parametrize("ids", ["long", "string"])
def test_grid_and_block_equal_brute_force(spark, metric, ids):
    rng = random.Random(4)
    name = (lambda i: i) if ids == "long" else (lambda i: f"d{i:04d}")

    def vec():
        return None if rng.random() < 0.05 else [0.0] * 4 if rng.random() < 0.1 else [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)]

    docs = [(name(i), vec()) for i in range(300)]
    queries = [(name(i), vec()) for i in range(60)]
    d = spark.createDataFrame(docs, f"doc_id {ids}, embedding array<double>")
    q = spark.createDataFrame(queries, f"topic_id {ids}, embedding array<double>")
    want = brute(queries, docs, 6, metric)
    for kw in ({}, {"query_block": 7, "doc_block": 40}, {"query_block": 1, "doc_block": 1000}):
        got = {(r["topic_id"], r["rank"]): (r["doc_id"], round(r["score"], 6) + 0.0) for r in dense_topk(q, d, 6, metric, **kw).collect()}
        assert got == want
    with pytest.raises(ValueError):
        dense_topk(q, d, metric="euclid")


def test_empty_sides_and_plans(spark):
    d = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "doc_id long, embedding array<double>")
    q = d.withColumnRenamed("doc_id", "topic_id")
    assert dense_topk(q.limit(0), d).count() == dense_topk(q, d.limit(0)).count() == dense_topk(q, d.limit(0), query_block=2).count() == 0
    assert dense_topk(q, d, 30, query_block=3, doc_block=6).count() == 400
    plan = dense_topk(q, d, query_block=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan and "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
