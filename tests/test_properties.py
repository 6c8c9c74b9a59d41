"""Properties and brute-force cross-checks on small inputs."""

import math
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import Window
from pyspark.sql import functions as F

from rankspark.operators import bm25 as bm
from rankspark.operators import dense
from rankspark.operators import evaluate as ev
from rankspark.operators import folds
from rankspark.operators.index import build_index
from rankspark.operators.ordering import global_positions, running_sums
from rankspark.operators.runs import rank_run
from rankspark.plans import inputs
from tests.conftest import SF_SMALL

DOCS = [(1, "the cat sat on the mat"), (2, "the dog sat"), (3, "cats and dogs"), (4, ""), (5, "Mat MAT mat")]
TOPICS = [(10, "the mat", 0), (11, "dog", 0), (0, "cat sat mat", 0)]


def brute_bm25(docs, topics, k1=1.2, b=0.75):
    tok = {d: regex.findall(r"[\p{L}\p{N}]+", t.lower()) for d, t in docs}
    n = len(tok)
    avgdl = sum(len(v) for v in tok.values()) / n
    dfs = Counter(t for v in tok.values() for t in set(v))
    out = {}
    for tid, text, _ in topics:
        q = Counter(regex.findall(r"[\p{L}\p{N}]+", text.lower()))
        for d, terms in tok.items():
            tf = Counter(terms)
            s = sum(qtf * math.log(1 + (n - dfs[t] + 0.5) / (dfs[t] + 0.5))
                    * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(terms) / avgdl))
                    for t, qtf in q.items() if tf[t])
            if any(tf[t] for t in q):
                out[(tid, d)] = s
    return out


@pytest.fixture(scope="module")
def tiny(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, body string")
    topics = spark.createDataFrame([(t, "q", p, x) for t, x, p in TOPICS],
                                   "topic_id long, facet string, facet_pos int, text string")
    return docs, topics


def test_bm25_equals_brute_force(spark, tiny):
    docs, topics = tiny
    got = {(r.topic_id, r.doc_id): r.score for r in bm.bm25(build_index(docs), topics).collect()}
    want = brute_bm25(DOCS, TOPICS)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12)


def test_bm25_on_stored_index_equals_inline(spark, tiny, tmp_path):
    docs, topics = tiny
    idx = build_index(docs)
    idx.write(str(tmp_path / "idx"))
    from rankspark.operators.index import Index
    stored = Index.read(spark, str(tmp_path / "idx"))
    a = {(r.topic_id, r.doc_id): r.score for r in bm.bm25(idx, topics).collect()}
    b = {(r.topic_id, r.doc_id): r.score for r in bm.bm25(stored, topics).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_settings_sweep_equals_single_runs(spark, tiny):
    docs, topics = tiny
    idx = build_index(docs)
    multi = {(r.setting, r.topic_id, r.doc_id): r.score
             for r in bm.bm25_settings(idx, topics, [(0, 1.2, 0.75), (1, 2.0, 0.3)]).collect()}
    for s, k1, b in [(0, 1.2, 0.75), (1, 2.0, 0.3)]:
        one = {(r.topic_id, r.doc_id): r.score for r in bm.bm25(idx, topics, k1=k1, b=b).collect()}
        assert one == pytest.approx({k[1:]: v for k, v in multi.items() if k[0] == s})


def test_rank_is_gap_free_permutation(spark, tiny):
    docs, topics = tiny
    run = rank_run(bm.bm25(build_index(docs), topics)).collect()
    per = {}
    for r in run:
        per.setdefault(r.topic_id, []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in per.values())


def test_log_normalised_bm25_peaks_at_ceiling(spark, tiny):
    docs, topics = tiny
    s = bm.bm25(build_index(docs), topics)
    w = Window.partitionBy("topic_id")
    top = s.withColumn("top", F.max("score").over(w)).where(F.col("top") > 2.0)
    z = F.pow(F.col("top"), F.lit(1 / 2.0))
    peaks = top.groupBy("topic_id").agg(F.max(F.log("score") / F.log(z)).alias("m")).collect()
    assert peaks and all(r.m == pytest.approx(2.0) for r in peaks)


def test_ideal_run_scores_one(spark):
    qrels = spark.createDataFrame([("t", "a", 2), ("t", "b", 1), ("t", "c", 0), ("u", "d", 1)],
                                  "topic_id string, doc_id string, rel int")
    ideal = rank_run(qrels.withColumn("score", F.col("rel").cast("double")))
    vals = ev.evaluate(ideal, qrels, ["ndcg@10", "map@1000", "bpref@1000", "rprec@1000"]).collect()
    assert all(v.value == pytest.approx(1.0) for v in vals)


def test_unjudged_document_leaves_bpref_unchanged(spark):
    qrels = spark.createDataFrame([("t", "a", 1), ("t", "n", 0), ("t", "b", 1)], "topic_id string, doc_id string, rel int")
    run = spark.createDataFrame([("t", "a", 1), ("t", "n", 2), ("t", "b", 3)], "topic_id string, doc_id string, rank long")
    more = spark.createDataFrame([("t", "a", 1), ("t", "u", 2), ("t", "n", 3), ("t", "b", 4)],
                                 "topic_id string, doc_id string, rank long")
    a = ev.evaluate(run, qrels, ["bpref@1000"]).first().value
    b = ev.evaluate(more, qrels, ["bpref@1000"]).first().value
    assert a == b


def test_folds_partition_and_stratify(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "label")
    n = e.count()
    f = folds.stratified_folds(e, "vec_id", "label", k=5, buckets=7)
    rows = f.collect()
    assert len(rows) == n and len({r.vec_id for r in rows}) == n
    per = Counter((r.label, r.fold) for r in rows)
    for lab in {r.label for r in rows}:
        sizes = [per[(lab, k)] for k in range(5)]
        assert max(sizes) - min(sizes) <= 1
    c = folds.contiguous_folds(e, "vec_id", 3).collect()
    assert {r.fold for r in c} == {0, 1, 2}
    order = sorted(c, key=lambda r: r.vec_id)
    assert [r.fold for r in order] == sorted(r.fold for r in order)
    tr, va = folds.split_fold(f, 2)
    assert tr.count() + va.count() == n


def test_global_positions_and_running_sums(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(200)], "v long, id long")
    pos = {r.id: r.position for r in global_positions(df, [F.col("v"), F.col("id")], 5).collect()}
    want = {r[1]: i for i, r in enumerate(sorted(((i % 7, i) for i in range(200))))}
    assert pos == want
    cs = running_sums(df.withColumn("one", F.lit(1)), [F.col("v").desc(), F.col("id")], ["one"], 3).collect()
    assert sorted(r.cum_one for r in cs) == list(range(1, 201))


def test_hash_encoder_jvm_equals_python(spark):
    texts = ["The cat sat.", "Été à Paris, 2024!", "", "ñandú ÑANDÚ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r.id: np.array(r.embedding) for r in dense.hash_encode(df, "text", 16, keep=["id"]).collect()}
    want = dense.HashEncoder(16).encode_batch(texts)
    for i in range(len(texts)):
        assert np.allclose(got[i], want[i])


def test_pluggable_encoder_path(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "Sea. Sky and sun."), (4, "...")], "id long, text string")
    enc = dense.HashEncoder(8)
    out = {r.id: r.embedding for r in dense.encode(df, "text", enc, keep=["id"]).collect()}
    assert np.allclose(out[1], enc.encode_batch(["a b"])[0])
    first = {r.id: r.embedding for r in dense.encode(df, "text", enc, keep=["id"], pooling="first").collect()}
    assert np.allclose(first[3], enc.encode_batch(["Sea"])[0]) and first[4] is None
    mean = {r.id: r.embedding for r in dense.encode(df, "text", enc, keep=["id"], pooling="mean", normalize=True).collect()}
    want = enc.encode_batch(["Sea", "Sky and sun"]).mean(axis=0)
    assert np.allclose(mean[3], want / np.linalg.norm(want))


def test_numeric_ids(spark):
    from rankspark.sources.topics import numeric_ids
    t = spark.createDataFrame([("12", "a"), ("007", "b")], "topic_id string, text string")
    assert dict(numeric_ids(t).dtypes)["topic_id"] == "bigint"
    u = spark.createDataFrame([("12", "a"), ("x7", "b")], "topic_id string, text string")
    assert dict(numeric_ids(u).dtypes)["topic_id"] == "string"


def test_dense_topk_equals_brute_force(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = e.select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in rows])
    m = np.array([r.embedding for r in rows], dtype=np.float64)
    m = m / np.linalg.norm(m, axis=1)[:, None]
    q = e.select(F.col("vec_id").alias("topic_id"), "embedding")
    d = e.select(F.col("vec_id").alias("doc_id"), "embedding")
    got = dense.dense_topk(q, d, k=5, query_block=37).collect()
    per = {}
    for r in got:
        per.setdefault(r.topic_id, []).append((r["rank"], r.doc_id))
    s = m @ m.T
    for qi, tid in enumerate(ids[:20]):
        order = sorted(range(len(ids)), key=lambda j: (-round(s[qi, j], 6), ids[j]))[:5]
        assert [doc for _, doc in sorted(per[tid])] == [int(ids[j]) for j in order]


def test_streaming_index_equals_batch_index(spark, tmp_path):
    corpus = inputs.corpus(spark, SF_SMALL).select("doc_id", "title", "body").withColumn("version", F.lit(1))
    src = str(tmp_path / "src")
    corpus.repartition(3, "doc_id").write.parquet(src)
    # a re-sent document: a later file holds a new version of doc 0
    first = corpus.where(F.col("doc_id") == 0).withColumn("body", F.lit("replaced text entirely")).withColumn("version", F.lit(2))
    from rankspark.streaming import incremental as inc
    stream = spark.readStream.schema(corpus.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    inc.stream_index(stream, out, ck, "version", ("title", "body")).awaitTermination()
    first.write.mode("append").parquet(src)
    inc.stream_index(spark.readStream.schema(corpus.schema).option("maxFilesPerTrigger", 1).parquet(src),
                     out, ck, "version", ("title", "body")).awaitTermination()
    got = inc.read_stream_index(spark, out)
    want_docs = corpus.where(F.col("doc_id") != 0).unionByName(first)
    want = build_index(want_docs, ("title", "body"))
    a = sorted(tuple(r) for r in got.postings.select("field", "term", "doc_id", "dl", "tf").collect())
    b = sorted(tuple(r) for r in want.postings.select("field", "term", "doc_id", "dl", "tf").collect())
    assert a == b
    fa = {r.field: (r.n_docs, round(r.avgdl, 9)) for r in got.field_stats.collect()}
    fb = {r.field: (r.n_docs, round(r.avgdl, 9)) for r in want.field_stats.collect()}
    assert fa == fb


def test_topic_stream_restart_adds_no_duplicates(spark, tmp_path):
    from rankspark.streaming import incremental as inc
    idx = inputs.corpus_index(spark, SF_SMALL, ("body",))
    topics = inputs.topics(spark, SF_SMALL)
    src = str(tmp_path / "topics")
    topics.repartition(2, "topic_id").write.parquet(src)
    out, ck = str(tmp_path / "runs"), str(tmp_path / "ck")

    def run_once():
        s = spark.readStream.schema(topics.schema).option("maxFilesPerTrigger", 1).parquet(src)
        inc.score_topic_stream(s, idx, out, ck, ("body",), k=5).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(out).select("topic_id", "doc_id", "rank").collect())

    first = run_once()
    assert run_once() == first  # restart from the checkpoint: nothing re-appended
    want = sorted(tuple(r) for r in rank_run(bm.bm25(idx, topics), k=5).select("topic_id", "doc_id", "rank").collect())
    assert first == want
