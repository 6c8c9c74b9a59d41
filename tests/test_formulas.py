"""Hand-sized cases with values worked out by hand (FIXTURES §4)."""

import math

import pytest
from pyspark.sql import functions as F

from rankspark.functions.columns import remap_labels
from rankspark.operators import evaluate as ev
from rankspark.operators import hybrid as hy
from rankspark.operators import pairs as pr


def test_z_value_and_log_term(spark):
    df = spark.createDataFrame([(16.0,), (1.0,), (0.25,)], "bm25 double")
    z = hy.z_value(F.lit(16.0), F.lit(2.0))
    out = df.select((F.log("bm25") / F.log(z)).alias("t"), z.alias("z")).collect()
    assert out[0]["z"] == pytest.approx(4.0)
    assert [round(r["t"], 12) for r in out] == [2.0, 0.0, -1.0]


def test_z_needs_top_above_ceiling(spark):
    row = spark.range(1).select(hy.z_value(F.lit(1.5), F.lit(2.0)).alias("z")).first()
    assert row["z"] is None


def test_embed_score_missing_vector_and_offset(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [-1.0, 0.0], 1), ([1.0, 0.0], None, 1)],
        "__q_e array<double>, e array<double>, n int")
    out = [r[0] for r in df.select(hy.embed_score(["e"], F.col("n"), offset=1.0)).collect()]
    assert out == [0.0, 0.0]  # cosine −1 plus offset 1 → 0; missing → 0 without offset


def test_ndcg_swapped_gains(spark):
    run = spark.createDataFrame([("t", "a", 1), ("t", "b", 2)], "topic_id string, doc_id string, rank long")
    qrels = spark.createDataFrame([("t", "a", 1), ("t", "b", 2)], "topic_id string, doc_id string, rel int")
    v = ev.evaluate(run, qrels, ["ndcg@2"], decimals=None).first()["value"]
    l3 = math.log2(3)
    assert v == pytest.approx((1 + 2 / l3) / (2 + 1 / l3))


def test_bpref_relevant_above_and_below_nonrelevant(spark):
    run = spark.createDataFrame([("t", "r1", 1), ("t", "n", 2), ("t", "r2", 3)],
                                "topic_id string, doc_id string, rank long")
    qrels = spark.createDataFrame([("t", "r1", 1), ("t", "r2", 1), ("t", "n", 0)],
                                  "topic_id string, doc_id string, rel int")
    v = ev.evaluate(run, qrels, ["bpref@1000"], decimals=None).first()["value"]
    assert v == pytest.approx((1 + 0) / 2)


def test_precision_recall_rprec_map(spark):
    run = spark.createDataFrame([("t", "a", 1), ("t", "x", 2), ("t", "b", 3)],
                                "topic_id string, doc_id string, rank long")
    qrels = spark.createDataFrame([("t", "a", 1), ("t", "b", 2), ("t", "c", 1)],
                                  "topic_id string, doc_id string, rel int")
    got = {(r["metric"], r["depth"]): r["value"] for r in
           ev.evaluate(run, qrels, ["p@2", "recall@3", "rprec@1000", "map@1000", "recip_rank@10"],
                       decimals=None).collect()}
    assert got[("p", 2)] == pytest.approx(0.5)
    assert got[("recall", 3)] == pytest.approx(2 / 3)
    assert got[("rprec", 1000)] == pytest.approx(2 / 3)
    assert got[("map", 1000)] == pytest.approx((1 / 1 + 2 / 3) / 3)
    assert got[("recip_rank", 10)] == pytest.approx(1.0)


def test_contrastive_loss_values(spark):
    one = spark.createDataFrame([([0.0, 0.0], [0.2, 0.0], 1)], "a array<double>, b array<double>, label int")
    zero = spark.createDataFrame([([0.0, 0.0], [0.2, 0.0], 0)], "a array<double>, b array<double>, label int")
    assert pr.contrastive_loss(one, "euclidean", 0.5).first()["loss_mean"] == pytest.approx(0.02)
    assert pr.contrastive_loss(zero, "euclidean", 0.5).first()["loss_mean"] == pytest.approx(0.045)


def test_label_remap(spark):
    df = spark.createDataFrame([(-1,), (0,), (1,), (2,)], "label int")
    assert sorted(r[0] for r in remap_labels(df).collect()) == [0, 0, 1]
    assert [r[0] for r in df.select(F.floor(F.col("label") / 2)).collect()] == [-1, 0, 0, 1]


def test_topic_id_zero_is_kept_and_last_duplicate_wins(spark, tmp_path):
    from rankspark.sources.topics import read_topics_csv
    p = tmp_path / "topics.tsv"
    p.write_text("id\ttext\n0\tzero topic\n7\tfirst\n7\tsecond\n")
    rows = {r["topic_id"]: r["text"] for r in read_topics_csv(spark, str(p), sep="\t").collect()}
    assert rows == {"0": "zero topic", "7": "second"}


def test_supcon_single_pair(spark):
    # two samples with the same label, unit vectors at 90°: logits 0 → loss = −(0 − log(e^0)) = 0
    views = spark.createDataFrame([(0, 0, 0, 1, [1.0, 0.0]), (0, 1, 0, 1, [0.0, 1.0])],
                                  "batch int, sample_id int, view int, label int, vec array<double>")
    assert pr.supcon_loss(views).first()["loss"] == pytest.approx(0.0)


def test_paired_t_pvalue(spark):
    from rankspark.functions.stats import t_pvalue
    # reference values of the t distribution (tables), odd and even degrees of freedom
    cases = [(2.0, 10, 0.07338803), (0.0, 5, 1.0), (12.7062, 1, 0.05), (4.302653, 2, 0.05), (3.182446, 3, 0.05),
             (-2.776445, 4, 0.05), (2.228139, 10, 0.05), (1.984217, 99, 0.05), (2.0, 0, None), (None, 4, None)]
    df = spark.createDataFrame([(i, t, n, p) for i, (t, n, p) in enumerate(cases)], "i int, t double, n int, want double")
    for r in df.withColumn("p", t_pvalue(F.col("t"), F.col("n"))).collect():
        assert r["p"] == (None if r["want"] is None else pytest.approx(r["want"], abs=2e-6))


def test_missing_topic_column_is_an_error(spark, tmp_path):
    from rankspark.sources.topics import read_topics_csv
    p = tmp_path / "t.csv"
    p.write_text("id,text\n1,a\n")
    with pytest.raises(ValueError):
        read_topics_csv(spark, str(p), fields=("text", "narrative"))


def test_strict_z_raises_when_top_not_above_ceiling(spark):
    from rankspark.operators.index import build_index
    docs = spark.createDataFrame([(1, "zebra")], "doc_id long, body string")
    topics = spark.createDataFrame([(1, "q", 0, "zebra")], "topic_id long, facet string, facet_pos int, text string")
    tv = spark.createDataFrame([(1, "q", 0, [1.0])], "topic_id long, facet string, facet_pos int, embedding array<double>")
    dv = spark.createDataFrame([(1, [1.0])], "doc_id long, embedding array<double>")
    idx = build_index(docs)
    assert hy.hybrid(idx, topics, tv, dv, ceiling=100.0).count() == 0  # left out, and listed:
    assert [r.topic_id for r in hy.low_topics(idx, topics, 100.0).collect()] == [1]
    loose = hy.hybrid(idx, topics, tv, dv, ceiling=100.0, keep_low=True).first()
    assert loose.z is None and loose.z_ok is False and loose.score is None
    with pytest.raises(ValueError):
        hy.hybrid(idx, topics, tv, dv, ceiling=100.0, strict=True)


def test_residual_options(spark):
    run = spark.createDataFrame([("t", "a", 1), ("t", "b", 2), ("t", "c", 3)], "topic_id string, doc_id string, rank long")
    qrels = spark.createDataFrame([("t", "a", 1), ("t", "c", 1)], "topic_id string, doc_id string, rel int")
    seen = spark.createDataFrame([("t", "a")], "topic_id string, doc_id string")
    keep_ranks = ev.evaluate_residual(run, qrels, seen, ["p@2"]).first().value
    renumbered = ev.evaluate_residual(run, qrels, seen, ["p@2"], rerank=True).first().value
    reduced = ev.evaluate_residual(run, qrels, seen, ["recall@3"], reduce_qrels=True).first().value
    assert keep_ranks == 0.0 and renumbered == 0.5 and reduced == 1.0


def test_complete_counts_missing_topics_as_zero(spark):
    run = spark.createDataFrame([("t", "a", 1)], "topic_id string, doc_id string, rank long")
    qrels = spark.createDataFrame([("t", "a", 1), ("u", "b", 1), ("v", "c", 0)], "topic_id string, doc_id string, rel int")
    default = {r.topic_id: r.value for r in ev.evaluate(run, qrels, ["p@1"]).collect()}
    complete = {r.topic_id: r.value for r in ev.evaluate(run, qrels, ["p@1"], complete=True).collect()}
    assert default == {"t": 1.0}
    assert complete == {"t": 1.0, "u": 0.0}  # v has no relevant document: left out either way
