"""Cases that earlier versions got wrong, each against its definition."""

import pytest
from pyspark.sql import functions as F

from rankspark.functions import columns as colf
from rankspark.operators import dense as dense_ops
from rankspark.operators import evaluate as ev
from rankspark.operators import folds, sweep
from rankspark.operators.ordering import average_ranks, global_positions
from rankspark.sources import corpus as csrc
from rankspark.sources import topics as tsrc
from rankspark.streaming import incremental as inc


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """400,000 rows of several columns on disk, ids in no order."""
    path = str(tmp_path_factory.mktemp("wide") / "t")
    (spark.range(400_000).select(F.pmod(F.col("id") * 7_919, F.lit(400_000)).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("pad"),
                                 (F.col("id") % 13).alias("kind")).write.parquet(path))
    return spark.read.parquet(path)


def test_positions_and_folds_of_a_wide_table(wide):
    pos = global_positions(wide, [F.col("id")])
    assert pos.columns[:3] == wide.columns and pos.where(F.col("position") != F.col("id")).count() == 0 and pos.count() == 400_000
    cut = folds.contiguous_folds(wide, "id", 3, "id")
    assert cut.where(F.col("fold") != F.floor(F.col("id") * 3 / 400_000)).count() == 0
    ranks = {r[0]: r[1] for r in average_ranks(wide, "kind", "r").select("kind", "r").distinct().collect()}
    n = {r[0]: r[1] for r in wide.groupBy("kind").count().collect()}
    below = 0
    for k in sorted(n):
        assert ranks[k] == below + (n[k] + 1) / 2
        below += n[k]


def test_settings_without_hits_count_as_zero(spark):
    run = spark.createDataFrame([("a", 1, 10, 1), ("a", 2, 20, 1), ("b", 1, 10, 1)], "s string, topic_id int, doc_id int, rank int")
    qrels = spark.createDataFrame([(1, 10, 1), (2, 20, 1)], "topic_id int, doc_id int, rel int")
    got = sorted((r["s"], r["topic_id"], r["value"]) for r in ev.evaluate(run, qrels, ["p@1"], complete=True, keys=("s",)).collect())
    assert got == [("a", 1, 1.0), ("a", 2, 1.0), ("b", 1, 1.0), ("b", 2, 0.0)]
    seen = spark.createDataFrame([(1, 10)], "topic_id int, doc_id int")
    left = ev.evaluate_residual(run, qrels, seen, ["p@1"], keys=("s",)).collect()
    assert [(r["s"], r["topic_id"]) for r in left] == [("a", 2)]


def test_stratified_folds_do_not_depend_on_the_table_size(spark):
    small = spark.range(500).select("id", F.lit("x").alias("label"))
    a = {r["id"]: r["fold"] for r in folds.stratified_folds(small, "id", "label", 5).collect()}
    counts = [list(a.values()).count(f) for f in range(5)]
    assert counts == [100] * 5


def test_nested_repeated_tags(spark, tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "A1.xml").write_text("<doc><cond><mesh>m1</mesh><mesh>m__2</mesh></cond></doc>")
    (d / "A2.xml").write_text("<doc><cond><mesh>m3</mesh></cond></doc>")
    rows = {r["doc_id"]: r["cond.mesh"] for r in csrc.read_docs_xml(spark, str(d), "doc", ["cond"]).collect()}
    assert rows == {"A1": "m1 m__2", "A2": "m3"}
    odd = spark.createDataFrame([(["x"], ["y", "z"])], ["a.b", "c__d"])
    assert tuple(colf.unwrap_singletons(odd).first()) == ("x", "y z")
    many = spark.createDataFrame([("i", [str(k) for k in range(30)], 1.0)], "id string, texts array<string>, label double")
    assert colf.examples_to_columns(many).columns[26:29] == ["text_z", "text_aa", "text_ab"]


def test_wide_topics_keep_every_facet(spark):
    t = spark.createDataFrame([(1, f"f{k}", k, f"t{k}") for k in range(40)], "topic_id int, facet string, facet_pos int, text string")
    row = tsrc.topics_to_wide(t).first()
    assert all(row[f"f{k}"] == f"t{k}" for k in range(40))


def test_parameter_types(spark):
    g = sweep.param_grid(spark, {"x": {"type": "discrete_uniform", "low": 0, "high": 1, "q": 0.5}}, 200)
    assert {r["x"] for r in g.collect()} == {0.0, 0.5, 1.0}
    with pytest.raises(ValueError):
        sweep.param_grid(spark, {"x": {"type": "float", "low": 1, "high": 2, "log": True, "step": 0.5}}, 3)
    with pytest.raises(ValueError):
        sweep.param_grid(spark, {"x": {"type": "discrete_uniform", "low": 1, "high": 2}}, 3)


def test_dense_ties_are_cut_inside_the_task(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding")).coalesce(1)
    odd = spark.createDataFrame([(9001, None), (9002, [0.0, 0.0])], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "topic_id long, embedding array<double>")
    got = {}
    for r in dense_ops.dense_topk(q, docs.unionAll(odd), k=5).collect():
        got.setdefault(r["topic_id"], []).append((r["rank"], r["doc_id"]))
    assert {k: sorted(v) for k, v in got.items()} == {t: [(i + 1, i) for i in range(5)] for t in (1, 2)}


def test_late_old_version_does_not_win(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for rows in ([(1, 2, "new  text"), (2, 1, "other")], [(1, 1, "old"), (2, 1, "other again"), (1, 0, "older")]):
        spark.createDataFrame(rows, "doc_id long, version long, body string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("doc_id long, version long, body string").parquet(src)
        inc.stream_index(stream, out, ck, "version", dim=8).awaitTermination()
    docs = {r["doc_id"]: r for r in inc.read_stream_documents(spark, out).collect()}
    assert docs[1]["body"] == "new text" and docs[2]["body"] == "other again" and len(docs[1]["body_embedding"]) == 8
    terms = {(r["term"], r["doc_id"]) for r in inc.read_stream_index(spark, out).postings.collect()}
    assert terms == {("new", 1), ("text", 1), ("other", 2), ("again", 2)}


def test_repeated_topic_keeps_its_last_list(spark, tmp_path):
    path = str(tmp_path / "runs")
    for batch, doc in ((0, 5), (1, 6)):
        spark.createDataFrame([(1, doc, 1)], "topic_id int, doc_id int, rank int").write.parquet(f"{path}/batch_id={batch}")
    assert [(r["topic_id"], r["doc_id"]) for r in inc.read_topic_runs(spark, path).collect()] == [(1, 6)]
