"""Readers, writers and column helpers."""

import math

import pytest
from pyspark.sql import functions as F

from rankspark.functions import columns as colf
from rankspark.functions.text import clean_whitespace, sentences, tokenize
from rankspark.sources import corpus as csrc
from rankspark.sources import topics as tsrc
from rankspark.sources import trec


def test_run_write_read_roundtrip(spark, tmp_path):
    run = spark.createDataFrame([("1", "d1", 1, 3.5), ("1", "d2", 2, 1.25), ("0", "d9", 1, 0.5)],
                                "topic_id string, doc_id string, rank long, score double")
    p = str(tmp_path / "run")
    trec.write_run(run, p, run_name="x")
    with pytest.raises(Exception):
        trec.write_run(run, p, run_name="x")  # existing output refused
    back = sorted(tuple(r) for r in trec.read_run(spark, p).collect())
    assert back == [("0", "d9", 1, 0.5, "x"), ("1", "d1", 1, 3.5, "x"), ("1", "d2", 2, 1.25, "x")]
    lines = [r.value for r in trec.trec_lines(run).collect()]
    assert "1\tQ0\td1\t1\t3.500000\tNO_RUN_NAME" in lines


def test_format_run_resorts(spark):
    run = spark.createDataFrame([("t", "a", 9, 1.0), ("t", "b", 1, 2.0)],
                                "topic_id string, doc_id string, rank long, score double")
    ranks = dict(r.value.split("\t")[2:4] for r in trec.format_run(run).collect())
    assert ranks == {"b": "1", "a": "2"}
    custom = trec.format_run(run, order_by=[F.col("doc_id").asc()]).collect()
    assert sorted(r.value.split("\t")[2:4] for r in custom) == [["a", "1"], ["b", "2"]]


def test_read_qrels(spark, tmp_path):
    p = tmp_path / "q.txt"
    p.write_text("1 0 d1 2\n1 0 d2 0\n\n2  0   d3 1\n")
    rows = sorted(tuple(r) for r in trec.read_qrels(spark, str(p)).collect())
    assert rows == [("1", "0", "d1", 2), ("1", "0", "d2", 0), ("2", "0", "d3", 1)]


def test_read_topics_jsonl_substring_and_exact(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text('{"qid": 1, "doc_id": "a", "q_text": "hello", "brief_title": "x", "other": "y"}\n'
                 '{"qid": 2, "doc_id": "b", "q_text": "bye", "brief_title": "z", "other": "w"}\n')
    loose = tsrc.read_topics_jsonl(spark, str(p), "qid", ["text", "title"], secondary_id="doc_id")
    got = sorted((r.topic_id, r.facet, r.text) for r in loose.collect())
    assert ("1_a", "q_text", "hello") in got and ("2_b", "brief_title", "z") in got
    assert all(f != "other" for _, f, _ in got)
    exact = tsrc.read_topics_jsonl(spark, str(p), "qid", ["q_text"], exact=True)
    assert sorted(r.text for r in exact.collect()) == ["bye", "hello"]


def test_read_topics_xml_fields_and_plain(spark, tmp_path):
    p = tmp_path / "fields.xml"
    p.write_text('<topics><topic number="1"><query> heart attack </query><question>why?</question></topic>'
                 '<topic number="2"><query>flu</query></topic></topics>')
    rows = sorted((r.topic_id, r.facet, r.text) for r in
                  tsrc.read_topics_xml(spark, str(p), fields=["query", "question", "narrative"]).collect())
    assert rows == [("1", "query", "heart attack"), ("1", "question", "why?"), ("2", "query", "flu")]
    q = tmp_path / "plain.xml"
    q.write_text('<topics><topic number="5">  a plain topic </topic></topics>')
    assert [(r.topic_id, r.facet, r.text) for r in tsrc.read_topics_xml(spark, str(q)).collect()] == [
        ("5", "query", "a plain topic")]


def test_read_docs_xml_one_file_per_doc(spark, tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "NCT01.xml").write_text("<doc><brief_title>T1</brief_title><brief_summary><textblock>S1</textblock>"
                                 "</brief_summary><condition>c1</condition><condition>c2</condition></doc>")
    (d / "NCT02.xml").write_text("<doc><brief_title>T2</brief_title><brief_summary><textblock>S2</textblock>"
                                 "</brief_summary><condition>c3</condition></doc>")
    df = csrc.read_docs_xml(spark, str(d), "doc", ["brief_title", "brief_summary", "condition", "missing"])
    rows = {r.doc_id: r.asDict() for r in df.collect()}
    assert rows["NCT01"]["brief_summary.textblock"] == "S1"
    assert rows["NCT02"]["condition"] == "c3" and rows["NCT01"]["condition"] == "c1 c2"


def test_read_posts_and_positional_csv(spark, tmp_path):
    p = tmp_path / "comments.csv"
    p.write_text("id,parent_id,selftext,title\n1,9,hello there,greeting\n")
    r = csrc.read_posts(spark, str(p), "comments").first()
    assert (r.id, r.parent_id, r.text, r.text2) == ("1", "9", "hello there", "greeting")
    q = tmp_path / "pos.csv"
    q.write_text("whatever,header\n3,third topic\n")
    t = tsrc.read_topics_csv(spark, str(q), positional=True).first()
    assert (t.topic_id, t.text) == ("3", "third topic")


def test_wide_long_roundtrip(spark):
    long = spark.createDataFrame([("1", "query", 0, "a"), ("1", "question", 1, "b"), ("2", "query", 0, "c")],
                                 "topic_id string, facet string, facet_pos int, text string")
    wide = tsrc.topics_to_wide(long, ["query", "question"])
    back = sorted(tuple(r) for r in tsrc.topics_long(wide, ["query", "question"]).collect())
    assert back == sorted(tuple(r) for r in long.collect())


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, ("x", (2, "y")), ["only"], ["a", "b"])],
                               "id int, s struct<a:string, b:struct<c:int, d:string>>, one array<string>, two array<string>")
    flat = colf.flatten_structs(df.select("id", "s"))
    assert flat.columns == ["id", "s_a", "s_b_c", "s_b_d"] and tuple(flat.first()) == (1, "x", 2, "y")
    un = colf.unwrap_singletons(df.select("one", "two")).first()
    assert (un.one, un.two) == ("only", "a b")
    assert colf.public_facets(spark.createDataFrame([(1, 2)], "a int, _b int")).columns == ["a"]
    ex = colf.examples_to_columns(colf.to_examples(spark.createDataFrame([(1, " p ", "q\n")], "id int, x string, y string"),
                                                   ["x", "y"], "id", label=0.0))
    assert tuple(ex.first()) == (1, "p", "q", 0.0)


def test_text_functions(spark):
    row = spark.createDataFrame([("a\r\n\r\nb\r\nc   d",)], "t string").select(
        clean_whitespace("t").alias("c"), sentences(F.lit("One. Two!  three?\n\n")).alias("s"),
        tokenize(F.lit("Ünïcode, 42 x-y")).alias("k")).first()
    assert row.c == "a\nb c d"
    assert row.s == ["One", "Two", "three"]
    assert row.k == ["ünïcode", "42", "x", "y"]


def test_small_helpers(spark, tmp_path):
    from rankspark.operators.runs import concat_examples, exclude, rank_agreement, select_ids
    from rankspark.sources.corpus import enrich_corpus, load_pairs
    run = spark.createDataFrame([("t", "a", 1, 2.0), ("t", "b", 2, 1.0)],
                                "topic_id string, doc_id string, rank long, score double")
    assert [r.doc_id for r in exclude(run, run.where("doc_id = 'a'")).collect()] == ["b"]
    assert concat_examples(run, run).count() == 4
    assert select_ids(run).columns == ["topic_id", "doc_id", "rank", "score"]
    other = spark.createDataFrame([("t", "a", 1, 2.0), ("t", "c", 2, 1.0)], run.schema)
    ag = rank_agreement(run, other).first()
    assert (ag.n_positions, ag.n_same, ag.agreement) == (2, 1, 0.5)
    pairs = spark.createDataFrame([(3, "x", "y", 2), (1, "p", "q", -1), (2, "m", "n", 1)],
                                  "id int, a string, b string, label int")
    got = sorted((r.id, r.label) for r in load_pairs(pairs, ["a", "b"], id_col="id", limit=2).collect())
    assert got == [(2, 0)]  # first two by id: 1 (−1 → dropped), 2 (1 // 2 = 0)
    docs = spark.createDataFrame([(1, "t")], "doc_id long, body string")
    enrich_corpus(docs, ["body"], str(tmp_path / "v2"))
    assert spark.read.parquet(str(tmp_path / "v2")).columns == ["doc_id", "body", "body_embedding"]
    nested = spark.createDataFrame([((1, "x"),)], "A struct<B:int, Textblock:string>")
    assert nested.select(colf.facet(nested, "A_B")).first()[0] == 1
    assert nested.select(colf.field_text(nested, "A")).first()[0] == "x"
    assert spark.range(1).select(colf.relevance(F.lit(1))).first()[0] == 0.5


def test_hybrid_options_and_generic_rerank(spark):
    from rankspark.operators import hybrid as hy
    from rankspark.operators.index import build_index
    from rankspark.operators.rerank import rerank
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green apple"), (3, "blue sky")], "doc_id long, body string")
    topics = spark.createDataFrame([(7, "q", 0, "apple pie")], "topic_id long, facet string, facet_pos int, text string")
    tv = spark.createDataFrame([(7, "q", 0, [1.0, 0.0])], "topic_id long, facet string, facet_pos int, embedding array<double>")
    dv = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, embedding array<double>")
    idx = build_index(docs)
    plain = {r.doc_id: r for r in hy.hybrid(idx, topics, tv, dv, z=-1.0).collect()}
    assert plain[1].score == pytest.approx(plain[1].bm25)  # negative z: plain BM25
    assert 3 not in plain  # no lexical match, no candidate
    emb_only = {r.doc_id: r.score for r in hy.hybrid(idx, topics, tv, dv, use_bm25=False).collect()}
    assert emb_only == pytest.approx({1: 2.0, 2: 1.0})
    fixed = {r.doc_id: r for r in hy.hybrid(idx, topics, tv, dv, z=2.0, guard=True).collect()}
    assert fixed[2].score == pytest.approx(math.log(fixed[2].bm25) / math.log(2.0) + 1.0)
    custom = hy.hybrid(idx, topics, tv, dv, z=2.0, score_fn=lambda c: c["embed"] * 10).collect()
    assert sorted(r.score for r in custom) == pytest.approx([10.0, 20.0])
    rr = rerank(plain_run := spark.createDataFrame([(7, 1, 1, 5.0), (7, 2, 2, 4.0)],
                                                   "topic_id long, doc_id long, rank long, score double"),
                -F.col("score"))
    assert [r.doc_id for r in rr.orderBy("rank").collect()] == [2, 1]
    del plain_run


def test_survey_named_helpers(spark):
    import rankspark as rs
    scores = spark.createDataFrame([(1, 10, 16.0), (1, 11, 4.0), (2, 12, 1.5)], "topic_id long, doc_id long, score double")
    z = {r.doc_id: r.z for r in rs.attach_z(scores, 2.0).collect()}
    assert z[10] == pytest.approx(4.0) and z[11] == pytest.approx(4.0) and z[12] is None
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, None, "y z")], "doc_id long, title string, body string")
    assert rs.max_seq_length(docs, ["title", "body"]).first()[0] == 3
    idx = rs.build_index(docs, ("body",))
    q = spark.createDataFrame([(7, "body", "z", 1.0)], "topic_id long, field string, term string, qw double")
    m = rs.match_terms(q, idx).collect()
    assert [(r.topic_id, r.doc_id, r.tf) for r in m] == [(7, 2, 1)]
    enc = spark.createDataFrame([(1, "t", [1.0]), (2, "u", None), (3, None, None)], "doc_id long, body string, v array<double>")
    assert [r.doc_id for r in colf.texts_to_encode(enc, "body", "v").collect()] == [2]


def test_write_bucketed_gives_colocated_scans(spark):
    from rankspark.sources.corpus import write_bucketed
    name = "rs_bucketed_docs_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, body string")
    write_bucketed(docs, name, 4)
    t = spark.table(name)
    t.groupBy("doc_id").count().collect()
    final = t.groupBy("doc_id").count()
    final.collect()
    final_plan = final._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Bucketed: true" in final_plan and "Exchange" not in final_plan
    assert t.count() == 40
    spark.sql(f"DROP TABLE IF EXISTS {name}")
