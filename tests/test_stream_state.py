"""The streamed index keeps its own statistics: versions, late rows, replays, no aggregation on reading."""

import random

from pyspark.sql import functions as F

from rankspark.operators.index import build_index
from rankspark.streaming import incremental as inc

SCHEMA = "doc_id long, version long, title string, body string"
FIELDS = ("title", "body")


def send(spark, folder, out, ck, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    inc.stream_index(spark.readStream.schema(schema).parquet(folder), out, ck, "version", FIELDS, dim=4).awaitTermination()


def tables(index):
    return (sorted(tuple(r) for r in index.postings.select("field", "term", "doc_id", "dl", "tf").collect()),
            sorted(tuple(r) for r in index.term_stats.select("field", "term", "df").collect()),
            sorted((r["field"], r["n_docs"], round(r["avgdl"], 9)) for r in index.field_stats.collect()))


def test_statistics_follow_versions_and_late_rows(spark, tmp_path):
    rng = random.Random(2)
    folder, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    held = {}
    for _ in range(4):
        rows = []
        for _ in range(25):
            i, v = rng.randrange(12), rng.choice((None, 0, 1, 2, 3))
            text = [" ".join(rng.choices("abcdefg", k=rng.randint(0, 5))) if rng.random() < 0.9 else None for _ in range(2)]
            rows.append((i, v, *text))
        newest = {}
        for r in rows:
            key = (r[1] is not None, r[1] or 0)
            if r[0] not in newest or key > newest[r[0]][0]:
                newest[r[0]] = key, [r]
            elif key == newest[r[0]][0]:
                newest[r[0]][1].append(r)
        for i, (key, same) in newest.items():  # equal versions in one batch: the greater row content; made unambiguous here
            for r in same[:-1]:
                rows.remove(r)
            if i not in held or key >= held[i][0]:
                held[i] = key, same[-1]
        send(spark, folder, out, ck, rows)
        want = build_index(spark.createDataFrame([r for _, r in held.values()], SCHEMA), FIELDS)
        assert tables(inc.read_stream_index(spark, out)) == tables(want)
    docs = inc.read_stream_documents(spark, out)
    assert sorted(docs.columns) == sorted(["doc_id", "version", "title", "body", "title_embedding", "body_embedding"])
    assert docs.count() == len(held)


def test_reading_aggregates_nothing(spark, tmp_path):
    folder, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    send(spark, folder, out, ck, [(1, 1, "a", "b c"), (2, 1, "d", "e")])
    send(spark, folder, out, ck, [(1, 2, "a", "z")])
    index = inc.read_stream_index(spark, out)
    for df in (index.postings, index.doc_len, index.term_stats, index.field_stats, inc.read_stream_documents(spark, out)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Window" not in plan


def test_a_replayed_batch_counts_once(spark, tmp_path, monkeypatch):
    folder, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    send(spark, folder, out, ck, [(1, 1, "a", "b c"), (2, 1, "d", "e")])
    real, calls = inc.term_changes, []

    def failing(*args):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost after the documents were written")
        return real(*args)

    monkeypatch.setattr(inc, "term_changes", failing)
    try:
        send(spark, folder, out, ck, [(1, 2, "a a", "z"), (3, 1, None, "y")])
        raise AssertionError("the batch should have failed")
    except Exception as ex:
        assert "lost after" in str(ex)
    unfinished = tables(inc.read_stream_index(spark, out))  # the last finished batch, without the broken one's rows
    assert unfinished == tables(build_index(spark.createDataFrame([(1, 1, "a", "b c"), (2, 1, "d", "e")], SCHEMA), FIELDS))
    inc.stream_index(spark.readStream.schema(SCHEMA).parquet(folder), out, ck, "version", FIELDS, dim=4).awaitTermination()
    want = build_index(spark.createDataFrame([(1, 2, "a a", "z"), (2, 1, "d", "e"), (3, 1, None, "y")], SCHEMA), FIELDS)
    assert tables(inc.read_stream_index(spark, out)) == tables(want)


def test_versions_may_be_times(spark, tmp_path):
    folder, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "doc_id string, version timestamp, title string, body string"
    for rows in ([("x", "2024-05-02 10:00:00", "new", "n")], [("x", "2024-05-01 10:00:00", "old", "o"), ("y", "2024-05-01 10:00:00", "t", "u")]):
        df = spark.createDataFrame(rows, "doc_id string, v string, title string, body string").select("doc_id", F.col("v").cast("timestamp").alias("version"), "title", "body")
        df.coalesce(1).write.mode("append").parquet(folder)
        inc.stream_index(spark.readStream.schema(schema).parquet(folder), out, ck, "version", FIELDS).awaitTermination()
    assert {(r["doc_id"], r["title"]) for r in inc.read_stream_documents(spark, out).collect()} == {("x", "new"), ("y", "t")}
