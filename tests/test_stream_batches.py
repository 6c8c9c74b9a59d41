"""A micro-batch is compared by id and version only: no Python call a document, no postings dealt, no text moved unless an id comes twice."""

from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

from rankspark.operators.index import build_index
from rankspark.streaming import incremental as inc
from tests.test_stream_state import FIELDS, SCHEMA, send, tables

ROWS = [(1, 2, "a b a", "x"), (2, None, None, "y y z"), (3, 1, "", "x")]


def test_no_python_state_a_document(spark, tmp_path, monkeypatch):
    def stop(*_, **__):
        raise AssertionError("a Python call a document")

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandasWithState", stop)
    folder, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    send(spark, folder, out, ck, ROWS)
    send(spark, folder, out, ck, [(2, 0, "q", "y"), (1, 1, "old", "old"), (4, 1, "n", None), (4, 1, "m", None), (None, 9, "no", "id")])
    held = [ROWS[0], ROWS[2], (2, 0, "q", "y"), (4, 1, "n", None)]
    assert tables(inc.read_stream_index(spark, out)) == tables(build_index(spark.createDataFrame(held, SCHEMA), FIELDS))
    assert {(r["doc_id"], r["revision"], r["__in"]) for r in spark.read.parquet(f"{out}/docs/batch_id=1").collect()} == {(2, 2, 0), (4, 1, None)}


def test_rows_of_single_documents_equal_the_dealt_ones(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = build_index(docs, FIELDS, keep=("version",)).raw
    want = build_index(docs, FIELDS).raw.join(docs.select("doc_id", "version"), "doc_id")
    columns = ("field", "term", "doc_id", "dl", "tf", "version")
    assert sorted(map(repr, got.select(*columns).collect())) == sorted(map(repr, want.select(*columns).collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_new_documents_are_not_moved(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert "Exchange" not in inc.newest_documents(docs, None, "doc_id", "version")._jdf.queryExecution().executedPlan().toString()
    held = inc.held_versions(docs, docs.limit(2).select("*", F.lit(1).alias("revision"), F.lit(0).alias("batch_id")), "doc_id")
    assert {(r["doc_id"], r["held"]["version"]) for r in held.collect()} <= {(1, 2), (2, 0), (3, 1)} and held.count() == 2


def test_source_files_have_row_groups_for_all_cores(spark, tmp_path, monkeypatch):
    import glob
    import pyarrow.parquet as pq
    from rankspark.plans import catalog

    class Done:
        def awaitTermination(self):
            pass

    monkeypatch.setattr(catalog, "scratch_path", lambda _, name: str(tmp_path / name))
    monkeypatch.setattr(catalog.inc, "stream_index", lambda *_, **__: Done())
    text = F.concat_ws(" ", *[F.md5(F.concat("id", F.lit(f"|{i}"))) for i in range(40)])
    docs = spark.range(0, 30000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("t").alias("title"), text.alias("body"), F.lit(1).cast("long").alias("version"))
    catalog._streamed(spark, docs)
    (file,) = glob.glob(f"{tmp_path}/docs-stream/*.parquet")
    assert pq.ParquetFile(file).num_row_groups >= 4


def test_reading_joins_only_what_was_sent_again(spark, tmp_path):
    folder, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    send(spark, folder, out, ck, ROWS)
    send(spark, folder, out, ck, [(7, 1, "new", "n")])
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (inc.read_stream_documents(spark, out), inc.read_stream_index(spark, out).postings)]
    assert not any("Join" in p for p in plans) and inc.read_stream_documents(spark, out).count() == 4
    send(spark, folder, out, ck, [(7, 2, "newer", "n")])
    docs = inc.read_stream_documents(spark, out)
    assert "Join" in docs._jdf.queryExecution().optimizedPlan().toString() and {r["title"] for r in docs.where("doc_id = 7").collect()} == {"newer"}
