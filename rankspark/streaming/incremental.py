"""Incremental indexing and topic scoring with Structured Streaming.

* ``stream_index``: each micro-batch is compared with the stored documents by id and version only. A newer
  or equal version passes with the next revision number and the batch that holds its predecessor; an
  older one that arrives late is dropped. Texts are moved only where an id is named twice in a batch. The passing
  documents are cleaned, encoded and written under ``batch_id=<n>`` with overwrite, their postings are
  counted text by text from those rows, and the changes (new terms count +1, those of replaced
  documents -1) are added to the statistics of the batch before, giving the next
  statistics table. A replayed batch (after a failure) starts from the same finished
  batches and rewrites the same folders, so nothing counts twice.
* ``read_stream_index`` reads the newest finished statistics as they are; only replaced
  revisions, which the documents themselves name, are anti-joined away. Nothing is aggregated.
* ``score_topic_stream``: topics arrive as a stream and each micro-batch is
  ranked against a static index (BM25 or hybrid + per-topic top-k), written by
  batch id; ``read_topic_runs`` keeps the latest list of a repeated topic.
Checkpoints live in the cluster's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rankspark.operators import bm25 as bm25_ops
from rankspark.operators.index import LENGTH_MARKER, Index, build_index
from rankspark.operators.runs import rank_run
from rankspark.operators.sizing import broadcast_if_bounded
from rankspark.sources.corpus import enrich

def _ordered(docs: DataFrame, version_col: str):
    """A version as a number or text that sorts like it."""
    kind = docs.schema[version_col].dataType
    v = F.col(version_col)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(v)
    if isinstance(kind, T.DateType):
        return F.unix_date(v).cast("long")
    return v.cast("long") if isinstance(kind, T.IntegralType) else v if isinstance(kind, T.StringType) else v.cast("double")


def _versions(docs: DataFrame, doc_id: str, version_col: str, *others) -> DataFrame:
    """(doc_id, __some, __version, others): a missing version is older than any other."""
    least = F.lit("" if isinstance(docs.schema[version_col].dataType, T.StringType) else 0)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(version_col).isNotNull().alias("__some"), F.coalesce(_ordered(docs, version_col), least).alias("__version"), *others)


def held_versions(batch: DataFrame, stored: DataFrame, doc_id: str) -> DataFrame:
    """(doc_id, held struct<revision, some, version, batch_id>) of the batch's documents that are stored already; no text is read."""
    ids = batch.select(F.col(doc_id).alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    rows = _versions(stored, "doc_id", "version", "revision", "batch_id").join(ids, "doc_id", "left_semi")
    last = F.max(F.struct("revision", F.col("__some").alias("some"), F.col("__version").alias("version"), "batch_id"))
    return rows.groupBy("doc_id").agg(last.alias("held"))


def newest_documents(batch: DataFrame, held: DataFrame | None, doc_id: str, version_col: str) -> DataFrame:
    """The documents of a micro-batch that pass, with ``revision`` and ``__in``, the batch that holds the one they replace (null: none).

    A row without an id is not indexed; a missing version is older than any other. Of one id the newest
    row of the batch counts, of equal versions the greater row content. ``held``: the stored versions, None if there are none.
    """
    rows = batch.where(F.col(doc_id).isNotNull())
    if not rows.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).isEmpty():
        rows = rows.repartition(doc_id)
        order = _versions(rows, doc_id, version_col, F.to_json(F.struct(*[c for c in rows.columns if c != doc_id])).alias("__row"), *[F.col(c).alias(f"__c_{c}") for c in rows.columns])
        w = Window.partitionBy("doc_id").orderBy(F.desc("__some"), F.desc("__version"), F.desc("__row"))
        rows = order.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).select(*[F.col(f"__c_{c}").alias(c) for c in rows.columns])
    if held is None:
        return rows.withColumns({"revision": F.lit(1).cast("long"), "__in": F.lit(None).cast("long")})
    known = broadcast_if_bounded(held.select(F.col("doc_id").alias("__id"), "held"))
    some, version = (F.col(c) for c in ("__some", "__version"))
    rows = _versions(rows, doc_id, version_col, *[F.col(c).alias(f"__c_{c}") for c in rows.columns]).join(known, F.col("doc_id") == F.col("__id"), "left")
    had, was = F.col("held.some"), F.col("held.version")
    rows = rows.where(F.col("__id").isNull() | (some & ~had) | ((some == had) & (version >= was)))
    return rows.select(*[F.col(f"__c_{c}").alias(c) for c in batch.columns], (F.coalesce(F.col("held.revision"), F.lit(0)) + 1).cast("long").alias("revision"),
                       F.col("held.batch_id").cast("long").alias("__in"))


def stream_index(docs_stream: DataFrame, out_path: str, checkpoint: str, version_col: str, fields=("body",), doc_id: str = "doc_id",
                 dim: int | None = None, encoder=None, available_now: bool = True) -> StreamingQuery:
    """Start the incremental indexing stream (see module docstring).

    ``version_col`` orders the versions of a document (a version number or an arrival time); of equal
    versions the one of the later micro-batch wins, within one the greater row content.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark, part = batch.sparkSession, f"batch_id={batch_id}"
        before = last_batch(spark, f"{out_path}/stats", batch_id - 1)
        stored = held = None
        if before is not None:
            stored = spark.read.parquet(f"{out_path}/docs").where(F.col("batch_id") <= F.lit(before))
            held = held_versions(batch, stored, doc_id).persist()  # ids and versions of re-sent documents only
        passing = newest_documents(batch, None if held is None or held.isEmpty() else held, doc_id, version_col)
        docs = enrich(passing, fields, dim, doc_id, encoder)
        docs.withColumnsRenamed({doc_id: "doc_id", version_col: "version"}).write.mode("overwrite").parquet(f"{out_path}/docs/{part}")
        if held is not None:
            held.unpersist()
        docs = spark.read.parquet(f"{out_path}/docs/{part}")
        build_index(docs, fields, keep=("revision",)).raw.write.mode("overwrite").parquet(f"{out_path}/raw/{part}")
        changes = term_changes(spark.read.parquet(f"{out_path}/raw/{part}"), 1)
        replaced = docs.where(F.col("__in").isNotNull()).select("doc_id", (F.col("revision") - 1).alias("revision"), F.col("__in").alias("batch_id"))
        holding = [r["batch_id"] for r in replaced.select("batch_id").distinct().collect()]  # a number a batch at most
        if holding:
            gone = stored.where(F.col("batch_id").isin(holding)).join(broadcast_if_bounded(replaced.drop("batch_id")), ["doc_id", "revision"], "left_semi")
            changes = changes.unionByName(term_changes(build_index(gone, fields, keep=("revision",)).raw, -1))
        if before is not None:
            changes = changes.unionByName(spark.read.parquet(f"{out_path}/stats/batch_id={before}"))
        stats = changes.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")).where(F.col("df") != 0)
        stats.write.mode("overwrite").parquet(f"{out_path}/stats/{part}")

    w = docs_stream.writeStream.outputMode("append").foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def term_changes(raw: DataFrame, sign: int) -> DataFrame:
    """(field, term, df, length): ``sign`` per document and term; under the length marker the document and its length."""
    return raw.select("field", "term", F.lit(sign).cast("long").alias("df"), F.when(F.col("term") == LENGTH_MARKER, F.col("dl") * sign).otherwise(0).cast("long").alias("length"))


def last_batch(spark: SparkSession, path: str, most: int | None = None) -> int | None:
    """The highest finished ``batch_id`` folder (not above ``most``), None if there is none."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    found = []
    for status in files.listStatus(folder):
        name = re.fullmatch(r"batch_id=(\d+)", status.getPath().getName())
        if name and files.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")) and (most is None or int(name[1]) <= most):
            found.append(int(name[1]))
    return max(found, default=None)


def _current(spark: SparkSession, out_path: str, name: str):
    """The rows of the finished batches without replaced revisions, and the last finished batch."""
    last = last_batch(spark, f"{out_path}/stats")
    docs = spark.read.parquet(f"{out_path}/docs").where(F.col("batch_id") <= F.lit(last))
    gone = docs.where(F.col("__in").isNotNull()).select("doc_id", (F.col("revision") - 1).alias("revision"))  # re-sent documents only
    rows = docs if name == "docs" else spark.read.parquet(f"{out_path}/{name}").where(F.col("batch_id") <= F.lit(last))
    return rows if gone.isEmpty() else rows.join(gone, ["doc_id", "revision"], "left_anti"), last


def read_stream_documents(spark: SparkSession, out_path: str) -> DataFrame:
    """The current documents: cleaned text, vectors and version."""
    docs, _ = _current(spark, out_path, "docs")
    return docs.drop("batch_id", "revision", "__in")


def read_stream_index(spark: SparkSession, out_path: str) -> Index:
    """The current index: the newest version of each document, with the statistics that the stream keeps."""
    raw, last = _current(spark, out_path, "raw")
    stats = spark.read.parquet(f"{out_path}/stats/batch_id={last}")
    is_length = F.col("term") == LENGTH_MARKER
    field_stats = stats.where(is_length).select("field", F.col("df").alias("n_docs"), (F.col("length") / F.col("df")).alias("avgdl"))
    return Index(raw.where(~is_length).select("field", "term", "doc_id", "dl", "tf"), raw.where(is_length).select("field", "doc_id", "dl"),
                 stats.where(~is_length).select("field", "term", "df"), field_stats)


def score_topic_stream(topics_stream: DataFrame, index: Index, out_path: str, checkpoint: str, fields=("body",),
                       k: int = 10, k1: float = 1.2, b: float = 0.75, facets: str = "first", available_now: bool = True,
                       score=None) -> StreamingQuery:
    """Rank every micro-batch of topics against a static index; results are written by batch id.

    ``facets`` picks the facets of a topic (``"first"`` or ``"all"``). ``score`` may
    replace BM25: ``score(index, topics) -> run`` with a rank, e.g. a hybrid.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if score is not None:
            run = score(index, batch)
        else:
            run = rank_run(bm25_ops.bm25(index, batch, fields, k1, b, facets=facets, k=k), k=k)
        run.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    w = topics_stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def read_topic_runs(spark: SparkSession, out_path: str) -> DataFrame:
    """The streamed runs; of a topic that came in several batches the last list only."""
    runs = spark.read.parquet(out_path)
    last = runs.groupBy("topic_id").agg(F.max("batch_id").alias("batch_id"))
    return runs.join(last, ["topic_id", "batch_id"], "left_semi")
