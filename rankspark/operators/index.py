"""Postings and collection statistics per field.

The postings carry the document length next to the term frequency, so scoring
never joins the (corpus-sized) length table back in; the per-field statistics
are one row per field and are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.functions.text import tokenize


# Fixed value: the term of the one marker row per (field, document) in ``Index.raw``.
# Tokens are non-empty runs of letters/digits, so the empty string never clashes.
LENGTH_MARKER = ""
ROWS = 1 << 18  # rows of one Arrow batch on the way out


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # field, term, doc_id, dl, tf
    doc_len: DataFrame  # field, doc_id, dl
    term_stats: DataFrame  # field, term, df
    field_stats: DataFrame  # field, n_docs, avgdl
    # Postings plus one LENGTH_MARKER row per (field, doc): a single tokenisation pass
    # yields postings, lengths and statistics (None for an index read from storage).
    raw: DataFrame | None = None
    # field, doc_id, toks: the tokens of each text, from which term lists are counted row by row (None when read from storage).
    tokens: DataFrame | None = None

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """Persist the index: postings range-clustered by (field, term) so row-group statistics prune scans.

        A fresh index is tokenised once: its raw rows are written first, and the
        four tables (and the range sampling) read them from there.
        """
        if self.raw is not None:
            self.raw.write.mode(mode).parquet(f"{path}/raw")
            from_raw(self.raw.sparkSession.read.parquet(f"{path}/raw"), keep_raw=False).write(path, mode)
            return
        # doc_id in the range key splits a very frequent term over several files
        (self.postings.repartitionByRange("field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id")
         .write.mode(mode).parquet(f"{path}/postings"))
        self.doc_len.write.mode(mode).parquet(f"{path}/doc_len")
        self.term_stats.repartitionByRange("field", "term").write.mode(mode).parquet(f"{path}/term_stats")
        self.field_stats.coalesce(1).write.mode(mode).parquet(f"{path}/field_stats")

    @staticmethod
    def read(spark, path: str) -> "Index":
        return Index(
            spark.read.parquet(f"{path}/postings"),
            spark.read.parquet(f"{path}/doc_len"),
            spark.read.parquet(f"{path}/term_stats"),
            spark.read.parquet(f"{path}/field_stats"),
        )


def fields_long(docs: DataFrame, fields, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, field, text) for the listed text fields, null texts dropped."""
    packed = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])
    return (docs.select(F.col(doc_id).alias("doc_id"), F.explode(packed).alias("f"))
            .select("doc_id", "f.field", "f.text")
            .where(F.col("text").isNotNull()))


def build_index(docs: DataFrame, fields=("body",), doc_id: str = "doc_id", keep=()) -> Index:
    """Tokenise each field once and derive postings, lengths and statistics (lazy).

    Each (field, doc) contributes its token rows plus one marker row carrying its
    length, all through one ``explode_outer`` (no inferred filter re-running the
    regex) and one partial + final aggregate. With ``keep``, columns that raw rows carry, each
    doc_id must name one document: its terms are counted text by text and no row is dealt.
    """
    if keep:
        return from_raw(counted_rows(docs, fields, doc_id, keep))
    tokens = fields_long(docs, fields, doc_id).select("field", "doc_id", tokenize("text").alias("toks"))
    raw = (tokens
           .select("field", "doc_id", F.size("toks").alias("dl"),
                   F.explode_outer(F.concat(F.array(F.lit(LENGTH_MARKER)), F.col("toks"))).alias("term"))
           .where(F.col("term").isNotNull())
           .groupBy("field", "term", "doc_id", "dl")
           .agg(F.count(F.lit(1)).alias("tf")))
    return replace(from_raw(raw), tokens=tokens)


def counted_rows(docs: DataFrame, fields, doc_id: str, keep) -> DataFrame:
    """``(field, term, doc_id, dl, tf, keep...)``: the raw rows of documents with one row each, counted in Arrow batches."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])).alias("f"))
    texts = texts.where(F.col("f.text").isNotNull()).select("doc_id", *keep, "f.field", tokenize("f.text").alias("toks"))
    schema = T.StructType([T.StructField("field", T.StringType()), T.StructField("term", T.StringType()), texts.schema["doc_id"], T.StructField("dl", T.IntegerType()),
                           T.StructField("tf", T.LongType()), *[texts.schema[c] for c in keep]])
    n_keep = len(keep)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            toks = batch.column(n_keep + 2)
            words = pc.list_flatten(toks).dictionary_encode()
            n = max(1, len(words.dictionary))
            key, tf = np.unique(pc.list_parent_indices(toks).to_numpy().astype(np.int64) * n + words.indices.to_numpy(), return_counts=True)
            dl = pc.list_value_length(toks)
            # one marker row a text, then its terms
            owner = np.concatenate([np.arange(batch.num_rows), key // n])
            term = pa.concat_arrays([pa.array([LENGTH_MARKER], words.dictionary.type), words.dictionary])
            place = np.concatenate([np.zeros(batch.num_rows, dtype=np.int64), key % n + 1])
            tf = np.concatenate([np.ones(batch.num_rows, dtype=np.int64), tf])
            for a in range(0, len(owner), ROWS):
                of = pa.array(owner[a:a + ROWS])
                yield pa.RecordBatch.from_arrays([batch.column(n_keep + 1).take(of), term.take(pa.array(place[a:a + ROWS])), batch.column(0).take(of), dl.take(of), pa.array(tf[a:a + ROWS]),
                                                  *[batch.column(1 + i).take(of) for i in range(n_keep)]], names=schema.names)

    return texts.mapInArrow(run, schema)


def from_raw(raw: DataFrame, keep_raw: bool = True) -> Index:
    """The index tables of raw rows (postings and length markers)."""
    postings = raw.where(F.col("term") != LENGTH_MARKER)
    doc_len = raw.where(F.col("term") == LENGTH_MARKER).select("field", "doc_id", "dl")
    term_stats = postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    field_stats = doc_len.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"),
                                               F.avg("dl").alias("avgdl"))
    return Index(postings.select("field", "term", "doc_id", "dl", "tf"), doc_len, term_stats, field_stats, raw if keep_raw else None)
