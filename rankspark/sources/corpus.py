"""Corpus readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.functions.columns import flatten_structs, remap_labels, unwrap_singletons
from rankspark.functions.text import clean_whitespace


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Full corpus scan (Parquet; projections and filters reach the scan)."""
    return spark.read.parquet(path)


def read_docs_xml(spark: SparkSession, path: str, row_tag: str, sections, sep: str = ".") -> DataFrame:
    """One XML file per document; listed sections, nested tags flattened, one-element lists unwrapped.

    The document id is the file name without its ``.xml`` suffix.
    """
    raw = spark.read.format("xml").option("rowTag", row_tag).load(path)
    present = [s for s in sections if s in raw.columns]
    df = raw.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.xml$", "").alias("doc_id"), *present)
    return unwrap_singletons(flatten_structs(df, sep=sep))


def read_posts(spark: SparkSession, path: str, kind: str = "submissions") -> DataFrame:
    """Forum posts keyed by id; comments rename selftext → text and title → text2."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return posts(raw, kind)


def posts(raw: DataFrame, kind: str = "submissions") -> DataFrame:
    if kind == "submissions":
        return raw.select("id", F.col("body").alias("text"))
    if kind == "comments":
        return raw.select("id", "parent_id", F.col("selftext").alias("text"), F.col("title").alias("text2"))
    raise ValueError("kind must be 'submissions' or 'comments'")


def load_pairs(df: DataFrame, text_cols, label_col: str = "label", id_col: str | None = None,
               limit: int | None = None, div: int = 2, drop: int = -1) -> DataFrame:
    """Labelled pairs; the first ``limit`` rows by ``id_col``; label // div with ``drop`` removed."""
    out = df.select(*([id_col] if id_col else []), *text_cols, label_col)
    if limit is not None:
        if id_col is None:
            raise ValueError("a limit needs an order column (id_col)")
        out = out.orderBy(id_col).limit(limit)
    return remap_labels(out, label_col, div, drop)


def enrich(docs: DataFrame, fields, dim: int | None = None, doc_id: str = "doc_id", encoder=None) -> DataFrame:
    """Cleaned text fields and a ``<field>_embedding`` for each, in one pass and without a join.

    The hash encoder by default, or any ``encode_batch`` object (one pass per field).
    """
    from rankspark.operators.dense import DEFAULT_DIM, encode, hash_encode_columns
    cleaned = docs.withColumns({f: clean_whitespace(f) for f in fields})
    if encoder is None:
        carried = cleaned.withColumns({f"__{f}": F.col(f) for f in fields})
        return hash_encode_columns(carried, {f"__{f}": f"{f}_embedding" for f in fields}, dim or DEFAULT_DIM, keep=cleaned.columns)
    for f in fields:
        # a null text is not encoded: an empty one stands in and its vector is removed again
        cleaned = encode(cleaned.withColumn("__text", F.coalesce(F.col(f), F.lit(""))), "__text", encoder, f"{f}_embedding", keep=cleaned.columns)
        cleaned = cleaned.withColumn(f"{f}_embedding", F.when(F.col(f).isNotNull(), F.col(f"{f}_embedding")))
    return cleaned


def enrich_corpus(docs: DataFrame, fields, path: str, mode: str = "errorifexists", **kw) -> None:
    """Write a new corpus version with cleaned text and vector columns (no in-place update)."""
    enrich(docs, fields, **kw).write.mode(mode).parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "doc_id", mode: str = "errorifexists") -> None:
    """Store a corpus or vector table bucketed (and sorted) by ``key`` as a catalog table.

    Scans of a bucketed table report hash partitioning on the key, so tokenising,
    the postings aggregate, the (topic, doc) sum and the join of candidates with
    document vectors (stored with the same bucket count) need no exchange.
    """
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
