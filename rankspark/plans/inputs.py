"""Stand-in inputs built from the driver's tables.

These only reshape the given tables into the schemas the operators expect
(corpus, topics, judgements, vectors). They do none of the operators' work.

* corpus   documents → doc_id, title (first line), body (whole text), source, lang
* topics   benchmark → topic_id = item_id, one facet ``text`` at position 0
* qrels    a document is relevant to a topic when the topic's tokens occur in it
           as one run (grade 1 + labels.quality, 1 when unlabelled); labelled
           documents that have the topic's rarest token without containing the
           run are judged non-relevant (grade 0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankspark.functions.text import first_line, tokenize
from rankspark.operators.index import Index, build_index
from rankspark.operators.sizing import max_broadcast_rows, spread

CORPUS_FIELDS = ("title", "body")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    return d.select("doc_id", first_line("text").alias("title"), F.col("text").alias("body"), "source", "lang")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("topic_id"), F.lit("text").alias("facet"),
                    F.lit(0).alias("facet_pos"), "text")


def conversation_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-facet topics: one conversation per topic, one facet per turn (``role_turn``)."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("topic_id"),
                    F.concat_ws("_", "role", F.col("turn").cast("string")).alias("facet"),
                    F.col("turn").cast("int").alias("facet_pos"), "text")


def corpus_index(spark: SparkSession, sf_dir: str, fields=CORPUS_FIELDS) -> Index:
    return build_index(corpus(spark, sf_dir), fields)


def _token_line(col) -> "F.Column":
    """The tokens of a text between single spaces (also before the first and after the last)."""
    return F.concat(F.lit(" "), F.array_join(tokenize(col), " "), F.lit(" "))


def qrels(spark: SparkSession, sf_dir: str, index: Index | None = None) -> DataFrame:
    """(topic_id, doc_id, rel) as described in the module docstring.

    Containment is a run of tokens, so a document that holds the topic holds each
    of its tokens: the candidates are the documents with the topic's rarest token
    (an equi-join, exact for topics of any length; a topic without tokens has no
    judgements), verified on the token line of the same row. One pass over
    the corpus carries terms and token lines of the documents that hold any
    topic token; the df count and the candidate join share it.
    ``index`` is accepted for call compatibility and not needed.
    """
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("topic_id"), "text")
    inner = (b.select("topic_id", _token_line("text").alias("topic_line"), F.explode(F.array_distinct(tokenize("text"))).alias("term")))
    small = inner.count() <= max_broadcast_rows(inner)  # bounds both topic-side tables below
    terms = inner.select("term").distinct()
    terms = F.broadcast(terms) if small else terms
    pairs = (docs.select("doc_id", F.explode_outer(F.array_distinct(tokenize("text"))).alias("term"))
             .where(F.col("term").isNotNull())
             .join(terms, "term", "left_semi")
             .repartition("doc_id"))  # the shared exchange: both consumers read it
    body_df = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # a token that no document has makes the topic's containment impossible; the rarest that occurs still gives the judged ones
    w = Window.partitionBy("topic_id").orderBy("df", "term")
    anchor = (inner.join(body_df, "term").withColumn("r", F.row_number().over(w))
              .where(F.col("r") == 1).select("topic_id", "topic_line", "term"))
    # anchors are a subset of the topics' tokens: bounded by ``inner``
    cand = pairs.join(F.broadcast(anchor) if small else anchor, "term").select("topic_id", "doc_id", "topic_line")
    judged = (cand.join(docs.select("doc_id", F.col("text").alias("doc_text")), "doc_id")
              .withColumn("hit", F.contains(_token_line("doc_text"), F.col("topic_line")))
              .join(labels, "doc_id", "left"))
    return (judged.where(F.col("hit") | F.col("quality").isNotNull())
            .select("topic_id", "doc_id",
                    F.when(F.col("hit"), F.lit(1) + F.coalesce(F.col("quality"), F.lit(0)))
                    .otherwise(F.lit(0)).cast("int").alias("rel")))


def doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial document vectors: ``embeddings.vec_id`` taken as a document id."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), "embedding", "label")
