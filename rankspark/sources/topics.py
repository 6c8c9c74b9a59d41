"""Topic readers and the long ↔ wide forms.

Long form: ``topics(topic_id STRING, facet STRING, facet_pos INT, text STRING)``.
When an id occurs twice the later line wins; Spark rows have no order, so each
row carries its position (file path, then a per-file increasing id) and the
winner is picked with ``max_by``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.functions.columns import strip_ws


def _position() -> "F.Column":
    return F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id())


def latest_per_id(df: DataFrame, id_col: str, value_cols, pos_col: str = "__pos") -> DataFrame:
    """Keep the last row (by ``pos_col``) of each id."""
    packed = F.struct(*value_cols)
    return (df.groupBy(id_col).agg(F.max_by(packed, F.col(pos_col)).alias("__v"))
            .select(id_col, *[F.col(f"__v.{c}").alias(c) for c in value_cols]))


def wide_to_long(df: DataFrame, id_col: str, fields) -> DataFrame:
    """Wide topics → long (facet order = order of ``fields``; null facets dropped)."""
    packed = F.array(*[F.struct(F.lit(f).alias("facet"), F.lit(i).alias("facet_pos"),
                                F.col(f).cast("string").alias("text")) for i, f in enumerate(fields)])
    return (df.select(F.col(id_col).cast("string").alias("topic_id"), F.explode(packed).alias("t"))
            .select("topic_id", "t.facet", "t.facet_pos", "t.text").where(F.col("text").isNotNull()))


def topics_long(df: DataFrame, fields, id_col: str = "topic_id") -> DataFrame:
    return wide_to_long(df, id_col, fields)


#: Most columns that ``topics_to_wide`` makes of a topic table's own facets.
MAX_WIDE_FACETS = 2000


def topics_to_wide(topics: DataFrame, fields=None) -> DataFrame:
    """One column per facet, null when absent (a pivot).

    Without ``fields`` all facets of the table become columns, in order of their
    names; more than ``MAX_WIDE_FACETS`` are an error, not a cut.
    """
    if fields is None:
        fields = sorted(r[0] for r in topics.select("facet").where(F.col("facet").isNotNull()).distinct().limit(MAX_WIDE_FACETS + 1).collect())
        if len(fields) > MAX_WIDE_FACETS:
            raise ValueError(f"more than {MAX_WIDE_FACETS} facets; list the wanted ones")
    return (topics.groupBy("topic_id").pivot("facet", list(fields))
            .agg(F.max_by("text", "facet_pos")))


def read_topics_csv(spark: SparkSession, path: str, id_field: str = "id", fields=("text",), sep: str = ",",
                    positional: bool = False) -> DataFrame:
    """Topics from CSV/TSV with a header (or by position: col 0 id, col 1 text)."""
    raw = (spark.read.option("header", True).option("sep", sep).option("multiLine", True)
           .option("escape", '"').csv(path))
    if positional:
        cols = raw.columns
        raw = raw.select(F.col(cols[0]).alias("id"), F.col(cols[1]).alias("text"), "_metadata")
        id_field, fields = "id", ("text",)
    missing = [c for c in (id_field, *fields) if c not in raw.columns]
    if missing:
        raise ValueError(f"topic file lacks columns {missing}")
    with_pos = raw.select(F.col(id_field).alias("topic_id"), *fields, _position().alias("__pos"))
    latest = latest_per_id(with_pos, "topic_id", list(fields))
    return wide_to_long(latest, "topic_id", fields)


def _keep_keys(columns, fields, exact: bool):
    if exact:
        return [c for c in columns if c in fields]
    return [c for c in columns if any(f in c or c in f for f in fields)]


def read_topics_jsonl(spark: SparkSession, path: str, id_field: str, fields, secondary_id: str | None = None,
                      exact: bool = False) -> DataFrame:
    """S3: JSON lines; the id (``id_id2`` with a second id) is popped, kept keys become facets.

    Keys are kept when a wanted field is a substring of the key or the other way
    round (``exact=False``), or on equality; the decision is made on the schema,
    so unwanted keys are never read.
    """
    raw = spark.read.json(path)
    rest = [c for c in raw.columns if c not in (id_field, secondary_id)]
    keep = _keep_keys(rest, fields, exact)
    tid = F.col(id_field).cast("string")
    if secondary_id:
        tid = F.concat_ws("_", tid, F.col(secondary_id).cast("string"))
    with_pos = raw.select(tid.alias("topic_id"), *[F.col(c).cast("string").alias(c) for c in keep],
                          _position().alias("__pos"))
    latest = latest_per_id(with_pos, "topic_id", keep)
    return wide_to_long(latest, "topic_id", keep)


def read_topics_xml(spark: SparkSession, path: str, row_tag: str = "topic", id_attr: str = "number",
                    fields=None) -> DataFrame:
    """One row per ``<topic>``; listed child fields (stripped, absent ones skipped) or the own text as ``query``.

    An id made only of digits is kept as written (string); cast where needed.
    """
    raw = spark.read.format("xml").option("rowTag", row_tag).load(path)
    id_col = F.col(f"_{id_attr}").cast("string")
    if fields:
        present = [f for f in fields if f in raw.columns]
        df = raw.select(id_col.alias("topic_id"), *[strip_ws(F.col(f).cast("string")).alias(f) for f in present],
                        _position().alias("__pos"))
        return wide_to_long(latest_per_id(df, "topic_id", present), "topic_id", present)
    df = raw.select(id_col.alias("topic_id"), strip_ws(F.col("_VALUE").cast("string")).alias("query"),
                    _position().alias("__pos"))
    return wide_to_long(latest_per_id(df, "topic_id", ["query"]), "topic_id", ["query"])


def numeric_ids(topics: DataFrame, id_col: str = "topic_id") -> DataFrame:
    """when every id is made of digits only, make the id column a long (one small check job)."""
    all_digits = topics.agg(F.min(F.col(id_col).cast("string").rlike("^[0-9]+$").cast("int"))).first()[0]
    if all_digits == 1:
        return topics.withColumn(id_col, F.col(id_col).cast("long"))
    return topics
