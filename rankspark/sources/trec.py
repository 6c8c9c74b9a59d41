"""TREC qrels and run files.

Run line: ``topic<TAB>Q0<TAB>doc<TAB>rank<TAB>score<TAB>run`` (score with six decimals).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.operators.runs import rank_run

DEFAULT_RUN_NAME = "NO_RUN_NAME"


def _fields(spark: SparkSession, path: str, n: int) -> DataFrame:
    parts = F.split(F.trim(F.col("value")), r"\s+")
    return (spark.read.text(path).where(F.length(F.trim("value")) > 0)
            .select(*[parts[i].alias(f"c{i}") for i in range(n)]))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``topic iter doc rel`` (whitespace separated)."""
    f = _fields(spark, path, 4)
    return f.select(F.col("c0").alias("topic_id"), F.col("c1").alias("iter"), F.col("c2").alias("doc_id"),
                    F.col("c3").cast("int").alias("rel"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """Six whitespace-separated columns."""
    f = _fields(spark, path, 6)
    return f.select(F.col("c0").alias("topic_id"), F.col("c2").alias("doc_id"), F.col("c3").cast("long").alias("rank"),
                    F.col("c4").cast("double").alias("score"), F.col("c5").alias("run_name"))


def trec_lines(run: DataFrame, run_name: str | None = None) -> DataFrame:
    """The text lines of a run (one ``value`` per row)."""
    name = F.col("run_name") if run_name is None and "run_name" in run.columns else F.lit(run_name or DEFAULT_RUN_NAME)
    return run.select("topic_id", "rank", F.concat_ws(
        "\t", F.col("topic_id").cast("string"), F.lit("Q0"), F.col("doc_id").cast("string"),
        F.col("rank").cast("string"), F.format_string("%.6f", F.col("score")), name).alias("value"))


def format_run(run: DataFrame, resort: bool = True, order_by=None, run_name: str | None = None) -> DataFrame:
    """Optionally renumber ranks by score (or a custom order), then the run lines."""
    if resort:
        run = rank_run(run.drop("rank") if "rank" in run.columns else run, order_by=order_by)
    return trec_lines(run, run_name)


def write_run(run: DataFrame, path: str, run_name: str | None = None, mode: str = "errorifexists",
              num_files: int | None = None) -> None:
    """Write a run as TREC text; ordered by topic then rank inside each file.

    Range-partitioning by (topic, rank) keeps the files in run order; an
    existing output is refused unless ``mode="overwrite"``.
    """
    lines = trec_lines(run, run_name)
    # (topic, rank) as the range key keeps files in run order and lets one huge topic span files
    if num_files:
        lines = lines.repartitionByRange(num_files, "topic_id", "rank")
    else:
        lines = lines.repartitionByRange("topic_id", "rank")
    lines.sortWithinPartitions("topic_id", "rank").select("value").write.mode(mode).text(path)
