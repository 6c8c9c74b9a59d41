"""A corpus pipeline from five of the training-data operators.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and
returns the documents it keeps, with the columns of ``documents`` (the last one
adds ``copy``). Between stages the table is written and read again. A text that a stage
shortens gets its ``n_chars`` anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm import decontaminate, jaccard_join, language_id, line_dedup, mixing
from rankspark.llm.frames import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_identified(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that the classifier rejects (no letters, or no language likely enough) go."""
    found = language_id.identify(docs.select(*COLUMNS), language_id.train_on(docs))
    return found.where(~F.col("rejected")).select(*COLUMNS)


def drop_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines found in several documents stay in the first one only."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(*COLUMNS)


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group of near copies stays."""
    return jaccard_join.keep_one(docs.select(*COLUMNS))


def drop_benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark window go."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document as often as the mix takes it, with the number of the copy."""
    return mixing.mix_documents(docs.select(*COLUMNS))


STAGES = [("language_id", keep_identified), ("line_dedup", drop_repeated_lines), ("near_copies", drop_near_copies),
          ("decontamination", drop_benchmark), ("mixing", mix)]

#: A trained classifier and a random draw: not expressible in SQL, tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
