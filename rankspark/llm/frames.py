"""Helpers around DataFrames: written intermediate tables, Arrow maps that carry other columns."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a local one only on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="rankspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


BATCH_ROWS = 1000
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(df: DataFrame) -> None:
    """Whole texts travel to Python in batches of ``BATCH_ROWS`` rows, unless the session sets its own number.

    Spark's default of 10,000 rows would put tens of MB of text (and their copies) into every worker at once.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        conf.set(_BATCH_CONF, str(BATCH_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps survive a lost executor."""
    path = os.path.join(shared_dir(df.sparkSession), f"llm-{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """Write ``df`` to the shared folder in buckets by ``column``: later joins and groups on it need no shuffle.

    The table's entry lives in the session's catalog; ``forget`` takes it out again.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"llm_{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = os.path.join(shared_dir(spark), table)
    writer = df.repartition(n, column).write.format("parquet").option("compression", "zstd").option("path", path)
    writer.bucketBy(n, column).saveAsTable(table)
    return spark.table(table)


def forget(df: DataFrame) -> None:
    """Take a ``bucketed`` table out of the session's catalog; ``df`` is not read any more."""
    spark = df.sparkSession
    for table in re.findall(r"llm_[a-z_]*_[0-9a-f]{32}", df._jdf.queryExecution().analyzed().toString()):
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def without(df: DataFrame, names) -> DataFrame:
    """``df`` without columns that clash (in any case) with columns about to be added."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


class Carried:
    """A frame under neutral column names (``c0``, ``c1``, ...), so that an operator's own names cannot clash.

    ``carried["text"]`` is the neutral name of an input column; ``restore`` gives
    the input's names back. Columns in ``replaced`` (in any case) are left out.
    """

    def __init__(self, df: DataFrame, replaced=()):
        taken = {n.lower() for n in replaced}
        self.names = [c for c in df.columns if c.lower() not in taken]
        self.df = df.select(*[df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(self.names)])

    def __getitem__(self, name: str) -> str:
        return f"c{[c.lower() for c in self.names].index(name.lower())}"

    def restore(self, out: DataFrame, *added, **instead) -> DataFrame:
        """The input's columns from ``out`` (``instead``: other columns for some of them), then ``added``."""
        return out.select(*[F.col(instead.get(f"c{i}", f"c{i}")).alias(c) for i, c in enumerate(self.names)], *added)


def map_rows(df: DataFrame, fn, fields: list[T.StructField]) -> DataFrame:
    """Adds columns computed per Arrow batch: ``fn(batch) -> list of Arrow arrays``, one per field.

    All other columns pass through untouched; an input column with the name of a new one is replaced.
    """
    base = without(df, [f.name for f in fields])
    kept = [c for c in base.columns]
    schema = T.StructType([*base.schema.fields, *fields])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            new = fn(batch)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], *new],
                                             names=[*kept, *[f.name for f in fields]])

    return df.mapInArrow(run, schema)
