"""Size-checked broadcast.

A side is broadcast only after its rows and bytes have been measured and found
below their bounds; above them the join stays a shuffle join (and AQE may still turn
it into a broadcast at run time from the measured shuffle size). Only call this
on tables derived from topics, settings or other small inputs — the count is a
job of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS_CONF = "rankspark.broadcast.maxRows"
DEFAULT_MAX_BROADCAST_ROWS = 2_000_000


MAX_BROADCAST_BYTES_CONF = "rankspark.broadcast.maxBytes"
DEFAULT_MAX_BROADCAST_BYTES = 256 << 20


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: texts and arrays by their length, anything else 16."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.octet_length(c) + 16)
        elif isinstance(f.dataType, T.ArrayType):
            inner = f.dataType.elementType
            one = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.octet_length(x) if isinstance(inner, T.StringType) else F.size(x) * 8, F.lit(0)) + 16) \
                if isinstance(inner, (T.StringType, T.ArrayType)) else F.size(c) * 8
            parts.append(one + 16)
        else:
            parts.append(F.lit(16))
    total = F.lit(0).cast("long")
    for p in parts:
        total = total + F.coalesce(p, F.lit(16))
    return total


def max_broadcast_bytes(df: DataFrame) -> int:
    conf = df.sparkSession.conf.get(MAX_BROADCAST_BYTES_CONF, None)
    return int(conf) if conf else DEFAULT_MAX_BROADCAST_BYTES


def max_broadcast_rows(df: DataFrame) -> int:
    conf = df.sparkSession.conf.get(MAX_BROADCAST_ROWS_CONF, None)
    return int(conf) if conf else DEFAULT_MAX_BROADCAST_ROWS


def broadcast_if_bounded(df: DataFrame, max_rows: int | None = None, bound_by: DataFrame | None = None) -> DataFrame:
    """Broadcast hint when rows and bytes are within their bounds; the plain frame otherwise.

    ``bound_by`` is a cheaper table whose row count is a proven upper bound of
    ``df``'s (e.g. the query terms for query-term weights joined 1:1 with
    statistics); it is counted instead of ``df``, which then must have columns of fixed width only.
    """
    bound = max_rows if max_rows is not None else max_broadcast_rows(df)
    if bound_by is not None:
        return F.broadcast(df) if bound_by.count() <= bound else df
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(df)).alias("bytes")).first()
    return F.broadcast(df) if size["rows"] <= bound and (size["bytes"] or 0) <= max_broadcast_bytes(df) else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-repartition on ``key`` when a scan yields fewer splits than the cluster has cores.

    Small files with few row groups give few scan tasks; the tokenisation that
    follows is CPU-bound, so it is worth one exchange of the input. Large inputs
    (more splits than cores) are returned untouched — no shuffle is added.
    """
    try:  # classic sessions only; without an RDD view the input is left as it is
        cores = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:
        return df
    if splits < cores:
        return df.repartition(cores, key)
    return df
