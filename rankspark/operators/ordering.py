"""Global positions and running totals without a single-task window.

A global ``row_number()`` or running sum with no PARTITION BY puts every row in
one task. Here the rows are range-partitioned on the order key (plus a unique
tie-break, so a hot value is still split), each range partition gets its own
row count / totals (one small row per partition), the offsets of earlier
partitions are summed over that small table, and each row adds its partition's
offset to its position inside the partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankspark.operators.sizing import broadcast_if_bounded
from rankspark.session import scratch_path


def _ranged(df: DataFrame, order_cols, num_partitions: int | None):
    """The rows with the number of their range.

    Range bounds come from a sample, and every evaluation of a range exchange
    samples anew (two branches that need different columns are two exchanges).
    So the ranges are written once, and all that follows reads one assignment.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(df.sparkSession, "ranged")
    df.repartitionByRange(n, *order_cols).withColumn("__pid", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def running_sums(df: DataFrame, order_cols, sum_cols, num_partitions: int | None = None) -> DataFrame:
    """Adds ``cum_<c>`` = Σ c over rows up to and including this one in the global order.

    ``order_cols`` are Columns or names; they must make the order total (add a
    unique column as the last key).
    """
    ranged = _ranged(df, order_cols, num_partitions)
    totals = ranged.groupBy("__pid").agg(*[F.sum(c).alias(f"__t_{c}") for c in sum_cols])
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select("__pid", *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}")
                                       for c in sum_cols])
    inner = Window.partitionBy("__pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "__pid")
    return out.select(*df.columns, *[(F.col(f"__o_{c}") + F.sum(c).over(inner)).alias(f"cum_{c}")
                                     for c in sum_cols])


def global_positions(df: DataFrame, order_cols, num_partitions: int | None = None) -> DataFrame:
    """Adds ``position`` (0-based) in the global order given by ``order_cols`` (must be total)."""
    with_one = df.withColumn("__one", F.lit(1))
    out = running_sums(with_one, order_cols, ["__one"], num_partitions)
    return out.withColumn("position", (F.col("cum___one") - 1).cast("long")).drop("__one", "cum___one")


def average_ranks(df: DataFrame, value_col: str, out_col: str, num_partitions: int | None = None) -> DataFrame:
    """Adds the 1-based average rank of ``value_col`` (ties share the mean of their ranks).

    Ranks come from the distinct values and their counts, so ties never pile up
    in one task; the rank table is joined back on the value.
    """
    counts = df.groupBy(value_col).agg(F.count(F.lit(1)).alias("__c"))
    cum = running_sums(counts, [F.col(value_col).asc()], ["__c"], num_partitions)
    ranks = cum.select(value_col, (F.col("cum___c") - F.col("__c") + (F.col("__c") + 1) / 2.0).alias(out_col))
    # few distinct values (e.g. a 0/1 label) must not become a few huge shuffle partitions:
    # broadcast the rank table when its size is checked small, else a shuffle join (AQE splits skew)
    return df.join(broadcast_if_bounded(ranks), value_col)
