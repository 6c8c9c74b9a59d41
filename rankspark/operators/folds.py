"""K-fold assignments as columns; train / validation as filters.

* ``kfolds``: fold from an md5 hash of (seed, id) — no global order needed;
  fold sizes are close to n/k rather than exact.
* ``stratified_folds``: within each label, rows are dealt round-robin over the
  folds in a seeded pseudo-random order (hash bucket, md5), so each fold holds
  ⌊n_l/k⌋ or ⌈n_l/k⌉ rows of every label. Rows of a label are first spread over
  ``buckets`` hash buckets (a label holding a third of the data is still many
  tasks); per-(label, bucket) counts give each bucket its start offset.
* ``contiguous_folds``: exactly k folds of consecutive rows in an explicit
  order, ``fold = ⌊position·k/n⌋`` with positions from ``global_positions``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.operators.ordering import global_positions

#: Hash buckets of every label in ``stratified_folds``.
FOLD_BUCKETS = 64


def seeded_key(id_col, seed: int) -> Column:
    """md5 of ``"<seed>|<id>"`` (hex string): a seeded pseudo-random order."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}|"), c.cast("string")))


def seeded_uniform(key: Column, hex_digits: int = 13) -> Column:
    """A number in [0, 1) from the first hex digits of an md5 string."""
    return F.conv(F.substring(key, 1, hex_digits), 16, 10).cast("long") / F.lit(float(16 ** hex_digits))


def kfolds(df: DataFrame, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Plain shuffled k-fold."""
    key = seeded_key(id_col, seed)
    return df.withColumn("fold", F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int"))


def stratified_folds(df: DataFrame, id_col: str, label_col: str, k: int = 5, seed: int = 42,
                     buckets: int = FOLD_BUCKETS) -> DataFrame:
    """Stratified k-fold (see module docstring).

    Every label is split into ``buckets`` hash buckets, whatever its size, so the
    deal depends on the seed, the ids and ``buckets`` alone; raise ``buckets`` where
    a bucket of the largest label would be too long to sort in one task.
    """
    key = seeded_key(id_col, seed)
    x = df.withColumn("__key", key).withColumn("__bucket", F.pmod(
        F.conv(F.substring("__key", 9, 8), 16, 10).cast("long"), F.lit(buckets)))
    counts = x.groupBy(label_col, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    wb = Window.partitionBy(label_col).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(label_col).alias("__ol"), F.col("__bucket").alias("__ob"),
                            F.coalesce(F.sum("__n").over(wb), F.lit(0)).alias("__off"))
    w = Window.partitionBy(label_col, "__bucket").orderBy("__key", F.col(id_col))
    pos = (x.join(offsets, x[label_col].eqNullSafe(F.col("__ol")) & (x["__bucket"] == F.col("__ob")))
           .drop("__ol", "__ob")
           .withColumn("__pos", F.col("__off") + F.row_number().over(w) - 1))
    return pos.withColumn("fold", F.pmod(F.col("__pos"), F.lit(k)).cast("int")).drop(
        "__key", "__bucket", "__off", "__pos")


def contiguous_folds(df: DataFrame, order_col: str, k: int, id_col: str | None = None) -> DataFrame:
    """Exactly k contiguous folds in ``order_col`` order.

    ``id_col`` breaks ties; without it a hash of the whole row does, so a value
    repeated on a third of the rows is still split over many range partitions.
    """
    tie = F.col(id_col) if id_col else F.xxhash64(*[F.col(c) for c in df.columns])
    order = [F.col(order_col)] + ([tie] if id_col != order_col else [])
    n = df.count()
    pos = global_positions(df, order)
    return pos.withColumn("fold", F.floor(F.col("position") * k / F.lit(max(n, 1))).cast("int")).drop("position")


def split_fold(df: DataFrame, i: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, validation) for fold i."""
    return df.where(F.col(fold_col) != i), df.where(F.col(fold_col) == i)
