"""Mixing sources to target weights by the cube method.

Each source's target is its share of all words; a document's expected number of
copies is ``target / source_size`` (at most ``max_repeat``). The whole part is
taken for sure. The fraction is an inclusion probability, and the cube method
draws the sample: probabilities move along the null space of the balancing
constraints (words and documents of the source) until all but at most two per
group are 0 or 1, so both totals are kept exactly in that flight phase.

At scale the flight runs on hash blocks of every source at once, each block a
stream in hash order with three units in memory. What a block leaves open (two
units at most) meets its source's other remainders in the next level, until one
stream per source is left. That one keeps its last ``LANDING`` units back: with
the two that its flight leaves open they are the landing problem, settled by the
choice whose words, then documents, come nearest to the target. Block and order come from hashes of the rows, so reruns agree.

Defined cases: a null text has size 0 and a null source is a source of its own,
last in order; rows equal in id, source, size and text hash are drawn together;
a source without words has target 0; an empty table gives an empty result.
Columns of the result replace input columns of the same names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.llm.frames import Carried, written
from rankspark.operators.ordering import global_positions

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: Units of one hash block (all sources together): bounds a stream's length, not memory.
BLOCK_UNITS = 50_000
#: Units kept back for the landing: 2^(LANDING + 2) choices are tried once per source.
LANDING = 12
EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``(source, source_size, target)`` from rows ``(source, size)``.

    Targets share all words by weight; one above ``max_repeat`` times its
    source's size stops there and the excess is shared again among the others.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = global_positions(sums, [F.col("source").asc_nulls_last()])
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    ranked = written(ranked.select("source", "source_size", w.alias("w"), (F.col("source_size") * max_repeat).alias("cap")), "mix-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while total:  # each round stops at least one more source, else it ends
        over = F.col("w") * level > F.col("cap")
        row = ranked.agg(F.sum(F.when(over, F.col("cap")).otherwise(0)).alias("fixed"), F.sum(F.when(over, 0.0).otherwise(F.col("w"))).alias("w"),
                         F.sum(over.cast("int")).alias("n")).first()
        if row["n"] == capped or not row["w"]:
            break
        level, capped = (total - row["fixed"]) / row["w"], row["n"]
    target = F.least(F.col("w") * F.lit(float(level)), F.col("cap").cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


class Flight:
    """The flight phase as a stream; a unit is ``[probability, documents, words, row]``."""

    def __init__(self, key, hold=0):
        import random

        self.pool, self.held, self.hold, self.draw = [], [], hold, random.Random(key).random

    def push(self, unit):
        """Add a unit; returns those that are decided now."""
        if unit[0] < EPS or unit[0] > 1 - EPS:
            unit[0] = float(round(unit[0]))
            return [unit]
        self.held.append(unit)
        if len(self.held) <= self.hold:
            return []
        self.pool.append(self.held.pop(0))
        return self.move() if len(self.pool) == 3 else []

    def direction(self):
        (_, m1, w1, _), (_, m2, w2, _), (_, m3, w3, _) = self.pool
        u = (m2 * w3 - m3 * w2, m3 * w1 - m1 * w3, m1 * w2 - m2 * w1)
        if any(u):
            return u
        return (m2, -m1, 0) if m1 or m2 else (1, 0, 0)  # all on one line: documents balance words too

    def move(self):
        u = self.direction()
        up = down = math.inf
        for (p, *_), d in zip(self.pool, u):
            if d > 0:
                up, down = min(up, (1 - p) / d), min(down, p / d)
            elif d < 0:
                up, down = min(up, p / -d), min(down, (1 - p) / -d)
        step = up if self.draw() * (up + down) < down else -down
        done, left = [], []
        for unit, d in zip(self.pool, u):
            unit[0] += step * d
            if unit[0] < EPS or unit[0] > 1 - EPS:
                unit[0] = float(round(unit[0]))
                done.append(unit)
            else:
                left.append(unit)
        self.pool = left
        return done

    def land(self):
        """Decide the last units: the choice whose words, then documents, come nearest."""
        import numpy as np

        left = self.pool + self.held
        if left:
            p, m, w = (np.array([u[i] for u in left], dtype=float) for i in range(3))
            bits = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
            off = (np.abs((bits - p) @ w), np.abs((bits - p) @ m))
            best = bits[np.lexsort((off[1], np.round(off[0], 6)))[0]]
            for b, u in zip(best.tolist(), left):
                u[0] = float(b)
        return left


def fly(units: DataFrame, blocks: int, last: bool) -> DataFrame:
    """One level: ``p`` becomes 0 or 1 but for at most two units of each (source, block)."""
    names, schema = units.columns, units.schema
    at = {c: names.index(c) for c in ("__source", "__p", "__m", "__w", "__order")}
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (units.withColumn("__block", F.pmod("__order", F.lit(blocks)))
             .repartition(n, "__source", "__block").sortWithinPartitions("__source", "__block", "__order", *[c for c in names if c.startswith("__key")]))

    def run(batches):
        import pyarrow as pa

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], names=names)

        flight, group, arrow = None, None, None
        for batch in batches:
            arrow = [batch.schema.field(c) for c in names]
            rows, ready = list(zip(*[c.to_pylist() for c in batch.columns])), []
            for row in rows:
                key = (row[at["__source"]], row[-1])
                if flight is None or key != group:
                    if flight:
                        ready += flight.land() if last else flight.pool
                    flight, group = Flight(repr(key), LANDING if last else 0), key
                ready += flight.push([row[at["__p"]], row[at["__m"]], row[at["__w"]], row])
            yield out([(*u[3][:at["__p"]], u[0], *u[3][at["__p"] + 1:-1]) for u in ready])
        if flight:
            yield out([(*u[3][:at["__p"]], u[0], *u[3][at["__p"] + 1:-1]) for u in (flight.land() if last else flight.pool)])

    return dealt.mapInArrow(run, schema)


def mix_copies(sized: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = 0) -> DataFrame:
    """From written rows ``(__id, __source, __size, __hash)``: one row per distinct such row with ``source_size, target, copies``."""
    keys = ["__id", "__source", "__size", "__hash"]
    targets = source_targets(sized.select(F.col("__source").alias("source"), F.col("__size").alias("size")), weights, max_repeat)
    # bounded by the number of sources; Spark decides by size whether to broadcast it
    units = sized.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m"))
    units = units.join(targets, units["__source"].eqNullSafe(targets["source"])).drop("source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeat)))).otherwise(0.0)
    units = units.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__source"), "source_size", "target",
                         F.floor(rate).cast("long").alias("__whole"), (rate - F.floor(rate)).alias("__p"), "__m",
                         (F.col("__m") * F.col("__size")).alias("__w"), F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)).alias("__order"))
    left = sized.count()
    done = []
    while True:
        blocks = max(1, math.ceil(left / BLOCK_UNITS))
        level = written(fly(units, blocks, blocks == 1), "mix-flight")
        if blocks == 1:
            done.append(level)
            break
        done.append(level.where((F.col("__p") == 0) | (F.col("__p") == 1)))
        units = level.where((F.col("__p") > 0) & (F.col("__p") < 1)).withColumn("__order", F.xxhash64("__order"))
        left = 2 * blocks  # of one source, at most
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*[F.col(f"__key{i}").alias(k) for i, k in enumerate(keys)], "source_size", "target",
                      (F.col("__whole") + F.col("__p").cast("long")).alias("copies"))


def sized_rows(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("__size"),
                       F.xxhash64(F.col(text_col)).alias("__hash"))


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **kw) -> DataFrame:
    """The mix without texts: ``doc_id, size, source_size, target, taken`` for every row of ``docs``."""
    sized = written(sized_rows(docs, id_col, source_col, text_col), "mix-sizes")
    copies = mix_copies(sized, **kw)
    on = [sized[c].eqNullSafe(copies[c]) for c in ("__id", "__source", "__size", "__hash")]
    return sized.join(copies, on).select(sized["__id"].alias(id_col), sized["__size"].alias("size"), "source_size", "target",
                                         (F.col("copies") * sized["__size"]).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **kw) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its columns and ``copy`` (0, 1, ...)."""
    carried = Carried(docs, ["copy"])
    base, id_col, source_col, text_col = carried.df, carried[id_col], carried[source_col], carried[text_col]
    sized = written(sized_rows(base, id_col, source_col, text_col), "mix-sizes")
    copies = mix_copies(sized, **kw).select("__id", "__source", "__size", "__hash", F.col("copies").alias("__copies")).where("__copies > 0")
    on = [base[id_col].eqNullSafe(copies["__id"]), base[source_col].eqNullSafe(copies["__source"]),
          F.xxhash64(base[text_col]) == copies["__hash"]]
    out = base.join(copies, on).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)))
    return carried.restore(out, "copy")


def op7_mixing(spark, sf_dir):
    """The mix of all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sizes(docs)
