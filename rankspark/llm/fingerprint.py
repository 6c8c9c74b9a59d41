"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (LZ78: each phrase is the longest known
one plus one character). The set of its phrases is hashed and reduced to a
minimum-hash signature: ``BINS`` bins by the top bits of the phrase hash, the
smallest hash of each bin, 16 bits of it. Like compression, likeness is high
where one text is built from the phrases of the other: the share of bins, among
those that either text fills, in which two signatures agree.

``neighbours`` compares every document with the next one in ascending ``id``
order: the rows are dealt into id ranges by explicit bounds, sorted within each
and read as a stream; the first row of a range also goes to the range before it.
Texts move once, no group is gathered.

Defined cases: a null text is empty; an empty text has no phrases, is like
another empty text (1) and unlike all others (0); equal ids are ordered by text;
a null id comes first; a single document is its own neighbour; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.llm.hashing import Poly, mix64

BINS = 128


def parse(text, known=(), start=0):
    """LZ78 phrase ends of ``text[start:]`` with the phrases ``known`` before."""
    seen, ends, i, n = set(known), [], start, len(text)
    while i < n:
        j = i + 1
        while j < n and text[i:j] in seen:
            j += 1
        seen.add(text[i:j])
        ends.append(j)
        i = j
    return ends


class Signer:
    """Signatures from a text and its phrase ends."""

    def __init__(self):
        self.polys = Poly(21)

    def sign(self, text, ends):
        """Bin values as uint16; 0 marks an empty bin."""
        out = np.zeros(BINS, dtype=np.uint16)
        if not ends:
            return out
        cp = mix64(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1))
        e = np.array(ends)
        s = np.concatenate([[0], e[:-1]])
        h = np.sort(self.polys.ranges(self.polys.prefix(cp), s, e))
        bins = (h >> np.uint64(57)).astype(np.int64)
        first = np.concatenate([[True], bins[1:] != bins[:-1]])
        low = (h[first] & np.uint64(0xFFFF)).astype(np.uint16)
        out[bins[first]] = np.maximum(low, 1)
        return out


def likeness(a, b):
    filled = (a != 0) | (b != 0)
    n = int(filled.sum())
    return 1.0 if n == 0 else float(((a == b) & filled).sum()) / n


def to_hex(signature):
    return signature.astype(">u2").tobytes().hex()


def from_hex(fingerprint):
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u2").astype(np.uint16)


def fingerprint_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``fingerprint`` (hex) of every whole text."""
    from rankspark.llm.frames import map_rows

    def run(batch):
        import pyarrow as pa

        signer = Signer()
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        return [pa.array([to_hex(signer.sign(t or "", parse(t or ""))) for t in texts], pa.string())]

    return map_rows(docs, run, [T.StructField("fingerprint", T.StringType())])


class Neighbour:
    """One document: its text, phrase ends and signature."""

    def __init__(self, doc_id, text, signer):
        self.doc_id, self.text = doc_id, text
        self.ends = parse(text)
        self.sig = signer.sign(text, self.ends)

    def against(self, other, signer):
        """The result row with ``other`` as next document."""
        import hashlib

        text, n = self.text, len(self.text)
        keep = n - n // 2
        edited = text[:keep] + other.text[:n // 2]
        done = bisect.bisect_right(self.ends, keep)  # phrases that end before the edit stay
        if done == len(self.ends) and len(edited) == keep:
            ends = self.ends
        else:
            head = self.ends[:done]
            known = [text[a:b] for a, b in zip([0, *head], head)]
            at = head[-1] if head else 0
            ends = head + parse(edited, known, at)
        sig = signer.sign(edited, ends)
        return (self.doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), to_hex(self.sig), to_hex(sig),
                likeness(self.sig, sig), likeness(self.sig, other.sig))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Per document: ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text replaces the last ``floor(n_chars / 2)`` characters by as many (or all) of the next document.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = rows.select("id")
    bounds = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10000)).first()[0] or []
    bounds = sorted(set(bounds))

    def dealt(df):
        # number of bounds that are not above the id; nulls first
        return df.withColumn("pid", F.when(F.col("id").isNull(), 0).otherwise(
            F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("id"))) if bounds else F.lit(0)).cast("int"))

    kind = rows.schema["id"].dataType
    heads = {r["pid"]: r["id"] for r in dealt(ids).groupBy("pid").agg(F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("has_null"))
             .select("pid", F.when(~F.col("has_null"), F.col("id")).alias("id")).collect()}  # one row per range
    order = sorted(heads)
    before = {heads[p]: order[i - 1] for i, p in enumerate(order)}  # first id of a range -> the range before it
    table = spark.createDataFrame([(k, v) for k, v in before.items()] or [], T.StructType([T.StructField("first", kind), T.StructField("to", T.IntegerType())]))
    own = dealt(rows).withColumn("ahead", F.lit(False))
    ahead = (rows.join(F.broadcast(table), rows["id"].eqNullSafe(table["first"]))  # one row per range
             .select("id", "text", F.col("to").alias("pid"), F.lit(True).alias("ahead")))
    parts = own.unionByName(ahead).repartitionById(len(bounds) + 1, "pid").sortWithinPartitions("pid", "ahead", F.asc_nulls_first("id"), "text")

    def run(batches):
        import pyarrow as pa

        signer, last, out, done = Signer(), None, [], False
        for batch in batches:
            for i, text, flag in zip(*[batch.column(k).to_pylist() for k in (0, 1, 3)]):
                if done:
                    break
                doc = last if flag and last and last.text == text else Neighbour(i, text, signer)
                if last is not None:
                    out.append(last.against(doc, signer))
                last, done = doc, flag
                if len(out) >= 1000:
                    yield table_of(pa, out)
                    out = []
        yield table_of(pa, out)

    types = ["long", "string", "string", "string", "double", "double"]
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = T.StructType([T.StructField("id", kind), *[T.StructField(c, {"long": T.LongType(), "string": T.StringType(), "double": T.DoubleType()}[t]) for c, t in zip(names, types)]])

    def table_of(pa, out):
        arrow = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t or id_type) for i, t in enumerate(arrow)], names=["id", *names])

    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(kind)
    return parts.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op3_fingerprint(spark, sf_dir):
    """Fingerprints of all ``documents``, of their edited texts, and their likeness to the next document."""
    return neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
