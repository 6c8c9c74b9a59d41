"""Encoders, exhaustive dense top-k and the embedding cache.

* ``hash_encode``  built-in encoder: a bag of hashed tokens, L2-normalised.
  Tokens are computed in the JVM; each distinct token of an Arrow batch is hashed once, and
  the per-row bucket counts are one ``np.bincount`` inside ``mapInArrow`` (no shuffle).
* ``encode``  any object with ``encode_batch(list[str]) -> ndarray`` (U1), run
  in ``mapInArrow``; one model per Python worker, Arrow batches in and out.
* ``dense_topk``  exhaustive top-k of query vectors against a corpus: one bounded block of
  queries is broadcast, more of them form a grid of blocks with the documents; each
  block is one matrix product, reduced to its local top-k per query, and a final
  window keeps the global top-k. No pair table is ever materialised.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.functions.text import sentences, tokenize
from rankspark.operators.blocks import TopK, unit_rows, vectors
from rankspark.operators.runs import rank_run

DEFAULT_DIM = 64


def _schema_with(df: DataFrame, keep, extra: list[T.StructField]) -> T.StructType:
    fields = [df.schema[c] for c in keep]
    return T.StructType(fields + extra)


def _text_for_pooling(col: str, pooling: str):
    if pooling == "all":
        return F.col(col)
    if pooling == "first":  # reference quirk: only the first sentence's vector survives
        return F.try_element_at(sentences(col), F.lit(1))
    raise ValueError("hash_encode pooling must be 'all' or 'first'")


def hash_encode(df: DataFrame, text_col: str, dim: int = DEFAULT_DIM, out_col: str = "embedding",
                keep=None, pooling: str = "all") -> DataFrame:
    """Hash encoder: bucket = first 24 bits of md5(token) mod dim; counts L2-normalised.

    Rows whose text is null are dropped (no vector: "missing" downstream).
    """
    keep = list(keep) if keep is not None else [c for c in df.columns if c != text_col]
    return hash_encode_columns(df.where(F.col(text_col).isNotNull()), {text_col: out_col}, dim, keep, pooling)


def hash_encode_columns(df: DataFrame, columns: dict, dim: int = DEFAULT_DIM, keep=None,
                        pooling: str = "all") -> DataFrame:
    """Encode several text columns in one pass: ``{text column: output column}``.

    A null text gives a null vector in its column; the row is kept.
    """
    keep = list(keep) if keep is not None else [c for c in df.columns if c not in columns]
    token_cols = [tokenize(_text_for_pooling(t, pooling)).alias(f"__t{i}") for i, t in enumerate(columns)]  # null for a null text
    src = df.select(*keep, *token_cols)
    outs = list(columns.values())
    out_schema = _schema_with(df, keep, [T.StructField(o, T.ArrayType(T.DoubleType()), True) for o in outs])
    n_keep = len(keep)

    def count_batches(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        out_fields = [pa.field(o, pa.list_(pa.float64()), True) for o in outs]
        for rb in batches:
            n = rb.num_rows
            vecs = []
            for j in range(len(outs)):
                lst = rb.column(n_keep + j)
                rows = pc.list_parent_indices(lst).to_numpy(zero_copy_only=False).astype(np.int64)
                toks = pc.list_flatten(lst).dictionary_encode()
                vals = hash_buckets(toks.dictionary, dim)[toks.indices.to_numpy(zero_copy_only=False)]
                m = np.bincount(rows * dim + vals, minlength=n * dim).astype(np.float64).reshape(n, dim)
                norms = np.sqrt((m * m).sum(axis=1))
                norms[norms == 0] = 1.0
                m /= norms[:, None]
                offsets = pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32))
                mask = lst.is_null()
                vecs.append(pa.ListArray.from_arrays(offsets, pa.array(m.ravel()), mask=mask))
            cols = [rb.column(i) for i in range(n_keep)] + vecs
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([rb.schema.field(i) for i in range(n_keep)]
                                                                    + out_fields))

    return src.mapInArrow(count_batches, out_schema)


def hash_buckets(tokens, dim: int) -> np.ndarray:
    """``functions.vectors.hash_bucket`` of an Arrow array of tokens."""
    import pyarrow as pa

    return np.fromiter((int.from_bytes(hashlib.md5(t).digest()[:3], "big") % dim for t in tokens.cast(pa.binary()).to_pylist()), np.int64, len(tokens))


class HashEncoder:
    """Python twin of ``hash_encode`` implementing the pluggable encoder interface."""

    def __init__(self, dim: int = DEFAULT_DIM):
        self.dim = dim
        self.identity = f"hash-md5-{dim}"

    def encode_batch(self, texts) -> np.ndarray:
        import regex
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            if t is None:
                continue
            for tok in regex.findall(r"[\p{L}\p{N}]+", t.lower()):
                out[i, int(hashlib.md5(tok.encode()).hexdigest()[:6], 16) % self.dim] += 1.0
        n = np.linalg.norm(out, axis=1)
        n[n == 0] = 1.0
        return out / n[:, None]


def encode(df: DataFrame, text_col: str, encoder, out_col: str = "embedding", keep=None,
           pooling: str = "none", normalize: bool = False) -> DataFrame:
    """R10 with a pluggable encoder: ``encoder.encode_batch(list[str]) -> ndarray`` over Arrow batches.

    ``pooling``: ``"none"`` encodes the whole text; ``"first"`` and ``"mean"`` split
    it into sentences (R2, in the JVM), encode every sentence of the batch in one
    call and keep the first sentence's vector (the reference's behaviour) or
    their mean. ``normalize`` makes the result unit length (R11).
    """
    keep = list(keep) if keep is not None else [c for c in df.columns if c != text_col]
    src = df.where(F.col(text_col).isNotNull())
    if pooling == "none":
        src = src.select(*keep, F.array(F.col(text_col)).alias("__s"))
    elif pooling in ("first", "mean"):
        src = src.select(*keep, sentences(text_col).alias("__s"))
    else:
        raise ValueError("pooling must be 'none', 'first' or 'mean'")
    out_schema = _schema_with(df, keep, [T.StructField(out_col, T.ArrayType(T.DoubleType()), True)])
    n_keep = len(keep)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        for rb in batches:
            lst = rb.column(n_keep)
            n = rb.num_rows
            texts = pc.list_flatten(lst).to_pylist()
            parent = pc.list_parent_indices(lst).to_numpy(zero_copy_only=False).astype(np.int64)
            m = np.asarray(encoder.encode_batch(texts), dtype=np.float64) if texts else np.zeros((0, 1))
            d = m.shape[1] if len(texts) else 1
            out = np.zeros((n, d))
            counts = np.bincount(parent, minlength=n).astype(np.float64)
            if pooling == "mean":
                np.add.at(out, parent, m)
                out[counts > 0] /= counts[counts > 0, None]
            else:  # first sentence (or the whole text): the first element of each row
                first = np.unique(parent, return_index=True)[1]
                out[parent[first]] = m[first]
            if normalize:
                nr = np.linalg.norm(out, axis=1)
                nr[nr == 0] = 1.0
                out = out / nr[:, None]
            vec = pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32)),
                                           pa.array(out.ravel()), mask=pa.array(counts == 0))
            cols = [rb.column(i) for i in range(n_keep)] + [vec]
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(
                [rb.schema.field(i) for i in range(n_keep)] + [pa.field(out_col, pa.list_(pa.float64()), True)]))

    return src.mapInArrow(run, out_schema)


# ------------------------------------------------------------------ exhaustive dense top-k
QUERY_BLOCK = 4096  # queries of one product; so many may be broadcast
DOC_BLOCK = 1 << 14  # documents of one product in the grid
QUERY_BLOCK_BYTES = 64 << 20


def dense_topk(queries: DataFrame, docs: DataFrame, k: int = 10, metric: str = "cosine",
               query_id: str = "topic_id", doc_id: str = "doc_id", query_vec: str = "embedding",
               doc_vec: str = "embedding", query_block: int = QUERY_BLOCK, doc_block: int = DOC_BLOCK) -> DataFrame:
    """(topic_id, doc_id, score, rank) — the k best documents per query, no lexical gate.

    Up to ``query_block`` queries (and ``QUERY_BLOCK_BYTES``) go to the executors as they are, and the
    corpus is scanned in place. More queries form a grid with the documents: queries are dealt into
    groups of about ``query_block``, documents into buckets of about ``doc_block``; each row goes to every cell
    of its line or column, and a cell (two bounded blocks that Spark cogroups) is one matrix product, reduced to
    the best k per query. Nothing grows on the driver, and no pair table is made.
    """
    if metric not in ("cosine", "dot"):
        raise ValueError("metric must be 'cosine' or 'dot'")
    q = queries.select(F.col(query_id).alias("topic_id"), F.col(query_vec).alias("qv")).where(F.col("qv").isNotNull())
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_vec).alias("dv")).where(F.col("dv").isNotNull())
    out_schema = T.StructType([T.StructField("topic_id", q.schema["topic_id"].dataType), T.StructField("doc_id", d.schema["doc_id"].dataType),
                               T.StructField("score", T.DoubleType())])
    size = q.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("qv") * 8).alias("bytes")).first()
    if size["n"] <= query_block and (size["bytes"] or 0) <= QUERY_BLOCK_BYTES:
        block = q.toArrow().combine_chunks()
        try:
            sent = docs.sparkSession.sparkContext.broadcast(block)
        except Exception:  # no SparkContext (Spark Connect): the bounded block travels with the function
            sent = _Inline(block)
        return rank_run(d.mapInArrow(_score_batches(sent, k, metric), out_schema), k=k)
    groups = max(-(-size["n"] // query_block), -(-size["bytes"] // QUERY_BLOCK_BYTES))
    buckets = max(1, -(-d.count() // doc_block))

    def cell(vec, mine, n_mine, other, n_other):
        place = F.pmod(F.xxhash64(*vec), F.lit(n_mine)).cast("int").alias(mine)
        return [place, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)]

    left = q.select("topic_id", "qv", *cell(("topic_id", "qv"), "g", groups, "h", buckets))
    right = d.select("doc_id", "dv", *cell(("doc_id", "dv"), "h", buckets, "g", groups))
    scored = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(_score_cell(k, metric), out_schema)
    return rank_run(scored, k=k)


class _Inline:
    """Same ``.value`` interface as a broadcast variable, for a value shipped with the function."""

    def __init__(self, value):
        self.value = value


class _Queries:
    """A block of queries: scores batches of documents and keeps the best."""

    def __init__(self, ids, column, k, metric):
        self.ids, self.k, self.metric = ids, k, metric
        m, _ = vectors(column)
        self.m = unit_rows(m) if metric == "cosine" else m
        self.best = TopK(k, len(ids))

    def add(self, ids, column):
        m, _ = vectors(column)
        if not len(m) or not len(self.m):
            return
        s = self.m @ (unit_rows(m) if self.metric == "cosine" else m).T  # (queries, docs)
        qi, di = best_of_block(s, ids, self.k)
        self.best.add(qi, ids[di], s[qi, di])

    def rows(self, kind):
        """The kept (topic_id, doc_id, score)."""
        import pyarrow as pa

        found = self.best.take() or (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0))
        return [self.ids.take(pa.array(found[0])), pa.array(found[1], kind) if len(found[0]) else pa.array([], kind), pa.array(found[2])]


def best_of_block(s, ids, k):
    """``(query, document)`` places of a block of scores that can be among a query's k best: a superset under (rounded score desc, id)."""
    rounded = np.round(s, 6)
    n = s.shape[1]
    if n <= k:
        return np.nonzero(np.ones_like(s, dtype=bool))
    kth = np.partition(rounded, n - k, axis=1)[:, n - k]
    near = rounded >= (kth - 2e-6)[:, None]
    # ties (equal or zero vectors): per query only the smallest ids of each score can be among the k
    many = np.flatnonzero(near.sum(axis=1) > 4 * k)
    place = np.argsort(np.argsort(ids, kind="stable"), kind="stable") if len(many) else None
    for i in many:
        cand = np.flatnonzero(near[i])
        cand = cand[np.lexsort((place[cand], rounded[i, cand]))]
        level = rounded[i, cand]
        start = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1]]))
        nth = np.arange(len(cand)) - np.repeat(start, np.diff(np.append(start, len(cand))))
        near[i] = False
        near[i, cand[nth < k]] = True
    return np.nonzero(near)


PRODUCT = 1 << 22  # scores of one matrix product


def _score_batches(sent, k: int, metric: str):
    def run(batches):
        import pyarrow as pa

        block, kind = sent.value, None
        found = _Queries(block.column("topic_id").combine_chunks(), block.column("qv").combine_chunks(), k, metric)
        step = max(64, PRODUCT // max(1, len(found.ids)))
        for rb in batches:
            kind = rb.column(0).type
            for a in range(0, rb.num_rows, step):
                part = rb.slice(a, step)
                found.add(part.column(0).to_numpy(zero_copy_only=False), part.column(1))
        if kind is not None:
            yield pa.RecordBatch.from_arrays(found.rows(kind), names=["topic_id", "doc_id", "score"])
    return run


def _score_cell(k: int, metric: str):
    def run(left, right):
        import pyarrow as pa

        left, right = left.combine_chunks(), right.combine_chunks()
        kind = right.schema.field("doc_id").type

        def column(table, name):
            x = table.column(name)
            return x.combine_chunks() if x.num_chunks != 1 else x.chunk(0)

        found = _Queries(column(left, "topic_id"), column(left, "qv"), k, metric)
        step = max(64, PRODUCT // max(1, len(found.ids)))
        ids, docs = column(right, "doc_id"), column(right, "dv")
        for a in range(0, len(ids), step):
            found.add(ids.slice(a, step).to_numpy(zero_copy_only=False), docs.slice(a, step))
        return pa.table(found.rows(kind), names=["topic_id", "doc_id", "score"])
    return run


# ------------------------------------------------------------------ embedding cache
def text_key(col) -> "F.Column":
    return F.sha2(F.col(col) if isinstance(col, str) else col, 256)


def unseen(docs: DataFrame, store: DataFrame, encoder_id: str, text_col: str = "text") -> DataFrame:
    """Rows whose (encoder id, sha256 of text) is not in the store yet."""
    keyed = docs.withColumn("text_key", text_key(text_col)).withColumn("encoder_id", F.lit(encoder_id))
    return keyed.join(store.select("encoder_id", "text_key"), ["encoder_id", "text_key"], "left_anti")


def encode_incremental(docs: DataFrame, store: DataFrame, encoder_id: str, text_col: str = "text",
                       dim: int = DEFAULT_DIM, encoder=None) -> DataFrame:
    """Encode only texts the store has not seen; returns the new store rows.

    Store schema: (encoder_id, text_key, embedding). Equal texts are encoded once.
    """
    new_texts = unseen(docs.select(text_col).where(F.col(text_col).isNotNull()).distinct(), store, encoder_id,
                       text_col)
    if encoder is None:
        enc = hash_encode(new_texts, text_col, dim, keep=["encoder_id", "text_key"])
    else:
        enc = encode(new_texts, text_col, encoder, keep=["encoder_id", "text_key"])
    return enc.select("encoder_id", "text_key", "embedding")
