"""Ranked lexical search over bit-sliced Bloom signatures, with exact results.

Index. Every document sets bits for its terms: one entry for a term that occurs at least
once, more entries for at least 2, 4, 8 times (``LEVELS``). Documents with a similar number
of entries share a block, whose signature width grows with that number, so that
long and short documents have about the same share of set bits. A block is stored
transposed: slice ``j`` is the bitmap, over the block's documents, of bit ``j``.

Search. A term's bitmap is the AND of its slices: it holds every document with the
term and a few others, so it never underestimates. For each item the bitmaps of
its terms, weighted, are summed level by level with each document's own
saturation, which bounds the document's score from above. The documents with the
largest bounds are scored exactly first; the k-th best of those scores is a floor
for the item. Every document whose bound reaches the floor is then scored
exactly from its whole text, so nothing that may rank is left out.

Score (64-bit integers): a term's weight is ``floor(1000 ln((2N+2)/(2df+1)))``; the
document's ``m = 100 - b + (b n N) div L`` for ``b = 75``; the score sums ``weight *
((10^9 tf) div (1000 tf + 8 m))`` over the item's terms, repeats included.

Scale: statistics count the items' terms per task (found by hash, confirmed byte for byte); signatures are built and
scanned per task without a shuffle; items go out in blocks of at most ``max_block_bytes``,
one scan of the signatures each; only documents that pass move, by id.

Defined cases: a null or empty text has no terms and never ranks, nor does it
count in N; an item without terms, or whose terms occur nowhere, gets no row;
item rows with one id are one item (their terms together); a null item id is the
empty string; each row of the documents is a document of its own, rows
with one id rank separately; rows with a null id count in the statistics but cannot be
returned; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.llm.frames import written
from rankspark.llm.hashing import NOT_ALNUM, Poly, byte_values, mix64, per_text, text_bytes, text_groups, tokens

#: The characters of a term, for Java and DuckDB regular expressions over text with A-Z lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEVELS = (1, 2, 4, 8)
BITS_PER_ENTRY, HASHES = 12, 4
BLOCK_DOCS = 1024
BLOCK_BYTES = 1 << 22
LANES = 8  # 8-byte pieces of a term that are compared together; longer terms are compared on their own
MAX_BLOCK_BYTES = 16 << 20
SEEDS = 4  # per item, times k: documents scored exactly to find the floor
B = 75


def term_list(col):
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(col), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def term_hash(texts):
    """Hashes of an Arrow array of texts that are one term each."""
    data, offs = text_bytes(texts)
    (h,), _ = tokens(data, offs, NOT_ALNUM, [Poly(41)], [byte_values(41, True)])
    return h


def positions(h, level, width):
    """Bit numbers of (term, level) entries: ``HASHES`` per entry."""
    x = mix64(h ^ mix64(np.full(len(h), 1000 + level, dtype=np.uint64)))
    step = mix64(x) | np.uint64(1)
    return [((x + np.uint64(i) * step) >> np.uint64(11)) % np.uint64(width) for i in range(HASHES)]


def saturation(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Blocks:
    """Collects documents by size class and emits finished bit-sliced blocks."""

    def __init__(self):
        self.open = {}

    def add(self, doc_id, n, top, hashes, counts):
        entries = int(sum((counts >= level).sum() for level in LEVELS))
        size = max(4, (entries - 1).bit_length())
        rows = self.open.setdefault(size, [])
        rows.append((doc_id, n, top, hashes, counts))
        if len(rows) >= min(BLOCK_DOCS, max(8, 8 * BLOCK_BYTES // (BITS_PER_ENTRY << size))):
            return self.close(size)
        return None

    def close(self, size):
        rows = self.open.pop(size)
        width, stride = BITS_PER_ENTRY << size, -(-len(rows) // 8)
        bits = np.zeros(width * stride, dtype=np.uint8)
        owner = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
        h, counts = np.concatenate([r[3] for r in rows]), np.concatenate([r[4] for r in rows])
        for level in LEVELS:
            here = counts >= level
            for at in positions(h[here], level, width):
                flat, bit = at.astype(np.int64) * stride + owner[here] // 8, owner[here] % 8
                for b in range(8):  # documents with one bit number at a time: a repeated place gets the same value
                    bits[flat[bit == b]] |= np.uint8(1 << b)
        return width, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], bits.tobytes()


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(width int, ids, lengths, tops array, slices binary)``: the bit-sliced blocks of all documents with terms."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    schema = T.StructType([T.StructField("width", T.LongType()), T.StructField("ids", T.ArrayType(plain.schema["id"].dataType)),
                           T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("tops", T.ArrayType(T.LongType())),
                           T.StructField("slices", T.BinaryType())])

    def build(batches):
        import pyarrow as pa

        poly, value, blocks = Poly(41), byte_values(41, True), Blocks()
        kinds = None

        def row(block):
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(block, kinds)], names=schema.names)

        for batch in batches:
            ids = batch.column(0)
            kinds = [pa.int64(), pa.list_(ids.type), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            ids = ids.to_pylist()
            data, offs = text_bytes(batch.column(1))
            for a, b in text_groups(offs):
                (h,), counts = tokens(data[offs[a]:offs[b]], offs[a:b + 1] - offs[a], NOT_ALNUM, [poly], [value])
                _, bounds = per_text(counts)
                for i in np.flatnonzero(counts).tolist():
                    terms, tf = np.unique(h[bounds[i]:bounds[i + 1]], return_counts=True)
                    done = blocks.add(ids[a + i], int(counts[i]), int(tf.max()), terms, tf)
                    if done:
                        yield row(done)
        for size in list(blocks.open):
            yield row(blocks.close(size))

    return plain.mapInArrow(build, schema)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item string, term, qtf long)``."""
    t = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.explode(term_list(text_col)).alias("term"))
    return t.groupBy("item", "term").agg(F.count(F.lit(1)).alias("qtf"))


class Wanted:
    """Finds a list of terms among the tokens of a piece of text: by hash first, then byte for byte."""

    def __init__(self, terms):
        import pyarrow as pa

        raw = [t.encode() for t in terms]
        h = term_hash(pa.array(terms, pa.string()))
        self.order = np.argsort(h, kind="stable")
        self.hashes, self.size = h[self.order], np.array([len(t) for t in raw])
        self.lanes = np.zeros((len(raw), LANES), dtype="<u8")
        for i, t in enumerate(raw):
            head = t[:8 * LANES].ljust(8 * LANES, b"\0")
            self.lanes[i] = np.frombuffer(head, dtype="<u8")
        self.raw = raw

    def find(self, low, h, s, e):
        """``(token numbers, term numbers)`` of the tokens that are wanted terms; ``low``: the lower-cased bytes."""
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        at = np.flatnonzero(self.hashes[place] == h)
        term = self.order[place[at]]
        same = (e[at] - s[at]) == self.size[term]
        at, term = at[same], term[same]
        if not len(at):
            return at, term
        padded = np.concatenate([low, np.zeros(8 * LANES, dtype=np.uint8)])
        words = np.ndarray((len(low) + 8 * (LANES - 1) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))  # the 8 bytes from each place
        good = np.ones(len(at), dtype=bool)
        for lane in range(LANES):
            left = np.minimum(self.size[term] - 8 * lane, 8)
            here = np.flatnonzero(left > 0)
            if not len(here):
                break
            mask = (~np.uint64(0)) >> (np.uint64(64) - left[here].astype(np.uint64) * np.uint64(8))
            good[here] &= (words[s[at[here]] + 8 * lane] & mask) == self.lanes[term[here], lane]
        for i in np.flatnonzero(self.size[term] > 8 * LANES).tolist():
            good[i] = low[s[at[i]]:e[at[i]]].tobytes() == self.raw[term[i]]
        return at[good], term[good]


def term_counts(docs: DataFrame, terms: list, text_col: str = "text") -> DataFrame:
    """``(term, df, sum_n long)``: documents with each listed term; under the empty term all documents that have terms, and all their terms."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        import pyarrow as pa

        poly, value, wanted = Poly(41), byte_values(41, True), Wanted(sent.value)
        df, n_docs, length = np.zeros(len(sent.value), dtype=np.int64), 0, 0
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        for batch in batches:
            data, offs = text_bytes(batch.column(0))
            for a, b in text_groups(offs):
                low = fold[data[offs[a]:offs[b]]]
                (h,), counts, s, e = tokens(low, offs[a:b + 1] - offs[a], NOT_ALNUM, [poly], [value], spans=True)
                n_docs, length = n_docs + int(np.count_nonzero(counts)), length + int(counts.sum())
                at, term = wanted.find(low, h, s, e)
                owner, _ = per_text(counts)
                pairs = np.unique(owner[at].astype(np.int64) * len(df) + term)
                df += np.bincount(pairs % len(df), minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(["", *(sent.value[i] for i in some)]), pa.array([n_docs, *df[some].tolist()]),
                                          pa.array([length] + [0] * len(some))], names=["term", "df", "sum_n"])

    parts = docs.select(text_col).mapInArrow(count, "term string, df long, sum_n long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("sum_n").alias("sum_n"))


def weighted_terms(docs: DataFrame, wanted: DataFrame, text_col: str = "text", max_block_bytes: int = MAX_BLOCK_BYTES):
    """``(item, term, qtf, weight)`` of the terms that occur, and ``(N, L)``; one pass over the texts per block of wanted terms."""
    vocab = written(wanted.select("term").distinct(), "search-vocab")
    size = vocab.agg(F.sum(F.octet_length("term") + 96)).first()[0] or 0
    blocks, counts = max(1, math.ceil(size / max_block_bytes)), None
    for b in range(blocks):
        terms = sorted(r["term"] for r in vocab.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b).collect())  # about max_block_bytes
        if terms:
            part = term_counts(docs, terms, text_col)
            counts = part if counts is None else counts.unionByName(part.where(F.col("term") != ""))
    if counts is None:
        return None, (0, 0)
    counts = written(counts, "search-counts")
    n_docs, length = counts.where(F.col("term") == "").select("df", "sum_n").first() or (0, 0)
    if not n_docs:
        return None, (0, 0)
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    return wanted.join(counts.select("term", "df"), "term").select("item", "term", "qtf", weight.alias("weight")), (n_docs, length)


def _norm(n, n_docs, length):
    return 100 - B + (B * n * n_docs) // length


def _bounds(index: DataFrame, block: dict, totals, emit, id_type) -> DataFrame:
    """Scans the signatures with one block of items; ``emit`` turns (items, ids, bounds) into the rows to keep."""
    sent = index.sparkSession.sparkContext.broadcast((block, totals))
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("id", id_type), T.StructField("bound", T.LongType())])

    def scan(batches):
        import pyarrow as pa

        items, (n_docs, length) = sent.value
        names = sorted(items)
        vocab = sorted({t for name in names for t, _, _ in items[name]})
        at = {t: i for i, t in enumerate(vocab)}
        h = term_hash(pa.array(vocab))
        parts = [(np.array([at[t] for t, _, _ in items[name]]), np.array([q * w for _, q, w in items[name]], dtype=np.float64)) for name in names]
        keep = emit(names)
        for batch in batches:
            ids_kind = batch.schema.field(1).type.value_type
            for r in range(batch.num_rows):
                width, ids = batch.column(0)[r].as_py(), batch.column(1)[r].values
                n, top = (batch.column(c)[r].values.to_numpy() for c in (2, 3))
                slices = np.frombuffer(batch.column(4)[r].as_buffer(), dtype=np.uint8).reshape(width, -1)
                m = _norm(n, n_docs, length)
                bounds = np.zeros((len(names), len(n)))
                before, present = np.zeros(len(n), dtype=np.int64), None
                for level, following in zip(LEVELS, [*LEVELS[1:], None]):
                    here = np.bitwise_and.reduce([slices[p] for p in positions(h, level, width)])
                    present = here if present is None else present & here
                    if not present.any():
                        break
                    upto = saturation(top if following is None else np.minimum(top, following - 1), m)
                    seen = np.unpackbits(present, axis=1, count=len(n), bitorder="little").astype(np.float64)
                    step = np.maximum(upto - before, 0)
                    for i, (terms, weights) in enumerate(parts):
                        bounds[i] += (weights @ seen[terms]) * step
                    before = np.maximum(before, upto)
                yield from keep(ids, ids_kind, bounds)
        yield from keep(None, None, None)

    return index.mapInArrow(scan, schema)


def _rows(names, i, ids, kind, bounds):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([names[x] for x in i], pa.string()), pa.array(ids, kind), pa.array(bounds, pa.int64())],
                                      names=["item", "id", "bound"])


def _largest(count):
    """Keeps each task's ``count`` largest bounds per item."""
    def make(names):
        state = {}

        def keep(ids, kind, bounds):
            if ids is None:
                for i, (best, got) in state.items():
                    yield _rows(names, [i] * len(got), got, state_kind[0], best.astype(np.int64))
                return
            state_kind[:] = [kind]
            for i in np.flatnonzero(bounds.max(axis=1) > 0).tolist():
                best, got = state.get(i, (np.zeros(0), []))
                at = np.flatnonzero(bounds[i] > (best[-1] if len(best) == count else 0))
                if len(at):
                    at = at[np.argsort(-bounds[i][at], kind="stable")[:count]]
                    values, found = np.concatenate([best, bounds[i][at]]), got + ids.take(at).to_pylist()
                    order = np.argsort(-values, kind="stable")[:count]
                    state[i] = values[order], [found[j] for j in order]

        state_kind = [None]
        return keep
    return make


def _reaching(floors):
    """Keeps every document whose bound is above 0 and reaches the item's floor."""
    def make(names):
        floor = np.array([max(1, floors.get(name, 1)) for name in names])[:, None]

        def keep(ids, kind, bounds):
            if ids is not None:
                i, j = np.nonzero(bounds >= floor)
                if len(i):
                    yield _rows(names, i, ids.take(j), kind, bounds[i, j].astype(np.int64))
        return keep
    return make


def exact_scores(pairs: DataFrame, docs: DataFrame, block: dict, totals, id_col: str, text_col: str) -> DataFrame:
    """``(item, id, score)``: the score of each listed (item, id), from the whole text of every row with that id."""
    id_type = pairs.schema["id"].dataType
    sent = docs.sparkSession.sparkContext.broadcast((block, totals))
    by_doc = written(pairs.groupBy("id").agg(F.collect_set("item").alias("items")), "search-pairs")  # at most the block's items a row
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(by_doc, "id")
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("id", id_type), T.StructField("score", T.LongType())])

    def score(batches):
        import re
        from collections import Counter

        import pyarrow as pa

        items, (n_docs, length) = sent.value
        terms = {name: [(t.encode(), q, w) for t, q, w in rows] for name, rows in items.items()}
        cut = re.compile(TERM_BYTES)
        for batch in batches:
            rows = []
            for doc, text, names in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2))):
                words = cut.findall((text or "").encode().lower())
                tf, m = Counter(words), _norm(len(words), n_docs, length)
                for name in names:
                    rows.append((name, doc, sum(q * w * saturation(tf[t], m) for t, q, w in terms[name] if t in tf)))
            kinds = pa.string(), batch.schema.field(0).type, pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=schema.names)

    return texts.select("id", "text", "items").mapInArrow(score, schema).where(F.col("score") > 0)


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
           item_text_col: str = "text", index: DataFrame | None = None, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """``(item string, rank int, id, score long)``: each item's ``k`` best documents with a score above 0, ties by id.

    ``index``: stored ``signatures`` of the same documents, else they are built and written.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    empty = spark.createDataFrame([], T.StructType([T.StructField("item", T.StringType()), T.StructField("rank", T.IntegerType()),
                                                    T.StructField("id", id_type), T.StructField("score", T.LongType())]))
    wanted = written(item_terms(items, item_id_col, item_text_col), "search-items")
    weighted, totals = weighted_terms(docs, wanted, text_col, max_block_bytes)
    if weighted is None:
        return empty
    weighted = written(weighted.where(F.col("weight") > 0), "search-weights")
    size = weighted.agg(F.sum(F.octet_length("term") + F.octet_length("item") + 64)).first()[0] or 0
    index = written(signatures(docs, id_col, text_col), "search-index") if index is None else index
    blocks, out = max(1, math.ceil(size / max_block_bytes)), None
    for b in range(blocks):
        block = {}
        for r in weighted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect():  # about max_block_bytes
            block.setdefault(r["item"], []).append((r["term"], r["qtf"], r["weight"]))
        if not block:
            continue
        best = _bounds(index, block, totals, _largest(SEEDS * k), id_type)
        by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), F.asc("id"))
        seeds = best.withColumn("r", F.row_number().over(by_bound)).where(F.col("r") <= SEEDS * k).select("item", "id")
        first = _ranked(exact_scores(seeds, docs, block, totals, id_col, text_col), k)
        floors = {r["item"]: r["score"] for r in first.where(F.col("rank") == k).collect()}  # one row an item
        pairs = _bounds(index, block, totals, _reaching(floors), id_type).select("item", "id")
        part = _ranked(exact_scores(pairs, docs, block, totals, id_col, text_col), k).select("item", "rank", "id", "score")
        out = part if out is None else out.unionByName(part)
    return empty if out is None else out


def op12_lexical_search(spark, sf_dir):
    """The ten best ``documents`` of every ``benchmark`` item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    out = search(docs, bench)
    return out.select(F.col("item").cast(bench.schema["item_id"].dataType).alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


OP12_SQL = r"""
WITH terms AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
totals AS (SELECT count(*) AS nd, sum(len(t)) AS total FROM terms WHERE len(t) > 0),
tfs AS (SELECT row_no, doc_id, n, term, count(*) AS tf FROM (SELECT row_no, doc_id, len(t) AS n, unnest(t) AS term FROM terms) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
items AS (
  SELECT item_id, term, count(*) AS qtf FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
weights AS (
  SELECT item_id, term, qtf, CAST(floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w
  FROM items JOIN dfs USING (term), totals),
scores AS (
  SELECT item_id, row_no, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // total)))) AS BIGINT) AS score
  FROM weights JOIN tfs USING (term), (SELECT nd, CAST(total AS BIGINT) AS total FROM totals) GROUP BY item_id, row_no, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""
