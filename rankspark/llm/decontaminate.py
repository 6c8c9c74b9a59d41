"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z
lower-cased. A window is ``size`` consecutive words of a benchmark item; an item
with fewer words, but not none, is one window. Each document is hashed word by
word and window by window; a window whose hash is in the broadcast set is
verified against the words themselves, and its words count as hit.

The set is built on executors and measured before it goes out. If it is larger
than ``max_block_bytes`` it is cut into blocks by hash, and the documents are
scanned once per block; spans and items found so far travel in the row, so no
join is needed and every broadcast is bounded.

Defined cases: null or empty texts have no words; items without words have no
windows; several items may share a window; rows with one item_id are one item; a
null item_id is reported as the empty string; an empty benchmark marks nothing.
Columns of the result replace input columns of the same names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.llm.frames import Carried, map_rows, written
from rankspark.llm.hashing import NOT_ALNUM, Poly, byte_values, text_bytes, text_groups, tokens

WINDOW = 10
MAX_BLOCK_BYTES = 32 << 20


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


class Words:
    """Alphanumeric words of a batch: hashes, counts per text and byte spans."""

    def __init__(self):
        self.poly, self.value, self.grams = Poly(11), byte_values(11, True), Poly(12)

    def groups(self, column):
        data, offs = text_bytes(column)
        for a, b in text_groups(offs):
            part, o = data[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
            (h,), counts, s, e = tokens(part, o, NOT_ALNUM, [self.poly], [self.value], spans=True)
            yield a, part.tobytes(), h, counts, s, e


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(item string, n int, words string)``: the distinct windows of every item, words joined by one space."""
    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            items = _column(batch, "__item")
            rows = set()
            for a, raw, _, counts, s, e in Words().groups(_column(batch, "__text")):
                low, first = raw.lower(), 0
                for i, n in enumerate(counts.tolist()):
                    words = [low[s[j]:e[j]] for j in range(first, first + n)]
                    first += n
                    k = min(n, size)
                    for j in range(n - k + 1 if n else 0):
                        rows.add((items[a + i].as_py(), k, b" ".join(words[j:j + k]).decode()))
            out = sorted(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))], names=["item", "n", "words"])

    plain = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__item"), F.col(text_col).alias("__text"))
    return plain.mapInArrow(cut, "item string, n int, words string").distinct()


def _scan(docs: DataFrame, text_col: str, found: list, fields) -> DataFrame:
    """One pass over the documents with one block of windows ``[(n, words, [items])]``."""
    items_of = {}
    for n, words, items in found:
        items_of.setdefault(n, {})[words.encode()] = items
    sent = docs.sparkSession.sparkContext.broadcast(items_of)
    state: dict = {}

    def tables():
        """Per window length: the sorted hashes, and a bitmap over their top 16 bits."""
        import pyarrow as pa

        words = Words()
        out = {}
        for n, windows in sent.value.items():
            _, _, h, counts, _, _ = next(words.groups(pa.array([b"\n".join(windows).decode()])))
            h = words.grams.windows(h, n)[::n]
            bits = np.zeros(1 << 16, dtype=bool)
            bits[h >> np.uint64(48)] = True
            out[n] = (np.sort(h), bits)
        return words, out

    def scan(batch):
        import pyarrow as pa

        if "t" not in state:
            state["t"] = tables()
        words, by_size = state["t"]
        old_spans = _column(batch, "__spans").to_pylist()
        old_items = _column(batch, "__items").to_pylist()
        spans, items, sizes = list(old_spans), list(old_items), []
        for a, raw, h, counts, s, e in words.groups(_column(batch, text_col)):
            sizes += counts.tolist()
            first = np.concatenate([[0], np.cumsum(counts)])
            low, got = None, {}
            for n, (sorted_h, bits) in by_size.items():
                w = words.grams.windows(h, n)
                at = np.flatnonzero(bits[w >> np.uint64(48)])
                if not len(at):
                    continue
                k = np.minimum(np.searchsorted(sorted_h, w[at]), len(sorted_h) - 1)
                at = at[sorted_h[k] == w[at]]
                row = np.searchsorted(first, at, side="right") - 1
                inside = at + n <= first[row + 1]
                low = raw.lower() if low is None else low
                for i, r in zip(at[inside].tolist(), row[inside].tolist()):
                    hit = sent.value[n].get(b" ".join(low[x:y] for x, y in zip(s[i:i + n].tolist(), e[i:i + n].tolist())))
                    if hit is not None:
                        g = got.setdefault(r, ([], set()))
                        g[0].append((i - int(first[r]), i - int(first[r]) + n))
                        g[1].update(hit)
            for r, (new, names) in got.items():
                flat = old_spans[a + r]
                spans[a + r] = union(new + list(zip(flat[::2], flat[1::2])))
                items[a + r] = sorted(names.union(old_items[a + r]))
        return [pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]

    return map_rows(docs, scan, fields)


def union(spans):
    """The union of half-open spans, flat: start, end, start, end, ..."""
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                       item_text_col: str = "text", size: int = WINDOW, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """Adds ``n_words, n_hit long, items array<string>`` (sorted) and ``hit_spans`` (word numbers, flat start/end pairs)."""
    names = ["n_words", "n_hit", "items", "hit_spans"]
    windows = written(benchmark_windows(benchmark, item_id_col, item_text_col, size), "bench-windows")
    total = windows.agg(F.sum(F.octet_length("words") + F.octet_length("item") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(total / max_block_bytes))
    longs, strings = T.ArrayType(T.LongType()), T.ArrayType(T.StringType())
    fields = [T.StructField("n_words", T.LongType()), T.StructField("__spans", longs), T.StructField("__items", strings)]
    carried = Carried(docs, names)
    text_col = carried[text_col]
    out = carried.df.withColumns({"__spans": F.lit(None).cast(longs), "__items": F.lit(None).cast(strings)})
    out = out.withColumns({"__spans": F.coalesce("__spans", F.array().cast(longs)), "__items": F.coalesce("__items", F.array().cast(strings))})
    for b in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b)
        found = part.groupBy("n", "words").agg(F.collect_set("item").alias("items")).collect()
        out = _scan(out, text_col, [(r["n"], r["words"], r["items"]) for r in found], fields)
        if b + 1 < blocks:
            out = written(out, "decontaminate")
    hit = F.aggregate(F.transform("__spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return carried.restore(out.withColumn("n_hit", hit), "n_words", "n_hit", F.col("__items").alias("items"), F.col("__spans").alias("hit_spans"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text_col: str = "text", **kw) -> DataFrame:
    """Documents without benchmark content, with the columns they came with.

    ``documents`` drops each document with a hit; ``spans`` keeps it without the
    text from the first to the last word of each hit span.
    """
    carried = Carried(docs)
    text_col = carried[text_col]
    found = find_contamination(carried.df, benchmark, text_col=text_col, **kw)
    if mode == "documents":
        return carried.restore(found.where(F.col("n_hit") == 0))
    if mode != "spans":
        raise ValueError("mode must be 'documents' or 'spans'")

    def cut(batch):
        import pyarrow as pa

        column = _column(batch, text_col)
        spans, out = _column(batch, "hit_spans").to_pylist(), column.to_pylist()
        _, offs = text_bytes(column)
        for a, raw, _, counts, s, e in Words().groups(column):
            first = np.concatenate([[0], np.cumsum(counts)])
            for i in np.flatnonzero([bool(x) for x in spans[a:a + len(counts)]]).tolist():
                at, end, kept = int(offs[a + i] - offs[a]), int(offs[a + i + 1] - offs[a]), []
                for x, y in zip(spans[a + i][::2], spans[a + i][1::2]):
                    kept.append(raw[at:int(s[first[i] + x])])
                    at = int(e[first[i] + y - 1])
                out[a + i] = b"".join([*kept, raw[at:end]]).decode()
        return [pa.array(out, pa.string())]

    cleaned = map_rows(found, cut, [T.StructField("__clean", T.StringType())])
    return carried.restore(cleaned, **{text_col: "__clean"})


def op5_decontaminate(spark, sf_dir):
    """Benchmark hits of all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    out = find_contamination(docs, bench)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
cuts AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM cuts),
lens AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lens WHERE len(w) >= n),
hits AS (SELECT doc_id, s.i, s.n, item FROM spots s JOIN windows v ON v.n = s.n AND v.win = array_to_string(s.w[s.i:s.i + s.n - 1], ' ')),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(m.n_hit, 0)::BIGINT AS n_hit, coalesce(d.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(d.ids, '')) AS items_sha256, coalesce(m.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN marked m ON w.doc_id = m.doc_id LEFT JOIN named d ON w.doc_id = d.doc_id"""
