"""Line deduplication: two Bloom filters, then an exact step for suspected repeats only.

A line's key is the line without ASCII white space at its ends and with A-Z
lower-cased. Keys of ``min_chars`` code points or more that are found in two or
more documents lose all their lines except in the smallest ``doc_id`` that holds
them. First pass: the once-seen and twice-seen filters (``bloom``). Second pass:
only keys in the twice filter leave the task, as the two halves of their 128-bit XXH3 hash
and the ``doc_id``. Their smallest and largest ``doc_id`` (aggregated on the map
side) confirm a repeat and name its keeper; a hot key's rows are split by
Spark's skew join. Lines to drop go back to their documents by ``doc_id``.

Defined cases: a null or empty text is one empty line and comes back empty; rows
with the same ``doc_id`` are one document; rows with a null ``doc_id`` neither
hold nor lose lines; an empty table gives an empty result. Keys are told apart
by 128 hash bits (a clash among 10^12 keys has a chance of about 10^-15).
``n_lines``, ``n_dropped`` replace input columns of these names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.llm.bloom import contains, filter_bits, twice_filter
from rankspark.llm.frames import Carried, map_rows, small_batches
from rankspark.llm.hashing import SPACE, text_bytes, text_groups

MIN_CHARS = 10
#: Sizes the filter; a wrong guess costs rows in the exact step, not results.
LINES_PER_DOCUMENT = 32


class Lines:
    """Splits a batch's texts into lines and hashes their keys."""

    def __init__(self, min_chars):
        self.min_chars, self.fold = min_chars, np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def groups(self, column):
        """Per group of rows: (first row, line starts, line ends, lines per text, long enough, key hashes)."""
        import xxhash

        data, offs = text_bytes(column)
        for a, b in text_groups(offs, 1 << 20):
            part, o = data[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
            feeds = np.flatnonzero(part == 10)
            # every text's lines start at its start and after each feed, and end at a feed or its end
            starts = np.sort(np.concatenate([o[:-1], feeds + 1]), kind="stable")
            ends = np.sort(np.concatenate([feeds, o[1:]]), kind="stable")
            counts = np.diff(np.searchsorted(feeds, o)) + 1
            ink = np.flatnonzero(~SPACE[part])
            first, last = np.searchsorted(ink, starts), np.searchsorted(ink, ends)
            full = last > first
            s = np.where(full, ink[np.minimum(first, len(ink) - 1)], 0) if len(ink) else np.zeros_like(starts)
            e = np.where(full, ink[np.maximum(last - 1, 0)] + 1, 0) if len(ink) else np.zeros_like(ends)
            chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
            enough = chars[e] - chars[s] >= self.min_chars
            keys, raw, at = np.zeros((len(s), 2), dtype=np.uint64), self.fold[part].tobytes(), np.flatnonzero(enough)
            digests = b"".join([xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(s[at].tolist(), e[at].tolist())])
            keys[at] = np.frombuffer(digests, dtype="<u8").reshape(-1, 2)
            keys = np.ascontiguousarray(keys.T)
            yield a, starts + offs[a], ends + offs[a], counts, enough, keys


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def _distinct(doc, keys):
    """Indices of one of each (document, key)."""
    order = np.lexsort((keys, doc))
    d, k = doc[order], keys[order]
    return order[np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])])] if len(order) else order


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with repeated lines removed from ``text``, plus ``n_lines`` and ``n_dropped``."""
    spark = docs.sparkSession
    carried = Carried(docs, ["n_lines", "n_dropped"])
    base, id_col, text_col = carried.df, carried[id_col], carried[text_col]
    small_batches(docs)
    bits = filter_bits(docs.count() * LINES_PER_DOCUMENT)
    texts = base.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col)

    def keys_of(batch):
        for _, _, _, counts, enough, keys in Lines(min_chars).groups(_column(batch, text_col)):
            doc = np.repeat(np.arange(len(counts)), counts)[enough]
            yield keys[0][enough][_distinct(doc, keys[0][enough])]

    twice = twice_filter(texts.select(text_col), keys_of, bits)

    def suspects(batches):
        import pyarrow as pa

        seen = np.frombuffer(twice.value, dtype=np.uint8)
        split = Lines(min_chars)
        for batch in batches:
            for a, _, _, counts, enough, keys in split.groups(_column(batch, text_col)):
                doc = np.repeat(np.arange(len(counts)), counts)
                at = np.flatnonzero(enough)
                at = at[contains(seen, keys[0][at], bits)]
                at = at[_distinct(doc[at], keys[0][at])]
                ids = _column(batch, id_col).take(pa.array(doc[at] + a))
                yield pa.RecordBatch.from_arrays([ids, pa.array(keys[0][at].view(np.int64)), pa.array(keys[1][at].view(np.int64))], names=["__d", "__k1", "__k2"])

    kind = base.schema[id_col].dataType
    found = texts.mapInArrow(suspects, T.StructType([T.StructField("__d", kind), T.StructField("__k1", T.LongType()), T.StructField("__k2", T.LongType())]))
    repeats = (found.groupBy("__k1", "__k2").agg(F.min("__d").alias("__first"), F.max("__d").alias("__last"))
               .where(F.col("__first") < F.col("__last")).drop("__last"))
    drops = (found.join(repeats, ["__k1", "__k2"]).where(F.col("__d") > F.col("__first"))
             .groupBy("__d").agg(F.collect_set(F.struct("__k1", "__k2")).alias("__drop")))
    marked = base.join(drops, base[id_col] == drops["__d"], "left").drop("__d")

    def strip(batch):
        import pyarrow as pa

        column, drop = _column(batch, text_col), _column(batch, "__drop")
        data, _ = text_bytes(column)
        raw = data.tobytes()
        bounds = drop.offsets.to_numpy()
        flat = drop.flatten()
        d1, d2 = (flat.field(i).to_numpy().view(np.uint64) for i in (0, 1))
        present = drop.is_valid().to_numpy(zero_copy_only=False)
        texts_out, lines, dropped = [], [], []
        base0 = bounds[0] if len(bounds) else 0
        for a, starts, ends, counts, enough, keys in Lines(min_chars).groups(column):
            first = np.concatenate([[0], np.cumsum(counts)])
            for i, n in enumerate(counts.tolist()):
                r, lo, hi = a + i, first[i], first[i + 1]
                keep = np.ones(n, dtype=bool)
                if present[r]:
                    b, c = bounds[r] - base0, bounds[r + 1] - base0
                    gone = dict(zip(d1[b:c].tolist(), d2[b:c].tolist()))
                    k1, k2 = keys[0][lo:hi], keys[1][lo:hi]
                    for j in np.flatnonzero(enough[lo:hi] & np.isin(k1, d1[b:c])):
                        keep[j] = gone.get(int(k1[j])) != int(k2[j])
                out = raw[starts[lo]:ends[hi - 1]] if keep.all() else b"\n".join(raw[starts[lo + j]:ends[lo + j]] for j in np.flatnonzero(keep))
                texts_out.append(out)
                lines.append(n)
                dropped.append(n - int(keep.sum()))
        return [pa.array(texts_out, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]

    fields = [T.StructField("__kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    out = map_rows(marked, strip, fields)
    return carried.restore(out, "n_lines", "n_dropped", **{text_col: "__kept"})


def op2_line_dedup(spark, sf_dir):
    """Line dedup of all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.*, coalesce(k.doc_id > f.first, false) AS gone FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, sum(CAST(gone AS BIGINT))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
