"""Removal of passages that recur, with repeated-phrase automata.

A window is ``size`` consecutive words (unchanged). Every word covered by a
window whose word sequence also starts anywhere else is removed.

1. Suspect. Among the ``PHRASE``-word phrases of a window the one with the
   smallest hash stands for it; equal windows have equal phrases at the same
   place, and neighbouring windows mostly share one, so there are far fewer of
   them than windows. A twice-seen Bloom filter finds the phrases that recur.
2. Confirm. Neighbouring windows with one recurring phrase form a segment, and
   leave the task as one row with their window hashes. Equal segments are counted first
   (aggregated before the shuffle, so copies cost one row per task); only phrases
   with several different segments are compared window by window.
3. Locate. Confirmed windows go back to their documents and join up to recurring
   passages. Documents are streamed in shards of about ``SHARD_BYTES``: the
   passages confirmed for a shard's documents are compiled to Aho-Corasick automata
   of at most ``AUTOMATON_CHARS`` characters each, and all documents of the shard run through
   them; every occurrence's words are removed. A shard needs no other
   passages, as a recurring window is confirmed for each document that has it.

Defined cases: a null text has no words and comes back empty; texts shorter than
a window lose nothing; a row that is repeated recurs, so its windows go in all
its copies; windows that overlap themselves count; an empty table gives an empty result.
``n_words``, ``n_removed`` replace input columns of these names. Windows are told
apart by phrase hash and window hash, 128 bits together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.llm.bloom import contains, filter_bits, twice_filter
from rankspark.llm.frames import Carried, map_rows, small_batches, written
from rankspark.llm.hashing import SPACE, Poly, byte_values, text_bytes, text_groups, tokens

WINDOW = 35
PHRASE = 8
SHARD_BYTES = 1 << 18
AUTOMATON_CHARS = 1 << 19
CHUNK_WORDS = 2048
PLACE_BITS = 24
#: Sizes the filter; a wrong guess costs rows in the confirming step, not results.
PHRASES_PER_DOCUMENT = 64
#: Phrases with several segments: up to this number (8 bytes each) they are broadcast, more are joined by a shuffle.
MAX_BROADCAST_KEYS = 1 << 21


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


class Segments:
    """Segments of neighbouring windows that share a smallest phrase."""

    def __init__(self, size=WINDOW, phrase=PHRASE):
        self.size, self.phrase = size, min(phrase, size)
        self.poly, self.value = Poly(51), byte_values(51, False)
        self.phrases, self.windows, self.runs = Poly(52), Poly(53), Poly(54)

    def groups(self, column):
        """(row, first window, windows, phrase key, place of the phrase, window hashes of the group, their offset)."""
        data, offs = text_bytes(column)
        for a, b in text_groups(offs):
            (h,), counts = tokens(data[offs[a]:offs[b]], offs[a:b + 1] - offs[a], SPACE, [self.poly], [self.value])
            first = np.concatenate([[0], np.cumsum(counts)])
            if len(h) < self.size:
                continue
            key = self.phrases.windows(h, self.phrase)
            wins = self.windows.windows(h, self.size)
            text = np.repeat(np.arange(b - a), counts)
            at = np.flatnonzero(text[:len(wins)] == text[self.size - 1:])  # windows within one text
            if not len(at):
                continue
            place = self.smallest(key)[at]
            new = np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])
            start = np.flatnonzero(new)
            yield a, text[at[start]], at[start] - first[text[at[start]]], np.diff(np.append(start, len(at))), key[place[start]], wins, at[start]

    def smallest(self, key):
        """For every window the place of its smallest phrase, the first of equals."""
        span = self.size - self.phrase + 1
        mask = np.uint64((1 << PLACE_BITS) - 1)
        m = (key & ~mask) | (np.arange(len(key), dtype=np.uint64) & mask)
        width = 1
        while 2 * width <= span:
            m = np.minimum(m[:len(m) - width], m[width:])
            width *= 2
        if width < span:
            m = np.minimum(m[:len(m) - (span - width)], m[span - width:])
        p = np.arange(len(m), dtype=np.uint64)
        return (p + (((m & mask) - p) & mask)).astype(np.int64)


def suspects(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Segments of suspected windows: ``__id, __text, start, n (windows), key, seg, wins``; written."""
    bits = filter_bits(docs.count() * PHRASES_PER_DOCUMENT)

    def keys_of(batch):
        for _, _, _, _, key, _, _ in Segments(size).groups(batch.column(0)):
            yield key

    twice = twice_filter(docs.select(text_col), keys_of, bits)
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__text"), F.col(text_col).alias("__whole"))

    def run(batches):
        import pyarrow as pa

        seen, cut = np.frombuffer(twice.value, dtype=np.uint8), Segments(size)
        for batch in batches:
            for a, row, start, n, key, wins, at in cut.groups(_column(batch, "__whole")):
                keep = np.flatnonzero(contains(seen, key, bits))
                if not len(keep):
                    continue
                row, start, n, key, at = row[keep], start[keep], n[keep], key[keep], at[keep]
                seg = cut.runs.ranges(cut.runs.prefix(wins), at, at + n) ^ n.astype(np.uint64)
                bounds = np.concatenate([[0], np.cumsum(n)])
                flat = wins[np.repeat(at - bounds[:-1], n) + np.arange(bounds[-1])]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.view(np.int64)))
                take = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(seg.view(np.int64)), lists],
                                                 names=["__id", "__text", "start", "n", "key", "seg", "wins"])

    schema = T.StructType([rows.schema["__id"], rows.schema["__text"], T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("key", T.LongType()),
                           T.StructField("seg", T.LongType()), T.StructField("wins", T.ArrayType(T.LongType()))])
    return written(rows.mapInArrow(run, schema), "substring-segments")


def confirm(found: DataFrame) -> DataFrame:
    """Per segment with a recurring window ``key, seg, mask`` (bit ``j``: its window ``j`` recurs)."""
    segs = written(found.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n")), "substring-distinct")
    several = written(segs.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("key"), "substring-several")
    if several.count() <= MAX_BROADCAST_KEYS:
        several = F.broadcast(several)
    alone = segs.join(several, "key", "left_anti").where("c > 1").select("key", "seg", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    # window hashes move only for phrases with several segments, once per segment and task
    wins = found.select("key", "seg", "wins").join(several, "key", "left_semi").groupBy("key", "seg").agg(F.count(F.lit(1)).alias("c"), F.first("wins").alias("wins"))
    wins = wins.select("key", "seg", "c", F.posexplode("wins").alias("j", "w"))
    again = wins.groupBy("key", "w").agg(F.sum("c").alias("n")).where("n > 1").select("key", "w")
    some = wins.join(again, ["key", "w"]).groupBy("key", "seg").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("mask"))
    return alone.unionByName(some)


def passages(starts, masks):
    """Word ranges of the maximal runs of recurring windows, from (first window, mask) pairs; ends count windows."""
    wins = sorted(s + j for s, m in zip(starts, masks) for j in range(m.bit_length()) if m >> j & 1)
    out = []
    for p in wins:
        if out and p <= out[-1][1]:
            out[-1][1] = max(out[-1][1], p + 1)
        else:
            out.append([p, p + 1])
    return out


def automata(patterns):
    """Automata over ``patterns``, each of at most ``AUTOMATON_CHARS`` characters (or one pattern)."""
    import ahocorasick

    a, chars = None, 0
    for p in sorted(patterns):
        if a is not None and chars + len(p) > AUTOMATON_CHARS:
            a.make_automaton()
            yield a
            a, chars = None, 0
        if a is None:
            a = ahocorasick.Automaton()
        a.add_word(p, len(p))
        chars += len(p)
    if a is not None:
        a.make_automaton()
        yield a


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """The documents with ``text`` reduced to the kept words, joined by one space, plus ``n_words`` and ``n_removed``."""
    carried = Carried(docs, ["n_words", "n_removed"])
    base, id_col, text_col = carried.df, carried[id_col], carried[text_col]
    small_batches(docs)
    found = suspects(base, id_col, text_col, size)
    masks = confirm(found.select("key", "seg", "n", "wins"))
    marks = (found.select("__id", "__text", "start", "key", "seg").join(masks, ["key", "seg"])
             .groupBy("__id", "__text").agg(F.collect_set(F.struct("start", "mask")).alias("__marks")))
    j = base.join(marks, base[id_col].eqNullSafe(marks["__id"]) & (F.xxhash64(base[text_col]) == marks["__text"]), "left").drop("__id", "__text")

    def locate(batch):
        import pyarrow as pa

        column = _column(batch, text_col)
        marks_in = _column(batch, "__marks").to_pylist()
        cut = Segments(size)
        data, offs = text_bytes(column)
        out, n_words, n_removed = [], [], []
        for a, b in text_groups(offs, SHARD_BYTES):
            part, o = data[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
            _, counts, s, e = tokens(part, o, SPACE, [], [], spans=True)
            raw = part.tobytes()
            first = np.concatenate([[0], np.cumsum(counts)])
            words, patterns = [], set()
            for i, n in enumerate(counts.tolist()):
                words.append([raw[x:y].decode() for x, y in zip(s[first[i]:first[i + 1]].tolist(), e[first[i]:first[i + 1]].tolist())])
                if marks_in[a + i]:
                    for p, q in passages([m["start"] for m in marks_in[a + i]], [m["mask"] for m in marks_in[a + i]]):
                        for k in range(p, q, CHUNK_WORDS):  # chunks share size - 1 words, so no window is lost
                            patterns.add(" " + " ".join(words[i][k:min(k + CHUNK_WORDS, q) + size - 1]) + " ")
            gone = [None] * len(words)
            for automaton in automata(patterns):
                for i, w in enumerate(words):
                    if len(w) < size:
                        continue
                    starts = None
                    for end, length in automaton.iter(" " + " ".join(w) + " "):
                        if starts is None:  # place of the space before each word, and the last space
                            starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in w])])
                            gone[i] = np.zeros(len(w), dtype=bool) if gone[i] is None else gone[i]
                        x, y = np.searchsorted(starts, [end - length + 1, end])
                        gone[i][x:y] = True
            for w, g in zip(words, gone):
                out.append(" ".join(w) if g is None else " ".join([x for x, y in zip(w, g.tolist()) if not y]))
                n_words.append(len(w))
                n_removed.append(0 if g is None else int(g.sum()))
        return [pa.array(out, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]

    fields = [T.StructField("__kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    out = map_rows(j, locate, fields)
    return carried.restore(out, "n_words", "n_removed", **{text_col: "__kept"})


def op10_substring_dedup(spark, sf_dir):
    """Passages of all ``documents`` that recur, removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_passages(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)),
again AS (SELECT win FROM windows GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows SEMI JOIN again USING (win)),
spots AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (SELECT s.doc_id, string_agg(word, ' ' ORDER BY s.p) AS t, count(*) AS n FROM spots s ANTI JOIN gone g ON g.doc_id = s.doc_id AND g.p = s.p GROUP BY s.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id"""
