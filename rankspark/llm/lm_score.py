"""Language-model scoring by context-tree weighting over bytes.

A text (A-Z lower-cased, UTF-8) is coded byte by byte and closed with an end
symbol. Every byte is decomposed into its 8 bits, high bit first: the 255 binary
nodes of a context each have a Krichevsky-Trofimov estimator, and a context's
block probability is the product over its nodes. A context ``s`` of up to
``DEPTH`` bytes mixes itself with its one byte longer contexts,
``P_w(s) = P_kt(s) / 2 + prod P_w(children) / 2``; the weights that follow from the
training counts are then held, so the probability of a byte is the mixture of
the KT estimates of all depths along its context path. Code length per byte is
``-log2`` of the score over the bytes.

All (context, byte) strings of the texts are counted exactly: tasks count their
own, Spark adds up. Every string of ``DEPTH + 1`` bytes of any text is in the table,
with count 0 if training lacks it, so its log probability is worked out once and
nothing is pruned. The subtree below a context of ``SPLIT`` bytes is complete in one
task (``subtrees``); the contexts above have at most 2^24 (context, byte) pairs
whatever the corpus, and the driver weighs them (``upper``). The most frequent strings
(at most ``MAX_ENTRIES``) are broadcast with their log probabilities; all others of a
text leave it, are joined with the table and summed per row. The bound decides the
way of a string, not its score.

``score_documents`` also gives an add-one word model (``base_score``). Words go
by 64-bit hash. The most frequent words (at most ``MAX_WORDS``) are broadcast;
all other words of a document leave as hashes, are joined with the rest of the
vocabulary and summed per row, so any vocabulary size is exact.

Defined cases: a null text is empty, which has the end symbol only; rows with a
null id are training rows (not held out); without training rows every byte costs
8 bits and the end symbol is a byte like others; an empty table gives an empty result. Result columns
replace input columns of the same names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.llm.frames import Carried, small_batches, written
from rankspark.llm.hashing import SPACE, Poly, byte_values, text_bytes, text_groups, tokens

DEPTH = 6
#: Contexts of so many bytes and their subtrees are weighed in tasks, shorter ones on the driver.
SPLIT = 3
MAX_ENTRIES = 1 << 21
#: Strings that a task weighs at once (whole subtrees, so a larger one is one piece).
PIECE = 1 << 18
MAX_WORDS = 1 << 20
#: A byte that UTF-8 never has: the end symbol, and the context before a text's start.
EDGE = 0xFF
FLUSH = 1 << 21
#: Marks packed strings of texts that are not learned from, while a task counts them.
HELD_OUT = np.uint64(1 << 63)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def framed(data, offs):
    """Each text lower-cased between ``DEPTH`` and one ``EDGE`` bytes; position of each coded byte; its text."""
    n = len(offs) - 1
    sizes = np.diff(offs) + DEPTH + 1
    text = np.repeat(np.arange(n), np.diff(offs))
    out = np.full(int(sizes.sum()), EDGE, dtype=np.uint8)
    out[np.arange(len(data)) + text * (DEPTH + 1) + DEPTH] = LOWER[data]
    first = np.concatenate([[0], np.cumsum(sizes)])
    coded = np.ones(len(out), dtype=bool)
    for k in range(DEPTH):
        coded[first[:-1] + k] = False
    return out, np.flatnonzero(coded), np.repeat(np.arange(n), np.diff(offs) + 1)


def grams(framed_bytes, at):
    """The ``DEPTH`` context bytes and the byte itself, packed into the low bits of a uint64 (byte itself lowest)."""
    g = np.zeros(len(framed_bytes), dtype=np.uint64)
    for k in range(DEPTH + 1):
        g[k:] |= framed_bytes[:len(framed_bytes) - k].astype(np.uint64) << np.uint64(8 * k)
    return g[at]


def tally(keys):
    """Sorted distinct keys and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


class Counter:
    """Counts keys with bounded memory: ``add`` returns what has to leave the task now."""

    def __init__(self):
        self.fresh, self.size, self.keys, self.counts = [], 0, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def add(self, keys):
        self.fresh.append(keys)
        self.size += len(keys)
        return self.fold() if self.size >= FLUSH else None

    def fold(self):
        if self.fresh:
            k, c = tally(np.concatenate(self.fresh))
            self.fresh, self.size = [], 0
            at = np.searchsorted(self.keys, k)
            known = at < len(self.keys)
            known[known] = self.keys[at[known]] == k[known]
            self.counts[at[known]] += c[known]
            self.keys, self.counts = np.insert(self.keys, at[~known], k[~known]), np.insert(self.counts, at[~known], c[~known])
        return self.take() if len(self.keys) >= FLUSH else None

    def take(self):
        out = self.keys, self.counts
        self.keys, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        return out


class WordHashes:
    def __init__(self):
        self.poly, self.value = Poly(31), byte_values(31, True)

    def of(self, data, offs):
        (h,), counts = tokens(data, offs, SPACE, [self.poly], [self.value])
        return h, counts


def corpus_counts(texts: DataFrame, text_col: str, training_col: str) -> DataFrame:
    """``(kind, key, n, uses)``: kind 0 counts word hashes of training texts, kind 1 packed byte strings, kind 2 (key 0) training texts.

    ``n`` counts in training texts, ``uses`` in all.
    """
    def count(batches):
        import pyarrow as pa

        def rows(kind, found):
            for i in range(0, len(found[0]), 100_000):
                k, n = found[0][i:i + 100_000], found[1][i:i + 100_000].astype(np.int64)
                learned = np.where(k & HELD_OUT, 0, n) if kind == 1 else n
                k = k & ~HELD_OUT if kind == 1 else k
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, dtype=np.int32)), pa.array(k.view(np.int64)), pa.array(learned), pa.array(n)], names=["kind", "key", "n", "uses"])

        words, by_kind, n_texts = WordHashes(), (Counter(), Counter()), 0
        for batch in batches:
            data, offs = text_bytes(batch.column(0))
            learn = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            n_texts += int(learn.sum())
            for a, b in text_groups(offs, 1 << 20):
                part, o = data[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
                full, at, text = framed(part, o)
                h, n_words = words.of(part, o)
                strings = grams(full, at) | np.where(learn[a:b], np.uint64(0), HELD_OUT)[text]
                for kind, keys in ((0, h[np.repeat(learn[a:b], n_words)]), (1, strings)):
                    found = by_kind[kind].add(keys)
                    if found:
                        yield from rows(kind, found)
        for kind in (0, 1):
            found = by_kind[kind].fold()
            yield from rows(kind, found or by_kind[kind].take())
        if n_texts:
            yield from rows(2, (np.zeros(1, dtype=np.uint64), np.array([n_texts])))

    out = texts.select(text_col, training_col).mapInArrow(count, "kind int, key long, n long, uses long")
    return out.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses"))


def log_gamma(x):
    """log Gamma for arrays of positive numbers (recurrence up to 8, then Stirling's series)."""
    x = x.astype(np.float64)
    shift = np.zeros_like(x)
    small = x < 8
    while small.any():
        shift[small] -= np.log(x[small])
        x = np.where(small, x + 1, x)
        small = x < 8
    i = 1 / x
    i2 = i * i
    return shift + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + i * (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 / 1680)))


#: log Gamma at k + 0.5 and k + 1 for small counts k.
LOG_GAMMA = {shift: log_gamma(np.arange(4096) + shift) for shift in (0.5, 1.0)}


def log_gamma_of(counts, shift):
    """log Gamma(count + shift) for arrays of counts."""
    table = LOG_GAMMA[shift]
    out = table[np.minimum(counts, len(table) - 1)]
    large = np.flatnonzero(counts >= len(table))
    out[large] = log_gamma(counts[large] + shift)
    return out


def bit_counts(keys, counts, bit):
    """For sorted pairs: (node of each pair at this bit, zeros and ones of each node, the pair's own bit)."""
    node = keys >> np.uint64(8 - bit)
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    number = np.cumsum(np.concatenate([[False], node[1:] != node[:-1]]))
    own = (keys >> np.uint64(7 - bit)) & np.uint64(1)
    ones = np.add.reduceat(np.where(own == 1, counts, 0), first)
    return number, np.add.reduceat(counts, first) - ones, ones, own, first


def estimates(keys, counts):
    """From sorted pairs: (contexts, their counts, first pair of each, log block probabilities, log KT estimate of each pair)."""
    c = keys >> np.uint64(8)
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    p, logs = np.zeros(len(keys)), np.zeros(len(first))
    for bit in range(8):
        number, zeros, ones, own, at = bit_counts(keys, counts, bit)
        z, o = zeros.astype(float), ones.astype(float)
        p += np.log((np.where(own == 1, o[number], z[number]) + 0.5) / (z[number] + o[number] + 1))
        node = log_gamma_of(zeros, 0.5) + log_gamma_of(ones, 0.5) - log_gamma_of(zeros + ones, 1.0) - math.log(math.pi)
        node[zeros + ones == 0] = 0.0
        np.add.at(logs, np.searchsorted(first, at, side="right") - 1, node)
    return c[first], np.add.reduceat(counts, first), first, logs, p


def tree(keys, counts, low, high, below=None):
    """Weighs the contexts of ``low`` to ``high`` bytes; ``keys``: all their sorted pairs of depth ``high`` (counts may be 0).

    ``below``: per context of ``high`` bytes the sum of its children's log weighted probabilities (none for ``DEPTH``).
    Returns ``(acc, out, going, weighted, contexts)``. Per pair: ``acc``, the log mixture of the depths up to ``high`` if
    the context path goes on; ``out``, the one if the deepest context known to training is the last (nan where there is
    none); ``going``, the log weight of going beyond ``high``; all relative to reaching the context of ``low`` bytes.
    ``weighted``: log weighted probability of the ``contexts`` of ``low`` bytes.
    """
    levels, up_pair = {}, {}
    pairs, n = keys, counts
    for d in range(high, low - 1, -1):
        if d < high:
            pairs, up_pair[d + 1] = np.unique(pairs & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
            n = np.bincount(up_pair[d + 1], weights=n, minlength=len(pairs)).astype(np.int64)
        levels[d] = (pairs, *estimates(pairs, n))
    half, stop, up = math.log(0.5), {}, {}
    for d in range(high, low - 1, -1):
        _, ctx, total, _, block, _ = levels[d]
        if d < high:
            up[d + 1] = np.searchsorted(ctx, levels[d + 1][1] & np.uint64((1 << 8 * d) - 1))
            below = np.bincount(up[d + 1], weights=weighted, minlength=len(ctx))
        if below is None:
            stop[d], weighted = np.zeros(len(ctx)), block
        else:
            weighted = np.logaddexp(half + block, half + below)
            stop[d] = np.minimum(half + block - weighted, -1e-12)
    for d in range(low, high + 1):
        pairs, ctx, total, first, _, kt = levels[d]
        of = np.repeat(np.arange(len(ctx)), np.diff(np.append(first, len(pairs))))
        if d == low:
            reach, acc, out = np.zeros(len(ctx)), np.full(len(pairs), -np.inf), np.full(len(pairs), np.nan)
        else:
            reach, acc, out = going[up[d]], acc[up_pair[d]], out[up_pair[d]]
        out = np.where(total[of] > 0, np.logaddexp(acc, reach[of] + kt), out)
        acc = np.logaddexp(acc, reach[of] + stop[d][of] + kt)
        going = reach + np.log(-np.expm1(np.minimum(stop[d], -1e-300))) if d < DEPTH else reach
    return acc, out, going[of], weighted, levels[low][1]


def build_model(levels: list) -> dict:
    """Weights and tables of a small tree in one process, from ``levels[d] = (pairs, counts)``: sorted ``context << 8 | byte`` of depth ``d``, all pairs of each opened context."""
    depth = len(levels) - 1
    ctx, block, kt = [], [], []
    for keys, counts in levels:
        c, n, _, logs, p = estimates(keys, counts)
        ctx.append((c, n))
        block.append(logs)
        kt.append(p)
    stop = [None] * (depth + 1)  # log weight of stopping at a context
    weighted = block[depth]
    stop[depth] = np.zeros(len(weighted))
    for d in range(depth - 1, -1, -1):
        c, n = ctx[d]
        child, child_n = ctx[d + 1]
        up = np.searchsorted(c, child & np.uint64((1 << 8 * d) - 1))
        sums, opened = np.zeros(len(c)), np.zeros(len(c))
        np.add.at(sums, up, weighted)
        np.add.at(opened, up, child_n)
        sums += block[d] * (1 - opened / n)  # the share in contexts that are not opened costs what it costs here
        weighted_here = np.logaddexp(math.log(0.5) + block[d], math.log(0.5) + sums)
        stop[d] = np.minimum(math.log(0.5) + block[d] - weighted_here, -1e-12)
        stop[d][opened == 0] = 0.0
        weighted = weighted_here
    reach = [np.zeros(len(ctx[0][0]))]  # log weight of coming as far as a context
    for d in range(1, depth + 1):
        c = ctx[d][0]
        up = np.searchsorted(ctx[d - 1][0], c & np.uint64((1 << 8 * (d - 1)) - 1))
        reach.append(reach[d - 1][up] + np.log(-np.expm1(np.minimum(stop[d - 1][up], -1e-300))))
    return {"ctx": [c for c, _ in ctx], "pairs": [k for k, _ in levels], "cum": [np.concatenate([[0], np.cumsum(n)]) for _, n in levels],
            "stop": [s.astype(np.float32) for s in stop], "reach": [r.astype(np.float32) for r in reach], "kt": [k.astype(np.float32) for k in kt]}


class Table:
    """Open addressing over distinct uint64 keys (none of them all ones); ``find`` looks up many at once."""

    EMPTY = np.uint64((1 << 64) - 1)

    def __init__(self, keys, values):
        bits = 1 + max(4, (len(keys) - 1).bit_length()) if len(keys) else 4
        size = 1 << bits
        self.mask, self.shift = np.uint64(size - 1), np.uint64(64 - bits)
        self.keys, self.values = np.full(size, self.EMPTY, dtype=np.uint64), np.zeros(size, dtype=values.dtype)
        slot, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == self.EMPTY
            self.keys[slot[left[free]]] = keys[left[free]]  # the last writer of a slot wins
            won = self.keys[slot[left]] == keys[left]
            self.values[slot[left[won]]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def slot(self, keys):
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift  # the top bits depend on the whole key

    def find(self, keys):
        """(value, found) per key."""
        slot = self.slot(keys)
        there = self.keys[slot]
        found = there == keys
        out = np.where(found, self.values[slot], self.values.dtype.type(0))
        at = np.flatnonzero(~found & (there != self.EMPTY))
        slot = slot[at]
        while len(at):
            slot = (slot + np.uint64(1)) & self.mask
            there = self.keys[slot]
            hit = there == keys[at]
            out[at[hit]] = self.values[slot[hit]]
            found[at[hit]] = True
            go = ~hit & (there != self.EMPTY)
            at, slot = at[go], slot[go]
        return out, found


class Scorer:
    """log probability of packed strings under a model."""

    def __init__(self, model):
        self.m, self.depth = model, len(model["pairs"]) - 1
        self.table = self.mixtures()

    def mixtures(self):
        """Over all depths: packed pair -> log probability where its context is the deepest opened one; and the opened contexts."""
        m, keys, values = self.m, [], []
        for d, pairs in enumerate(m["pairs"]):
            c = np.searchsorted(m["ctx"][d], pairs >> np.uint64(8))
            here = m["kt"][d].astype(np.float64)
            if d:
                up = np.searchsorted(m["pairs"][d - 1], pairs & np.uint64((1 << 8 * d) - 1))
                logs = np.logaddexp(shallow[up], m["reach"][d][c] + here)  # mixture if d is the last depth
                shallow = np.logaddexp(shallow[up], m["reach"][d][c] + m["stop"][d][c] + here)
            else:
                logs, shallow = here, m["stop"][0][c] + here
            keys += [pairs | np.uint64(d << 56), m["ctx"][d] | np.uint64((d + 16) << 56)]
            values += [logs.astype(np.float32), np.zeros(len(m["ctx"][d]), dtype=np.float32)]
        return Table(np.concatenate(keys), np.concatenate(values))

    def logs(self, packed):
        """Natural log probability of the byte of each packed string after its context."""
        out, left, part = np.zeros(len(packed), dtype=np.float64), None, packed
        for d in range(self.depth, -1, -1):
            part = part & np.uint64((1 << 8 * (d + 1)) - 1)
            value, found = self.table.find(part | np.uint64(d << 56))
            if left is None:
                out[:] = value
                left = np.flatnonzero(~found)
            else:
                out[left[found]] = value[found]
                left = left[~found]
            part = part[~found]
            if not len(left):
                return out
            opened = self.table.find((part >> np.uint64(8)) | np.uint64((d + 16) << 56))[1]
            if opened.any():  # the context is known, the byte after it is new
                out[left[opened]] = self.slow(part[opened], d)
                left, part = left[~opened], part[~opened]
        out[left] = -8 * math.log(2)
        return out

    def slow(self, packed, last):
        """The mixture up to depth ``last`` for pairs that training never had at that depth."""
        total = np.full(len(packed), -np.inf)
        for d in range(last + 1):
            part = packed & np.uint64((1 << 8 * (d + 1)) - 1)
            c = np.searchsorted(self.m["ctx"][d], part >> np.uint64(8))
            k = np.minimum(np.searchsorted(self.m["pairs"][d], part), len(self.m["pairs"][d]) - 1)
            seen = self.m["pairs"][d][k] == part
            p = self.m["kt"][d][k].astype(np.float64)
            p[~seen] = self.unseen(d, part[~seen])
            total = np.logaddexp(total, self.m["reach"][d][c] + p + (self.m["stop"][d][c] if d < last else 0))
        return total

    def unseen(self, d, packed):
        """log KT probability of bytes that a context of depth ``d`` never had, from its counts."""
        out, at, node = np.zeros(len(packed)), np.arange(len(packed)), self.range(d, packed, 0)
        for bit in range(1, 9):
            inside = self.range(d, packed[at], bit)
            out[at] += np.log((inside + 0.5) / (node + 1))
            gone = inside == 0
            out[at[gone]] -= (8 - bit) * math.log(2)  # no counts below: every bit is even
            at, node = at[~gone], inside[~gone]
        return out

    def range(self, d, packed, bits):
        """Count of the context's bytes that share the first ``bits`` bits."""
        low = packed >> np.uint64(8 - bits) << np.uint64(8 - bits)
        a, b = np.searchsorted(self.m["pairs"][d], low), np.searchsorted(self.m["pairs"][d], low + np.uint64(1 << (8 - bits)))
        return self.m["cum"][d][b] - self.m["cum"][d][a]


def subtrees(found: DataFrame) -> DataFrame:
    """``(key, uses, log, context, weighted)`` from ``(key, n, uses)``: rows of strings and, with null keys, of the contexts of ``SPLIT`` bytes.

    ``log`` is relative to reaching the string's context of ``SPLIT`` bytes, nan where training lacks that.
    """
    context = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * SPLIT) - 1))

    def run(batches):
        import pyarrow as pa

        def weigh(key, n, uses):
            order = np.argsort(key)
            key, n, uses = key[order], n[order], uses[order]
            _, out, _, weighted, ctx = tree(key.view(np.uint64), n, SPLIT, DEPTH)
            none = [pa.nulls(len(key), t) for t in (pa.int64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(uses), pa.array(out), *none], names=names)
            none = [pa.nulls(len(ctx), t) for t in (pa.int64(), pa.int64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(ctx.view(np.int64)), pa.array(weighted)], names=names)

        names, held, size = ["key", "uses", "log", "context", "weighted"], [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size < PIECE:
                continue
            key, n, uses = (np.concatenate(x) for x in zip(*held))
            c = (key >> 8) & ((1 << 8 * SPLIT) - 1)
            cut = int(np.searchsorted(c, c[-1]))  # the last subtree may go on
            if cut:
                yield from weigh(key[:cut], n[:cut], uses[:cut])
            held, size = [[key[cut:], n[cut:], uses[cut:]]], 0 if not cut else size - cut
        if held and sum(len(h[0]) for h in held):
            yield from weigh(*(np.concatenate(x) for x in zip(*held)))

    dealt = found.select("key", "n", "uses").repartition(context).sortWithinPartitions(context)
    return dealt.mapInArrow(run, "key long, uses long, log double, context long, weighted double")


def upper(found: DataFrame, trees: DataFrame):
    """The contexts above ``SPLIT`` bytes: sorted pairs of depth ``SPLIT - 1`` and per pair the three logs of ``tree``."""
    top = found.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * SPLIT) - 1)).alias("pair")).agg(F.sum("n").alias("n")).toArrow()  # at most 2^24 rows
    below = (trees.where("key IS NULL").groupBy(F.col("context").bitwiseAND(F.lit((1 << 8 * (SPLIT - 1)) - 1)).alias("context"))
             .agg(F.sum("weighted").alias("weighted")).toArrow())  # at most 2^16 rows
    pairs, n = top.column(0).to_numpy(), top.column(1).to_numpy()
    order = np.argsort(pairs)
    pairs, n = pairs[order].view(np.uint64), n[order]
    if not len(pairs):
        return pairs, *[np.zeros(0)] * 3
    order = np.argsort(below.column(0).to_numpy())  # the same contexts as those of the pairs
    acc, out, going, _, _ = tree(pairs, n, 0, SPLIT - 1, below.column(1).to_numpy()[order])
    return pairs, acc, np.where(np.isnan(out), -8 * math.log(2), out), going


def log_probabilities(spark, found: DataFrame) -> DataFrame:
    """``(key, uses, log)``: the natural log probability of the last byte of each packed string after its context, from written ``(key, n, uses)``."""
    trees = written(subtrees(found), "lm-trees")
    sent = spark.sparkContext.broadcast(upper(found, trees))

    def whole(batches):
        import pyarrow as pa

        pairs, acc, out, going = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            key, log = batch.column(0).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            at = np.searchsorted(pairs, key & np.uint64((1 << 8 * SPLIT) - 1))
            log = np.where(np.isnan(log), out[at], np.logaddexp(acc[at], going[at] + log))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(log)], names=["key", "uses", "log"])

    return trees.where("key IS NOT NULL").select("key", "uses", "log").mapInArrow(whole, "key long, uses long, log double")


def frequent(table: DataFrame, count_col: str, most: int) -> int:
    """The smallest exponent so that at most ``most`` rows count 2^exponent or more."""
    sizes = table.groupBy(F.floor(F.log2(count_col)).cast("int").alias("e")).count().collect()  # at most 64 rows
    exponent = 0
    while sum(r["count"] for r in sizes if r["e"] >= exponent) > most:
        exponent += 1
    return exponent


def score_documents(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", max_entries: int = MAX_ENTRIES,
                    max_words: int = MAX_WORDS) -> DataFrame:
    """Adds ``n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte`` to the columns but the text.

    ``training`` is a boolean Column over ``docs``; texts for which it holds are learned from.
    """
    spark = docs.sparkSession
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]
    docs, text_name = docs.withColumn("__training", training), text_col
    carried = Carried(docs, names)
    docs, text_col, training = carried.df, carried[text_col], F.col(carried["__training"])
    small_batches(docs)
    counts = written(corpus_counts(docs.select(text_col, training.alias("__learn")), text_col, "__learn"), "lm-counts")
    strings = counts.where("kind = 1")
    table = log_probabilities(spark, strings)
    least = 1 << frequent(strings, "uses", max_entries)
    often = table.where(F.col("uses") >= least).select("key", "log").toArrow()  # at most max_entries rows
    words = counts.where("kind = 0")
    total = {r["kind"]: (r["n"], r["distinct"]) for r in counts.where("kind != 1").groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")).collect()}
    ends = total.get(2, (0, 0))[0]
    n_train, vocabulary = total.get(0, (0, 0))[0] + ends, total.get(0, (0, 0))[1] + (ends > 0)
    base_log = math.log10(n_train + vocabulary + 1)
    exponent = frequent(words, "n", max_words)
    common = words.where(F.col("n") >= 1 << exponent).select("key", "n").toArrow()  # at most max_words rows
    keys, n = common.column(0).to_numpy().view(np.uint64), common.column(1).to_numpy()
    order = np.argsort(keys)
    sent = spark.sparkContext.broadcast((often.column(0).to_numpy().view(np.uint64), often.column(1).to_numpy(), keys[order], np.log10(n[order] + 1.0)))
    base = docs.drop(text_col)
    kept = base.columns
    state: dict = {}

    def left_over(keys, hit, owner, rows):
        """The keys without a hit, and where those of each row start."""
        return keys[~hit].view(np.int64), np.concatenate([[0], np.cumsum(np.bincount(owner[~hit], minlength=rows))])

    def score(batches):
        import pyarrow as pa

        def lists(found):
            flat = np.concatenate([g for g, _ in found]) if found else np.zeros(0, dtype=np.int64)
            bounds, at = [0], 0
            for g, w in found:
                bounds += (w[1:] + at).tolist()
                at += len(g)
            return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))

        for batch in batches:
            if "s" not in state:
                strings, probabilities, k, logs = sent.value
                state["s"] = (Table(strings, probabilities), WordHashes(), Table(k, logs))
            model, hashes, known = state["s"]
            data, offs = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            cols = [[] for _ in range(5)]
            misses, strays = [], []
            for a, b in text_groups(offs, 1 << 18):
                part, o = data[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
                full, at, text = framed(part, o)
                packed = grams(full, at)
                logs, hit = model.find(packed)
                cols[0].append(np.bincount(text, weights=logs, minlength=b - a) / math.log(10))
                strays.append(left_over(packed, hit, text, b - a))
                cols[1].append(np.diff(o))
                h, n_words = hashes.of(part, o)
                owner = np.repeat(np.arange(b - a), n_words)
                word_logs, hit = known.find(h)
                cols[2].append(n_words)
                cols[3].append(np.bincount(owner[hit], minlength=b - a))
                cols[4].append(np.bincount(owner[hit], weights=word_logs[hit], minlength=b - a))
                misses.append(left_over(h, hit, owner, b - a))
            c = [np.concatenate(x) if x else np.zeros(0) for x in cols]
            new = [pa.array(c[0], pa.float64()), pa.array(c[1].astype(np.int64)), pa.array(c[2].astype(np.int64)), pa.array(c[3].astype(np.int64)), pa.array(c[4], pa.float64()), lists(misses), lists(strays)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(x)) for x in kept], *new], names=[*kept, "score", "n_bytes", "__words", "__known", "__logs", "__rare", "__strings"])

    fields = [T.StructField("score", T.DoubleType()), T.StructField("n_bytes", T.LongType()), T.StructField("__words", T.LongType()), T.StructField("__known", T.LongType()),
              T.StructField("__logs", T.DoubleType()), T.StructField("__rare", T.ArrayType(T.LongType())), T.StructField("__strings", T.ArrayType(T.LongType()))]
    rows = docs.mapInArrow(score, T.StructType([*base.schema.fields, *fields]))
    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()), "lm-rows")  # written: the row numbers stay
    rest = words.where(F.col("n") < 1 << exponent).select(F.col("key").alias("__key"), F.col("n").alias("__n"))
    used = rows.select("__row", F.explode("__rare").alias("__key")).groupBy("__row", "__key").agg(F.count(F.lit(1)).alias("__tf"))
    sums = used.join(rest, "__key").groupBy("__row").agg(F.sum("__tf").alias("__more"), F.sum(F.col("__tf") * F.log10(F.col("__n") + 1)).alias("__more_logs"))
    uncommon = table.where(F.col("uses") < least).select(F.col("key").alias("__key"), "log")
    stray = rows.select("__row", F.explode("__strings").alias("__key")).join(uncommon, "__key").groupBy("__row").agg(F.sum("log").alias("__more_score"))
    n_tokens = F.col("__words") + 1
    known = F.col("__known") + F.coalesce("__more", F.lit(0)) + F.lit(int(ends > 0))
    logs = F.col("__logs") + F.coalesce("__more_logs", F.lit(0.0)) + F.lit(math.log10(ends + 1))
    rows = rows.drop("__rare", "__strings").join(sums, "__row", "left").join(stray, "__row", "left")
    rows = rows.withColumn("score", F.col("score") + F.coalesce("__more_score", F.lit(0.0)) / math.log(10))
    return rows.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carried.names) if c not in (text_name, "__training")], n_tokens.alias("n_tokens"), known.cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (logs - n_tokens * F.lit(base_log)).alias("base_score"), "score", "n_bytes",
        (-F.col("score") * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


def op8_lm_score(spark, sf_dir):
    """Scores of all ``documents``; those whose crc32(doc_id) mod 7 is not 2 are learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    out = score_documents(docs.withColumn("held_out", held), ~held)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
