"""Language ID, line dedup, fingerprints, decontamination, scoring: brute force and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankspark.llm import decontaminate, fingerprint, language_id, line_dedup, lm_score
from tests.conftest import SF_SMALL
from tests.llm.helpers import ascii_lower, frame, words


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# -- language ID

def test_language_id_held_out_accuracy_and_fields(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = language_id.op1_language_id(spark, SF_SMALL).collect()
    assert len(out) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_language_id_never_learns_from_held_out_rows(spark):
    rows = [(i, "aaa bbb abab" if i % 2 else "zzz yyy zyzy", "x" if i % 2 else "y") for i in range(80)]
    rows = [(i, t, "wrong" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    model = language_id.train_on(frame(spark, rows))
    assert model["labels"] == ["x", "y"]


def test_language_id_odd_texts(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(40)]
    model = language_id.train_on(frame(spark, rows))
    odd = [(100, None), (101, ""), (102, "12 34 !!"), (103, "the dog " * 40_000), (104, "\U0001F600 \U00010428 der hund"), (104, "the cat"), (None, "die katze")]
    got = {(r["doc_id"], r["text"]): r for r in language_id.identify(frame(spark, odd), model).collect()}
    assert len(got) == len(odd)
    for key in odd[:3]:
        assert (got[key]["lang_pred"], got[key]["score"], got[key]["rejected"]) == ("und", 0.0, True)
    assert got[odd[3]]["lang_pred"] == "en" and got[odd[6]]["lang_pred"] == "de" and got[odd[5]]["lang_pred"] == "en"
    assert got[odd[3]]["cls"] == "c"
    assert language_id.train_on(frame(spark, [])) is None
    assert language_id.identify(frame(spark, odd), None).select("lang_pred").distinct().collect()[0][0] == "und"


def test_language_id_learns_every_label_and_repeated_rows_once(spark):
    docs = spark.createDataFrame([(i, f"{chr(0x4e00 + i % 300) * 4} {chr(0x4e00 + i % 300)}{i}", f"l{i % 300}") for i in range(1200)], "doc_id long, text string, lang string")
    found = language_id.sample_counts(docs, "doc_id", "text", "lang", F.lit(True), 400)
    assert len(found) == 300 and {r[0] for r in found} == {f"l{i}" for i in range(300)}
    with pytest.raises(ValueError):
        language_id.sample_counts(docs, "doc_id", "text", "lang", F.lit(True), 200)
    hot = spark.range(6000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, "same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"),
                                   F.lit("en").alias("lang"))
    assert 300 < len(language_id.sample_counts(hot, "doc_id", "text", "lang", F.lit(True), 400)) <= 400


def test_language_id_threshold_needs_enough_texts_and_no_model_keeps_texts(spark):
    rows = [(x, np.array([i % 2 + 2 * (i % 3)], dtype=np.uint16), np.ones(1, dtype=np.float32)) for i, x in enumerate("ab" * 60)]
    assert language_id.train(rows, epochs=1)["threshold"] == 0.0
    assert language_id.train(rows, epochs=1, alpha=0.5)["threshold"] > 0.0
    out = language_id.identify(frame(spark, [(1, "words"), (2, None), (3, "12 !")]), language_id.train([]))
    assert {r["doc_id"]: r["rejected"] for r in out.collect()} == {1: False, 2: True, 3: True}


def test_subwords_of_a_batch_do_not_cross_texts():
    cut = language_id.Subwords()

    def grams(texts):
        out = {}
        for a, _, parts in cut.groups(pa.array(texts, pa.string())):
            for own, bucket in parts:
                for t, b in zip(own.tolist(), bucket.tolist()):
                    out.setdefault(a + t, Counter())[b] += 1
        return out

    texts = ["Abc dé", "", "x", "ab9cd", None]
    together = grams(texts)
    for i, t in enumerate(texts):
        assert together.get(i) == grams([t]).get(0)
    assert grams(["ABC"]) == grams(["abc"])
    # boundary-a-b-boundary: a, b, _a, ab, b_, _ab, ab_, _ab_
    assert sum(grams(["ab"])[0].values()) == 8


# -- line dedup

def brute_lines(rows, least=10):
    holders = {}
    key = lambda line: ascii_lower(line.strip(" \t\n\v\f\r"))
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (i is not None and len(holders.get(key(x), ())) > 1 and min(holders[key(x)]) < i)]
        out.append((i, "\n".join(kept) if t else t or "", len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_line_dedup_brute_force(spark):
    rng = random.Random(3)
    pool = ["short", "A line that repeats", "  a LINE that repeats\t", "Ünïcode länge zehn", "ÜNÏCODE länge zehn", "exactly 10", "nine char", "", "\x0b\x0c", "another line, quite long " * 40]
    rows = [(i, "\n".join(rng.choice(pool) + (str(rng.random()) if rng.random() < 0.4 else "") for _ in range(rng.randrange(6)))) for i in range(60)]
    rows += [(None, "A line that repeats"), (60, None), (61, ""), (62, "\n\n"), (5, "A line that repeats"), (5, "A line that repeats"), (63, "x" * 200_000 + "\nA line that repeats")]
    out = line_dedup.dedup_lines(frame(spark, rows))
    assert set(out.columns) >= {"__id", "cls", "d", "n", "lang"}
    assert rows_of(out, "doc_id", "text", "n_lines", "n_dropped") == brute_lines(rows)


def test_line_dedup_empty(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


# -- fingerprints

def brute_phrases(text):
    seen, cur = set(), ""
    for c in text:
        cur += c
        if cur not in seen:
            seen.add(cur)
            cur = ""
    return seen | ({cur} if cur else set())


def test_parse_gives_the_phrases_of_the_textbook_loop():
    rng = random.Random(1)
    for n in (0, 1, 5, 200):
        t = "".join(rng.choice("abé") for _ in range(n))
        ends = fingerprint.parse(t)
        assert {t[a:b] for a, b in zip([0, *ends], ends)} == brute_phrases(t)


@pytest.mark.parametrize("ranges", [1, 4])
def test_neighbours_brute_force(spark, ranges):
    rng = random.Random(2)
    rows = [(i * 3, "".join(rng.choice("abcdé ") for _ in range(rng.randrange(80)))) for i in range(30)]
    rows += [(200, None), (201, ""), (202, "same"), (202, "same"), (202, "other"), (None, "no id"), (204, "xy" * 20_000)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    signer = fingerprint.Signer()
    want = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        a, b, c = (signer.sign(x, fingerprint.parse(x)) for x in (t, edited, nxt))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.to_hex(a), fingerprint.to_hex(b), fingerprint.likeness(a, b), fingerprint.likeness(a, c)))
    out = fingerprint.neighbours(frame(spark, rows), ranges=ranges)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_fingerprint_likeness(spark):
    assert fingerprint.neighbours(frame(spark, [])).count() == 0
    one = fingerprint.neighbours(frame(spark, [(1, "abcabcabc")])).first()
    assert one["near_next"] == 1.0
    out = fingerprint.op3_fingerprint(spark, SF_SMALL)
    r = out.agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n"), F.count("*").alias("c"), F.countDistinct("doc_id").alias("d")).first()
    assert r["e"] > 2 * r["n"] and r["c"] == r["d"] == 200
    prints = dict(fingerprint.fingerprint_texts(frame(spark, [(1, "a b c d"), (2, "a b c d"), (3, None)])).select("doc_id", "fingerprint").collect())
    assert prints[1] == prints[2] != prints[3] and set(prints[3]) == {"0"}
    assert fingerprint.to_hex(fingerprint.from_hex(prints[1])) == prints[1]


# -- decontamination

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(rows, items, size=10):
    windows = {}
    for item, t in items:
        w = ALNUM.findall(ascii_lower(t or ""))
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + k]), set()).add("" if item is None else str(item))
    out = []
    for i, t in rows:
        w, hit, names = ALNUM.findall(ascii_lower(t or "")), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in windows:
                    hit |= set(range(a, a + n))
                    names |= windows[tuple(w[a:a + n])]
        out.append((i, len(w), len(hit), sorted(names)))
    return sorted(out, key=repr)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "solo"), (3, ""), (4, None), (5, "née été 42"), (None, "no name here"), (1, "a b a b a b a b a b a b"), (10, "...")]
TEXTS = [(1, "x ONE two, three four five six seven eight nine ten eleven y"), (2, "solo! and\tsolo"), (3, None), (4, ""), (5, "NÉE née été 42"), (5, "plain text"), (None, "no-name here"),
         (6, "a b " * 12), (7, "clean " * 30_000 + "two three four five six seven eight nine ten eleven twelve"), (8, "one two three four five six seven eight nine"), (9, "plain")]


@pytest.mark.parametrize("block", [32 << 20, 200])
def test_contamination_brute_force(spark, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.find_contamination(frame(spark, TEXTS), items, max_block_bytes=block)
    assert rows_of(found, "doc_id", "n_words", "n_hit", "items") == brute_hits(TEXTS, ITEMS)


def test_decontaminate_modes(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = frame(spark, TEXTS).withColumn("N_hit", F.lit("mine"))
    clean = decontaminate.decontaminate(docs, items)
    assert clean.columns == docs.columns and clean.first()["N_hit"] == "mine"
    hits = brute_hits(TEXTS, ITEMS)
    assert clean.count() == sum(h[2] == 0 for h in hits)
    spans = decontaminate.decontaminate(docs, items, mode="spans")
    texts = {r["doc_id"]: r["text"] for r in spans.collect() if r["doc_id"] != 5}
    assert texts[1] == "x  y" and texts[2] == "! and\t" and texts[3] is None and texts[7] == "clean " * 30_000 and texts[9] == "plain"
    assert spans.count() == len(TEXTS)


def test_decontaminate_empty(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(frame(spark, TEXTS), items).count() == len(TEXTS)
    assert decontaminate.decontaminate(frame(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


# -- language-model scoring

def brute_base(rows, held):
    count = Counter()
    tok = lambda t: [*words(t, True), None]
    for i, t in rows:
        if not held(i):
            count.update(tok(t))
    n, v = sum(count.values()), len(count)
    return sorted(((i, len(tok(t)), sum(count[w] > 0 for w in tok(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tok(t)), 8)) for i, t in rows), key=repr)


@pytest.mark.parametrize("limits", [{}, {"max_words": 3, "max_entries": 200}])
def test_scores_of_a_small_corpus(spark, limits):
    rng = random.Random(4)
    vocab = ["The", "the", "cat", "été", "naïve x", "dog", "Zz9", " "]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(12)))) for i in range(60)]
    rows += [(60, None), (61, ""), (5, "the cat"), (5, "the cat"), (None, "dog dog"), (62, "new words here"), (63, "the cat " * 20_000)]
    docs = frame(spark, rows)
    held = F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False))
    out = lm_score.score_documents(docs, ~held, **limits)
    assert {"cls", "d", "lang"} <= set(out.columns)
    got = sorted(map(tuple, out.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score").collect()), key=repr)
    want = brute_base(rows, lambda i: i is not None and i % 7 == 2)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert all(abs(a[4] - b[4]) <= 1e-9 * abs(b[4]) + 1e-7 for a, b in zip(got, want))
    scores = {(r["doc_id"], r["n_tokens"]): r["score"] for r in out.collect()}
    assert all(s < 0 for s in scores.values()) and scores[(63, 40_001)] / 40_001 > -0.2


def level_counts(data, depth):
    table = {}
    full = bytes([lm_score.EDGE] * depth) + data + bytes([lm_score.EDGE])
    for i in range(depth, len(full)):
        for d in range(depth + 1):
            key = 0
            for b in full[i - d:i + 1]:
                key = key << 8 | b
            table.setdefault(d, Counter())[key] += 1
    return [(np.array(sorted(t), dtype=np.uint64), np.array([t[k] for k in sorted(t)], dtype=np.int64)) for _, t in sorted(table.items())]


def kt(zeros, ones):
    """log of the sequential KT probability."""
    return sum(math.log(k + 0.5) for k in range(zeros)) + sum(math.log(k + 0.5) for k in range(ones)) - sum(math.log(k + 1) for k in range(zeros + ones))


def brute_probability(levels, context, byte):
    """Mixture of the KT estimates along a context path, from the definition."""
    tables = [dict(zip(k.tolist(), n.tolist())) for k, n in levels]

    def counts(d, ctx):
        return {k & 255: n for k, n in tables[d].items() if k >> 8 == ctx}

    def nodes(c):
        for bit in range(8):
            for top in {b >> (8 - bit) for b in c}:
                yield [sum(n for b, n in c.items() if b >> (7 - bit) == (top << 1 | x)) for x in (0, 1)]

    def block(d, ctx):
        return sum(kt(*x) for x in nodes(counts(d, ctx)))

    def weighted(d, ctx):
        if d == len(levels) - 1:
            return block(d, ctx)
        kids = {k >> 8 for k in tables[d + 1] if (k >> 8) & ((1 << 8 * d) - 1) == ctx}
        return np.logaddexp(math.log(0.5) + block(d, ctx), math.log(0.5) + sum(weighted(d + 1, k) for k in kids))

    total, reach = 0.0, 1.0
    for d in range(len(levels)):
        ctx = 0
        for b in context[len(context) - d:]:
            ctx = ctx << 8 | b
        c = counts(d, ctx)
        p = 1.0
        for bit in range(8):
            inside = sum(n for b, n in c.items() if b >> (7 - bit) == byte >> (7 - bit))
            node = sum(n for b, n in c.items() if b >> (8 - bit) == byte >> (8 - bit))
            p *= (inside + 0.5) / (node + 1)
        nxt = None
        if d + 1 < len(levels):
            k = 0
            for b in context[len(context) - d - 1:]:
                k = k << 8 | b
            nxt = counts(d + 1, k) or None
        if nxt is None:
            return total + reach * p
        stop = math.exp(math.log(0.5) + block(d, ctx) - weighted(d, ctx))
        total += reach * stop * p
        reach *= 1 - stop


def test_context_tree_equals_the_definition_and_sums_to_one():
    levels = level_counts(b"abracadabra abracad abba", 2)
    scorer = lm_score.Scorer(lm_score.build_model(levels))
    for context in (b"ab", b"ra", b"zz", b"za", bytes([lm_score.EDGE] * 2)):
        packed = np.array([context[0] << 16 | context[1] << 8 | b for b in range(256)], dtype=np.uint64)
        p = np.exp(scorer.logs(packed))
        assert abs(p.sum() - 1) < 1e-5
        for b in b"abrz\x00\xff":
            assert abs(p[b] - brute_probability(levels, context, b)) < 1e-5 * max(p[b], 1e-3)


@pytest.mark.parametrize("limits", [{}, {"max_entries": 5}])
def test_scores_do_not_depend_on_the_broadcast_bound(spark, monkeypatch, limits):
    monkeypatch.setattr(lm_score, "PIECE", 50)
    rng = random.Random(6)
    learn = [" ".join(rng.choice(["abra", "Cada", "bra", "é", "x1"]) for _ in range(rng.randrange(9))) for _ in range(12)]
    held = ["abra cada zebra", "ö", "", "quite other words"]
    rows = [(i * 2, t) for i, t in enumerate(learn)] + [(i * 2 + 1, t) for i, t in enumerate(held)]
    counts = [Counter() for _ in range(lm_score.DEPTH + 1)]
    for t in learn:
        for table, (keys, n) in zip(counts, level_counts(ascii_lower(t).encode(), lm_score.DEPTH)):
            table.update(dict(zip(keys.tolist(), n.tolist())))
    levels = [(np.array(sorted(t), dtype=np.uint64), np.array([t[k] for k in sorted(t)], dtype=np.int64)) for t in counts]
    memo = {}
    want = {}
    for i, t in rows:
        full = bytes([lm_score.EDGE] * lm_score.DEPTH) + ascii_lower(t).encode() + bytes([lm_score.EDGE])
        strings = [(full[k - lm_score.DEPTH:k], full[k]) for k in range(lm_score.DEPTH, len(full))]
        for s in strings:
            if s not in memo:
                memo[s] = math.log10(brute_probability(levels, *s))
        want[i] = sum(memo[s] for s in strings)
    docs = frame(spark, rows)
    got = {r["doc_id"]: r["score"] for r in lm_score.score_documents(docs, F.col("doc_id") % 2 == 0, **limits).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) <= 1e-6 * abs(want[i]) for i in want)


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.9, 8.0, 100.5, 1e6])
    assert np.allclose(lm_score.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)


def test_scores_without_training_rows(spark):
    out = lm_score.score_documents(frame(spark, [(1, "ab"), (2, None)]), F.lit(False)).orderBy("doc_id").collect()
    assert [round(r["score"], 6) for r in out] == [round(-k * 8 * math.log10(2), 6) for k in (3, 1)]
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out] == [(2, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert lm_score.score_documents(frame(spark, []), F.lit(True)).count() == 0
