"""Fill-in-the-middle, ranked search, personal data: brute force, round trips, odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankspark.llm import fill_middle, lexical_search, personal_data
from rankspark.llm.hashing import Poly, byte_values
from tests.conftest import SF_SMALL
from tests.llm.helpers import ascii_lower, frame

ODD = [(1, None), (2, ""), (3, "\n"), (4, "one line"), (5, "a\nb\n\nc"), (5, "a\nb\n\nc"), (None, "x\ny\n"), (7, "has <M> mark\nb"), (8, "ä\n\U0001F600\n" * 30_000), (9, "<\nS>\n<P\n>")]


# -- fill in the middle

def formed(doc_id, text, rate=100, spm_share=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm_share:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate,share", [(100, 50), (40, 0)])
def test_fill_middle_equals_brute_force_and_comes_back(spark, rate, share):
    rng = random.Random(3)
    rows = ODD + [(100 + i, "".join(rng.choice("ab\n<>PSMé") for _ in range(rng.randint(0, 40)))) for i in range(300)]
    out = fill_middle.restore(fill_middle.fill_middle(frame(spark, rows), rate=rate, spm_share=share)).collect()
    got = Counter((r["doc_id"], r["text"], r["n_units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out)
    assert got == Counter((i, t, *formed(i, t, rate, share)) for i, t in rows)
    assert all(r["restored"] == (r["text"] or "") and r["cls"] == "c" for r in out)
    assert len({r["form"] for r in out}) == (3 if share else 2)


def test_fill_middle_clashing_names_other_marks_and_empty_table(spark):
    docs = frame(spark, [(1, "x y z")]).withColumnRenamed("cls", "Output").withColumnRenamed("key", "__h")
    out = fill_middle.fill_middle(docs, sep=" ", marks=fill_middle.Marks("[pre]", "[suf]", "[mid]"))
    assert out.columns.count("output") == 1 and "Output" not in out.columns and "__h" in out.columns
    assert out.first()["output"].count("[mid]") == 1 and out.first()["n_units"] == 3
    assert fill_middle.restore(fill_middle.fill_middle(frame(spark, []))).count() == 0
    for bad in (("", "b", "c"), ("aa", "b", "c"), ("ab", "bc", "x"), ("abc", "b", "x"), ("q", "q", "x")):
        with pytest.raises(ValueError):
            fill_middle.Marks(*bad)


# -- ranked lexical search

def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def best(docs, items, k=10):
    rows = [(i, Counter(terms(t))) for i, t in docs]
    full = [c for _, c in rows if c]
    n_docs, length = len(full), sum(sum(c.values()) for c in full)
    df = Counter(t for c in full for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault("" if item is None else str(item), Counter()).update(terms(text))
    out = {}
    for item, q in wanted.items():
        scored = []
        for i, c in rows:
            m = 25 + 75 * sum(c.values()) * n_docs // length if length else 25
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, n in q.items() if c[t])
            if s > 0 and i is not None:
                scored.append((-s, i))
        for r, (s, i) in enumerate(sorted(scored)[:k]):
            out[item, r + 1] = (i, -s)
    return out


def found(df):
    return {(r["item"], r["rank"]): (r["id"], r["score"]) for r in df.collect()}


def test_search_equals_brute_force_with_ties_repeats_and_odd_rows(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(60)] + ["Über", "x" * 300, "\U0001F600"]
    docs = [(i, " ".join(rng.choices(vocab[:rng.choice((5, 30, 63))], k=rng.randint(0, 80)))) for i in range(400)]
    docs += [(1000 + i, docs[i % 7][1]) for i in range(40)] + [(1000, docs[0][1]), (None, "w1 w2 rare"), (2000, None), (2001, "..!"), (2002, "w1 " * 50_000 + "lonely")]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 12)))) for i in range(25)]
    items += [(3, "w1 w1 W1"), (100, None), (101, "absent words"), (None, "lonely rare"), (102, docs[0][1])]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("bound", F.lit(1))
    got = found(lexical_search.search(frame(spark, docs), table))
    assert got == best(docs, items)
    assert found(lexical_search.search(frame(spark, docs), table, k=3, max_block_bytes=2000)) == best(docs, items, 3)


def test_search_bounds_are_never_too_low_and_leave_most_out(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text")
    wanted = lexical_search.item_terms(items)
    weighted, totals = lexical_search.weighted_terms(docs, wanted)
    block = {}
    for r in weighted.collect():
        block.setdefault(r["item"], []).append((r["term"], r["qtf"], r["weight"]))
    index = lexical_search.signatures(docs)
    bounds = lexical_search._bounds(index, block, totals, lexical_search._reaching({}), docs.schema["doc_id"].dataType)
    exact = lexical_search.exact_scores(bounds.select("item", "id"), docs, block, totals, "doc_id", "text")
    both = bounds.join(exact, ["item", "id"])
    slack = both.select((F.col("bound") - F.col("score")).alias("d"), (F.col("bound") / F.col("score")).alias("q"))
    low, mean = slack.agg(F.min("d"), F.avg("q")).first()
    assert low >= 0 and mean < 1.2


def test_search_of_empty_tables(spark):
    nothing, one = frame(spark, []), frame(spark, [(1, "a b")])
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(nothing, items).count() == 0
    assert lexical_search.search(one, items.limit(0)).count() == 0
    assert found(lexical_search.search(one, items)) == best([(1, "a b")], [(1, "a")])


# -- personal data

def naive(text):
    out = []
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            d = [int(c) for c in m.group() if c.isdigit()]
            checks = (lambda: True, lambda: all(int(x) <= 255 for x in m.group().split(".")),
                      lambda: 13 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0, lambda: 9 <= len(d) <= 15)
            if checks[k]():
                out.append((k, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("12.34@@ab-+ ()0%.5é") for _ in range(rng.randint(0, 60)))
        assert personal_data.base_spans(text) == naive(text)
    assert len(personal_data.base_spans("4111111111111111 " + "1" * 200_000 + "a" * 200_000 + "+" + " " * 200_000)) == 0
    assert personal_data.base_spans("0" * 9000 + "1.2.3.4") == [(1, 0, 9007)]


def test_random_field_finds_held_out_forms():
    rows = personal_data.labelled_rows(600, seed=99)
    found = personal_data.find_spans(pa.array([t for t, _ in rows]), personal_data.default_model(), (Poly(61), byte_values(61, True)))
    hit = wrong = missed = 0
    for (_, gold), (_, spans) in zip(rows, found):
        a, b = set(gold), {(personal_data.KINDS[k], s, e) for k, s, e in spans}
        hit, wrong, missed = hit + len(a & b), wrong + len(b - a), missed + len(a - b)
    assert hit / (hit + missed) > 0.9 and hit / (hit + wrong) > 0.9


def test_viterbi_and_marginals_equal_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    trans = personal_data._allowed() + rng.normal(size=(personal_data.N_LABELS + 1, personal_data.N_LABELS))
    scores, size = rng.normal(size=(3, 4, personal_data.N_LABELS)), [4, 1, 3]
    mask = np.arange(4) < np.array(size)[:, None]
    path, (z, p, _) = personal_data.viterbi(scores, mask, trans), personal_data.marginals(scores, mask, trans)
    for c, t in enumerate(size):
        ways = {}
        for way in itertools.product(range(personal_data.N_LABELS), repeat=t):
            ways[way] = trans[-1, way[0]] + sum(scores[c, i, x] for i, x in enumerate(way)) + sum(trans[a, b] for a, b in zip(way, way[1:]))
        assert tuple(path[c, :t]) == max(ways, key=ways.get)
        total = sum(math.exp(v) for v in ways.values())
        assert z[c] == pytest.approx(math.log(total))
        assert p[c, 0, 1] == pytest.approx(sum(math.exp(v) for w, v in ways.items() if w[0] == 1) / total)


def test_find_personal_odd_rows_and_redaction(spark):
    rows = [(1, None), (2, ""), (3, "é mail anna.k@mail3.example.com or call (743) 555-3824 ."), (3, "é mail anna.k@mail3.example.com or call (743) 555-3824 ."),
            (None, "on 2024-05-06 at 12:30, 3 dot 4"), (5, "plain words only"), (6, "tel +1 (578) 555-6437 4918187128635271 end"), (7, "x 1 " * 20_000 + "\n10.0.0.7")]
    out = personal_data.find_personal(frame(spark, rows).withColumnRenamed("key", "Spans")).collect()
    assert len(out) == len(rows) and all("Spans" not in r.asDict() for r in out)
    by_text = {r["text"]: r for r in out}
    plain = [by_text[rows[i][1]] for i in (0, 1, 4, 5)]
    assert all(not r["base_spans"] and not r["spans"] for r in plain)
    both = [tuple(s) for s in by_text[rows[2][1]]["spans"]]
    assert both == [("email", 7, 31), ("phone", 40, 54)] and len(by_text[rows[2][1]]["base_spans"]) == 1
    assert [s["kind"] for s in by_text[rows[6][1]]["spans"]] == ["card", "phone"]
    assert [tuple(s) for s in by_text[rows[7][1]]["spans"]] == [("ip", 80_001, 80_009)]
    clean = {r["text"] for r in personal_data.redact(frame(spark, rows)).collect()}
    assert "é mail <email> or call <phone> ." in clean and "tel <phone> <card> end" in clean
    assert personal_data.find_personal(frame(spark, [])).count() == 0


def test_train_on_a_labelled_table(spark):
    rows = [(t, [tuple(s) for s in spans]) for t, spans in personal_data.labelled_rows(150, seed=2)] + [(None, None), ("no spans", None)]
    table = spark.createDataFrame(rows, "text string, spans array<struct<kind:string,start:long,end:long>>")
    model = personal_data.train_on(table, max_rows=100)
    assert model["weights"].shape[1] == personal_data.N_LABELS
    personal_data.find_personal(frame(spark, [(1, "a@b.org")]), model).collect()
    personal_data.train([])


def test_op13_equals_the_patterns_on_whole_tables(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    out = {r["doc_id"]: r for r in personal_data.op13_personal_data(spark, SF_SMALL).collect()}
    assert len(out) == len(docs)
    for r in docs:
        base = naive(r["text"] or "")
        listed = ",".join(f"{personal_data.KINDS[k]}:{s}:{e}" for k, s, e in base)
        got = out[r["doc_id"]]
        assert got["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [got[f"n_{k}"] for k in personal_data.KINDS] == [sum(x[0] == i for x in base) for i in range(4)]
        assert set(listed.split(",") if listed else []) <= set(got["spans"].split(","))
