"""URL rules, chat formatting, mixing, joins, substring dedup, helpers and the pipeline: brute force and odd inputs."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankspark.llm import bloom, chat_format, jaccard_join, mixing, substring_dedup, url_filter
from rankspark.llm.components import components
from tests.conftest import SF_SMALL
from tests.llm.helpers import frame, words

# -- URLs


def test_url_parts_rules_and_vocabulary(spark):
    cases = [
        (1, "http://A.Net/x?q#f", "a.net", "/x", "net/", "block"),
        (2, "https://www.example.NET/en/1", "www.example.net", "/en/1", "example.net/en/", "allow"),
        (3, "x://example.com/de/?q", "example.com", "/de/", "example.com/de/", "block"),
        (4, "http://b.org/fr/xxx/casino", "b.org", "/fr/xxx/casino", "org/fr/", "allow"),
        (5, None, "", "", None, "allow"), (6, "no scheme net/", "", "", None, "allow"), (7, "http://net", "net", "", None, "allow"),
        (8, "http://a.com/XXX-1", "a.com", "/XXX-1", None, "block"), (9, "http://a.com/xxxy", "a.com", "/xxxy", None, "allow"),
        (10, "http://a.com/free/free", "a.com", "/free/free", None, "allow"), (11, "http://a.com/free?cheap", "a.com", "/free", None, "block"),
        (12, "http://notexample.com/de/", "notexample.com", "/de/", None, "allow"), (13, "", "", "", None, "allow"),
        (14, "http://a.com?u=://b.net/", "a.com", "", None, "allow"), (15, "http://a.com/" + "free" * 50_000, "a.com", "/" + "free" * 50_000, None, "allow"),
        (15, "http://A.Net/x?q#f", "a.net", "/x", "net/", "block"),
    ]
    pages = spark.createDataFrame([(c[0], c[1], "old", "old") for c in cases], "page_id long, url string, Host string, __fit string")
    out = url_filter.judge_urls(pages.drop("__fit"))
    assert "Host" not in out.columns
    assert sorted(map(tuple, out.select("page_id", "url", "host", "path", "rule", "verdict").collect()), key=repr) == sorted(cases, key=repr)
    assert url_filter.judge_urls(pages.drop("__fit").limit(0)).count() == 0


# -- chat

CONTROL = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "\\", "<", "|>", "<\\|", "\n", "assistant\n", "é\U0001F600", "$1", "ok", ""]


def test_chat_round_trip_with_control_strings(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(80):
        for turn in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "assistant", "sys\ntem", "<|im_end|>", None])
            text = None if rng.random() < 0.1 else "".join(rng.choice(CONTROL) for _ in range(rng.randrange(6)))
            rows.append((conv, turn if rng.random() < 0.9 else None, role, text, "x"))
    rows += [(None, 1, "user", "hi", "x"), (200, 1, "assistant", "x" * 300_000, "x"), (201, 1, "user", "twice", "x"), (201, 1, "user", "twice", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string").repartition(5)
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    want = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        want[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        turns = [t[2:] for t in sorted(turns)]
        r = got[conv]
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["loss_text"] == "".join(t for role, t in turns if role == "assistant")
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert r["formatted"].count("<|im_start|>") == 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
        assert r["formatted"].count("<|im_end|>") == r["formatted"].count("<|im_start|>")
    assert chat_format.format_conversations(df.limit(0)).count() == 0


# -- mixing

def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        share = (total - sum(fixed.values())) / sum(w[s] for s in rest) if rest else 0
        over = {s: 3 * sizes[s] for s in rest if share * w[s] > 3 * sizes[s]}
        if not over:
            return {s: fixed.get(s, share * w[s]) for s in names}
        fixed |= over


def mixture(spark, monkeypatch, block):
    rng = random.Random(6)
    monkeypatch.setattr(mixing, "BLOCK_UNITS", block)
    rows = [(i, " ".join("w" for _ in range(int(rng.paretovariate(1.2)) + 1)), None, rng.choice(["a", "a", "a", "a", "b", "Ä", "c", None])) for i in range(900)]
    rows += [(1000, None, None, "a"), (1001, "", None, "empty"), (None, "one two", None, "a"), (1002, "same same", None, "b"), (1002, "same same", None, "b"), (1003, "x " * 50_000, None, "c")]
    return rows, frame(spark, rows)


@pytest.mark.parametrize("block", [50_000, 40])
def test_mixing_targets_and_totals(spark, monkeypatch, block):
    rows, docs = mixture(spark, monkeypatch, block)
    out = mixing.mix_sizes(docs).collect()
    assert len(out) == len(rows)
    source = {(r[0], len(words(r[1]))): r[3] for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    targets = brute_targets(sizes)
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-6
    taken, copies, expected = Counter(), Counter(), Counter()
    for r in out:
        s = source[(r["doc_id"], r["size"])]
        assert r["source_size"] == sizes[s] and abs(r["target"] - targets[s]) < 1e-6 * max(1, targets[s])
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        rate = targets[s] / sizes[s] if sizes[s] else 0
        if r["size"]:
            assert r["taken"] // r["size"] in (math.floor(rate + 1e-9), math.floor(rate - 1e-9), math.ceil(rate))
        taken[s] += r["taken"]
    for s in sizes:
        if s != "c":  # one document holds nearly all of c
            assert abs(taken[s] - targets[s]) <= max(3, 0.01 * targets[s])
    again = mixing.mix_sizes(docs.repartition(7)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)


def test_mixing_documents_repeat_as_often_as_taken(spark, monkeypatch):
    rows, docs = mixture(spark, monkeypatch, 50_000)
    taken = Counter()
    for r in mixing.mix_sizes(docs).where("size > 0").collect():
        taken[r["doc_id"]] += r["taken"]
    out = mixing.mix_documents(docs)
    assert set(out.columns) == {*docs.columns, "copy"}
    got = Counter()
    for r in out.select("doc_id", "text").collect():
        got[r["doc_id"]] += len(words(r["text"]))
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in got.items() if v}
    assert mixing.mix_documents(frame(spark, [])).count() == 0 and mixing.mix_sizes(frame(spark, [])).count() == 0


def test_flight_keeps_words_and_documents_and_probabilities():
    hits = np.zeros(40)
    for seed in range(400):
        f = mixing.Flight(str(seed))
        units = [[0.3, 1, 1 + (7 * i) % 11, i] for i in range(40)]
        done = [u for x in units for u in f.push(x)]
        for j, exact in ((1, 12.0), (2, 0.3 * sum(1 + (7 * i) % 11 for i in range(40)))):
            assert abs(sum(u[0] * u[j] for u in done + f.pool) - exact) < 1e-6
        assert len(f.pool) <= 2 and all(u[0] in (0.0, 1.0) for u in done)
        for u in done + f.pool:
            hits[u[3]] += u[0]
    assert abs(hits / 400 - 0.3).max() < 0.12


# -- Jaccard join

def shingles(text, size=5):
    w = words(text, True)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in least[root(i)] if x is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return sorted(out, key=repr)


def near_rows(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    hot = [rng.choice(vocab) for _ in range(40)]
    rows, base = [], []
    for i in range(40):
        text = [rng.choice(vocab) for _ in range(rng.randrange(1, 120))]
        base.append(text)
        rows.append((i, " ".join(text + (hot if i % 3 == 0 else []))))
    for i in range(40, 160):  # copies of copies with few edits: similarities on both sides of the threshold
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            text[rng.randrange(len(text))] = rng.choice(vocab)
        if rng.random() < 0.3:
            text = text + hot[:rng.randrange(40)]
        base.append(text)
        rows.append((i, " ".join(text).upper() if i % 7 == 0 else "\t ".join(text)))
    rows += [(500, None), (501, ""), (502, "one two"), (503, "ONE  two"), (504, "one two three"), (505, " \n"), (7, "again the same id but another text here"),
             (None, rows[3][1]), (None, "only null ids have this text for once"), (506, rows[5][1]), (506, rows[5][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard_join, "LOCAL_DOCS", 2)
    rows = near_rows(seed)
    out = jaccard_join.link_documents(frame(spark, rows)).drop("__text")
    assert sorted(map(tuple, out.collect()), key=repr) == brute_components(rows)


@pytest.mark.parametrize("split", [1, 3])
def test_jaccard_of_long_sets_in_cells_of_several_numbers(spark, monkeypatch, split):
    monkeypatch.setattr(jaccard_join, "SPLIT", split)
    rng = random.Random(split)
    base = [f"x{rng.randrange(10**9)}" for _ in range(4300)]
    rows = []
    for i in range(24):  # around 4096 shingles, where the number of cells doubles; cut, or with words changed, at and off the limit
        text = base[:rng.choice([3440, 3600, 4095, 4100, 4300])]
        for at in rng.sample(range(len(text)), rng.choice([0, 5, 80, 95, 400])):
            text = text[:at] + [f"y{rng.random()}"] + text[at + 1:]
        rows.append((i, " ".join(text)))
    rows += [(40, rows[3][1]), (3, rows[3][1])]
    out = jaccard_join.link_documents(frame(spark, rows)).drop("__text")
    assert sorted(map(tuple, out.collect()), key=repr) == brute_components(rows)


def test_cell_parity_never_overstates_the_difference():
    rng = np.random.default_rng(4)
    for n, m in [(1, 1), (900, 1000), (2040, 2060), (4000, 4200), (9000, 7500), (70_000, 60_000)]:
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        y = np.concatenate([x[:min(n, m) * 9 // 10], rng.integers(0, 1 << 63, m - min(n, m) * 9 // 10, dtype=np.uint64)])
        apart = jaccard_join.cells_apart(jaccard_join.cell_parity(x), jaccard_join.cell_parity(y))
        assert apart <= len(np.setxor1d(x, y)) and (n < 100 or apart > 0.25 * len(np.setxor1d(x, y)))
        assert (jaccard_join.fold(jaccard_join.cell_parity(x)) == jaccard_join.fold(jaccard_join.cell_parity(np.flip(x)))).all()


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_jaccard_deals_no_postings_of_copies_and_none_out_of_reach(spark, monkeypatch, bound):
    monkeypatch.setattr(jaccard_join, "MAX_FETCH", bound)
    found, dealt = [], jaccard_join.postings

    def postings(*args):
        found.append((args[0].collect(), dealt(*args)))
        return found[-1][1]

    monkeypatch.setattr(jaccard_join, "postings", postings)
    monkeypatch.setattr(jaccard_join, "forget", lambda posts: None)
    rows = [(i, " ".join(f"copy{j}" for j in range(200))) for i in range(30)] + [(100 + i, " ".join(f"own{i}x{j}" for j in range(200))) for i in range(30)]
    jaccard_join.link_documents(frame(spark, rows).repartition(5))
    base = [f"z{j}" for j in range(300)]
    near = [(200 + i, " ".join(base[:150] + [f"e{i % 4}"] + base[151:])) for i in range(6)]
    out = jaccard_join.link_documents(frame(spark, rows + near).repartition(5)).drop("__text")
    assert sorted(map(tuple, out.collect()), key=repr) == brute_components(rows + near)
    (one, alone), (_, posts) = found
    assert len({r["cls"] for r in one}) == len(one) == 31 and alone.count() == 0  # a class is not joined with itself
    lists = defaultdict(list)
    for r in posts.collect():
        lists[r["token"]].append(r["pos"] <= r["n"] - math.ceil(160 * r["n"] / 180))
    assert lists and all(len(x) > 1 and any(x) for x in lists.values())
    for _, p in found:
        monkeypatch.undo()
        jaccard_join.forget(p)


def test_jaccard_keeps_one_of_each_group(spark):
    rows = [r for r in near_rows(3) if r[0] is not None]
    kept = jaccard_join.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted({r["doc_id"] for r in kept.collect()}) == sorted({c for _, _, c in brute_components(rows)})
    # two components may have one smallest id (texts of one id): groups are counted as components, rows without words on their own
    grouped = jaccard_join.linked(frame(spark, rows), "doc_id", "text")
    wordless = sum(not (t or "").strip() for _, t in rows)
    assert kept.count() == grouped.where(F.col("__component").isNotNull()).select("__component").distinct().count() + wordless
    same = [(9, "one and the same row of text here", lang) for lang in ("b", "a", None, "a")]
    assert [r["lang"] for r in jaccard_join.keep_one(frame(spark, same)).collect()] in (["a"], [None]) and len({
        jaccard_join.keep_one(frame(spark, same).repartition(i)).first()["lang"] for i in (1, 2, 3)}) == 1
    assert jaccard_join.link_documents(frame(spark, [])).count() == 0 and jaccard_join.keep_one(frame(spark, [])).count() == 0


def test_jaccard_keeps_unrelated_rows_without_id_or_of_one_id(spark):
    rows = [(None, "alpha beta gamma delta epsilon zeta"), (None, "one two three four five six seven"), (None, "One two three four five six seven"),
            (1, "some text of its own under one id"), (1, "quite another text under that same id"), (1, "quite another text under that same id"),
            (2, "one two three four five six seven"), (None, None), (None, ""), (3, " "), (3, None)]
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard_join.keep_one(frame(spark, rows)).collect()), key=repr)
    assert kept == sorted([rows[i] for i in (0, 3, 4, 6, 7, 8, 9, 10)], key=repr)


def test_jaccard_keep_one_moves_no_text_while_dropped_rows_fit(spark, monkeypatch):
    rows = [r for r in near_rows(3) if r[0] is not None] + [(900 + i, f"an extra text told apart by number {i} at its very end") for i in range(3)]
    rows += rows[:4]

    def kept():
        out = jaccard_join.keep_one(frame(spark, rows))
        return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr), out._jdf.queryExecution().toString()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found, plan = kept()
        monkeypatch.setattr(jaccard_join, "MAX_FETCH", 0)
        assert kept()[0] == found  # past the bound: by a shuffle
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and len(found) < len(rows)


def thue_morse(n, a, b):
    """Two strings of n letters that collide under every polynomial modulo 2^64 from n = 1024 on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_strings_that_collide_under_polynomials_are_told_apart(spark):
    from rankspark.llm import line_dedup, substring_dedup

    x, y = thue_morse(2048, "a", "b")
    kept = line_dedup.dedup_lines(frame(spark, [(1, x), (2, y), (3, x.upper())])).collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {1: x, 2: y, 3: ""}
    rest = " ".join(f"w{i}" for i in range(40))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link_documents(frame(spark, [(1, x), (2, y), (3, f"{x} {rest}"), (4, f"{x.upper()} {rest}")])).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3}
    tail = " ".join(f"v{i}" for i in range(34))
    out = substring_dedup.dedup_passages(frame(spark, [(1, f"{x} {tail}"), (2, f"{y} {tail} end"), (3, f"{x} {tail} other")])).collect()
    assert {r["doc_id"]: r["n_removed"] for r in out} == {1: 35, 2: 0, 3: 35}


def test_components_of_a_chain_and_a_star(spark):
    rng = random.Random(8)
    names = list(range(300))
    rng.shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(149)] + [(names[200], names[i]) for i in range(201, 300)] + [(5000, 5001), (5001, 5000), (6000, 6000)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    chain, star = names[:150], names[200:300]
    assert {got[x] for x in chain} == {min(chain)} and {got[x] for x in star} == {min(star)} and got[5001] == got[5000] == 5000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- substring dedup

def brute_passages(rows, size=35):
    seen = Counter()
    for _, t in rows:
        w = words(t)
        seen.update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                gone |= set(range(i, i + size))
        out.append((d, " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chars", [1 << 20, 300])
def test_passages_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(substring_dedup, "AUTOMATON_CHARS", chars)
    monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", 16)
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(200)] + ["é", "Ü", "\xa0x"]
    long = [rng.choice(vocab) for _ in range(300)]
    rows = []
    for i in range(50):
        a, n = rng.randrange(250), rng.randrange(20, 90)
        rows.append((i, " ".join([rng.choice(vocab) for _ in range(rng.randrange(60))] + long[a:a + n] + [rng.choice(vocab) for _ in range(rng.randrange(60))])))
    rows += [(100, None), (101, ""), (102, "a " * 36), (103, "a " * 35), (104, "b " * 35), (105, "b c " * 40), (106, "same row " + " ".join(vocab[:60])), (106, "same row " + " ".join(vocab[:60])),
             (107, "\n".join(vocab[:60])), (None, " ".join(long[100:150])), (108, " ".join(long[100:134])), (109, "\t" + "  ".join(f"u{i}" for i in range(30_000)))]
    out = substring_dedup.dedup_passages(frame(spark, rows))
    assert {"__id", "key", "n"} - set(out.columns) == set()
    assert sorted(map(tuple, out.select("doc_id", "text", "n_words", "n_removed").collect()), key=repr) == brute_passages(rows)


def test_passages_empty(spark):
    assert substring_dedup.dedup_passages(frame(spark, [])).count() == 0


# -- helpers

def test_twice_filter_has_no_false_negatives(spark):
    df = spark.range(0, 40_000, numPartitions=70).select((F.col("id") % 30_000).alias("k"))
    bits = bloom.filter_bits(30_000)

    def keys_of(batch):
        yield bloom.np.asarray(batch.column(0)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    sent = bloom.twice_filter(df, keys_of, bits)
    keys = np.arange(30_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hit = bloom.contains(np.frombuffer(sent.value, dtype=np.uint8), keys, bits)
    assert hit[:10_000].all() and hit[10_000:].mean() < 0.05


def test_filter_of_keys_met_beside_others(spark):
    df = spark.range(0, 6000, numPartitions=70).select((F.col("id") % 5000).alias("k"), (F.col("id") % 5000 >= 2500).alias("beside"))
    bits, mult = bloom.filter_bits(6000), np.uint64(0x9E3779B97F4A7C15)

    def keys_of(batch):
        k = batch.column(0).to_numpy().astype(np.uint64) * mult
        at = batch.column(1).to_numpy(zero_copy_only=False)
        yield k[~at], np.concatenate([k[at], k[~at & (k % np.uint64(2) == 0)]])

    sent = bloom.twice_filter(df, keys_of, bits)
    k = np.arange(5000, dtype=np.uint64) * mult
    hit = bloom.contains(np.frombuffer(sent.value, dtype=np.uint8), k, bits)
    due = (np.arange(5000) < 2500) & ((np.arange(5000) < 1000) | (k % np.uint64(2) == 0))
    assert hit[due].all() and hit[~due].mean() < 0.02


@pytest.mark.parametrize("share", [0, 1e-5, 0.002, 0.02, 0.3, 1])
def test_packed_slices_come_back(share):
    bits = np.packbits(np.random.default_rng(3).random(bloom.SLICE_BITS) < share, bitorder="little")
    data = bloom.packed(bits)
    assert (bloom.unpacked(data) == bits).all() and bloom.unpacked(bloom.packed(None)) is None
    entropy = 0 if share in (0, 1) else -(share * math.log2(share) + (1 - share) * math.log2(1 - share))
    assert len(data) < 1.25 * bloom.SLICE_BITS / 8 * entropy + 700  # deflated bytes of sparse bits took 1.7 times that and more


# -- pipeline

def test_pipeline_stages_have_their_effect(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    from tests.llm.test_text_operators import brute_hits, brute_lines

    before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    cur = docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_copies", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, cur, SF_SMALL).cache()
        after = [tuple(r) for r in out.select("doc_id", "text").collect()]
        if name == "language_id":
            assert len(after) >= 0.98 * len(before) and set(after) <= set(before)
        elif name == "line_dedup":
            assert sorted(after, key=repr) == sorted(((d, t) for d, t, _, _ in brute_lines(before)), key=repr)
        elif name == "near_copies":
            assert sorted(d for d, _ in after) == sorted({c for _, _, c in brute_components(before)})
        elif name == "decontamination":
            assert sorted(d for d, _ in after) == sorted(d for d, _, n, _ in brute_hits(before, bench) if not n)
        if name != "mixing":
            assert out.columns == docs.columns
        cur, before = out, after
    assert {d for d, _ in before} <= {r["doc_id"] for r in docs.select("doc_id").collect()} and "copy" in cur.columns
