"""Near-duplicate documents by an n-gram Jaccard join with prefix, length, positional and suffix filters.

A document's set is its distinct word shingles (A-Z lower-cased). Two documents
link when ``100 * |x & y| >= percent * |x | y|``. Documents with equal sets form one
class at once, and only classes are joined:

1. Order. Shingles that tasks see often are counted and the most frequent
   (bounded) ones go out with their level, so every document sorts its shingles
   rare-first: by level, then by hash. Any total order is right; this one keeps
   common passages out of the prefixes.
2. Prefixes. Two linked sets share a shingle among their first
   ``n - ceil(t n) + 1``, and the shorter one has it among its first
   ``n - ceil(2t/(1+t) n) + 1``, its index prefix. Two Bloom filters over the prefix shingles of one document a class drop
   those of one class only, the second (over what passes the first) also those that are in no index prefix; the
   rest are the postings, joined on the shingle.
3. Filters. Length (``n_x >= t n_y``), position (shingles left after the match
   must still suffice) and suffix: the shingles are dealt into cells by hash (as
   many as shingles, ``CELLS`` at least, a power of two), and the number of cells whose counts
   differ in parity is a lower bound for the symmetric difference.
4. Verification. A pair that passes is verified once on its whole sets: the set of the class
   with fewer pairs travels to the one with more, which is copied once for every ``SPLIT`` pairs.

Pairs within a group are not listed: a first round compares every class with
two leaders of each of its posting lists, and the components of the links found
are taken. Further rounds compare it with two more leaders, drawn anew for every list, if they
are of another component, until a round finds no link. Only pairs of a posting
list that lie in different components after that are listed, so nothing is
missed and a group of near copies costs a few pairs per member and round. The postings
are dealt by shingle once and stored in buckets; no round shuffles them again.

Defined cases: a text with fewer words than a shingle is one shingle; an empty or null
text has an empty set and no links; rows with one id and different texts are
different members; a null id counts for linking, and a component's id is its
smallest non-null one; an empty table gives an empty result. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.llm.bloom import contains, filter_bits, twice_filter
from rankspark.llm.components import components
from rankspark.llm.frames import Carried, bucketed, forget, small_batches, written
from rankspark.llm.hashing import SPACE, Poly, byte_values, mix64, text_bytes, text_groups, tokens
from rankspark.llm.lm_score import Counter

SHINGLE = 5
PERCENT = 80
#: Fewest cells of the suffix filter; longer sets have as many as shingles, up to the next power of two.
CELLS = 2048
#: Pairs of one class that a task verifies together; a class with more has its set copied to several.
SPLIT = 256
#: A task reports shingles that it sees in so many documents; the most frequent MAX_COMMON are broadcast.
LOCAL_DOCS = 4
MAX_COMMON = 1 << 19
#: Ids up to this number (24 bytes each) are broadcast to fetch sets, more are joined by a shuffle.
MAX_FETCH = 1 << 20
#: At most so many rounds with fresh leaders, before the remaining pairs are compared.
LEADER_ROUNDS = 1
#: Up to so many classes with a link (32 bytes each) their components are broadcast, more are joined by a shuffle.
MAX_LABELS = 1 << 20


def needed(n_sum, percent):
    """Smallest intersection of two linked sets whose sizes add up to ``n_sum``."""
    return -(-percent * n_sum // (100 + percent))


class Shingles:
    """Hashed shingle sets of a batch of texts."""

    def __init__(self, size=SHINGLE):
        self.size, self.poly, self.value, self.grams = size, Poly(41), byte_values(41, True), Poly(42)

    def sets(self, column):
        """(row, sorted distinct uint64 shingles) of every text with words."""
        data, offs = text_bytes(column)
        for a, b in text_groups(offs):
            (h,), counts = tokens(data[offs[a]:offs[b]], offs[a:b + 1] - offs[a], SPACE, [self.poly], [self.value])
            w = self.grams.windows(h, self.size)
            first = 0
            for i, n in enumerate(counts.tolist()):
                if n >= self.size:
                    s = np.sort(w[first:first + n - self.size + 1])
                    yield a + i, s[np.concatenate([[True], s[1:] != s[:-1]])]
                elif n:
                    yield a + i, self.grams.windows(h[first:first + n], n) ^ np.uint64(n)
                first += n


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def class_key(shingles):
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def cell_parity(shingles):
    n = max(CELLS, 1 << (len(shingles) - 1).bit_length())
    cells = (mix64(shingles ^ np.uint64(0xA5A5)) & np.uint64(n - 1)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=n) & 1).astype(np.uint8)).tobytes()


def cells_apart(x: bytes, y: bytes) -> int:
    """Cells that differ in parity; the one with more cells is folded to the other's number."""
    x, y = sorted((x, y), key=len)
    x, y = (np.frombuffer(c, dtype="<u8") for c in (x, y))
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


SIG = ("s0", "s1", "s2", "s3")


def fold(cells):
    """The parities of 256 cells (every 256th together) as four numbers."""
    return np.bitwise_xor.reduce(np.frombuffer(cells, dtype="<i8").reshape(-1, len(SIG)), axis=0)


def common_shingles(texts: DataFrame, size: int):
    """Sorted hashes and levels (floor log2 of the documents seen) of the most frequent shingles."""
    def count(batches):
        import pyarrow as pa

        def rows(found):
            k, n = (x[found[1] >= LOCAL_DOCS] for x in found)
            for i in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[i:i + 100_000].view(np.int64)), pa.array(n[i:i + 100_000].astype(np.int64))], names=["k", "n"])

        counter, cut = Counter(), Shingles(size)
        for batch in batches:
            for _, s in cut.sets(batch.column(0)):
                found = counter.add(s)
                if found:
                    yield from rows(found)
        yield from rows(counter.fold() or counter.take())

    found = written(texts.mapInArrow(count, "k long, n long").groupBy("k").agg(F.floor(F.log2(F.sum("n"))).cast("int").alias("level")), "jaccard-common")
    sizes = {r["level"]: r["count"] for r in found.groupBy("level").count().collect()}  # at most 64 rows
    level = 0
    while sum(c for e, c in sizes.items() if e >= level) > MAX_COMMON:
        level += 1
    top = found.where(F.col("level") >= level).toArrow()  # at most MAX_COMMON rows
    k, n = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(k)
    return k[order], n[order].astype(np.int8)


def prefixes(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Per document ``__id, __text (hash), n, cls, prefix, cells, s0..s3``; written."""
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(common_shingles(docs.select(text_col), size))
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__text"), F.col(text_col).alias("__whole"))

    def run(batches):
        import pyarrow as pa

        known, levels = common.value
        bits = np.zeros(1 << 20, dtype=bool)
        bits[known >> np.uint64(44)] = True
        cut = Shingles(size)
        for batch in batches:
            n = [0] * batch.num_rows
            cls, pre, cells = [None] * len(n), [None] * len(n), [None] * len(n)
            for row, s in cut.sets(_column(batch, "__whole")):
                take = len(s) - -(-percent * len(s) // 100) + 1
                n[row], cls[row], cells[row] = len(s), class_key(s), cell_parity(s)
                maybe = np.flatnonzero(bits[s >> np.uint64(44)])
                if len(maybe):
                    k = np.minimum(np.searchsorted(known, s[maybe]), len(known) - 1)
                    hit = known[k] == s[maybe]
                    level = np.zeros(len(s), dtype=np.int8)
                    level[maybe[hit]] = levels[k[hit]]
                    pre[row] = s[np.argsort(level, kind="stable")[:take]].tobytes()
                else:
                    pre[row] = s[:take].tobytes()
            sig = np.array([[0] * len(SIG) if c is None else fold(c) for c in cells], dtype=np.int64).reshape(-1, len(SIG))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(pre, pa.binary()), pa.array(cells, pa.binary()),
                                              *[pa.array(sig[:, i]) for i in range(len(SIG))]],
                                             names=["__id", "__text", "n", "cls", "prefix", "cells", *SIG])

    schema = T.StructType([rows.schema["__id"], rows.schema["__text"], T.StructField("n", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("cls", "prefix", "cells")], *[T.StructField(c, T.LongType()) for c in SIG]])
    return written(rows.mapInArrow(run, schema), "jaccard-prefixes")


def one_a_class(full: DataFrame, classes: DataFrame) -> DataFrame:
    """The row of each class that ``classes`` names: copies need no postings of their own.

    Rows equal in id and text all stay. Rows are dealt, and then written, only if the classes with copies are too many to broadcast.
    """
    many = classes.where("rows > 1").select(F.col("cls").alias("__c"), F.col("__id").alias("__i"), F.col("__text").alias("__t"))
    named = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__text") == F.col("__t"))
    few = many.count() <= MAX_FETCH
    one = full.join(F.broadcast(many) if few else many, F.col("cls") == F.col("__c"), "left").where(F.col("__c").isNull() | named).select(*full.columns)
    return one if few else written(one, "jaccard-one")


def postings(rows: DataFrame, total: int, percent: int) -> DataFrame:
    """``(token, cls, n, pos, s0..s3)`` of prefix shingles that more than one class has, one of them in its index prefix."""
    bits = filter_bits(total)
    held = rows.select("cls", "n", "prefix")

    def sets_of(batch):
        seen = set()
        for cls, n, pre in zip(*[_column(batch, c).to_pylist() for c in ("cls", "n", "prefix")]):
            if cls is not None and cls not in seen:
                seen.add(cls)
                yield np.frombuffer(pre, dtype=np.uint64), n - -(-2 * percent * n // (100 + percent)) + 1

    first = twice_filter(held, lambda batch: (s for s, _ in sets_of(batch)), bits)

    def passing(batch):
        for s, index in sets_of(batch):
            ok = contains(np.frombuffer(first.value, dtype=np.uint8), s, bits)
            yield tuple(mix64(x[k]) for x, k in ((s[:index], ok[:index]), (s[index:], ok[index:])))

    # a second filter, at other places and of the keys that pass the first only: few keys of one class pass both
    second = twice_filter(held, passing, bits)

    def emit(batches):
        import pyarrow as pa

        seen, again = (np.frombuffer(x.value, dtype=np.uint8) for x in (first, second))
        for batch in batches:
            tok, at, row, done = [], [], [], set()
            for i, (cls, pre) in enumerate(zip(_column(batch, "cls").to_pylist(), _column(batch, "prefix").to_pylist())):
                if cls is None or cls in done:
                    continue
                done.add(cls)
                s = np.frombuffer(pre, dtype=np.uint64)
                k = np.flatnonzero(contains(seen, s, bits))
                k = k[contains(again, mix64(s[k]), bits)]
                if len(k):
                    tok.append(s[k])
                    at.append(k)
                    row.append(np.full(len(k), i))
            if tok:
                r = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tok).view(np.int64)), _column(batch, "cls").take(r), _column(batch, "n").take(r), pa.array(np.concatenate(at).astype(np.int32)), *[_column(batch, c).take(r) for c in SIG]],
                                                 names=["token", "cls", "n", "pos", *SIG])

    found = rows.select("cls", "n", "prefix", *SIG).mapInArrow(emit, "token long, cls binary, n long, pos int, s0 long, s1 long, s2 long, s3 long")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.repartition(n, "token").groupBy("token", "cls").agg(F.max("n").alias("n"), F.min("pos").alias("pos"), *[F.max(c).alias(c) for c in SIG])
    return bucketed(found, "jaccard-postings", "token")


def passes(percent, other="l"):
    """Length, positional and 256-cell filter of two classes that meet at ``pos`` of ``n`` shingles; the other's columns begin with ``other``."""
    na, nb = F.col("n"), F.col(f"{other}n")
    least = F.ceil(F.lit(percent) * (na + nb) / F.lit(100 + percent))
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{other}{c}"))) for c in SIG), F.lit(0))
    return ((F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (F.least(na - F.col("pos"), nb - F.col(f"{other}pos")) >= least)
            & (apart <= na + nb - 2 * least))


def pair(a, na, b, nb):
    """Columns of a pair with the smaller class key first."""
    return [F.when(a < b, a).otherwise(b).alias("a"), F.when(a < b, na).otherwise(nb).alias("na"),
            F.when(a < b, b).otherwise(a).alias("b"), F.when(a < b, nb).otherwise(na).alias("nb")]


def with_components(posts: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Postings with ``comp``, the class's component (itself, if it has no link yet)."""
    if labels is None:
        return posts.withColumn("comp", F.col("cls"))
    labels = labels.withColumnRenamed("node", "cls")
    if labels.count() <= MAX_LABELS:
        labels = F.broadcast(labels)  # the postings stay in their buckets
    return posts.join(labels, "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")


def leader_pairs(posts: DataFrame, labels: DataFrame | None, percent: int, salt: int) -> DataFrame:
    """Candidate pairs of classes with two leaders of each posting list, in other components: two at most per posting.

    The first round's leaders are the first classes in two orders by hash, the same in all lists, so that few
    different pairs arise; later rounds draw others in every list.
    """
    p = with_components(posts, labels)
    carried = ("cls", "n", "pos", *SIG, "comp")
    seeds = [("cls", F.lit(i)) if labels is None else ("cls", "token", F.lit(2 * salt + i)) for i in (0, 1)]
    firsts = [F.min(F.struct(F.xxhash64(*x).alias("o"), *carried)).alias(f"l{i}") for i, x in enumerate(seeds)]
    lead = p.groupBy("token").agg(*firsts, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
    lead = lead.select("token", F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"{x}.{y}") for y in carried]) for x in ("l0", "l1")]))).alias("l"))
    lead = lead.select("token", *[F.col(f"l.{c}").alias(f"l{c}") for c in carried])
    j = p.join(lead, "token").where((F.col("comp") != F.col("lcomp")) & passes(percent))
    return j.select(*pair(F.col("cls"), F.col("n"), F.col("lcls"), F.col("ln"))).distinct()


def rest_pairs(posts: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs of posting lists whose classes lie in different components."""
    p = with_components(posts, labels)
    mixed = p.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("token")
    p = p.join(mixed, "token", "left_semi")
    index = F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / F.lit(100 + percent))
    x = p.where(F.col("pos") <= index).select("token", *[F.col(c).alias(f"l{c}") for c in ("cls", "n", "pos", *SIG, "comp")])
    on = (F.col("ln") < F.col("n")) | ((F.col("ln") == F.col("n")) & (F.col("lcls") < F.col("cls")))
    j = p.join(x, "token").where(on & (F.col("comp") != F.col("lcomp")) & passes(percent))
    return j.select(*pair(F.col("cls"), F.col("n"), F.col("lcls"), F.col("ln"))).distinct()


def bounded(df: DataFrame) -> DataFrame:
    """A written table of keys: broadcast up to ``MAX_FETCH`` rows, so that the large side need not move."""
    return F.broadcast(df) if df.count() <= MAX_FETCH else df


def members(pairs: DataFrame) -> DataFrame:
    """``(cls)`` of all classes in some pairs."""
    return written(pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct(), "jaccard-members")


def suffix_filter(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs whose cells leave a large enough intersection possible; ``rows``: one a class (or some equal ones)."""
    cells = rows.select("cls", "cells").join(bounded(members(pairs)), "cls", "left_semi").groupBy("cls").agg(F.first("cells").alias("cells"))
    j = (pairs.join(cells.select(F.col("cls").alias("a"), F.col("cells").alias("ca")), "a")
         .join(cells.select(F.col("cls").alias("b"), F.col("cells").alias("cb")), "b").select("a", "na", "b", "nb", "ca", "cb"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (batch.column(i).to_pylist() for i in (4, 5))
            apart = np.zeros(len(x), dtype=np.int64)
            short = np.array([len(p) == len(q) == CELLS // 8 for p, q in zip(x, y)])
            if short.any():
                p, q = (np.frombuffer(b"".join(z[i] for i in np.flatnonzero(short)), dtype="<u8").reshape(-1, CELLS // 64) for z in (x, y))
                apart[short] = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64)
            for i in np.flatnonzero(~short).tolist():
                apart[i] = cells_apart(x[i], y[i])
            both = batch.column(1).to_numpy() + batch.column(3).to_numpy()
            keep = apart <= both - 2 * needed(both, percent)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep))

    return j.mapInArrow(run, "a binary, na long, b binary, nb long")


def whole_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(cls, set)`` (8 bytes a shingle) of the rows named in ``wanted`` (``cls, __id, __text``), one row a class; written."""
    wanted = written(wanted, "jaccard-wanted")
    keys, classes = wanted.select("__id", "__text").distinct(), wanted.count()
    if classes <= MAX_FETCH:  # distinct rows are no more
        keys = F.broadcast(keys)
    rows = docs.select(F.col(id_col).alias("__i"), F.col(text_col).alias("__whole"))
    rows = rows.join(keys, rows["__i"].eqNullSafe(keys["__id"]) & (F.xxhash64(rows["__whole"]) == keys["__text"]), "left_semi")

    def run(batches):
        import pyarrow as pa

        cut, seen = Shingles(size), set()
        for batch in batches:
            out = []
            for _, s in cut.sets(batch.column(0)):
                key = class_key(s)
                if key not in seen:
                    seen.add(key)
                    out.append((key, s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.binary()) for i in (0, 1)], names=["cls", "set"])

    sets = written(rows.select("__whole").mapInArrow(run, "cls binary, set binary"), "jaccard-sets")
    if sets.count() != classes:  # rows equal in id and text, met by several tasks
        sets = written(sets.dropDuplicates(["cls"]), "jaccard-sets")
    return sets


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, ``(a, b)``."""
    often = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count(F.lit(1)).alias("d"))
    often = bounded(written(often, "jaccard-often"))
    p = (pairs.select("a", "b").join(often.select(F.col("cls").alias("a"), F.col("d").alias("da")), "a")
         .join(often.select(F.col("cls").alias("b"), F.col("d").alias("db")), "b"))
    first = F.col("da") >= F.col("db")
    p = p.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"),
                 F.ceil(F.greatest("da", "db") / SPLIT).alias("parts"))
    p = written(p.withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))), "jaccard-split")
    travel = bounded(p.select("a", "b", "part")).join(sets.select(F.col("cls").alias("b"), F.col("set").alias("sb")), "b")
    stay = (sets.select(F.col("cls").alias("a"), F.col("set").alias("sa")).join(bounded(written(p.select("a", "parts").distinct(), "jaccard-stay")), "a")
            .select("a", "sa", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")))
    j = travel.join(stay.hint("merge"), ["a", "part"]).select("a", "b", "sa", "sb")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = np.sort(np.concatenate([x, y]))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return j.mapInArrow(run, "a binary, b binary")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document ``id, __text (hash of the text), n_shingles, component_id`` (smallest id reachable by links)."""
    return linked(docs, id_col, text_col, size, percent).drop("__component")


def linked(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``link_documents`` with ``__component``: one class key for all linked documents, null for an empty set."""
    small_batches(docs)
    rows = prefixes(docs, id_col, text_col, size, percent)
    full = rows.where(F.col("n") > 0)
    # one row per class, with the row that its set, prefix and cells are taken from
    classes = written(full.groupBy("cls").agg(F.min(F.struct("__id", "__text")).alias("r"), F.min("__id").alias("least"), F.count(F.lit(1)).alias("rows"))
                      .select("cls", "least", "r.__id", "r.__text", "rows"), "jaccard-classes")
    one = one_a_class(full, classes)
    total = one.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    posts = postings(one, total // 8, percent)
    tested = labels = None
    rounds = 0
    while True:
        last = rounds > LEADER_ROUNDS
        found = rest_pairs(posts, labels, percent) if last else leader_pairs(posts, labels, percent, rounds)
        if tested is not None:
            found = found.join(tested, ["a", "b"], "left_anti").select("a", "na", "b", "nb")
        found = written(found, "jaccard-pairs")
        tested = found.select("a", "b") if tested is None else tested.unionAll(found.select("a", "b"))
        likely = written(suffix_filter(found, one, percent), "jaccard-likely")
        rounds += 1
        new = None
        if labels is None or not likely.isEmpty():
            wanted = classes.select("cls", "__id", "__text").join(bounded(members(likely)), "cls", "left_semi")
            sets = whole_sets(docs, wanted, id_col, text_col, size)
            new = written(verify(likely, sets, percent), "jaccard-links")
        if labels is None or (new is not None and not new.isEmpty()):
            # links of earlier rounds are already in the labels: only their components are joined up further
            links = new if labels is None else new.unionAll(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
            labels = written(components(links), "jaccard-labels")
        elif not last:
            rounds = LEADER_ROUNDS + 1  # leaders find nothing more: what is left is compared in full
        if last:
            break
    forget(posts)
    owned = classes.select("cls", "least").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = owned.groupBy("component").agg(F.min("least").alias("component_id"))
    owned = owned.join(least, "component").select("cls", "component", "component_id")
    out = rows.select("__id", "__text", "n", "cls").join(owned, "cls", "left")
    return out.select(F.col("__id").alias(id_col), "__text", F.col("n").alias("n_shingles"), F.coalesce("component_id", F.col("__id")).alias("component_id"),
                      F.col("component").alias("__component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One document of each linked group, by smallest id (null last) and text hash; documents without words all stay."""
    carried = Carried(docs)
    docs, id_col, text_col = carried.df, carried[id_col], carried[text_col]
    groups = linked(docs, id_col, text_col, **kw).where(F.col("__component").isNotNull())
    rows = written(groups.groupBy("__component", F.col(id_col).alias("__id"), "__text").agg(F.count(F.lit(1)).alias("__rows")), "jaccard-rows")
    first = rows.groupBy("__component").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__text", "__rows")).alias("f"), F.sum("__rows").alias("all"))
    first = written(first.where("all > 1").select("__component", F.col("f.__id").alias("__first"), F.col("f.__text").alias("__first_text"), F.col("f.__rows").alias("__same")), "jaccard-first")
    # the rows to drop are named, not those to keep: texts stay where they are while the dropped ones can be broadcast
    others = rows.join(bounded(first), "__component").where(~(F.col("__id").eqNullSafe(F.col("__first")) & (F.col("__text") == F.col("__first_text"))))
    out = unnamed(docs, written(others.select("__id", "__text"), "jaccard-dropped"), id_col, text_col)
    same = first.where("__same > 1").select(F.col("__first").alias("__id"), F.col("__first_text").alias("__text"))
    if not same.isEmpty():  # rows equal in id and text: the first one by its other columns, picked in each task first
        by = F.to_json(F.struct(*[c for c in docs.columns if c != text_col]))
        one = unnamed(out, same, id_col, text_col, "left_semi").groupBy(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__text"))
        one = one.agg(F.min_by(F.struct(*docs.columns), by).alias("__r")).select("__r.*")
        out = unnamed(out, same, id_col, text_col).unionAll(one)
    return carried.restore(out)


def unnamed(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, how: str = "left_anti") -> DataFrame:
    """The rows whose id and text hash are not (``left_semi``: are) in the written table ``keys``."""
    keys = bounded(keys)
    return docs.join(keys, docs[id_col].eqNullSafe(keys["__id"]) & (F.xxhash64(docs[text_col]) == keys["__text"]), how)


def op9_jaccard_join(spark, sf_dir):
    """Near-duplicate components of all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return link_documents(docs).drop("__text")


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
cuts AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM cuts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(least(l.b, d.doc_id), d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id"""
