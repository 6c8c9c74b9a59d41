"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is lower-cased; everything that is not a letter is a word boundary.
Its subwords are the 1- to 4-grams of letters that reach into no second word (a
boundary may stand at either end). Each is hashed to one of ``BUCKETS``
embedding rows; the text's vector is their mean, and a linear softmax over it
gives the languages. Embeddings and softmax are trained together by mini-batch
stochastic gradient descent in numpy on a bounded sample (``SAMPLE_ROWS``
labelled documents, dealt evenly over all labels by hash order, one a label at least;
rows equal in id, label and text count once); executors
reduce each sampled text to bucket counts first. A part of the sample is kept
apart to calibrate: a temperature, then the rejection threshold, which at most
a share ``ALPHA`` of its rightly labelled texts falls short of (0 where they are too few to tell).

Prediction covers whole texts. As embeddings and softmax are linear, a worker
needs one ``BUCKETS x languages`` table.

Defined cases: a null text, or one without letters, is ``und`` with score 0 and
rejected; with nothing to learn from every text is ``und`` and only those without letters
are rejected; an empty table gives an empty result, repeated rows equal ones; rows whose id is
null are never learned from and not held out; more labels than ``SAMPLE_ROWS`` are an error; ``lang_pred, score, rejected``
replace input columns of these names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.llm.frames import map_rows
from rankspark.llm.hashing import mix64, text_bytes, text_groups

BUCKETS = 1 << 15
DIM = 16
MAX_GRAM = 4
SAMPLE_ROWS = 6000
EPOCHS = 6
MIN_STEPS = 300
BATCH = 64
RATE = 6.0
ALPHA = 0.001
MAX_THRESHOLD = 0.4
SEGMENT = 1 << 20
UND = "und"


def held_out(id_col: Column, parts: int = 4) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % parts == 2, F.lit(False))


def letter_tables():
    """Lower-case code point (0: not a letter) of every code point of the basic plane."""
    low = np.zeros(1 << 16, dtype=np.uint64)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            x = ch.lower()
            low[c] = ord(x) if len(x) == 1 else c
    return low


class Subwords:
    """Hashed subwords of a batch of texts."""

    def __init__(self, max_gram=MAX_GRAM, buckets=BUCKETS):
        self.low, self.max_gram, self.shift = letter_tables(), max_gram, np.uint64(64 - (buckets - 1).bit_length())
        self.keys = mix64(np.arange(2 * max_gram, dtype=np.uint64) + np.uint64(99)) | np.uint64(1)

    def letters(self, data):
        cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        x = self.low[np.minimum(cp, 0xFFFF)]
        for c in np.unique(cp[cp > 0xFFFF]):
            x[cp == c] = ord(chr(c).lower()) if chr(c).isalpha() else 0
        return x

    def groups(self, column, limit=SEGMENT):
        """Per group of rows: (first row, letters per text, iterator of (text numbers, buckets))."""
        data, offs = text_bytes(column)
        for a, b in text_groups(offs, limit):
            part, o = data[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
            chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[o]
            x = self.letters(part)
            text = np.repeat(np.arange(b - a), np.diff(chars))
            y = np.zeros(len(x) + 2 * (b - a), dtype=np.uint64)  # a boundary before and after each text
            at = np.arange(len(x)) + 2 * text + 1
            y[at] = x
            owner = np.repeat(np.arange(b - a), np.diff(chars) + 2)
            letters = np.bincount(text[x != 0], minlength=b - a)
            yield a, letters, self.grams(y, owner)

    def grams(self, y, owner):
        for s in range(0, len(y), SEGMENT):
            seg = y[s:s + SEGMENT + self.max_gram - 1]
            n, own = min(SEGMENT, len(y) - s), owner[s:s + SEGMENT]
            h = np.zeros(len(seg), dtype=np.uint64)
            inner = np.ones(len(seg), dtype=bool)
            for g in range(1, self.max_gram + 1):
                if len(seg) < g:
                    break
                h = h[:len(seg) - g + 1] + seg[g - 1:] * self.keys[g - 1]
                if g == 1:
                    ok = seg != 0
                elif g == 2:
                    ok = (seg[:-1] != 0) | (seg[1:] != 0)
                else:
                    inner = inner[:len(seg) - g + 1] & (seg[g - 2:len(seg) - 1] != 0)
                    ok = inner
                ok = np.flatnonzero(ok[:n])
                yield own[ok], (mix64(h[ok] + self.keys[self.max_gram + g - 1]) >> self.shift).astype(np.int64)


def sample_counts(docs: DataFrame, id_col, text_col, label_col, learn: Column, rows: int) -> list:
    """Bucket counts of at most ``rows`` labelled texts: ``[(label, buckets, shares)]``."""
    keys = ["__id", "__label", "__hash"]
    known = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    texts = known.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"), F.xxhash64(text_col).alias("__hash"), F.col(text_col).alias("__text"))
    usable = known.where(learn).select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"), F.xxhash64(text_col).alias("__hash"))
    order = F.xxhash64(F.col("__id").cast("string"), "__hash")
    found = usable.groupBy("__label").agg(F.approx_count_distinct(order).alias("n")).limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"more than {rows} labels: raise `rows`")
    if not found:
        return []
    labels, share = {r["__label"]: max(1, r["n"]) for r in found}, rows // len(found)
    # a coarse cut by hash first: about four times the share of each label, 40 at least, is left to rank, whatever its size
    cut = F.create_map(*[F.lit(x) for k, n in sorted(labels.items()) for x in (k, min(1.0, max(4 * share, 40) / n))])[F.col("__label")]
    picked = (usable.where(F.pmod(order, F.lit(1 << 30)) <= cut * (1 << 30)).dropDuplicates(keys)
              .withColumn("__rank", F.row_number().over(Window.partitionBy("__label").orderBy(order, *keys)))
              .where(F.col("__rank") <= share).drop("__rank"))
    texts = texts.join(F.broadcast(picked), keys, "left_semi").dropDuplicates(keys).select("__id", "__label", "__text")  # at most `rows` rows

    def count(batches):
        import pyarrow as pa

        words = Subwords()
        for batch in batches:
            ids, labels, out = batch.column(0).cast(pa.string()), batch.column(1), []
            for a, letters, grams in words.groups(batch.column(2)):
                sums = {}
                for own, bucket in grams:
                    for t in np.unique(own).tolist():
                        sums[t] = sums.get(t, 0) + np.bincount(bucket[own == t], minlength=BUCKETS)
                for t, c in sums.items():
                    k = np.flatnonzero(c)
                    out.append((ids[a + t].as_py(), labels[a + t].as_py(), k.astype(np.uint16).tobytes(), (c[k] / c.sum()).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary(), pa.binary()))], names=["id", "label", "buckets", "shares"])

    found = texts.mapInArrow(count, "id string, label string, buckets binary, shares binary").collect()
    found = sorted(found, key=lambda r: (r["id"], r["label"], r["buckets"]))
    return [(r["label"], np.frombuffer(r["buckets"], dtype=np.uint16), np.frombuffer(r["shares"], dtype=np.float32)) for r in found]


def dense(rows):
    """The buckets that some of the rows have, and the rows' shares of them."""
    cols = np.unique(np.concatenate([b for _, b, _ in rows]))
    x = np.zeros((len(rows), len(cols)), dtype=np.float32)
    for i, (_, b, s) in enumerate(rows):
        x[i, np.searchsorted(cols, b)] = s
    return cols, x


def softmax(z):
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(rows: list, seed: int = 1, epochs: int = EPOCHS, alpha: float = ALPHA) -> dict | None:
    """Fit on ``sample_counts`` rows; ``{labels, table, bias, threshold}`` or None without rows."""
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    labels = sorted({r[0] for r in rows})
    order = rng.permutation(len(rows))
    kept = order[:len(rows) // 5] if len(rows) >= 60 else order[:0]
    use = order[len(kept):]
    k = len(labels)
    number = {x: i for i, x in enumerate(labels)}
    y = np.array([number[r[0]] for r in rows])
    emb = rng.normal(0, 1.0, (BUCKETS, DIM)).astype(np.float32)
    w = np.zeros((DIM, k), dtype=np.float32)
    bias = np.zeros(k, dtype=np.float32)
    per_epoch = -(-len(use) // BATCH)
    epochs = max(epochs, -(-MIN_STEPS // per_epoch))
    steps, step = epochs * per_epoch, 0
    for _ in range(epochs):
        use = rng.permutation(use)
        for i in range(0, len(use), BATCH):
            part = use[i:i + BATCH]
            cols, x = dense([rows[j] for j in part])
            hidden = x @ emb[cols]
            err = softmax(hidden @ w + bias)
            err[np.arange(len(part)), y[part]] -= 1
            err /= len(part)
            rate = np.float32(RATE * (1 - step / steps))
            back = err @ w.T
            w -= rate * (hidden.T @ err)
            bias -= rate * 0.1 * err.sum(axis=0)
            emb[cols] -= rate * 20 * (x.T @ back)
            step += 1
    table, heat, threshold = emb @ w, 1.0, 0.0
    if len(kept):
        parts = [dense([rows[j] for j in kept[i:i + 256]]) for i in range(0, len(kept), 256)]
        z = np.concatenate([x @ table[cols] for cols, x in parts]) + bias
        truth = y[kept]
        loss = {t: -np.log(softmax(z / t)[np.arange(len(kept)), truth] + 1e-12).mean() for t in np.geomspace(0.05, 20, 60)}
        heat = min(loss, key=loss.get)
        p = softmax(z / heat)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
        below = int(alpha * (len(right) + 1))  # so many at most may fall short
        if below:
            threshold = min(MAX_THRESHOLD, float(right[below - 1]))
    return {"labels": labels, "table": np.ascontiguousarray(table / heat, dtype=np.float32), "bias": (bias / heat).astype(np.float64), "threshold": threshold}


def train_on(docs: DataFrame, id_col="doc_id", text_col="text", label_col="lang", learn: Column | None = None, rows: int = SAMPLE_ROWS):
    """Fit on the documents for which ``learn`` holds (default: crc32 of the id, mod 4, is not 2)."""
    learn = (F.col(id_col).isNotNull() & ~held_out(F.col(id_col))) if learn is None else learn
    return train(sample_counts(docs, id_col, text_col, label_col, learn, rows))


def identify(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred`` (the likeliest label, or ``und``), ``score`` (its calibrated probability) and ``rejected``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def predict(batch):
        import pyarrow as pa

        if "w" not in state:
            state["w"] = Subwords()
        m = sent.value
        preds, scores, rejected = [], [], []
        limit = SEGMENT if m is None else max(1 << 16, (4 << 20) // max(4, len(m["labels"])))
        for _, letters, grams in state["w"].groups(batch.column(batch.schema.get_field_index(text_col)), limit):
            if m is None:
                preds += [UND] * len(letters)
                scores += [0.0] * len(letters)
                rejected += (letters == 0).tolist()
                continue
            sums, counts = np.zeros((len(letters), len(m["labels"]))), np.zeros(len(letters))
            for own, bucket in grams:
                if len(own):
                    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    sums[own[first]] += np.add.reduceat(m["table"][bucket], first, axis=0, dtype=np.float64)
                    counts += np.bincount(own, minlength=len(letters))
            p = softmax(sums / np.maximum(counts, 1)[:, None] + m["bias"])
            best, top, has = p.argmax(axis=1), p.max(axis=1), letters > 0
            preds += [m["labels"][i] if ok else UND for i, ok in zip(best.tolist(), has.tolist())]
            scores += np.where(has, np.round(top, 6), 0.0).tolist()
            rejected += (~has | (top < m["threshold"] - 1e-6)).tolist()
        return [pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return map_rows(docs, predict, fields)


def op1_language_id(spark, sf_dir):
    """The language of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train_on(docs)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
