"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

Base spans follow fixed patterns for e-mail addresses, IP addresses, card numbers
(Luhn) and phone numbers. The random field adds spans that people write in other
forms: ``anna (at) mail [dot] org``, ``(743) 555 3824``, ``192[.]0[.]2[.]7``, a card
number with dots. It labels tokens (runs of letters, runs of digits, single
other characters) with ``O`` or the begin or inside of a kind. Its features are hashed
word shapes: case and length of letters, length and size of numbers, the
character itself, each token's neighbours, whether a space stands between,
and the few words that the labelled table repeats. It is trained in numpy (forward-backward
gradients) on a small labelled table, by default one that ``labelled_rows`` makes
from a rule. Tasks decode chains of many texts at once by Viterbi over padded batches.

Chains: the tokens within ``REACH`` tokens of a digit, an ``@``, a bracketed ``at`` or a ``dot``, on
one line. All other tokens are ``O`` by definition, so plain prose costs one pass
over its bytes. An added span must also be well formed (enough digits, Luhn, parts
at most 255, an at sign or word) and overlap no base span.

Defined cases: null or empty text: no spans; a text is searched whole, whatever
its length; repeated rows are each searched; empty tables give empty tables; added
columns replace input columns of their names, all others stay.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.llm.frames import Carried, map_rows
from rankspark.llm.hashing import Poly, byte_values, mix64, text_bytes, text_groups

KINDS = ("email", "ip", "card", "phone")
N_LABELS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind
REACH = 6
TABLE_BITS = 15
EPOCHS, BATCH, RATE, L2 = 12, 64, 0.2, 1e-4
MAX_TRAIN_ROWS = 5000
PADDED = 1 << 17

# ------------------------------------------------------------------ fixed patterns
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match never starts inside a run of digits: its first digit would have matched as well
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(text):
    return "".join(c for c in text if "0" <= c <= "9")


def small_parts(parts):
    """All numbers at most 255."""
    short = [p.lstrip("0") for p in parts]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in short)


def is_card(digits):
    return 13 <= len(digits) <= 19 and luhn(digits)


def emails(text):
    """Leftmost matches of local@domain, linear in the text: from each at sign the local part is read backwards."""
    out, end, before = [], 0, 0
    for at in re.finditer("@", text):
        p = at.start()
        local = LOCAL.match(text[max(end, before):p][::-1])
        domain = DOMAIN.match(text, p + 1) if local else None
        if domain:
            end = domain.end()
            out.append((0, p - local.end(), end))
        before = p + 1
    return out


def base_spans(text):
    """``[(kind number, start, end)]`` in code points, by kind and start."""
    out = emails(text) if "@" in text else []
    out += [(1, *m.span()) for m in IP.finditer(text) if small_parts(m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and is_card(digits_of(m.group()))]
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


# ------------------------------------------------------------------ tokens, shapes, features
SPACE, LINE, LETTER, DIGIT, OTHER = range(5)
CLASS = np.full(256, OTHER, dtype=np.int8)
CLASS[[32, 9, 11, 12, 13]] = SPACE
CLASS[10] = LINE
CLASS[128:] = LETTER
CLASS[65:91] = CLASS[97:123] = LETTER
CLASS[48:58] = DIGIT


class Tokens:
    """Tokens of a few texts: byte spans, classes, line numbers, shape codes and word hashes."""

    def __init__(self, data, offsets, poly, value):
        cls = CLASS[data]
        cut = np.ones(len(data) + 1, dtype=bool)
        if len(data):
            cut[1:-1] = (cls[1:] != cls[:-1]) | (cls[1:] == OTHER)
        cut[offsets] = True
        edge = np.flatnonzero(cut)
        s, e = edge[:-1], edge[1:]
        real = cls[s] >= LETTER if len(s) else np.zeros(0, dtype=bool)
        line = np.zeros(len(data) + 1, dtype=np.int64)
        line[1:] = np.cumsum(cls == LINE)
        starts = np.zeros(len(data) + 1, dtype=np.int64)
        np.add.at(starts, offsets[:-1], 1)
        self.s, self.e = s[real], e[real]
        self.cls = cls[self.s] if len(self.s) else np.zeros(0, dtype=np.int8)
        self.line = line[self.s] + np.cumsum(starts)[self.s]
        size = np.minimum(self.e - self.s, 20)
        head = data[self.s].astype(np.int64) if len(self.s) else np.zeros(0, dtype=np.int64)
        upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
        ups = upper[self.e] - upper[self.s]
        case = np.select([ups == 0, ups == self.e - self.s, (ups == 1) & (head >= 65) & (head <= 90)], [0, 1, 2], 3)
        tall = np.select([size <= 1, size == 2, size == 3, size <= 6], [0, 1, 2, 3], 4)
        number = np.zeros(len(self.s), dtype=np.int64)
        for i in range(3):
            here = (self.cls == DIGIT) & (size > i) & (size <= 3)
            number[here] = number[here] * 10 + data[self.s[here] + i] - 48
        self.shape = np.where(self.cls == LETTER, 1 + case * 5 + tall,
                              np.where(self.cls == DIGIT, 32 + 2 * size + (number > 255), 128 + head)).astype(np.int64)
        self.glued = np.zeros(len(self.s) + 1, dtype=bool)
        self.glued[1:-1] = (self.s[1:] == self.e[:-1]) & (self.line[1:] == self.line[:-1])
        self.word = np.zeros(len(self.s), dtype=np.uint64)
        short = np.flatnonzero((self.cls == LETTER) & (self.e - self.s <= 12))
        self.word[short] = poly.strings(data, value, self.s[short], self.e[short])
        self.anchor = (self.cls == DIGIT) | (head == 64)
        low = np.where((data >= 65) & (data <= 90), data + 32, data)
        for text, bracketed in ((b"dot", False), (b"at", True)):
            at = np.flatnonzero((self.cls == LETTER) & (self.e - self.s == len(text)))
            for i, c in enumerate(text):
                at = at[low[self.s[at] + i] == c]
            if bracketed:
                at = at[at > 0]
                at = at[np.isin(head[at - 1], [40, 60, 91, 123])]
            self.anchor[at] = True

    def near(self, x, shift, none=0):
        """Each token's neighbour value ``shift`` places on, ``none`` beyond the line."""
        out = np.full(len(x), none, dtype=x.dtype)
        if abs(shift) < len(x):
            a, b = (slice(shift, None), slice(None, -shift)) if shift > 0 else (slice(None, shift), slice(-shift, None))
            same = self.line[a] == self.line[b]
            out[b] = np.where(same, x[a], none)
        return out

    def chains(self):
        """``(tokens in chains, chain number of each)``."""
        mask = self.anchor.copy()
        for shift in range(1, REACH + 1):
            mask |= self.near(self.anchor, shift, False) | self.near(self.anchor, -shift, False)
        at = np.flatnonzero(mask)
        first = np.ones(len(at), dtype=bool)
        first[1:] = (np.diff(at) != 1) | (np.diff(self.line[at]) != 0)
        return at, np.cumsum(first) - 1

    def features(self, at, vocab):
        """Feature numbers, one row per listed token."""
        word = np.zeros(len(self.s), dtype=np.int64)
        if len(vocab):
            place = np.minimum(np.searchsorted(vocab, self.word), len(vocab) - 1)
            word = np.where(vocab[place] == self.word, place + 1, 0)
        left, right = self.glued[:-1].astype(np.int64), self.glued[1:].astype(np.int64)
        sh = {d: (self.near(self.shape, d) if d else self.shape)[at] for d in range(-3, 4)}
        wd = {d: (self.near(word, d) if d else word)[at] for d in range(-2, 3)}
        l, r = left[at], right[at]
        ll, rr = self.near(left, -1)[at], self.near(right, 1)[at]
        sets = [(sh[0],), (sh[0], l, r), (sh[-1], l), (sh[1], r), (sh[-2], ll), (sh[2], rr), (sh[-1], sh[0], l), (sh[0], sh[1], r),
                (sh[-1], sh[1], l * 2 + r), (sh[-2], sh[-1], sh[0]), (sh[0], sh[1], sh[2]), (sh[-2], sh[0], sh[2]), (sh[-3], sh[-1], sh[0]),
                (sh[0], sh[1], sh[3]), (wd[0], l, r), (wd[-1], sh[0]), (wd[1], sh[0]), (wd[-2], sh[-1], sh[0]), (wd[2], sh[1], sh[0])]
        out = np.empty((len(at), len(sets)), dtype=np.int64)
        for i, parts in enumerate(sets):
            h = np.full(len(at), i + 1, dtype=np.uint64)
            for p in parts:
                h = h * np.uint64(1009) + p.astype(np.uint64)
            out[:, i] = (mix64(h) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        return out


# ------------------------------------------------------------------ the random field
def _allowed():
    """0 or minus infinity: an inside label only follows the begin or inside of its kind; the last row holds the starts."""
    trans = np.zeros((N_LABELS + 1, N_LABELS))
    for k in range(len(KINDS)):
        trans[:, 2 + 2 * k] = -np.inf
        trans[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return trans


def padded(chain):
    """Groups of chains of similar length: ``(places, mask)``, places of tokens as a (chains, length) table."""
    if not len(chain):
        return
    first = np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]]))
    size = np.diff(np.append(first, len(chain)))
    order = np.argsort(size, kind="stable")[::-1]
    i = 0
    while i < len(order):
        t = int(size[order[i]])
        pick = order[i:i + max(1, PADDED // t)]
        pick = pick[size[pick] * 2 >= t]
        step = np.arange(t)
        yield np.minimum(first[pick][:, None] + step, len(chain) - 1), step < size[pick][:, None]
        i += len(pick)


def viterbi(scores, mask, trans):
    """Best label paths of padded chains: ``scores`` (chains, length, labels)."""
    n, t, _ = scores.shape
    best, back = scores[:, 0] + trans[-1], np.zeros((t, n, N_LABELS), dtype=np.int8)
    back[:] = np.arange(N_LABELS)
    for i in range(1, t):
        step = best[:, :, None] + trans[:-1]
        move = step.argmax(axis=1)
        new = np.take_along_axis(step, move[:, None], axis=1)[:, 0] + scores[:, i]
        live = mask[:, i]
        back[i, live] = move[live]
        best = np.where(live[:, None], new, best)
    path = np.zeros((n, t), dtype=np.int8)
    path[:, -1] = best.argmax(axis=1)
    for i in range(t - 1, 0, -1):
        path[:, i - 1] = back[i, np.arange(n), path[:, i]]
    return path


def _logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def marginals(scores, mask, trans):
    """``(log Z per chain, label marginals, expected transitions)`` by forward-backward over padded chains."""
    n, t, _ = scores.shape
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[:, 0] = scores[:, 0] + trans[-1]
    for i in range(1, t):
        new = _logsum(alpha[:, i - 1][:, :, None] + trans[:-1], 1) + scores[:, i]
        alpha[:, i] = np.where(mask[:, i, None], new, alpha[:, i - 1])
    z = _logsum(alpha[:, -1], 1)
    moves = np.zeros_like(trans)
    for i in range(t - 1, 0, -1):
        after = (scores[:, i] + beta[:, i])[:, None, :] + trans[:-1]
        live = mask[:, i]
        moves[:-1] += np.exp(alpha[live, i - 1][:, :, None] + after[live] - z[live, None, None]).sum(axis=0)
        beta[:, i - 1] = np.where(live[:, None], _logsum(after, 2), beta[:, i])
    p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
    moves[-1] = p[:, 0].sum(axis=0)
    return z, p, moves


def train(rows, epochs: int = EPOCHS, seed: int = 5):
    """A model from ``[(text, [(kind, start, end)])]``, spans in code points."""
    import pyarrow as pa

    poly, value = Poly(61), byte_values(61, True)
    data, offs = text_bytes(pa.array([t for t, _ in rows], pa.string()))
    toks = Tokens(data, offs, poly, value)
    words, seen = np.unique(toks.word[toks.word != 0], return_counts=True)
    vocab = words[seen >= max(3, len(rows) // 150)]
    at, chain = toks.chains()
    gold = np.zeros(len(toks.s), dtype=np.int64)
    for i, (text, spans) in enumerate(rows):
        for kind, a, b in spans:
            x, y = (int(offs[i]) + len(text[:k].encode()) for k in (a, b))
            j = np.flatnonzero((toks.s >= x) & (toks.e <= y))
            gold[j] = 2 + 2 * KINDS.index(kind)
            gold[j[:1]] = 1 + 2 * KINDS.index(kind)
    gold, feats = gold[at], toks.features(at, vocab)
    rng = np.random.default_rng(seed)
    weights, trans = np.zeros((1 << TABLE_BITS, N_LABELS)), _allowed()
    free = np.isfinite(trans)
    sums, trans_sums = np.full(weights.shape, 1e-6), np.full(trans.shape, 1e-6)
    bounds = np.append(np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]])), len(chain)) if len(chain) else np.zeros(1, dtype=np.int64)
    for _ in range(epochs):
        order = rng.permutation(len(bounds) - 1)
        for b in range(0, len(order), BATCH):
            pick = order[b:b + BATCH]
            size = bounds[pick + 1] - bounds[pick]
            place = np.minimum(bounds[pick][:, None] + np.arange(size.max()), len(chain) - 1)
            mask = np.arange(size.max()) < size[:, None]
            scores = weights[feats[place]].sum(axis=2)
            _, p, moves = marginals(scores, mask, trans)
            y = gold[place]
            p[np.arange(len(pick))[:, None], np.arange(p.shape[1]), y] -= mask
            pair = mask[:, 1:]
            np.add.at(moves, (y[:, :-1][pair], y[:, 1:][pair]), -1)
            np.add.at(moves, (np.full(len(pick), N_LABELS), y[:, 0]), -1)
            used, inverse = np.unique(feats[place[mask]], return_inverse=True)
            grad = np.zeros((len(used), N_LABELS))
            np.add.at(grad, inverse.reshape(-1, feats.shape[1]), p[mask][:, None, :])
            grad = grad / len(pick) + L2 * weights[used]
            moves = np.where(free, moves / len(pick), 0)
            sums[used] += grad * grad
            trans_sums += moves * moves
            weights[used] -= RATE * grad / np.sqrt(sums[used])
            trans[free] -= (RATE * moves / np.sqrt(trans_sums))[free]
    return {"weights": weights.astype(np.float32), "trans": trans, "vocab": vocab}


def train_on(labelled: DataFrame, text_col: str = "text", spans_col: str = "spans", max_rows: int = MAX_TRAIN_ROWS):
    """A model from a labelled table, ``spans`` an array of (kind, start, end); of more than ``max_rows`` rows the first in hash order."""
    picked = labelled.where(F.col(text_col).isNotNull()).orderBy(F.xxhash64(text_col), text_col).limit(max_rows).select(text_col, spans_col)
    return train([(r[0], [tuple(s) for s in r[1] or []]) for r in picked.collect()])


# ------------------------------------------------------------------ the default labelled table
#: Surface forms of each kind. u user, h host, t domain ending, 0-3 numbers up to 255, c card groups, a area, x exchange, l line.
FORMS = {
    "email": ("{u}@{h}.{t}", "{u}@{h}.{t}", "{u} (at) {h}.{t}", "{u} [at] {h} [dot] {t}", "{u} at {h} dot {t}", "{u}(at){h}(dot){t}", "{u} @ {h}.{t}",
              "{u}[at]{h}[dot]{t}", "{u} AT {h} DOT {t}", "{u} {{at}} {h} {{dot}} {t}", "{u}[at]{h}.{t}", "{u}(at){h}.{t}", "{u}@{h}[.]{t}", "{u}@{h} dot {t}"),
    "ip": ("{0}.{1}.{2}.{3}", "{0}.{1}.{2}.{3}", "{0}[.]{1}[.]{2}[.]{3}", "{0} . {1} . {2} . {3}", "{0}(.){1}(.){2}(.){3}", "{0} dot {1} dot {2} dot {3}",
           "{0}.{1}.{2}[.]{3}", "{0}[dot]{1}[dot]{2}[dot]{3}"),
    "card": ("{c0}{c1}{c2}{c3}", "{c0} {c1} {c2} {c3}", "{c0}-{c1}-{c2}-{c3}", "{c0}.{c1}.{c2}.{c3}", "{c0}/{c1}/{c2}/{c3}", "{c0}_{c1}_{c2}_{c3}",
             "{c0}  {c1}  {c2}  {c3}", "{c0} - {c1} - {c2} - {c3}"),
    "phone": ("+1 ({a}) {x}-{l}", "+{n} {a} {x} {l}", "({a}) {x}-{l}", "({a}){x}-{l}", "{a}-{x}-{l}", "{a}.{x}.{l}", "({a}) {x} {l}", "+{n}/{a}/{x}/{l}", "00{n} {a} {x}{l}",
              "001-{a}-{x}-{l}", "1-{a}-{x}-{l}", "({a}) {x}.{l}", "1 ({a}) {x}-{l}"),
}
#: Numbers that are not personal data. d a digit run of 1 to 4, e of 5 to 12, y a year, m up to 12, h hexadecimal digits, w a word.
CLEAN = ("{y}-{m}-{m}", "{m}/{m}/{y}", "{m}.{m}.{y}", "{m}:{d}", "{d},{d}", "{d}.{d}", "{d}", "{e}", "{y}", "{y}-{y}", "${d}.{m}", "{d}%", "v{m}.{m}.{m}", "No. {d}",
         "[{d}]", "({y})", "({d})", "{d} x {d}", "{d} {d} {d}", "{d}, {d}, {d}, {d}", "{e} {e}", "{d}\t{d}\t{d}", "{d} | {d} | {d}", "{w}{d}", "{w}@{w}", "@{w}", "#{d}",
         "{d}-{d}", "{d}/{d}", "{w}-{d}", "\"{h}\"", "{h}", "{e}-{e}", "{w} dot {w}", "the dot", "({w})", "{w} [at] {w}", "{d} + {d} = {d}", "{m}.{m} {w}", "{d}.{d}.{d}",
         "{e}.{d}", "{w} ({d}-{d})", "{y}, {d}({m}), {d}-{d}", "978-{m}-{e}-{m}", "{d}*** {d}&&&", "+{d}", "+ {d}", "-{d}.{d}")


def _fill(rng, form):
    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def word(low=2, high=9):
        return "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(low, high)))

    body = rng.choice("3456") + digits(14)
    card = next(body + c for c in "0123456789" if luhn(body + c))
    user = word() + rng.choice(["", ".", "_", "-", "+"]) * rng.randint(0, 1)
    names = {"u": user + (digits(2) if rng.random() < 0.4 else word(1, 5)), "h": word() + rng.choice(["", "", digits(1), "." + word(3, 7), "-" + word(3, 5)]),
             "t": rng.choice(["com", "org", "net", "de", "fr", "es", "info", "edu"]), "a": str(rng.randint(200, 999)), "x": str(rng.randint(200, 999)), "l": digits(4),
             "n": str(rng.randint(1, 99)), "y": str(rng.randint(1700, 2030)), "m": str(rng.randint(0, 12)), "h16": ""}
    parts = [str(rng.randint(0, 255)) for _ in range(4)]
    names |= {f"c{i}": card[4 * i:4 * i + 4] for i in range(4)}
    if "{u}" in form or "{x}" in form or "{c0}" in form or "{0}" in form:
        return form.format(*parts, **names)
    makers = {"{d}": lambda: digits(rng.randint(1, 4)), "{e}": lambda: digits(rng.randint(5, 12)), "{y}": lambda: str(rng.randint(1700, 2030)),
              "{m}": lambda: str(rng.randint(0, 12)), "{h}": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((8, 16, 32, 40)))), "{w}": word}
    return re.sub(r"\{[deymhw]\}", lambda m: makers[m.group()](), form)


def labelled_rows(n: int = 2400, seed: int = 11):
    """``n`` made-up lines with their spans: words of random letters around one or two items, personal or not."""
    rng, out = random.Random(seed), []

    def context():
        words = []
        for _ in range(rng.randint(0, 7)):
            w = "".join(rng.choice("abcdefghiklmnoprstuvwäéñößçèí") for _ in range(rng.randint(1, 12)))
            words.append(rng.choice([w, w, w, w.capitalize(), w.upper(), rng.choice(["at", "the", "in", "tel:", "mail", "a", "call", "dot"])])
                         + rng.choice(["", "", "", "", ",", ".", ":", "***", "&&&", ";", "!"]))
        return " ".join(words)

    for _ in range(n):
        text, spans = context(), []
        for _ in range(rng.choice((1, 1, 2))):
            kind = rng.choice([*KINDS, None, None, None, None])
            item = _fill(rng, rng.choice(FORMS[kind] if kind else CLEAN))
            left, right = rng.choice(((" ", " "), (" ", " "), (" ", ", "), (" ", ". "), (" (", ") "), (" \"", "\" "), (" ", "!! "), (": ", " "), ("\n", "\n"), (" ", "### ")))
            text = text + left if text else ""
            if kind:
                spans.append((kind, len(text), len(text) + len(item)))
            text = (text + item + right) + context()
        out.append((text, spans))
    return out


@functools.lru_cache(maxsize=1)
def default_model():
    return train(labelled_rows())


# ------------------------------------------------------------------ decoding
def well_formed(kind, text):
    digits = digits_of(text)
    if kind == "email":
        low = text.lower()
        return bool(re.search(r"@|\bat\b", low)) and bool(re.search(r"\.|\bdot\b", low)) and "@" not in (low[:1], low[-1:])
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and small_parts(parts) and not re.search(r"[A-Za-z]", re.sub("(?i)dot", "", text))
    if kind == "card":
        return is_card(digits) and not re.search(r"[A-Za-z]", text)
    return 7 <= len(digits) <= 15 and not re.search(r"[^0-9\s()+./-]", text)


def added_spans(data, offsets, model, state):
    """``[(text number, kind number, byte start, byte end)]`` that the random field finds in a few texts."""
    toks = Tokens(data, offsets, *state)
    at, chain = toks.chains()
    if not len(at):
        return []
    feats = toks.features(at, model["vocab"])
    scores = np.zeros((len(at), N_LABELS), dtype=np.float32)
    for j in range(feats.shape[1]):
        scores += model["weights"][feats[:, j]]
    label = np.zeros(len(at), dtype=np.int8)
    for place, mask in padded(chain):
        label[place[mask]] = viterbi(scores[place].astype(np.float64), mask, model["trans"])[mask]
    begin = np.flatnonzero(label % 2 == 1)
    inside = (label > 0) & (label % 2 == 0)
    stop = np.append(np.flatnonzero(~inside), len(at))
    end = stop[np.searchsorted(stop, begin, side="right")] - 1
    s, e = toks.s[at[begin]], toks.e[at[end]]
    text = np.searchsorted(offsets, s, side="right") - 1
    return list(zip(text.tolist(), ((label[begin] - 1) // 2).tolist(), s.tolist(), e.tolist()))


def find_spans(texts, model, state):
    """Per text of an Arrow column ``(base spans, all spans)`` as (kind, start, end), by kind and start, code points."""
    data, offs = text_bytes(texts)
    out = []
    has = np.concatenate([[0], np.cumsum((CLASS[data] == DIGIT) | (data == 64))])
    for a, b in text_groups(offs):
        part, o = data[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
        found = {}
        for i, kind, s, e in added_spans(part, o, model, state):
            found.setdefault(i, []).append((kind, s, e))
        for i in range(b - a):
            base = all_spans = []
            if i in found or has[offs[a + i + 1]] > has[offs[a + i]]:
                raw = part[o[i]:o[i + 1]].tobytes()
                text = raw.decode()
                base = base_spans(text) if has[offs[a + i + 1]] > has[offs[a + i]] else []
                points = np.concatenate([[0], np.cumsum((part[o[i]:o[i + 1]] & 0xC0) != 0x80)]) if i in found else None
                taken = sorted((x, y) for _, x, y in base)
                reach = np.maximum.accumulate([y for _, y in taken]) if taken else np.zeros(0)
                first = [x for x, _ in taken]
                more = []
                for kind, s, e in found.get(i, ()):
                    x, y = int(points[s - o[i]]), int(points[e - o[i]])
                    j = int(np.searchsorted(first, y))  # base spans that start before this one's end
                    if (j == 0 or reach[j - 1] <= x) and well_formed(KINDS[kind], text[x:y]):
                        more.append((kind, x, y))
                all_spans = sorted(base + more)
            out.append((base, all_spans))
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _span_array(lists):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in x] for x in lists], kind)


def find_personal(docs: DataFrame, model=None, text_col: str = "text") -> DataFrame:
    """Adds ``base_spans`` and ``spans`` (base and added): arrays of (kind, start, end) by kind as in ``KINDS``, then start."""
    sent = docs.sparkSession.sparkContext.broadcast(model or default_model())  # about 1 MB, whatever the data
    carried = Carried(docs, [n for n in ("base_spans", "spans") if n != text_col])
    text_col, state = carried[text_col], {}

    def run(batch):
        if not state:
            state["poly"] = (Poly(61), byte_values(61, True))
        found = find_spans(batch.column(batch.schema.get_field_index(text_col)), sent.value, state["poly"])
        return [_span_array([f[0] for f in found]), _span_array([f[1] for f in found])]

    out = map_rows(carried.df, run, [T.StructField("__base", SPAN), T.StructField("__all", SPAN)])
    return carried.restore(out, F.col("__base").alias("base_spans"), F.col("__all").alias("spans"))


def redact(docs: DataFrame, model=None, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets (overlapping spans by the first one's)."""
    carried = Carried(docs)
    text_col = carried[text_col]

    def run(batch):
        import pyarrow as pa

        out = []
        for text, spans in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (text_col, "spans"))):
            at, parts = 0, []
            for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    parts += [text[at:s["start"]], f"<{s['kind']}>"]
                at = max(at, s["end"])
            out.append(text if text is None else "".join([*parts, text[at:]]))
        return [pa.array(out, pa.string())]

    found = find_personal(carried.df, model, text_col)
    return carried.restore(map_rows(found, run, [T.StructField("__clean", T.StringType())]), **{text_col: "__clean"})


def digest(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_personal_data(spark, sf_dir):
    """Personal data in all ``documents``; the counts are those of the base spans, ``n_added`` of the random field's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = find_personal(docs)
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(digest(F.col("base_spans")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"),
                      (F.size("spans") - F.size("base_spans")).cast("long").alias("n_added"))
