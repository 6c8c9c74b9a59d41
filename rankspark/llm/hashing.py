"""Vectorised splitting and hashing of Arrow text batches (used inside tasks).

A short token's hash is a polynomial over its bytes modulo 2^64, taken from prefix
sums: with ``S[i] = sum(v[b_k] * B^k, k < i)`` the hash of bytes ``[s, e)`` is
``(S[e] - S[s]) * B^-s``, which depends on the content alone. Windows of tokens
are hashed the same way over the token hashes. That is a few numpy calls
per piece of about half a megabyte, never a call per token. Polynomials modulo 2^64 have
collisions that hold for every base, between strings of many hundred
bytes; so a token of more than ``LONG`` bytes is hashed on its own by XXH3 with the polynomial's seed.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 19
#: Up to here a polynomial loses at most 20 of its 64 bits to the worst pair of strings.
LONG = 32
M64 = (1 << 64) - 1


def mix64(x):
    """splitmix64 finaliser over a uint64 array (public-domain constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values(seed, fold):
    """A random odd 64-bit value per byte; with ``fold``, A-Z share the values of a-z."""
    v = mix64(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1000003 + 12345)) | np.uint64(1)
    if fold:
        v[65:91] = v[97:123]
    return v


def powers(base, n):
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Poly:
    """Prefix-sum hashing of ranges with one random base; power tables grow as needed."""

    def __init__(self, seed):
        self.seed = seed
        self.base = (int(mix64(np.array([seed + 77], dtype=np.uint64))[0]) & ~7 & M64) | 5
        self.inv_base = pow(self.base, -1, 1 << 64)
        self.n = 0

    def grow(self, n):
        if n > self.n:
            self.n = max(n, 2 * self.n, 4096)
            self.pw, self.inv = powers(self.base, self.n), powers(self.inv_base, self.n)

    def prefix(self, values):
        self.grow(len(values) + 1)
        s = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.pw[:len(values)], dtype=np.uint64, out=s[1:])
        return s

    def ranges(self, prefix, starts, ends):
        return mix64((prefix[ends] - prefix[starts]) * self.inv[starts])

    def strings(self, data, values, starts, ends):
        """Hashes of byte ranges of any length (``values``: a number per byte; equal ones are the same letter)."""
        out = self.ranges(self.prefix(values[data]), starts, ends)
        long = np.flatnonzero(ends - starts > LONG)
        if len(long):
            import xxhash

            same = np.arange(256, dtype=np.uint8)
            if values[65] == values[97]:
                same[65:91] += 32
            raw = same[data].tobytes()
            out[long] = [xxhash.xxh3_64_intdigest(raw[a:b], self.seed) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
        return out

    def windows(self, tokens, size):
        """Hash of every run of ``size`` tokens (one per start position)."""
        if len(tokens) < size:
            return np.zeros(0, dtype=np.uint64)
        s = self.prefix(tokens)
        return mix64((s[size:] - s[:-size]) * self.inv[:len(tokens) - size + 1])


#: Byte classes: the white space of words and lines, and the separators of alphanumeric words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x41:0x5B] = NOT_ALNUM[0x61:0x7B] = False


def text_bytes(column):
    """``(data, offsets)`` of an Arrow string column; a null text is empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    o = o.astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return d[o[0]:o[-1]], o - o[0]


def pieces(data, offsets, sep):
    """Byte ranges of about ``PIECE`` bytes that never cut a token (they end at a separator or a text's end)."""
    n, at = len(data), 0
    while at < n:
        to = min(n, at + PIECE)
        while to < n:
            k = int(np.searchsorted(offsets, to))
            bound = int(offsets[k]) if k < len(offsets) else n
            hit = sep[data[to:min(to + 65536, bound)]]
            if hit.any():
                to += int(hit.argmax())
                break
            to = min(to + 65536, bound)
            if to == bound:
                break
        yield at, to
        at = to


def tokens(data, offsets, sep, polys, values, spans=False):
    """Maximal runs of non-separator bytes, which never cross texts.

    Returns ``(hashes per poly, tokens per text[, starts, ends])``.
    """
    hashes, starts, ends = [[] for _ in polys], [], []
    first = np.unique(offsets[:-1])
    for a, b in pieces(data, offsets, sep):
        part = data[a:b]
        word = np.zeros(len(part) + 2, dtype=bool)
        word[1:-1] = ~sep[part]
        begin = word[1:-1] & ~word[:-2]
        end = word[1:-1] & ~word[2:]
        cut = first[np.searchsorted(first, a):np.searchsorted(first, b)] - a
        begin[cut] |= word[1:-1][cut]
        before = cut[cut > 0] - 1
        end[before] |= word[1:-1][before]
        s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        for out, poly, value in zip(hashes, polys, values):
            out.append(poly.strings(part, value, s, e))
        starts.append(s + a)
        ends.append(e + a)
    s = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.searchsorted(s, offsets))
    hs = [np.concatenate(h) if h else np.zeros(0, dtype=np.uint64) for h in hashes]
    if spans:
        return hs, counts, s, np.concatenate(ends) if ends else s
    return hs, counts


def per_text(counts):
    """For each token the number of its text, and each text's first token."""
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return np.repeat(np.arange(len(counts)), counts), bounds


def text_groups(offsets, limit=1 << 20):
    """Row ranges of a batch with about ``limit`` bytes of text each."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
