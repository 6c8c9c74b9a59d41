"""A pair of Bloom filters over key hashes: keys seen, and keys seen twice.

Built by Spark in three steps that all stay bounded: every task sets the bits of
its own keys and emits them as compressed slices, the slices are merged in a
tree of groups of at most ``FAN_IN`` fragments, and the twice filter, whose size
is fixed before (``bits`` is at most ``MAX_BITS``), goes to the driver to be
broadcast. Merging ``(once, twice)`` pairs is associative:
``(o1 | o2, t1 | t2 | (o1 & o2))``. A third part takes keys that need not meet one
another, only one of the others: it is merged by ``|`` and met with ``once`` at the end. The twice filter has no false negatives; a
false positive only costs a row in the exact step that follows. Past the size
for which ``MAX_BITS`` was chosen more keys pass and the exact step gets more
rows, but results stay the same.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BITS = 1 << 20
FAN_IN = 64
#: 2^28 bits are 32 MB: the most that is broadcast.
MAX_BITS = 1 << 28
#: At 4 bits a key about one key in 50 that was seen once passes.
BITS_PER_KEY = 4
PROBES = 2
#: A slice with fewer than one bit in so many set is sent as the gaps between them.
SPARSE = 40
PARTS = ("once", "twice", "beside")


def filter_bits(keys: int, bits_per_key: int = BITS_PER_KEY, max_bits: int = MAX_BITS) -> int:
    """A power of two for about ``keys`` keys, one slice at least, ``max_bits`` at most."""
    want = max(SLICE_BITS, keys * bits_per_key)
    return min(max_bits, 1 << (want - 1).bit_length())


def positions(hashes, bits):
    """``PROBES`` bit positions for each uint64 hash."""
    mask = np.uint64(bits - 1)
    second = (hashes >> np.uint64(32)) | (hashes << np.uint64(32))
    step = second * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    return [(hashes + np.uint64(i) * step) & mask for i in range(PROBES)]


class Pair:
    """The two filters of one task; ``add`` takes keys of which equal ones count as seen again (not those in ``beside``)."""

    def __init__(self, bits):
        self.bits, self.once, self.twice, self.beside = bits, np.zeros(bits >> 3, dtype=np.uint8), np.zeros(bits >> 3, dtype=np.uint8), None

    def add(self, hashes, beside=None):
        if beside is not None:
            if self.beside is None:
                self.beside = np.zeros(self.bits >> 3, dtype=np.uint8)
            for pos in positions(beside, self.bits):
                set_bits(self.beside, pos)
        for pos in positions(hashes, self.bits):
            pos = np.sort(pos)
            again = pos[1:][pos[1:] == pos[:-1]]
            distinct = pos[np.concatenate([[True], pos[1:] != pos[:-1]])] if len(pos) else pos
            old = (self.once[distinct >> np.uint64(3)] >> (distinct & np.uint64(7)).astype(np.uint8)) & 1
            set_bits(self.twice, again)
            set_bits(self.twice, distinct[old == 1])
            set_bits(self.once, distinct)

    def slices(self):
        """(slice, once, twice, beside) of every slice with a bit set, compressed."""
        size = SLICE_BITS >> 3
        for k in range(self.bits // SLICE_BITS):
            once, twice, beside = (None if x is None else x[k * size:(k + 1) * size] for x in (self.once, self.twice, self.beside))
            if once.any() or (beside is not None and beside.any()):
                yield k, packed(once), packed(twice), packed(beside)


def packed(bits) -> bytes:
    """Deflated bits; of few set bits the gaps between them, after a 0 byte."""
    if bits is None:
        return b""
    if int(np.bitwise_count(bits).sum()) * SPARSE < 8 * len(bits):
        gaps = np.diff(np.flatnonzero(np.unpackbits(bits, bitorder="little")), prepend=-1) - 1
        data = np.full(len(gaps) + int((gaps // 255).sum()), 255, dtype=np.uint8)  # a gap is its number of 255s and the rest
        data[np.cumsum(gaps // 255 + 1) - 1] = gaps % 255
        return b"\0" + deflated(data.tobytes())
    return deflated(bits.tobytes())


def deflated(data: bytes) -> bytes:
    """Scattered values compress best by Huffman codes alone, runs by matches."""
    plain = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY)
    return min(zlib.compress(data, 1), plain.compress(data) + plain.flush(), key=len)


def unpacked(data: bytes):
    """The bytes of one slice (None: there is none)."""
    if not data:
        return None
    if data[0]:  # a zlib stream begins with 0x78
        return np.frombuffer(zlib.decompress(data), dtype=np.uint8).copy()
    gaps = np.frombuffer(zlib.decompress(data[1:]), dtype=np.uint8)
    pos = np.cumsum(gaps, dtype=np.int64)[gaps < 255]
    bits = np.zeros(SLICE_BITS, dtype=np.uint8)
    bits[pos + np.arange(len(pos))] = 1
    return np.packbits(bits, bitorder="little")


def set_bits(filter_, pos):
    if len(pos):
        np.bitwise_or.at(filter_, pos >> np.uint64(3), np.uint8(1) << (pos & np.uint64(7)).astype(np.uint8))


def contains(filter_, hashes, bits):
    """Boolean per hash; ``filter_`` is a uint8 array."""
    out = np.ones(len(hashes), dtype=bool)
    for pos in positions(hashes, bits):
        out &= ((filter_[pos >> np.uint64(3)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1) == 1
    return out


def merge(parts):
    """One (once, twice, beside) triple from compressed fragments."""
    once = twice = beside = None
    for o, t, e in parts:
        o, t, e = unpacked(o), unpacked(t), unpacked(e)
        if once is None:
            once, twice = o, t
        else:
            twice |= t
            twice |= once & o
            once |= o
        if e is not None:
            beside = e if beside is None else beside | e
    return once, twice, beside


def twice_filter(df: DataFrame, keys_of, bits: int):
    """Broadcast the twice filter of ``keys_of(batch) -> uint64 array`` over all batches of ``df``.

    ``keys_of`` gives each key once per document: what it gives again, within a
    batch or later, counts as seen twice. It may give pairs of arrays: keys of the second
    count as seen twice if some document gives them in the first. Returns a broadcast of ``bytes``.
    """
    spark = df.sparkSession

    def build(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        pair, task = Pair(bits), TaskContext.get().partitionId()
        for batch in batches:
            for keys in keys_of(batch):
                pair.add(*(keys if isinstance(keys, tuple) else (keys,)))
        rows = list(pair.slices())
        for i in range(0, len(rows), 16):
            k, *parts = zip(*rows[i:i + 16])
            yield pa.RecordBatch.from_arrays([pa.array([task] * len(k), pa.int64()), pa.array(k, pa.int64()), *[pa.array(x, pa.binary()) for x in parts]], names=["task", "slice", *PARTS])

    def merged(group):
        import pandas as pd

        return pd.DataFrame({"task": [int(group["task"].iloc[0]) // FAN_IN], "slice": [int(group["slice"].iloc[0])],
                             **{c: [packed(x)] for c, x in zip(PARTS, merge(zip(*[group[c] for c in PARTS])))}})

    schema = "task long, slice long, once binary, twice binary, beside binary"
    tasks = max(1, df.rdd.getNumPartitions())
    parts = df.mapInArrow(build, schema)
    while True:
        parts = parts.groupBy("slice", F.expr(f"task div {FAN_IN}").alias("g")).applyInPandas(merged, schema)
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            break
    out = np.zeros(bits >> 3, dtype=np.uint8)
    size = SLICE_BITS >> 3
    whole = {}
    for row in parts.select("slice", *PARTS).collect():  # at most three times MAX_BITS / 8 bytes, and as a rule one row a slice
        part = tuple(row[c] for c in PARTS)
        if row["slice"] in whole:  # an adaptive plan may have dealt the tasks otherwise
            part = tuple(packed(x) for x in merge([whole[row["slice"]], part]))
        whole[row["slice"]] = part
    for k, part in whole.items():
        once, twice, beside = (unpacked(x) for x in part)
        out[k * size:(k + 1) * size] = twice if beside is None else twice | (once & beside)
    return spark.sparkContext.broadcast(out.tobytes())
