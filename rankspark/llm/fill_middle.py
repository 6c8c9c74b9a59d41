"""Fill-in-the-middle transformation as a pipeline of Arrow list operations.

A text is cut into units, each of which ends after a separator (by default a
line with its line feed). Two cuts, drawn from a hash of the document's id, divide
the units into prefix, middle and suffix. Per Arrow batch: the texts are split
into list arrays, flattened with their parent indices, every unit gets its
ordinal, units are filtered by role, each role's lists are rebuilt with new
offsets and joined, and the three pieces are joined behind their marks. No text
is touched on its own, and nothing is shuffled.

``psm`` writes prefix, suffix, middle; ``spm`` suffix, prefix, middle; ``plain`` is
the text itself: an empty text, a text that holds a mark, or one that the draw leaves.
As no text with a mark is transformed, and no mark can arise where a piece meets
a mark (``Marks`` checks that), ``restore`` gets the exact text back.

Defined cases: a null text is empty; a null id draws like the empty id; equal ids
draw equal hashes (their cuts differ as far as their texts do); no row is dropped or added, an empty
table gives an empty table; added columns replace input columns of their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.llm.frames import Carried, map_rows
from rankspark.llm.hashing import text_bytes, text_groups

GROUP_BYTES = 1 << 22


@dataclass(frozen=True)
class Marks:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = self.all()
        for i, a in enumerate(marks):
            for j, b in enumerate(marks):
                if not a or (i != j and a in b) or any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)) + (i != j))):
                    raise ValueError(f"mark {a!r} cannot be told apart from {b!r} everywhere")

    def all(self):
        return self.prefix, self.suffix, self.middle


def draws(id_col: Column, seed: str = "7:", n: int = 4) -> Column:
    """The first ``n`` 32-bit groups of the id's SHA-256, as an array of longs."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)])


def units(texts, sep):
    """``(units, parents, counts)``: the texts' units in order, each one's text number, and units per text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.split_pattern(texts, sep)
    values, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    last = np.ones(len(parents), dtype=bool)
    last[:-1] = parents[1:] != parents[:-1]
    ends = pc.if_else(pa.array(last), pa.scalar("", pa.large_string()), pa.scalar(sep, pa.large_string()))
    whole = pc.binary_join_element_wise(values, ends, pa.scalar("", pa.large_string()))
    real = ~(last & (pc.binary_length(values).to_numpy(zero_copy_only=False) == 0))  # what follows the last separator may be nothing
    parents = parents[real]
    return whole.filter(pa.array(real)), parents, np.bincount(parents, minlength=len(texts))


def joined(parts, parents, n):
    """The parts of each of ``n`` texts, joined."""
    import pyarrow as pa
    import pyarrow.compute as pc

    offsets = np.concatenate([[0], np.cumsum(np.bincount(parents, minlength=n))])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts), pa.scalar("", pa.large_string()))


def _grouped(column):
    """Pieces of a text column with about ``GROUP_BYTES`` each, nulls empty, 64-bit offsets."""
    import pyarrow as pa

    texts = column.cast(pa.large_string()).fill_null("")
    _, offsets = text_bytes(texts)
    for a, b in text_groups(offsets, GROUP_BYTES):
        yield a, texts.slice(a, b - a)


def _concat(parts, kind):
    import pyarrow as pa

    return pa.concat_arrays(parts).cast(kind) if parts else pa.array([], kind)


def fill_middle(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: str = "7:", rate: int = 100,
                spm_share: int = 50, sep: str = "\n", marks: Marks = Marks()) -> DataFrame:
    """Adds ``n_units long, form string, prefix_chars, middle_chars long, output string``.

    ``rate`` of 100 texts are transformed, ``spm_share`` of 100 of those as ``spm``. The piece lengths are code points, null when plain.
    """
    names = ["n_units", "form", "prefix_chars", "middle_chars", "output"]
    carried = Carried(docs, [n for n in names if n != text_col])
    id_col, text_col = carried[id_col], carried[text_col]

    def transform(texts, h):
        import pyarrow as pa
        import pyarrow.compute as pc

        n = len(texts)
        parts, parents, counts = units(texts, sep)
        ordinals = np.arange(len(parents)) - np.concatenate([[0], np.cumsum(counts)])[parents]
        cuts = np.sort(h[:, :2] % (counts[:, None] + 1), axis=1)
        role = (ordinals >= cuts[parents, 0]).astype(np.int8) + (ordinals >= cuts[parents, 1])
        prefix, middle, suffix = (joined(parts.filter(pa.array(role == r)), parents[role == r], n) for r in range(3))
        plain = (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0) | (h[:, 2] % 100 >= rate)
        for mark in marks.all():
            plain |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        spm = h[:, 3] % 100 < spm_share
        p, s, m = (pa.scalar(x, pa.large_string()) for x in marks.all())
        none = pa.scalar("", pa.large_string())
        psm_text = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
        spm_text = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)
        plain, spm = pa.array(plain), pa.array(spm)
        output = pc.if_else(plain, texts, pc.if_else(spm, spm_text, psm_text))
        form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
        blank = pa.scalar(None, pa.int64())
        lengths = [pc.if_else(plain, blank, pc.utf8_length(x)) for x in (prefix, middle)]
        return [pa.array(counts, pa.int64()), form, *lengths, output]

    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()]

    def run(batch):
        import pyarrow as pa

        column = batch.column(batch.schema.get_field_index(text_col))
        h = batch.column(batch.schema.get_field_index("__h")).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
        groups = [transform(texts, h[a:a + len(texts)]) for a, texts in _grouped(column)]
        return [_concat([g[i] for g in groups], k) for i, k in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]

    out = map_rows(carried.df.withColumn("__h", draws(F.col(id_col), seed)), run, [T.StructField(f"__{n}", k) for n, k in zip(names, kinds)])
    return carried.restore(out, *[F.col(f"__{n}").alias(n) for n in names])


def restore(docs: DataFrame, output_col: str = "output", form_col: str = "form", marks: Marks = Marks(), restored_col: str = "restored") -> DataFrame:
    """Adds the text rebuilt from an output and its form alone (null output: empty)."""
    pattern = "|".join(re.escape(m) for m in marks.all())
    carried = Carried(docs, [restored_col])
    output_col, form_col = carried[output_col], carried[form_col]

    def rebuild(texts, form):
        import pyarrow as pa
        import pyarrow.compute as pc

        moved = pc.not_equal(form, "plain")
        pieces = pc.list_flatten(pc.split_pattern_regex(texts.filter(moved), pattern))  # nothing, then three pieces a text
        at = np.arange(0, len(pieces), 4)
        first, second, middle = (pieces.take(pa.array(at + i)) for i in (1, 2, 3))
        spm = pc.equal(form.filter(moved), "spm")
        none = pa.scalar("", pa.large_string())
        whole = pc.binary_join_element_wise(pc.if_else(spm, second, first), middle, pc.if_else(spm, first, second), none)
        return pc.replace_with_mask(texts, moved, whole)

    def run(batch):
        import pyarrow as pa
        import pyarrow.compute as pc

        form = pc.fill_null(batch.column(batch.schema.get_field_index(form_col)), "plain")
        groups = [rebuild(texts, form.slice(a, len(texts))) for a, texts in _grouped(batch.column(batch.schema.get_field_index(output_col)))]
        return [_concat(groups, pa.string())]

    out = map_rows(carried.df, run, [T.StructField("__restored", T.StringType())])
    return carried.restore(out, F.col("__restored").alias(restored_col))


def op11_fill_middle(spark, sf_dir):
    """Fill-in-the-middle forms of all ``documents``, and their round trip."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fill_middle(docs).select("doc_id", "n_units", "form", "prefix_chars", "middle_chars", "output")
    return restore(out).select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
                               F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
drawn AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
         CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM cut),
formed AS (
  SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
pieces AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
         coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM pieces"""
