"""Column-level helpers for topics, corpora and training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.functions.text import WHITESPACE


def strip_ws(col) -> Column:
    """remove leading and trailing whitespace of any kind."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def flatten_structs(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested struct fields become top-level columns named ``a<sep>b``, values kept."""
    cols: list[Column] = []

    def walk(dtype: T.DataType, path: list[str]):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(f.dataType, path + [f.name])
        else:
            ref = F.col(f"`{path[0]}`")
            for p in path[1:]:
                ref = ref.getField(p)
            cols.append(ref.alias(sep.join(path)))

    for f in df.schema.fields:
        walk(f.dataType, [f.name])
    return df.select(*cols)


def facet(df: DataFrame, path: str, sep: str = "_") -> Column:
    """A nested value by a separated path (``"A_B"`` → ``A.B``)."""
    parts = path.split(sep)
    ref = F.col(parts[0])
    for p in parts[1:]:
        ref = ref.getField(p)
    return ref.alias(path)


def public_facets(df: DataFrame) -> DataFrame:
    """P5: drop columns whose names start with ``_``."""
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def text_facets(df: DataFrame) -> list[str]:
    """Columns that are not embedding columns."""
    return [c for c in df.columns if "embedding" not in c.lower()]


def unwrap_singletons(df: DataFrame, cols=None) -> DataFrame:
    """P10: a one-element array becomes its element; longer arrays are joined with spaces.

    A column holds one type, so the unwrapped value and the joined form are both strings.
    """
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    out = {}
    for c in cols:
        ref = df[f"`{c}`"]
        s = F.transform(ref, lambda x: x.cast("string"))
        out[c] = F.when(F.size(ref) == 1, s[0]).otherwise(F.concat_ws(" ", s))
    return df.select(*[(out[c].alias(c) if c in out else df[f"`{c}`"]) for c in df.columns])


def field_text(df: DataFrame, field: str) -> Column:
    """The text to encode for a field: its ``Textblock`` child when present, else the value."""
    dtype = df.schema[field].dataType
    if isinstance(dtype, T.StructType) and "Textblock" in dtype.fieldNames():
        return F.col(field).getField("Textblock").cast("string")
    return F.col(field).cast("string")


def texts_to_encode(df: DataFrame, field: str, encoded_col: str | None = None) -> DataFrame:
    """Rows whose field text should be encoded: text present (``Textblock`` child when
    there is one) and, when ``encoded_col`` is given, no vector stored yet."""
    out = df.withColumn(f"{field}_text", field_text(df, field)).where(F.col(f"{field}_text").isNotNull())
    if encoded_col and encoded_col in df.columns:
        out = out.where(F.col(encoded_col).isNull())
    return out


def relevance(col, max_score: float = 2.0) -> Column:
    """Graded label scaled to 0–1."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("double") / F.lit(float(max_score))


def remap_labels(df: DataFrame, label: str = "label", div: int = 2, drop: int = -1) -> DataFrame:
    """``label // div`` (floor division, so −1 stays −1), then drop ``drop``."""
    return (df.withColumn(label, F.floor(F.col(label) / F.lit(div)).cast("int"))
            .where(F.col(label) != F.lit(drop)))


def to_examples(df: DataFrame, text_cols, id_col: str, label_col: str | None = None,
                label: float | None = None) -> DataFrame:
    """(id, texts array, label) from a column label or a constant (0 allowed)."""
    lab = F.col(label_col).cast("double") if label_col else F.lit(None if label is None else float(label)).cast("double")
    return df.select(F.col(id_col).alias("id"), F.array(*[F.col(c).cast("string") for c in text_cols]).alias("texts"),
                     lab.alias("label"))


def examples_to_columns(df: DataFrame, n: int | None = None) -> DataFrame:
    """``texts[]`` → ``text_a, text_b, …`` (trimmed); ``n`` fixes the number of columns."""
    if n is None:
        n = df.select(F.max(F.size("texts"))).first()[0] or 0
    def name(i):  # a ... z, then aa, ab, ...
        return (name(i // 26 - 1) if i >= 26 else "") + chr(ord("a") + i % 26)

    names = [f"text_{name(i)}" for i in range(n)]
    return df.select("id", *[strip_ws(F.try_element_at("texts", F.lit(i + 1))).alias(nm) for i, nm in enumerate(names)],
                     "label")
