"""Text functions, all JVM-side Column expressions (no Python per row).

Analyzer [decision]: lower-case, then runs of Unicode letters / digits.
Sentence splitter [decision]: split on runs of ``.``, ``!``, ``?`` or newline,
collapse whitespace inside each piece, drop empty pieces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns (the analyzer and the splitter; DuckDB accepts the same text).
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
SENTENCE_BOUNDARY = r"[.!?\n]+"
WHITESPACE = r"[ \t\n\f\r\x0B]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokenize(col) -> Column:
    """``array<string>`` of lower-cased letter/digit runs."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(TOKEN_PATTERN), 0)


def token_count(col) -> Column:
    """Number of tokens without building the token array (same count as ``size(tokenize(col))``)."""
    return F.regexp_count(F.lower(_c(col)), F.lit(TOKEN_PATTERN))


def explode_tokens(col) -> Column:
    """``explode_outer`` of the tokens: unlike ``explode`` it does not make Catalyst add a
    ``size(tokens) > 0`` filter that evaluates the regex again; callers drop the null row."""
    return F.explode_outer(tokenize(col))


def clean_whitespace(col) -> Column:
    """CRLF CRLF → LF, CRLF → space, runs of spaces → one space."""
    c = F.regexp_replace(_c(col), "\r\n\r\n", "\n")
    c = F.regexp_replace(c, "\r\n", " ")
    return F.regexp_replace(c, " {2,}", " ")


def sentences(col) -> Column:
    """R2: sentences of a text, whitespace-normalised, empty ones dropped."""
    parts = F.split(_c(col), SENTENCE_BOUNDARY)
    norm = F.transform(parts, lambda s: F.trim(F.regexp_replace(s, WHITESPACE + "+", " ")))
    return F.filter(norm, lambda s: F.length(s) > 0)


def first_line(col) -> Column:
    """Text before the first newline (whole text when there is none)."""
    return F.substring_index(_c(col), "\n", 1)


def max_token_length(*cols) -> Column:
    """A11 helper: the largest token count over several text columns of a row."""
    sizes = [F.size(tokenize(c)) for c in cols]
    return sizes[0] if len(sizes) == 1 else F.greatest(*sizes)


def max_seq_length(df, cols):
    """The longest token count over the given text columns of all rows (one-row DataFrame)."""
    return df.agg(F.max(max_token_length(*cols)).cast("long").alias("max_seq_length"))
