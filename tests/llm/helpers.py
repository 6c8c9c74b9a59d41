"""Fixtures shared by the tests of the training-data operators."""

from __future__ import annotations

import re

import duckdb

from tests.conftest import SF_SMALL
from tools.oracle_check import TABLES

SPACE = r"[\x20\x09-\x0D]+"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id int, cls string, key string, n int, d long"


def duck(sf=SF_SMALL):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def frame(spark, rows):
    """Documents from (doc_id, text[, lang, source]) with extra columns whose names operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1] or ""), 7, "c", "k", 1, 2) for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text, lower=False):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or "") if lower else text or "")
