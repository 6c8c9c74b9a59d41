"""URL rules and a weighted URL vocabulary.

``judge_urls`` first applies host/path rules (longest fitting rule wins). A URL
that no rule fits is judged by vocabulary: one Aho-Corasick pass over the
lower-cased URL finds the terms, a hit counts only between boundaries (the
neighbours are not ASCII letters or digits), and the URL is blocked on one
strict term or on ``soft_limit`` distinct soft terms.

Defined cases: a null URL or one without ``://`` has empty host and path, is
fitted by no rule and (null) contains no term, so it is allowed. The rules and
the vocabulary are small parameters of the job, not data. Input columns named
like an output column are replaced; all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.llm.frames import Carried, map_rows

#: The rules of the task, (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

STRICT_TERMS = ("porn", "xxx", "hentai", "escort", "casino", "warez", "phishing", "malware")
SOFT_TERMS = ("adult", "sex", "nude", "bet", "poker", "slots", "free", "cheap", "pills", "viagra", "loan", "torrent",
              "crack", "keygen", "proxy", "click", "winner", "prize")
SOFT_LIMIT = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty where it is null or has no ``://``."""
    cut = F.instr(url, "://")
    rest = F.when(cut > 0, F.substr(url, cut + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """``struct(verdict, rule)`` of the longest rule that fits, else null.

    A rule fits its host and every subdomain where the path starts with the
    rule's. Rules of one length: the order of the rule text decides.
    """
    fit = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        on = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        fit = F.when(on, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(fit)
    return fit


def build_automaton(strict, soft):
    import ahocorasick

    a = ahocorasick.Automaton()
    for term in {*strict, *soft}:
        a.add_word(term, (len(term), term, term in strict))
    a.make_automaton()
    return a


def term_hits(automaton, url):
    """Distinct (strict, soft) terms of a URL that stand between boundaries."""
    strict, soft = set(), set()
    text = url.translate({c: c + 32 for c in range(65, 91)})
    for end, (size, term, is_strict) in automaton.iter(text):
        before, after = text[end - size:end - size + 1] if end >= size else "", text[end + 1:end + 2]
        if (before and before.isascii() and before.isalnum()) or (after and after.isascii() and after.isalnum()):
            continue
        (strict if is_strict else soft).add(term)
    return strict, soft


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES, strict=STRICT_TERMS, soft=SOFT_TERMS,
               soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """Adds ``host, path, rule, verdict, strict_hits, soft_hits`` (arrays of distinct terms, sorted)."""
    strict, soft = tuple(strict), tuple(soft)
    if not strict and not soft:
        raise ValueError("the vocabulary is empty")
    hits = T.ArrayType(T.StringType())
    state: dict = {}

    def count(batch):
        import pyarrow as pa

        if "a" not in state:
            state["a"] = build_automaton(strict, soft)
        s, w = [], []
        for url in batch.column(batch.schema.get_field_index(url_col)).to_pylist():
            x, y = term_hits(state["a"], url) if url else ((), ())
            s.append(sorted(x))
            w.append(sorted(y))
        return [pa.array(s, pa.list_(pa.string())), pa.array(w, pa.list_(pa.string()))]

    names = ["host", "path", "rule", "verdict", "strict_hits", "soft_hits"]
    carried = Carried(pages, names)
    url_col = carried[url_col]
    counted = map_rows(carried.df, count, [T.StructField("strict_hits", hits), T.StructField("soft_hits", hits)])
    host, path = host_and_path(F.col(url_col))
    out = counted.withColumns({"host": host, "path": path})
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    bad = (F.size("strict_hits") > 0) | (F.size("soft_hits") >= soft_limit)
    out = (out.withColumn("fit", fit).withColumn("rule", F.col("fit.rule"))
           .withColumn("verdict", F.coalesce("fit.verdict", F.when(bad, "block").otherwise("allow"))))
    return carried.restore(out, *names)


def op4_url_filter(spark, sf_dir):
    """Verdict for every url of ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    def fits(h, p):
        return f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"

    def has(t):
        return f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"

    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in order)
    verdict = " ".join(f"WHEN rule = '{h + p}' THEN '{v}'" for v, h, p in order)
    soft = " + ".join(f"CAST({has(t)} AS INT)" for t in SOFT_TERMS)
    return f"""
WITH rest AS (
  SELECT page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS low,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, low, translate(regexp_extract(r, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
ruled AS (SELECT *, CASE {rule} ELSE NULL END AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE {verdict} WHEN {" OR ".join(has(t) for t in STRICT_TERMS)} THEN 'block'
            WHEN {soft} >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""


OP4_SQL = _sql()
