"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each statement is self-contained over the driver's views (documents,
benchmark, labels, embeddings, ...). Shared pieces are SQL fragments below;
they restate the library's definitions in plain SQL, not Spark's plans.
"""

from __future__ import annotations

from rankspark.functions.text import TOKEN_PATTERN


def tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{TOKEN_PATTERN}', 0)"


def corpus_ctes(fields=("body",)) -> str:
    parts = " UNION ALL ".join(
        f"SELECT doc_id, '{f}' AS field, {f} AS text FROM corpus WHERE {f} IS NOT NULL" for f in fields)
    return f"""
corpus AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS body, source, lang FROM documents),
flong AS ({parts}),
dtoks AS (SELECT field, doc_id, {tok('text')} AS toks FROM flong),
doclen AS (SELECT field, doc_id, len(toks) AS dl FROM dtoks),
fstats AS (SELECT field, count(*) AS n_docs, avg(dl) AS avgdl FROM doclen GROUP BY field),
postings AS (SELECT field, term, doc_id, any_value(dl) AS dl, count(*) AS tf
             FROM (SELECT field, doc_id, len(toks) AS dl, unnest(toks) AS term FROM dtoks)
             GROUP BY field, term, doc_id),
tstats AS (SELECT field, term, count(*) AS df FROM postings GROUP BY field, term)"""


def topics_cte() -> str:
    return "topics AS (SELECT item_id AS topic_id, 'text' AS facet, 0 AS facet_pos, text FROM benchmark)"


def bm25_ctes(fields=("body",), boosts=None, facets="first", k1="1.2", b="0.75", by_field=False,
              topics="topics", prefix="") -> str:
    """qterms → weights → parts → <prefix>scores. k1 / b may be SQL expressions of columns of qterms."""
    boosts = boosts or {}
    fb = ", ".join(f"('{f}', {float(boosts.get(f, 1.0))}::DOUBLE)" for f in fields)
    where = "WHERE facet_pos = 0" if facets == "first" else ""
    keys = "topic_id, field, doc_id" if by_field else "topic_id, doc_id"
    p = prefix
    return f"""
{p}qt AS (SELECT topic_id, term, count(*) AS qtf
        FROM (SELECT topic_id, unnest({tok('text')}) AS term FROM {topics} {where}) GROUP BY topic_id, term),
{p}qterms AS (SELECT topic_id, f.field, term, qtf * f.boost AS qw FROM {p}qt, (VALUES {fb}) f(field, boost)
            WHERE qtf * f.boost <> 0),
{p}weights AS (SELECT q.topic_id, q.field, q.term, s.avgdl,
                  q.qw * ln(1 + (s.n_docs - t.df + 0.5) / (t.df + 0.5)) AS wt
             FROM {p}qterms q JOIN tstats t USING (field, term) JOIN fstats s USING (field)),
{p}parts AS (SELECT w.topic_id, p.field, p.doc_id,
                w.wt * (p.tf * ({k1}::DOUBLE + 1)) / (p.tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * p.dl / w.avgdl)) AS part
           FROM postings p JOIN {p}weights w USING (field, term)),
{p}scores AS (SELECT {keys}, sum(part) AS score FROM {p}parts GROUP BY {keys})"""


def rank_cte(name: str, source: str, k: int | None, part: str = "topic_id", score: str = "score") -> str:
    lim = f"WHERE rank <= {k}" if k is not None else ""
    return f"""
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY round({score}, 6) DESC, doc_id) AS rank
                        FROM {source}) {lim})"""


def qrels_ctes() -> str:
    """From the definition: every (topic, document) pair is tested for containment as a run of tokens."""
    line = f"' ' || array_to_string({tok('text')}, ' ') || ' '"
    return f"""
tlines AS (SELECT item_id AS topic_id, {line} AS line, list_distinct({tok('text')}) AS terms FROM benchmark WHERE len({tok('text')}) > 0),
dlines AS (SELECT doc_id, {line} AS line FROM documents),
hits AS (SELECT t.topic_id, d.doc_id FROM tlines t JOIN dlines d ON contains(d.line, t.line)),
dfs AS (SELECT term, count(*) AS df FROM postings WHERE field = 'body' GROUP BY term),
rarest AS (SELECT topic_id, arg_min(term, struct_pack(df := df, term := term)) AS term
           FROM (SELECT topic_id, unnest(terms) AS term FROM tlines) JOIN dfs USING (term) GROUP BY topic_id),
near AS (SELECT r.topic_id, p.doc_id FROM rarest r JOIN postings p ON p.field = 'body' AND p.term = r.term JOIN labels l ON l.doc_id = p.doc_id),
qrels AS (SELECT topic_id, doc_id, CAST(CASE WHEN max(hit) = 1 THEN 1 + coalesce(any_value(l.quality), 0) ELSE 0 END AS INTEGER) AS rel
          FROM (SELECT *, 1 AS hit FROM hits UNION ALL SELECT *, 0 FROM near) LEFT JOIN labels l USING (doc_id) GROUP BY topic_id, doc_id)"""


def eval_ctes(run: str = "run", maxd: int = 1000, p: str = "", keys: str = "") -> str:
    """<p>totals, <p>ej, <p>ej2 and <p>ideal for one run (needs ``qrels``); ``keys`` like ``"setting, "``."""
    kr = ", ".join(f"r.{k.strip()}" for k in keys.split(",") if k.strip())
    kr = kr + ", " if kr else ""
    return f"""
{p}totals AS (SELECT topic_id, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS R, sum(CASE WHEN rel <= 0 THEN 1 ELSE 0 END) AS N
           FROM qrels GROUP BY topic_id HAVING sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) > 0),
{p}ej AS (SELECT {kr}r.topic_id, r.doc_id, r.rank, q.rel FROM {run} r LEFT JOIN qrels q USING (topic_id, doc_id) WHERE r.rank <= {maxd}),
{p}ej2 AS (SELECT e.*, coalesce(sum(CASE WHEN rel <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys}topic_id ORDER BY rank
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
               sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys}topic_id ORDER BY rank
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rel_upto,
               coalesce(rel, 0)::DOUBLE AS g, t.R::DOUBLE AS RR, t.N::DOUBLE AS NN
        FROM {p}ej e JOIN {p}totals t USING (topic_id)),
{p}ideal AS (SELECT topic_id, rel, row_number() OVER (PARTITION BY topic_id ORDER BY rel DESC) AS pos FROM qrels WHERE rel > 0)"""


def metric_select(name: str, k: int, p: str = "", keys: str = "", rnd: bool = True) -> str:
    hits = f"sum(CASE WHEN rank <= {k} AND g > 0 THEN 1 ELSE 0 END)"
    if name == "p":
        v = f"{hits} / {float(k)}"
    elif name == "recall":
        v = f"{hits} / any_value(RR)"
    elif name == "rprec":
        v = f"sum(CASE WHEN rank <= least(RR, {k}) AND g > 0 THEN 1 ELSE 0 END) / any_value(RR)"
    elif name == "ndcg":
        v = (f"sum(CASE WHEN rank <= {k} AND g > 0 THEN g / log2(rank + 1.0) ELSE 0.0 END) / "
             f"any_value((SELECT sum(rel / log2(pos + 1.0)) FROM {p}ideal i WHERE i.topic_id = x.topic_id AND pos <= {k}))")
    elif name == "bpref":
        v = (f"sum(CASE WHEN rank <= {k} AND g > 0 THEN (CASE WHEN above > 0 THEN 1.0 - least(above, RR) / least(RR, NN) "
             f"ELSE 1.0 END) ELSE 0.0 END) / any_value(RR)")
    elif name == "map":
        v = f"sum(CASE WHEN rank <= {k} AND g > 0 THEN rel_upto / rank ELSE 0.0 END) / any_value(RR)"
    elif name == "recip_rank":
        v = f"coalesce(max(CASE WHEN rank <= {k} AND g > 0 THEN 1.0 / rank END), 0.0)"
    else:
        raise ValueError(name)
    val = f"round(CAST({v} AS DOUBLE), 6)" if rnd else f"CAST({v} AS DOUBLE)"
    return (f"SELECT {keys}topic_id, '{name}' AS metric, CAST({k} AS INTEGER) AS depth, "
            f"{val} AS value FROM {p}ej2 x GROUP BY {keys}topic_id")


def metrics_union(specs, p: str = "", keys: str = "", rnd: bool = True) -> str:
    return "\nUNION ALL\n".join(metric_select(n, k, p, keys, rnd) for n, k in specs)


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n"


def hash_vec_ctes(name: str, source: str, keys: str, text: str, dim: int = 64) -> str:
    """<name>(keys..., vec DOUBLE[]): the hash encoder over ``text`` of ``source``."""
    return f"""
{name}_b AS (SELECT {keys}, list_transform({tok(text)}, lambda t: ('0x' || substr(md5(t), 1, 6))::BIGINT % {dim}) AS bk
             FROM {source} WHERE {text} IS NOT NULL),
{name}_c AS (SELECT {keys}, list_transform(range({dim}), lambda i: len(list_filter(bk, lambda x: x = i)))::DOUBLE[] AS cnt
             FROM {name}_b),
{name}_n AS (SELECT *, sqrt(list_sum(list_transform(cnt, lambda c: c * c))) AS nrm FROM {name}_c),
{name} AS (SELECT {keys}, CASE WHEN nrm > 0 THEN list_transform(cnt, lambda c: c / nrm) ELSE cnt END AS vec FROM {name}_n)"""


def cos(a: str, b: str) -> str:
    den = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"(CASE WHEN {den} = 0 THEN 0.0 ELSE list_dot_product({a}, {b}) / {den} END)"


def conversation_topics_cte() -> str:
    return ("topics AS (SELECT conv_id AS topic_id, concat_ws('_', role, CAST(turn AS VARCHAR)) AS facet, "
            "CAST(turn AS INTEGER) AS facet_pos, text FROM conversations)")


WS = r"[ \t\n\f\r\x0B]"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"
