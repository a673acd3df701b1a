"""Option validation over per-document option texts (PRJ-6, PRJ-7, JSN-1).

Each document gets an options JSON text built from one of the fixture
templates below (cycled by doc_id) filled with the document's own values, so
the work grows with the table."""
from __future__ import annotations

import string

from pyspark.sql import functions as F

from quire.functions.options import DEFAULTS, ENUMS, OPTION_KEYS, with_defaults, with_sanitized_options
from quire.plans import sqlfrag as Q
from quire.session import read_table

QUERIES = {}
ORACLE = {}

# Fixture option texts (FIXTURES.md §3.3 cases); {c} = n_chars, {d} = doc_id, {l} = lang.
TEMPLATES = [
    '{{"lang":"{l}","method":"txt","start_page":{c7}}}',
    '{{"device":"auto","backend":"pipeline","end_page":"{c11}"}}',
    '{{"formula":"false","table":0}}',
    '{{"end_page":{ck}}}',
    '{{"method":"fast"}}',
    '{{"end_page":"3.7"}}',
    '{{"start_page":true,"lang":{d}}}',
    '{{"device":"AUTO"}}',
    'not json {d}',
    '[]',
    '{{"end_page":[]}}',
    '{{"x":1,"device":"cuda","table":false}}',
    '{{"end_page":null,"lang":""}}',
    '{{"backend":"vlm-transformers","method":"ocr","formula":1}}',
    '{{"start_page":" {c7} ","end_page":"1_000"}}',
    '{{"formula":[],"table":{{"a":1}},"lang":false}}',
]


_SPARK_FIELDS = {
    "l": lambda: F.col("lang"),
    "d": lambda: F.col("doc_id").cast("string"),
    "c7": lambda: (F.col("n_chars") % 7).cast("string"),
    "c11": lambda: (F.col("n_chars") % 11).cast("string"),
    "ck": lambda: F.format_string("%.3f", F.col("n_chars") / 1000.0),
}
_SQL_FIELDS = {"l": "lang", "d": "CAST(doc_id AS VARCHAR)", "c7": "CAST(n_chars % 7 AS VARCHAR)",
               "c11": "CAST(n_chars % 11 AS VARCHAR)", "ck": "printf('%.3f', n_chars / 1000.0)"}


def _pieces(t: str):
    """Template -> [(literal, field or None), ...] following str.format rules."""
    return [(lit, field) for lit, field, _, _ in string.Formatter().parse(t)]


def _spark_template(t: str):
    parts = []
    for lit, field in _pieces(t):
        if lit:
            parts.append(F.lit(lit))
        if field is not None:
            parts.append(_SPARK_FIELDS[field]())
    return F.concat(*parts)


def _sql_template(t: str) -> str:
    parts = []
    for lit, field in _pieces(t):
        if lit:
            parts.append(Q.lit(lit))
        if field is not None:
            parts.append(_SQL_FIELDS[field])
    return " || ".join(parts)


def option_texts(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    n = len(TEMPLATES)
    raw = F.element_at(F.array(*[_spark_template(t) for t in TEMPLATES]), (F.col("doc_id") % n + 1).cast("int"))
    return d.select("doc_id", raw.alias("raw"))


def q_sanitize_options(spark, sf_dir):
    r = with_sanitized_options(option_texts(spark, sf_dir), "raw", "r")
    return r.select("doc_id", "raw", *[F.col(f"r.options.{k}").alias(k) for k in OPTION_KEYS],
                    F.col("r.error").alias("error"))


def q_effective_options(spark, sf_dir):
    r = with_sanitized_options(option_texts(spark, sf_dir), "raw", "r").filter(F.col("r.error").isNull())
    e = with_defaults(F.col("r.options"))
    return r.select("doc_id", *[e[k].alias(k) for k in OPTION_KEYS])


# -- DuckDB twin of the rules in functions/options.py ---------------------------------------
_INT_TEXT = "[+-]?[0-9]+(_[0-9]+)*"
_STRIP = "^[\\t\\n\\x0b\\x0c\\r ]+|[\\t\\n\\x0b\\x0c\\r ]+$"


def _sql_key(k: str):
    t = f"json_type(jraw, '$.{k}')"
    s = f"json_extract_string(jraw, '$.{k}')"
    j = f"CAST(json_extract(jraw, '$.{k}') AS VARCHAR)"
    absent = (f"({t} IS NULL OR {t} = 'NULL' OR ({t} = 'VARCHAR' AND {s} = '')"
              + (f" OR ({t} = 'VARCHAR' AND {s} = 'auto')" if k == "device" else "") + ")")
    rep = f"CASE WHEN {t} = 'VARCHAR' THEN '''' || {s} || '''' WHEN {t} = 'BOOLEAN' THEN CASE WHEN {s} = 'true' THEN 'True' ELSE 'False' END ELSE {j} END"
    if k in ENUMS:
        ok = f"({t} = 'VARCHAR' AND {s} IN {Q.in_list(ENUMS[k])})"
        val = f"CASE WHEN {ok} THEN {s} END"
        err = f"CASE WHEN NOT {ok} THEN 'Invalid value for ''{k}'': ' || {rep} END"
    elif k in ("formula", "table"):
        val = (f"CASE WHEN {t} = 'BOOLEAN' THEN {s} = 'true' WHEN {t} = 'VARCHAR' THEN true "
               f"WHEN {t} IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST({s} AS DOUBLE) <> 0 "
               f"WHEN {t} = 'ARRAY' THEN json_array_length(jraw, '$.{k}') > 0 WHEN {t} = 'OBJECT' THEN {j} <> '{{}}' END")
        err = "CAST(NULL AS VARCHAR)"
    elif k in ("start_page", "end_page"):
        txt = f"regexp_replace({s}, '{_STRIP}', '', 'g')"
        val = (f"CASE WHEN {t} = 'BOOLEAN' THEN CASE WHEN {s} = 'true' THEN 1 ELSE 0 END "
               f"WHEN {t} IN ('BIGINT', 'UBIGINT') THEN TRY_CAST({s} AS INTEGER) "
               f"WHEN {t} = 'DOUBLE' THEN TRY_CAST(trunc(CAST({s} AS DOUBLE)) AS INTEGER) "
               f"WHEN {t} = 'VARCHAR' AND regexp_full_match({txt}, '{_INT_TEXT}') "
               f"THEN TRY_CAST(replace({txt}, '_', '') AS INTEGER) END")
        err = (f"CASE WHEN {t} = 'VARCHAR' AND ({val}) IS NULL THEN 'invalid literal for int() with base 10: ''' || {s} || '''' "
               f"WHEN {t} IN ('ARRAY', 'OBJECT') THEN 'int() argument must be a string, a bytes-like object or a real number, not ''' "
               f"|| CASE WHEN {t} = 'ARRAY' THEN 'list' ELSE 'dict' END || '''' "
               f"WHEN ({val}) IS NULL THEN 'Invalid value for ''{k}'': ' || {j} END")
    else:
        val = f"CASE WHEN {t} = 'VARCHAR' THEN {s} WHEN {t} = 'BOOLEAN' THEN CASE WHEN {s} = 'true' THEN 'True' ELSE 'False' END ELSE {j} END"
        err = "CAST(NULL AS VARCHAR)"
    return f"CASE WHEN NOT {absent} THEN {val} END", f"CASE WHEN NOT {absent} THEN {err} END"


def _sql_options() -> str:
    n = len(TEMPLATES)
    raw = "CASE " + " ".join(f"WHEN doc_id % {n} = {i} THEN {_sql_template(t)}" for i, t in enumerate(TEMPLATES)) + " END"
    vals, errs = zip(*[_sql_key(k) for k in OPTION_KEYS])
    types = {"formula": "BOOLEAN", "table": "BOOLEAN", "start_page": "INTEGER", "end_page": "INTEGER"}
    err = (f"CASE WHEN NOT json_valid(raw) THEN 'malformed options JSON' "
           f"WHEN json_type(jraw) <> 'OBJECT' THEN 'options must be a JSON object' ELSE coalesce({', '.join(errs)}) END")
    cols = ", ".join(f"CASE WHEN e IS NULL THEN CAST(v{i} AS {types.get(k, 'VARCHAR')}) END AS \"{k}\""
                     for i, k in enumerate(OPTION_KEYS))
    inner_vals = ", ".join(f"CASE WHEN json_type(jraw) = 'OBJECT' THEN {v} END AS v{i}"
                           for i, v in enumerate(vals))
    # DuckDB evaluates every CASE branch, so JSON functions read a text that is
    # always valid JSON ('null' for malformed input).
    return (f"WITH r AS (SELECT doc_id, {raw} AS raw FROM documents), "
            f"o AS (SELECT doc_id, raw, CASE WHEN json_valid(raw) THEN raw ELSE 'null' END AS jraw FROM r), "
            f"c AS (SELECT doc_id, raw, {inner_vals}, {err} AS e FROM o) "
            f"SELECT doc_id, raw, {cols}, e AS error FROM c")


QUERIES["sanitize_options"] = q_sanitize_options
ORACLE["sanitize_options"] = _sql_options()
QUERIES["effective_options"] = q_effective_options
_DEF_SQL = {k: ("NULL" if v is None else (Q.lit(v) if isinstance(v, str) else str(v).lower())) for k, v in DEFAULTS.items()}
ORACLE["effective_options"] = (
    f"SELECT doc_id, {', '.join(f'coalesce(\"{k}\", {_DEF_SQL[k]}) AS \"{k}\"' if DEFAULTS[k] is not None else f'\"{k}\"' for k in OPTION_KEYS)} "
    f"FROM ({_sql_options()}) WHERE error IS NULL")
