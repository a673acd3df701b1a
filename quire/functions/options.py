"""Processing options: parse, whitelist, type-check, defaults (PRJ-6, PRJ-7, JSN-1).

The raw options arrive as a JSON string per row.  ``sanitize_options`` parses
it into a VARIANT and applies the whitelist rules with native expressions:

* keys outside the whitelist are dropped;
* null, '' and device 'auto' are dropped before any check; false and 0 stay;
* enums (backend, method, device) must be one of their strings exactly;
* booleans follow truthiness: any non-empty string is true ("false" too),
  numbers are true unless 0, arrays/objects unless empty;
* integers accept integers, booleans (1/0), numbers truncated toward zero and
  strings of an optionally signed decimal integer (surrounding white space and
  '_' between digits allowed) - "3.7" is an error;
* lang becomes text (True/False for booleans).

The first failing key (whitelist order) gives the ``error``; then the options
are null.  Malformed JSON and non-object JSON are errors too.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values (must equal the reference's) ---
ENUMS = {
    "backend": ["pipeline", "vlm-transformers"],
    "method": ["auto", "txt", "ocr"],
    "device": ["auto", "cuda", "mps", "cpu"],
}
OPTION_KEYS = ["lang", "backend", "method", "formula", "table", "start_page", "end_page", "device"]
BOOL_KEYS = ["formula", "table"]
INT_KEYS = ["start_page", "end_page"]
DEFAULTS = {"lang": "en", "backend": "pipeline", "method": "auto", "formula": True, "table": True,
            "start_page": 0, "end_page": None, "device": None}
# --- end of fixed values ---

OPTIONS_STRUCT = T.StructType([
    T.StructField("lang", T.StringType()),
    T.StructField("backend", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("formula", T.BooleanType()),
    T.StructField("table", T.BooleanType()),
    T.StructField("start_page", T.IntegerType()),
    T.StructField("end_page", T.IntegerType()),
    T.StructField("device", T.StringType()),
])

INT_TEXT = r"^[+-]?[0-9]+(_[0-9]+)*\z"
STRIP = r"^[\s\x1c-\x1f\x85]+|[\s\x1c-\x1f\x85]+\z"  # white space around a number
INTEGRAL_TYPES = ["TINYINT", "SMALLINT", "INT", "BIGINT"]


def _typ(v: Column) -> Column:
    """Variant type name without parameters: STRING, BIGINT, DECIMAL, OBJECT, ..."""
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)


def _is_num(t: Column) -> Column:
    return t.isin(*INTEGRAL_TYPES, "DECIMAL", "DOUBLE", "FLOAT")


def _field(v: Column, key: str):
    e = F.try_variant_get(v, f"$.{key}", "variant")
    t = F.when(e.isNotNull(), _typ(e))
    s = F.try_variant_get(e, "$", "string")
    absent = e.isNull() | (t == "VOID") | ((t == "STRING") & (s == "")) | (
        F.lit(key == "device") & (t == "STRING") & (s == "auto"))
    return e, t, s, absent


def _py_repr(t: Column, s: Column, e: Column) -> Column:
    """Rough Python repr of a JSON value for error messages."""
    return (F.when(t == "STRING", F.concat(F.lit("'"), s, F.lit("'")))
            .when(t == "BOOLEAN", F.when(F.try_variant_get(e, "$", "boolean"), "True").otherwise("False"))
            .otherwise(F.to_json(e)))


def _convert(key: str, e: Column, t: Column, s: Column):
    """(value, error) for one present key."""
    if key in ENUMS:
        ok = (t == "STRING") & s.isin(*ENUMS[key])
        return (F.when(ok, s),
                F.when(~ok, F.concat(F.lit(f"Invalid value for '{key}': "), _py_repr(t, s, e))))
    if key in BOOL_KEYS:
        val = (F.when(t == "BOOLEAN", F.try_variant_get(e, "$", "boolean"))
               .when(t == "STRING", F.lit(True))
               .when(_is_num(t), F.try_variant_get(e, "$", "double") != 0)
               .when(t == "ARRAY", F.size(F.from_json(F.to_json(e), "array<string>")) > 0)
               .when(t == "OBJECT", F.to_json(e) != "{}"))
        return val, F.lit(None).cast("string")
    if key in INT_KEYS:
        txt = F.regexp_replace(s, STRIP, "")
        from_text = F.when(txt.rlike(INT_TEXT), F.regexp_replace(txt, "_", "").try_cast("int"))
        val = (F.when(t == "BOOLEAN", F.try_variant_get(e, "$", "boolean").cast("int"))
               .when(t.isin(*INTEGRAL_TYPES), F.try_variant_get(e, "$", "int"))
               .when(_is_num(t), F.try_variant_get(e, "$", "double").cast("long").try_cast("int"))
               .when(t == "STRING", from_text))
        err = (F.when((t == "STRING") & val.isNull(),
                      F.concat(F.lit("invalid literal for int() with base 10: '"), s, F.lit("'")))
               .when(t.isin("ARRAY", "OBJECT"),
                     F.concat(F.lit("int() argument must be a string, a bytes-like object or a real number, not '"),
                              F.when(t == "ARRAY", "list").otherwise("dict"), F.lit("'")))
               .when(val.isNull(), F.concat(F.lit(f"Invalid value for '{key}': "), F.to_json(e))))
        return val, err
    # free text (lang)
    val = (F.when(t == "STRING", s)
           .when(t == "BOOLEAN", F.when(F.try_variant_get(e, "$", "boolean"), "True").otherwise("False"))
           .otherwise(F.to_json(e)))
    return val, F.lit(None).cast("string")


def sanitize_options(raw) -> Column:
    """JSON text -> struct<options: OPTIONS_STRUCT, error: string>.  Null text means {}."""
    raw_c = F.col(raw) if isinstance(raw, str) else raw
    v = F.try_parse_json(F.coalesce(raw_c, F.lit("{}")))
    top = _typ(v)
    values, errors = [], []
    for key in OPTION_KEYS:
        e, t, s, absent = _field(v, key)
        val, err = _convert(key, e, t, s)
        values.append(F.when(~absent, val).cast(OPTIONS_STRUCT[key].dataType).alias(key))
        errors.append(F.when(~absent, err))
    error = (F.when(v.isNull(), F.lit("malformed options JSON"))
             .when(top != "OBJECT", F.lit("options must be a JSON object"))
             .otherwise(F.coalesce(*errors)))
    return F.struct(F.when(error.isNull(), F.struct(*values)).alias("options"), error.alias("error"))


def with_defaults(options) -> Column:
    """Options with the processing defaults filled in (PRJ-7)."""
    o = F.col(options) if isinstance(options, str) else options
    return F.struct(*[
        (F.coalesce(o[k], F.lit(d)) if d is not None else o[k]).cast(OPTIONS_STRUCT[k].dataType).alias(k)
        for k, d in DEFAULTS.items()])


def _sql_convert(k: str) -> tuple[str, str]:
    """(value, error) SQL for one present key; same rules as ``_convert``."""
    e, t, s = f"_oe_{k}", f"_ot_{k}", f"_os_{k}"
    q = "''''"  # a quote character inside a SQL string literal
    num = "('TINYINT', 'SMALLINT', 'INT', 'BIGINT', 'DECIMAL', 'DOUBLE', 'FLOAT')"
    ints = "('TINYINT', 'SMALLINT', 'INT', 'BIGINT')"
    if k in ENUMS:
        allowed = ", ".join(f"'{v}'" for v in ENUMS[k])
        ok = f"({t} = 'STRING' AND {s} IN ({allowed}))"
        rep = (f"CASE WHEN {t} = 'STRING' THEN concat({q}, {s}, {q}) WHEN {t} = 'BOOLEAN' THEN "
               f"CASE WHEN try_variant_get({e}, '$', 'boolean') THEN 'True' ELSE 'False' END ELSE to_json({e}) END")
        return (f"CASE WHEN {ok} THEN {s} END",
                f"CASE WHEN NOT {ok} THEN concat('Invalid value for ''{k}'': ', {rep}) END")
    if k in BOOL_KEYS:
        return (f"CASE WHEN {t} = 'BOOLEAN' THEN try_variant_get({e}, '$', 'boolean') WHEN {t} = 'STRING' THEN true "
                f"WHEN {t} IN {num} THEN try_variant_get({e}, '$', 'double') <> 0 "
                f"WHEN {t} = 'ARRAY' THEN size(from_json(to_json({e}), 'array<string>')) > 0 "
                f"WHEN {t} = 'OBJECT' THEN to_json({e}) <> '{{}}' END"), "CAST(NULL AS STRING)"
    if k in INT_KEYS:
        txt = f"regexp_replace({s}, r'{STRIP}', '')"
        val = (f"CASE WHEN {t} = 'BOOLEAN' THEN CAST(try_variant_get({e}, '$', 'boolean') AS INT) "
               f"WHEN {t} IN {ints} THEN try_variant_get({e}, '$', 'int') "
               f"WHEN {t} IN {num} THEN try_cast(CAST(try_variant_get({e}, '$', 'double') AS BIGINT) AS INT) "
               f"WHEN {t} = 'STRING' AND {txt} RLIKE r'{INT_TEXT}' THEN try_cast(replace({txt}, '_', '') AS INT) END")
        kind = f"CASE WHEN {t} = 'ARRAY' THEN 'list' ELSE 'dict' END"
        err = (f"CASE WHEN {t} = 'STRING' AND _ov_{k} IS NULL "
               f"THEN concat('invalid literal for int() with base 10: ', {q}, {s}, {q}) "
               f"WHEN {t} IN ('ARRAY', 'OBJECT') THEN concat('int() argument must be a string, a bytes-like object "
               f"or a real number, not ', {q}, {kind}, {q}) "
               f"WHEN _ov_{k} IS NULL THEN concat('Invalid value for ''{k}'': ', to_json({e})) END")
        return val, err
    return (f"CASE WHEN {t} = 'STRING' THEN {s} WHEN {t} = 'BOOLEAN' THEN CASE WHEN "
            f"try_variant_get({e}, '$', 'boolean') THEN 'True' ELSE 'False' END ELSE to_json({e}) END",
            "CAST(NULL AS STRING)")


def with_sanitized_options(df, raw: str, out: str = "opts"):
    """DataFrame form of ``sanitize_options`` for large inputs.

    The rules are emitted as SQL text and applied in a few staged projections
    (parse once; per key: value, type and text once; then value and error), so
    both the plan and its construction from Python stay small."""
    keys = OPTION_KEYS
    d = df.selectExpr("*", f"try_parse_json(coalesce(`{raw}`, '{{}}')) AS _ov")
    d = d.selectExpr("*", "regexp_extract(schema_of_variant(_ov), '^([A-Z]+)', 1) AS _otop",
                     *[f"try_variant_get(_ov, '$.{k}', 'variant') AS _oe_{k}" for k in keys])
    d = d.selectExpr("*", *[x for k in keys for x in (
        f"CASE WHEN _oe_{k} IS NOT NULL THEN regexp_extract(schema_of_variant(_oe_{k}), '^([A-Z]+)', 1) END AS _ot_{k}",
        f"try_variant_get(_oe_{k}, '$', 'string') AS _os_{k}")])
    absent = {k: (f"(_oe_{k} IS NULL OR _ot_{k} = 'VOID' OR (_ot_{k} = 'STRING' AND _os_{k} = '')"
                  + (f" OR (_ot_{k} = 'STRING' AND _os_{k} = 'auto')" if k == "device" else "") + ")")
              for k in keys}
    conv = {k: _sql_convert(k) for k in keys}
    d = d.selectExpr("*", *[f"CAST(CASE WHEN NOT {absent[k]} THEN {conv[k][0]} END AS "
                            f"{OPTIONS_STRUCT[k].dataType.simpleString()}) AS _ov_{k}" for k in keys])
    d = d.selectExpr("*", *[f"CASE WHEN NOT {absent[k]} THEN {conv[k][1]} END AS _oerr_{k}" for k in keys])
    errs = ", ".join(f"_oerr_{k}" for k in keys)
    d = d.selectExpr("*", f"CASE WHEN _ov IS NULL THEN 'malformed options JSON' WHEN _otop <> 'OBJECT' "
                          f"THEN 'options must be a JSON object' ELSE coalesce({errs}) END AS _oerror")
    fields = ", ".join(f"'{k}', _ov_{k}" for k in keys)
    d = d.selectExpr("*", f"named_struct('options', CASE WHEN _oerror IS NULL THEN named_struct({fields}) END, "
                          f"'error', _oerror) AS `{out}`")
    tmp = ["_ov", "_otop", "_oerror"] + [f"_o{x}_{k}" for k in keys for x in ("e", "t", "s", "v", "err")]
    return d.drop(*tmp)
