"""DuckDB SQL fragments for the oracle twins of the name/text expressions.

The oracle runs in DuckDB (RE2 regex, byte/char functions), so each fragment
is written for that dialect; the patterns are the same texts the Spark side
uses (see ``quire.functions.names``).
"""
from __future__ import annotations

from quire.functions.names import (
    FALLBACK_STEM,
    IMAGE_SUFFIXES,
    INVALID_NAME_CHARS,
    MAX_STEM_BYTES,
    OFFICE_SUFFIXES,
    PDF_SUFFIXES,
    SUFFIX_PATTERN,
    STEM_PATTERN,
    SUPPORTED_SUFFIXES,
    UNICODE_WS,
)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def base_name(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL ELSE coalesce("
            f"list_filter(string_split({x}, '/'), lambda p: p <> '' AND p <> '.')[-1], '') END")


def stem(x: str) -> str:
    return f"regexp_replace({x}, {lit(STEM_PATTERN)}, '\\1')"


def suffix(x: str) -> str:
    return f"regexp_extract({x}, {lit(SUFFIX_PATTERN)}, 1)"


def lower_suffix(x: str) -> str:
    return f"lower({suffix(x)})"


def file_kind(x: str) -> str:
    s = lower_suffix(x)
    return (f"CASE WHEN {s} IN {in_list(PDF_SUFFIXES)} THEN 'pdf' "
            f"WHEN {s} IN {in_list(IMAGE_SUFFIXES)} THEN 'image' "
            f"WHEN {s} IN {in_list(OFFICE_SUFFIXES)} THEN 'office' ELSE 'unsupported' END")


def is_supported(x: str) -> str:
    return f"({lower_suffix(x)} IN {in_list(SUPPORTED_SUFFIXES)})"


def is_supported_client(x: str) -> str:
    return f"(lower(regexp_extract({x}, '(?s)(\\.[^.]*)\\z', 1)) IN {in_list(SUPPORTED_SUFFIXES)})"


def sanitize_ctes(src: str, col: str, out: str, prefix: str = "ss") -> list[str]:
    """CTE chain adding column ``out`` = safe stem of ``col`` to relation ``src``."""
    n = MAX_STEM_BYTES
    return [
        f"{prefix}1 AS (SELECT *, {stem(base_name(col))} AS _s1 FROM {src})",
        f"{prefix}2 AS (SELECT *, regexp_replace(regexp_replace(_s1, {lit(INVALID_NAME_CHARS)}, ' ', 'g'), "
        f"{lit(UNICODE_WS + '+')}, ' ', 'g') AS _s2 FROM {prefix}1)",
        f"{prefix}3 AS (SELECT *, regexp_replace(trim(_s2), '[. ]+\\z', '') AS _s3 FROM {prefix}2)",
        f"{prefix}4 AS (SELECT *, regexp_replace(CASE WHEN strlen(_s3) <= {n} THEN _s3 ELSE "
        f"left(_s3, list_max(list_filter(range(0, {n + 1}), lambda k: strlen(left(_s3, k)) <= {n}))) END, "
        f"'[. ]+\\z', '') AS _s4 FROM {prefix}3)",
        f"{prefix}5 AS (SELECT * EXCLUDE (_s1, _s2, _s3, _s4), "
        f"CASE WHEN _s4 = '' THEN {lit(FALLBACK_STEM)} ELSE _s4 END AS {out} FROM {prefix}4)",
    ]


def with_ctes(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
