"""Block-level expressions: preview text, page-range predicate, stage toggles."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values (must equal the reference's) ---
PREVIEW_CHARS = 220
TABLE_PLACEHOLDER = "[table]"
# --- end of fixed values ---

BLOCK_STRUCT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("page_idx", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("latex", T.StringType()),
    T.StructField("img_caption", T.ArrayType(T.StringType())),
    T.StructField("img_path", T.StringType()),
    T.StructField("table_caption", T.ArrayType(T.StringType())),
    T.StructField("text_level", T.IntegerType()),
])
CONTENT_LIST = T.ArrayType(BLOCK_STRUCT)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def block_preview(type_="type", text="text", latex="latex", img_caption="img_caption",
                  img_path="img_path", table_caption="table_caption",
                  limit: int = PREVIEW_CHARS) -> Column:
    """Per-type fallback chain, cut to ``limit`` characters (PRJ-3, ARR-1).

    image: captions joined by spaces, else img_path; table: captions, else
    '[table]'; equation: text, else latex; anything else: text.  Empty strings
    fall through; null caption items render as '' but keep their separator.
    """
    def joined(arr):
        return _nonempty(F.array_join(_c(arr), " ", ""))

    t = _c(type_)
    full = (F.when(t == "image", F.coalesce(joined(img_caption), _nonempty(_c(img_path)), F.lit("")))
            .when(t == "table", F.coalesce(joined(table_caption), F.lit(TABLE_PLACEHOLDER)))
            .when(t == "equation", F.coalesce(_nonempty(_c(text)), _nonempty(_c(latex)), F.lit("")))
            .otherwise(F.coalesce(_nonempty(_c(text)), F.lit(""))))
    return F.substring(full, 1, limit)


def page_in_range(page_idx="page_idx", start="start_page", end="end_page") -> Column:
    """0-indexed page range, end inclusive, null end = to the last page (PRJ-4).
    A null start means the default 0."""
    p = _c(page_idx)
    s = F.coalesce(_c(start), F.lit(0))
    e = _c(end)
    return (p >= s) & (e.isNull() | (p <= e))


def stage_allows(type_="type", formula="formula", table="table") -> Column:
    """Formula / table recognition switched off -> such blocks are not produced (PRJ-5).
    Null switches mean the defaults (on)."""
    t = _c(type_)
    f_on = F.coalesce(_c(formula), F.lit(True))
    t_on = F.coalesce(_c(table), F.lit(True))
    return ~(((t == "equation") & ~f_on) | ((t == "table") & ~t_on))
