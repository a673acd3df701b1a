"""Document extraction (UDF-1 .. UDF-6, SRC-6/7, PRJ-8).

``extract(df, parser)`` runs a user parser over many documents inside Spark
tasks with ``mapInArrow``: the parser is opened once per Python worker (models
load once), each document is parsed inside
its own try/except so one bad document yields an ``error`` row instead of a
failed task, and only slim results (Markdown, counts, blocks) come back.

The result has one row per input document (``documents_out``);
``blocks_of(result)`` explodes the content lists into the ``blocks`` table.

``text_blocks`` is the built-in plain-text/Markdown parser written with native
expressions only (no Python), so it stays inside whole-stage codegen.
"""
from __future__ import annotations

import time
import uuid
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.blocks import BLOCK_STRUCT, CONTENT_LIST
from quire.functions.options import OPTIONS_STRUCT
from quire.session import ship_package

NO_MARKDOWN_ERROR = "RuntimeError: parser produced no markdown output"


class Parser(Protocol):
    """A per-document solver.  ``open`` runs once per Python worker."""

    def open(self) -> None: ...

    def parse(self, content: Any, options: dict) -> tuple[str | None, list[dict]]: ...


#: Content that is turned into Python objects at a time, and what a row counts besides its content (its blocks' buffers).
SLICE_BYTES = 1 << 20
ROW_BYTES = 2 << 10
#: The opened parsers of this worker, newest last; a worker keeps few, so that models do not pile up.
_WORKER_PARSERS: dict[str, Any] = {}
KEEP_PARSERS = 4


def _worker_parser(key: str, parser):
    """The parser of one ``extract`` call, opened once per worker.  ``key`` is unique to the call."""
    p = _WORKER_PARSERS.pop(key, None)
    if p is None:
        parser.open()
        p = parser
        while len(_WORKER_PARSERS) >= KEEP_PARSERS:
            _WORKER_PARSERS.pop(next(iter(_WORKER_PARSERS)))
    _WORKER_PARSERS[key] = p
    return p


def _slices(rb: pa.RecordBatch):
    """Whole rows of at most SLICE_BYTES of content at a time, or one larger row: by the rows' own lengths, as long documents may stand together."""
    content, n = rb.column(1), rb.num_rows
    kinds = pa.types
    if kinds.is_string(content.type) or kinds.is_binary(content.type) or kinds.is_large_string(content.type) or kinds.is_large_binary(content.type):
        sizes = pc.fill_null(pc.binary_length(content), 0).to_pylist()
    else:
        sizes = [content.nbytes // n] * n
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size + ROW_BYTES > SLICE_BYTES:
            yield rb.slice(start, i - start)
            start, held = i, 0
        held += size + ROW_BYTES
    if n:
        yield rb.slice(start)


def _fits(value: Any, kind: T.DataType) -> bool:
    if value is None:
        return True
    if isinstance(kind, T.ArrayType):
        return isinstance(value, (list, tuple)) and all(_fits(v, kind.elementType) for v in value)
    if isinstance(kind, T.IntegerType):
        return isinstance(value, int) and not isinstance(value, bool) and -(1 << 31) <= value < 1 << 31
    return isinstance(value, str)


def checked_result(found: Any) -> tuple[str | None, list[dict] | None, str | None]:
    """(markdown, blocks, error) of what a parser returned; raises TypeError where it does not fit the result schema.

    No blocks (None) are an empty list; fields that the schema lacks are left out."""
    markdown, blocks = found
    if markdown is None:
        return None, None, NO_MARKDOWN_ERROR
    if not isinstance(markdown, str):
        raise TypeError(f"markdown is {type(markdown).__name__}, not str")
    markdown.encode()  # lone surrogates cannot be stored
    if not isinstance(blocks, (list, tuple, type(None))):
        raise TypeError(f"blocks are {type(blocks).__name__}, not list")
    kept = []
    for i, b in enumerate(blocks or ()):
        if not isinstance(b, dict):
            raise TypeError(f"block {i} is {type(b).__name__}, not dict")
        kept.append({f.name: b.get(f.name) for f in BLOCK_STRUCT.fields})
        for f in BLOCK_STRUCT.fields:
            if not _fits(b.get(f.name), f.dataType):
                raise TypeError(f"block {i}: {f.name} does not fit {f.dataType.simpleString()}")
    return markdown, kept, None


def _error(e: Exception) -> str:
    return f"{type(e).__name__}: {e}".encode("utf-8", "replace").decode()


def extract(df: DataFrame, parser, id_col: str = "doc_id", content_col: str = "content",
            options_col: str | None = None) -> DataFrame:
    """Run ``parser`` over every row; never fails a task because of one document.

    Output: id, markdown, markdown_chars, blocks, error, seconds, content_list.
    A parser that returns no Markdown (None) marks the document failed; empty Markdown is a result (PRJ-8).
    """
    return extract_routed(df, {"": parser}, F.lit(""), id_col, content_col, options_col).drop("route")


def extract_routed(df: DataFrame, parsers: dict[str, Any], route: Column, id_col: str = "doc_id", content_col: str = "content",
                   options_col: str | None = None) -> DataFrame:
    """Run every row through the parser that its ``route`` names, in one pass over the input (UDF-5).

    Output as of ``extract``, and the ``route``.  A worker opens a parser when the first row needs it and takes the rows
    of a batch route by route.  Each document stands alone: a parser that raises, that cannot be opened, or whose result does
    not fit the schema, and a route without a parser (null too) give that document an error row."""
    id_type = df.schema[id_col].dataType
    out = T.StructType([
        T.StructField(id_col, id_type),
        T.StructField("markdown", T.StringType()),
        T.StructField("markdown_chars", T.LongType()),
        T.StructField("blocks", T.LongType()),
        T.StructField("error", T.StringType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("content_list", CONTENT_LIST),
        T.StructField("route", T.StringType()),
    ])
    ship_package(df.sparkSession)
    cols = [F.col(id_col), F.col(content_col).alias("_content")]
    cols.append((F.col(options_col) if options_col else F.lit(None).cast(OPTIONS_STRUCT)).alias("_options"))
    cols.append(route.cast("string").alias("_route"))
    key = uuid.uuid4().hex

    def parse_one(name, content, options, lists):
        """(markdown, blocks as an Arrow list, error, seconds) of one document."""
        t0 = time.perf_counter()
        try:
            if name not in parsers:
                raise LookupError(f"no parser for route {name}")
            markdown, blocks, err = checked_result(_worker_parser(f"{key} {name}", parsers[name]).parse(content, options))
            blocks = None if blocks is None else pa.array([blocks], lists)
        except Exception as e:  # noqa: BLE001 - isolation is the point
            markdown, blocks, err = None, None, _error(e)
        return markdown, blocks, err, round(time.perf_counter() - t0, 6)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        lists = arrow.field("content_list").type
        for rb in (part for batch in batches for part in _slices(batch)):
            contents, options, routes = (rb.column(i).to_pylist() for i in (1, 2, 3))
            found = [None] * rb.num_rows
            for i in sorted(range(rb.num_rows), key=lambda i: (routes[i] or "", i)):
                found[i] = parse_one(routes[i], contents[i], {k: v for k, v in (options[i] or {}).items() if v is not None}, lists)
            markdown, blocks, errors, seconds = zip(*found)
            columns = [rb.column(0), pa.array(markdown, pa.string()), pa.array([None if m is None else len(m) for m in markdown], pa.int64()),
                       pa.array([None if b is None else len(b[0]) for b in blocks], pa.int64()), pa.array(errors, pa.string()), pa.array(seconds, pa.float64()),
                       pa.concat_arrays([pa.nulls(1, lists) if b is None else b for b in blocks]), pa.array(routes, pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.select(*cols).mapInArrow(run, out)


def blocks_of(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """documents_out -> blocks table (one row per block, ordinal = position)."""
    ex = result.select(id_col, F.posexplode("content_list").alias("block_idx", "_b"))
    return ex.select(id_col, F.col("block_idx").cast("int").alias("block_idx"),
                     *[F.col(f"_b.{f.name}").alias(f.name) for f in BLOCK_STRUCT.fields])


def documents_of(result: DataFrame) -> DataFrame:
    """documents_out without the content list (UDF-6: payloads stay in their own table)."""
    return result.drop("content_list")


# ---------------------------------------------------------------------------
# Built-in native text / Markdown parser
# ---------------------------------------------------------------------------
PAGE_BREAK = "\f"
NONBLANK = r"[^ \t\n\r\x0b\x0c]"
DISPLAY_MATH_LINE = r"(?s)^\$\$(.+)\$\$\z"
IMAGE_LINE = r"^!\[([^\]]*)\]\(([^)]*)\)\z"
TABLE_LINE = r"(?i)^<table"
HEADING_LINE = r"^(#{1,6}) "


def _classify(line: Column) -> Column:
    t = F.trim(line)
    return F.struct(
        F.when(t.rlike(DISPLAY_MATH_LINE), "equation").when(t.rlike(IMAGE_LINE), "image")
         .when(t.rlike(TABLE_LINE), "table").otherwise("text").alias("type"),
        t.alias("text"),
        F.when(t.rlike(DISPLAY_MATH_LINE), F.regexp_extract(t, DISPLAY_MATH_LINE, 1)).alias("latex"),
        F.when(t.rlike(IMAGE_LINE), F.regexp_extract(t, IMAGE_LINE, 2)).alias("img_path"),
        F.when(t.rlike(IMAGE_LINE) & (F.regexp_extract(t, IMAGE_LINE, 1) != ""),
               F.array(F.regexp_extract(t, IMAGE_LINE, 1))).alias("img_caption"),
        F.when(t.rlike(HEADING_LINE), F.length(F.regexp_extract(t, HEADING_LINE, 1))).alias("text_level"),
    )


def text_blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Plain text / Markdown -> blocks, natively (no Python worker).

    Pages are separated by form feeds; each non-blank line is a block, typed
    as equation ($$..$$), image (![c](p)), table (<table..) or text (with a
    heading level for '#' lines).  ``block_idx`` runs across pages: the lines of all
    pages form one array, and a line's position in it is its index.
    """
    nonblank = lambda l: l.rlike(NONBLANK)
    pages = F.split(F.col(text_col), PAGE_BREAK, -1)
    tagged = F.flatten(F.transform(pages, lambda p, i: F.transform(
        F.filter(F.split(p, r"\r?\n", -1), nonblank), lambda l: F.struct(i.alias("page"), l.alias("line")))))
    lines = df.select(F.col(id_col), F.posexplode(tagged).alias("_i", "_l")).select(
        id_col, "_i", F.col("_l.page").alias("page_idx"), F.col("_l.line").alias("_line"))
    c = _classify(F.col("_line"))
    return lines.select(
        id_col,
        F.col("_i").cast("int").alias("block_idx"),
        c["type"].alias("type"),
        F.col("page_idx").cast("int").alias("page_idx"),
        c["text"].alias("text"),
        c["latex"].alias("latex"),
        c["img_caption"].alias("img_caption"),
        c["img_path"].alias("img_path"),
        F.lit(None).cast("array<string>").alias("table_caption"),
        c["text_level"].cast("int").alias("text_level"),
    )


def text_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents_out for the native text parser: the text is its own Markdown.
    The block count is computed from the line arrays without exploding them."""
    nonblank = lambda l: l.rlike(NONBLANK)
    pages = F.split(F.col(text_col), PAGE_BREAK, -1)
    n = F.aggregate(F.transform(pages, lambda p: F.size(F.filter(F.split(p, r"\r?\n", -1), nonblank))),
                    F.lit(0), lambda a, x: a + x)
    return df.select(
        F.col(id_col),
        F.col(text_col).alias("markdown"),
        F.length(text_col).cast("bigint").alias("markdown_chars"),
        n.cast("bigint").alias("blocks"),
        F.when(F.col(text_col).isNull(), F.lit(NO_MARKDOWN_ERROR)).alias("error"),
    )


def extraction_route(method="method", has_text_layer="has_text_layer") -> Column:
    """Which parser a document goes to (UDF-5): 'txt' -> text, 'ocr' -> ocr,
    'auto' (or unset) -> text when the document has an embedded text layer,
    else ocr.  ``extract_routed`` runs the parsers; the OCR parser is user-supplied
    (no model ships with this library)."""
    m = F.coalesce(F.col(method) if isinstance(method, str) else method, F.lit("auto"))
    t = F.col(has_text_layer) if isinstance(has_text_layer, str) else has_text_layer
    return (F.when(m == "txt", "text").when(m == "ocr", "ocr")
            .when(F.coalesce(t, F.lit(False)), "text").otherwise("ocr"))


#: What a run's summary says of a document, in this order.
SUMMARY_PATHS = ("parse_dir", "markdown_path", "content_list_path", "images_dir")


def run_summary(result: DataFrame, id_col: str = "doc_id", located: DataFrame | None = None, source: Column | None = None, device: Column | None = None) -> DataFrame:
    """Machine-readable summary of an extraction run (SNK-5): ids, status, counts, and where things are, never the payloads
    (Markdown, content lists).

    ``source`` and ``device`` are expressions over the result; ``located`` holds a row per id with ``SUMMARY_PATHS`` (see
    ``artifacts.locate_outputs``), joined on the id; a document without outputs has null paths."""
    keep = [c for c in result.columns if c not in ("markdown", "content_list", id_col)]
    said = [c.alias(n) for c, n in ((source, "source"), (device, "device")) if c is not None]
    out = result.select(id_col, *said, *[c for c in keep if c not in ("source", "device") or not said])
    return out if located is None else out.join(located.select(id_col, *SUMMARY_PATHS), id_col, "left")


def write_run_summary(result: DataFrame, path: str, id_col: str = "doc_id", **about) -> None:
    run_summary(result, id_col, **about).write.mode("overwrite").json(path)
