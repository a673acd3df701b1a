"""Framing of captured logs that are stored as chunks of bytes (STR-5, STRG-5/6/7 at rest).

A log of any size is framed by many tasks: no log is ever put together.  Every chunk is read on its own as

* the piece before its first line break (the end of a line that an earlier chunk began),
* whole lines,
* the piece after its last break (the beginning of a line that a later chunk ends).

A chunk without a break is one piece that only carries on.  The pieces of a line share the number
of chunks with a break that come before the line's end, a running count over one narrow row per chunk; they are
joined as bytes before they are decoded, so a character cut by a chunk's border is whole again.
A second running sum, of the lines that stay, numbers the lines.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import clean_line, decode_lenient
from quire.operators.sequence import MIN_HOT_ROWS, running_count_within_key, running_sum_within_key
from quire.session import materialize

#: One character per byte: lets string functions cut bytes without decoding them.
BYTEWISE = "ISO-8859-1"


def _line(piece):
    return clean_line(decode_lenient(F.encode(piece, BYTEWISE)))


def _meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Shuffled join where null equals null; ``right`` has one row per key and grows with the logs."""
    renamed = right.select(*[F.col(k).alias(f"_r{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(renamed, [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys], how).drop(*[f"_r{k}" for k in keys])


def frame_chunks(chunks: DataFrame, log_col: str = "doc_id", pos_col: str = "pos", data_col: str = "chunk",
                 min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Columns ``log_col``, ``line_idx`` (from 0, over the lines that stay) and ``line`` of chunked logs.

    Lines end at CR or LF, are decoded leniently, cleaned, and dropped if nothing is left; what
    follows a log's last break is unfinished and never comes out.  Null and empty chunks add nothing;
    a null log id is a log of its own; positions must be unique inside a log.  Other columns are ignored.
    One line is one value: a line's pieces meet in one task, an unfinished tail's never do.

    The chunks are read twice: for the narrow rows, and for the whole lines, which meet their number by (log, position)."""
    spark = chunks.sparkSession
    text = F.decode(F.coalesce(F.col(data_col), F.lit(b"")), BYTEWISE)
    parts = F.split(F.replace(text, F.lit("\r"), F.lit("\n")), "\n", -1)  # as at LINE_BREAK, but by one character, which needs no pattern
    cut = chunks.select(F.col(log_col).alias("_log"), F.col(pos_col).alias("_pos"), parts.alias("_parts"))
    inner = F.filter(F.transform(F.slice("_parts", 2, F.greatest(F.size("_parts") - 2, F.lit(0))), _line), lambda x: x != "")
    several = F.size("_parts") > 1
    narrow = materialize(cut.select(
        "_log", "_pos", several.alias("_cut"), F.size(inner).alias("_inner"),
        F.element_at("_parts", 1).alias("_head"), F.when(several, F.element_at("_parts", -1)).alias("_tail")), "log_pieces")

    counted = running_count_within_key(narrow, ["_log"], ["_pos"], F.col("_cut"), "_nth", min_hot_rows, total="_closed")
    # a head ends the line that was open before its chunk, a tail opens the line after it
    ends = F.col("_cut").cast("int")
    pieces = counted.select("_log", "_pos", "_closed", F.explode(F.array(
        F.struct((F.col("_nth") - ends).alias("nth"), F.col("_head").alias("piece"), F.col("_cut").alias("ends")),
        F.struct(F.col("_nth").alias("nth"), F.col("_tail").alias("piece"), F.lit(False).alias("ends")))).alias("_p"))
    # only lines that some chunk ends are put together: a long log without a break gathers nowhere
    pieces = pieces.select("_log", "_pos", "_closed", "_p.*").filter("piece IS NOT NULL AND nth < _closed AND (piece <> '' OR ends)")
    joined = pieces.groupBy("_log", "nth").agg(
        F.max(F.when(F.col("ends"), F.col("_pos"))).alias("_pos"), F.sort_array(F.collect_list(F.struct("_pos", "piece"))).alias("_all"))
    # lines left empty go after the write: a filter before it would clean every line twice
    edges = joined.select("_log", "_pos", _line(F.array_join(F.col("_all.piece"), "")).alias("line"))
    edges = materialize(edges, "log_edges").filter("line <> ''")

    # the running sum sees which chunks end a line, not the line
    kept = _meet(narrow.select("_log", "_pos", "_inner"), edges.select("_log", "_pos", F.lit(1).alias("_edge")), ["_log", "_pos"], "left")
    kept = kept.select("_log", "_pos", (F.col("_inner") + F.coalesce(F.col("_edge"), F.lit(0))).alias("_n")).filter("_n > 0")
    numbered = running_sum_within_key(kept, ["_log"], ["_pos"], F.col("_n"), "_upto", min_hot_rows)
    places = materialize(numbered.select("_log", "_pos", (F.col("_upto") - F.col("_n")).alias("_from")), "log_places")

    # a place has a line at least, so none is null; without "outer" a check of the array's size would clean its lines twice
    found = _meet(_meet(cut, places, ["_log", "_pos"]), edges.withColumnRenamed("line", "_first"), ["_log", "_pos"], "left")
    lines = found.select(
        "_log", "_from", F.posexplode_outer(F.concat(F.filter(F.array("_first"), lambda x: x.isNotNull()), inner)).alias("_i", "line"))
    return lines.select(F.col("_log").alias(log_col), (F.col("_from") + F.col("_i")).cast("bigint").alias("line_idx"), "line")
