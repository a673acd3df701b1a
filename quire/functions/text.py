"""Text expressions: image-link rewriting, log-line cleaning, math spans.

All native (``regexp_*``, ``split``, higher-order array functions), so they
run in whole-stage codegen and process whole texts.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.names import UNICODE_WS

# --- Fixed values (must equal the reference's) ---
# Image references as the parser writes them, relative to its output folder.
IMG_MD_PATTERN = r"(!\[[^\]]*\]\()images/"
IMG_HTML_PATTERN = r"""(<img[^>]+src=["'])images/"""
ANSI_PATTERN = r"\x1b\[[0-9;]*[A-Za-z]"
LINE_BREAK = r"[\r\n]"
DISPLAY_MATH = r"\$\$([\s\S]+?)\$\$"
INLINE_MATH = r"\$([^$\n]+?)\$"
MATH_PLACEHOLDER = "§§MATH{}§§"
PROGRESS_CHARS = 300
# --- end of fixed values ---

SPANS_TYPE = "array<struct<span_idx:int,display:boolean,body:string>>"

# Characters Python's str.strip() removes: Unicode white space incl. 1C-1F.
STRIP_WS = UNICODE_WS[:-1] + r"\x1c-\x1f]"
#: The same characters one by one.
STRIP_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quote_replacement(s) -> Column:
    """Make a per-row string safe as regexp_replace replacement text:
    backslash and '$' are special there (stems may contain '$')."""
    return F.replace(F.replace(_c(s), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def rewrite_image_links(markdown, images_dir) -> Column:
    """Point Markdown and HTML image links at ``images_dir`` (STRG-4).

    Only ``![..](images/`` and ``<img .. src="images/`` (either quote) are
    touched, case-sensitively; the directory is a per-row column.
    """
    rep = F.concat(F.lit("$1"), quote_replacement(images_dir), F.lit("/"))
    md = F.regexp_replace(_c(markdown), IMG_MD_PATTERN, rep)
    return F.regexp_replace(md, IMG_HTML_PATTERN, rep)


def strip_ansi(s) -> Column:
    return F.regexp_replace(_c(s), ANSI_PATTERN, "")


def strip_unicode(s) -> Column:
    """Python ``str.strip()``: trim Unicode white space at both ends.  Only the ends are looked at: a pattern would try every run of blanks."""
    return F.btrim(_c(s), F.lit(STRIP_CHARS))


def clean_line(s) -> Column:
    """One progress line: ANSI escapes removed, trimmed (STRG-5)."""
    return strip_unicode(strip_ansi(s))


def decode_lenient(b) -> Column:
    """UTF-8 decode with U+FFFD for invalid bytes (STRG-7)."""
    return F.make_valid_utf8(_c(b).cast("string"))


def complete_lines(text) -> Column:
    """Split a byte-stream's text on CR or LF and keep only finished lines:
    the last piece is the unfinished tail, which is never emitted (STRG-6, STR-5).
    Lines are cleaned; empty ones dropped."""
    parts = F.split(_c(text), LINE_BREAK, -1)
    done = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.filter(F.transform(done, clean_line), lambda l: l != "")


def truncate_progress(line) -> Column:
    return F.substring(_c(line), 1, PROGRESS_CHARS)


def math_spans(text) -> Column:
    """Math spans of a Markdown text as array<struct<span_idx, display, body>> (STRG-8).

    Pass 1 takes display spans ``$$..$$`` (may cross lines, bodies may start
    with '$'); each is replaced by a numbered placeholder.  Pass 2 takes inline
    ``$..$`` spans (one line) from the remaining text - a placeholder can be
    inside an inline body, so the numbering has to be real.  Display spans are
    numbered first, then inline ones.
    """
    t = _c(text)
    display = F.regexp_extract_all(t, F.lit(DISPLAY_MATH), 1)
    segments = F.split(t, DISPLAY_MATH, -1)
    prefix, suffix = MATH_PLACEHOLDER.split("{}")
    rebuilt = F.array_join(F.transform(
        segments, lambda s, i: F.when(i == 0, s).otherwise(
            F.concat(F.lit(prefix), (i - 1).cast("string"), F.lit(suffix), s))), "")
    inline = F.regexp_extract_all(rebuilt, F.lit(INLINE_MATH), 1)
    both = F.concat(F.transform(display, lambda b: F.struct(F.lit(True).alias("display"), b.alias("body"))),
                    F.transform(inline, lambda b: F.struct(F.lit(False).alias("display"), b.alias("body"))))
    # the number of a span is its place in the joined list
    spans = F.transform(both, lambda s, i: F.struct(i.alias("span_idx"), s["display"].alias("display"), s["body"].alias("body")))
    # Texts without a '$' have no spans: skip the three regex passes.
    return F.when(F.instr(t, "$") > 0, spans).otherwise(F.array().cast(SPANS_TYPE))
