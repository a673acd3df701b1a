"""File-name expressions: base name, stem, suffix, safe stem, display name, kind.

All functions are ``Column -> Column`` built from native Spark expressions, so
they run inside whole-stage codegen and never leave the JVM.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: these must equal the reference's for identical results ---
PDF_SUFFIXES = [".pdf"]
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".jp2", ".webp", ".gif", ".bmp", ".tiff"]
OFFICE_SUFFIXES = [".docx", ".pptx", ".xlsx"]
SUPPORTED_SUFFIXES = PDF_SUFFIXES + IMAGE_SUFFIXES + OFFICE_SUFFIXES
MAX_STEM_BYTES = 96
FALLBACK_STEM = "document"
# Characters invalid in file names on common file systems, plus C0 controls.
INVALID_NAME_CHARS = r'[<>:"/\\|?*\x00-\x1f]'
# Preview classes of the side viewer (case-insensitive suffix patterns).
PDF_PREVIEW_PATTERN = r"(?i)\.pdf\z"
IMAGE_PREVIEW_PATTERN = r"(?i)\.(png|jpe?g|webp|gif|bmp|tiff|jp2)\z"
# Media types served for originals; anything else is application/octet-stream.
MEDIA_TYPES = {
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".jp2": "image/jp2",
    ".webp": "image/webp",
    ".gif": "image/gif",
    ".bmp": "image/bmp",
    ".tiff": "image/tiff",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
DEFAULT_MEDIA_TYPE = "application/octet-stream"
# --- end of fixed values ---

# Unicode white space as Python's str.isspace sees it (C0 separators 1C-1F are
# already turned into spaces by INVALID_NAME_CHARS).  Java's plain \s is ASCII
# only and RE2's lacks \v, so the class is written out; the same text works in
# Java regex and in DuckDB's RE2.
UNICODE_WS = (r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
              r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")

STEM_PATTERN = r"(?s)^(.+)\.[^.]+\z"          # group 1 = stem when a suffix exists
SUFFIX_PATTERN = r"(?s)^.+(\.[^.]+)\z"        # group 1 = suffix ('' when none)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_name(path) -> Column:
    """Last path component, ignoring empty and '.' components (like a path's name)."""
    parts = F.filter(F.split(_col(path), "/"), lambda x: (x != "") & (x != "."))
    return F.when(_col(path).isNull(), F.lit(None)).otherwise(
        F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")))


def name_stem(name) -> Column:
    """Stem of a file name: drop the last suffix; '.pdf' and 'foo.' keep their text."""
    return F.regexp_replace(_col(name), STEM_PATTERN, "$1")


def name_suffix(name) -> Column:
    """Suffix of a file name as written ('' when none)."""
    return F.regexp_extract(_col(name), SUFFIX_PATTERN, 1)


def lower_suffix(name) -> Column:
    return F.lower(name_suffix(name))


def _rstrip_dots_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"[. ]+\z", "")


def cap_utf8_bytes(s: Column, n: int = MAX_STEM_BYTES) -> Column:
    """Longest prefix of ``s`` whose UTF-8 encoding has at most ``n`` bytes.

    Cutting the bytes at n, n-1, n-2, n-3 and keeping the first cut that is
    valid UTF-8 lands on a character boundary (a character is at most 4 bytes).
    """
    b = F.encode(s, "UTF-8")
    cuts = [F.try_validate_utf8(F.substring(b, 1, k).cast("string")) for k in range(n, n - 4, -1)]
    return F.when(F.octet_length(s) <= n, s).otherwise(F.coalesce(*cuts))


def sanitize_stem(name) -> Column:
    """File-system-safe stem of an original file name (STRG-1).

    stem -> invalid characters to spaces -> white-space runs to one space ->
    strip -> drop trailing dots/spaces -> cap at 96 UTF-8 bytes (and drop
    trailing dots/spaces again) -> 'document' when nothing is left.
    """
    s = name_stem(base_name(name))
    s = F.regexp_replace(s, INVALID_NAME_CHARS, " ")
    s = F.regexp_replace(s, UNICODE_WS + "+", " ")
    s = _rstrip_dots_spaces(F.trim(s))
    s = _rstrip_dots_spaces(cap_utf8_bytes(s))
    return F.when(s == "", F.lit(FALLBACK_STEM)).otherwise(s)


def display_name(name) -> Column:
    """Library display name: drop the last '.ext' ('.pdf' alone becomes '')."""
    return F.regexp_replace(_col(name), r"\.[^.]+\z", "")


def file_kind(name) -> Column:
    """pdf / image / office / unsupported by lower-cased suffix (PRJ-1)."""
    sfx = lower_suffix(name)
    return (F.when(sfx.isin(PDF_SUFFIXES), "pdf")
            .when(sfx.isin(IMAGE_SUFFIXES), "image")
            .when(sfx.isin(OFFICE_SUFFIXES), "office")
            .otherwise("unsupported"))


def is_supported(name) -> Column:
    """Server-side admission: the name's suffix (Path rules) is supported."""
    return lower_suffix(name).isin(SUPPORTED_SUFFIXES)


def is_supported_client(name) -> Column:
    """Browser-side admission: text from the last dot on, so '.pdf' alone passes."""
    ext = F.lower(F.regexp_extract(_col(name), r"(?s)(\.[^.]*)\z", 1))
    return ext.isin(SUPPORTED_SUFFIXES)


def media_type(name) -> Column:
    """MIME type of an original by suffix, octet-stream when unknown (SRC-13)."""
    m = F.create_map(*[x for k, v in MEDIA_TYPES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, lower_suffix(name)), F.lit(DEFAULT_MEDIA_TYPE))


def preview_class(name) -> Column:
    """Side-viewer class: pdf, image or other."""
    n = _col(name)
    return (F.when(n.rlike(PDF_PREVIEW_PATTERN), "pdf")
            .when(n.rlike(IMAGE_PREVIEW_PATTERN), "image")
            .otherwise("other"))
