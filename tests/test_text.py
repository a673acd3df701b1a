from pyspark.sql import functions as F

from quire.functions import text as TX
from tests.conftest import one_col


def test_link_rewrite_golden(spark):
    cases = [
        ("![x](images/1.jpg)", "A$1_images", "![x](A$1_images/1.jpg)"),
        ("<img alt=\"q\" src='images/2.png'>", "A$1_images", "<img alt=\"q\" src='A$1_images/2.png'>"),
        ("![](images/images/1.png)", "d", "![](d/images/1.png)"),
        ("[x](images/1.jpg)", "d", "[x](images/1.jpg)"),
        ("![a]b](images/1.jpg)", "d", "![a]b](images/1.jpg)"),
        ("![x](./images/1.jpg)", "d", "![x](./images/1.jpg)"),
        ("<IMG src=\"images/1.png\">", "d", "<IMG src=\"images/1.png\">"),
        ("![x](images/a.png) and ![y](images/b.png)", "back\\slash", "![x](back\\slash/a.png) and ![y](back\\slash/b.png)"),
    ]
    df = spark.createDataFrame(cases, "md string, d string, want string")
    for r in df.select("want", TX.rewrite_image_links("md", "d").alias("got")).collect():
        assert r.got == r.want


def test_log_lines_golden(spark):
    chunk = "a\x1b[31mred\x1b[0m\rp 10%\r\n  \ntail"
    got = one_col(spark, [chunk]).select(TX.complete_lines("v").alias("l")).first().l
    assert got == ["ared", "p 10%"]


def test_log_lines_unicode_strip_and_cap(spark):
    chunk = "　 x  \n" + "y" * 400 + "\n"
    got = one_col(spark, [chunk]).select(F.transform(TX.complete_lines("v"), TX.truncate_progress).alias("l")).first().l
    assert got == ["x", "y" * 300]


def test_math_spans_two_passes(spark):
    def spans(text):
        r = one_col(spark, [text]).select(TX.math_spans("v").alias("m")).first().m
        return [(s.span_idx, s.display, s.body) for s in r]

    assert spans("a $x$ b $$y\nz$$ c") == [(0, True, "y\nz"), (1, False, "x")]
    # the inline pass must not swallow the display placeholder
    assert spans("$5 and $$x$$ and $6") == [(0, True, "x"), (1, False, "5 and §§MATH0§§ and ")]
    assert spans("$$$a$$") == [(0, True, "$a")]
    assert spans("no math here") == []
    assert spans("$a\nb$") == []


def test_strip_looks_at_the_ends_only(spark):
    """Long runs of blanks inside a line: a pattern that tries each of them takes minutes for this one."""
    import sys
    import time

    assert set(TX.STRIP_CHARS) == {c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()}
    blanks = TX.STRIP_CHARS
    texts = ["", blanks, f"{blanks}a{blanks}é{blanks}", "a", None, f" a{' ' * 200_000}b\u3000"]
    t0 = time.monotonic()
    got = [r.s for r in one_col(spark, texts).select("v", TX.strip_unicode("v").alias("s")).collect()]
    assert time.monotonic() - t0 < 30
    assert got == [None if x is None else x.strip() for x in texts]
