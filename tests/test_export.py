import os
import tempfile

from pyspark.sql import functions as F

from quire.operators.export import export_count, export_files
from quire.sources.files_sink import write_files


def _inputs(spark):
    lib = spark.createDataFrame([
        ("d1", "Report.pdf", "Report", "p/1.md", "p/1/images"),
        ("d2", "report.PDF", "report", "p/2.md", None),
        ("d3", "A$1.pdf", "A$1", "p/3.md", "p/3/images"),
        ("d4", "none.pdf", "none", None, None),
        ("d5", "gone.pdf", "gone", "p/5.md", None)],
        "id string, original_name string, stem string, markdown_path string, images_dir string")
    md = spark.createDataFrame([("d1", "![f](images/x.png)"), ("d2", "plain"), ("d3", "<img src=\"images/y.png\">")],
                               "id string, markdown string")
    img = spark.createDataFrame([("d1", "x.png", bytearray(b"PNG")), ("d3", "y.png", bytearray(b"P2"))],
                                "id string, image_name string, content binary")
    sel = spark.createDataFrame([(1, "d1"), (2, "d2"), (3, "d4"), (4, "zz"), (5, "d1"), (6, "d3"), (7, "d5")],
                                "ord long, id string")
    return sel, lib, md, img


def test_export_names_links_and_files(spark):
    sel, lib, md, img = _inputs(spark)
    files = export_files(sel, lib, md, img, "md+images")
    got = {r.file_name: bytes(r.content) for r in files.collect()}
    assert set(got) == {"Report.md", "report (2).md", "Report (3).md", "A$1.md",
                        "Report_images/x.png", "Report (3)_images/x.png", "A$1_images/y.png"}
    assert got["Report.md"] == b"![f](Report_images/x.png)"
    assert got["Report (3).md"] == b"![f](Report (3)_images/x.png)"
    assert got["A$1.md"] == b'<img src="A$1_images/y.png">'
    assert got["report (2).md"] == b"plain"
    c = export_count(files).first()
    assert (c.documents, c.files, c.empty) == (4, 7, False)

    md_only = {r.file_name for r in export_files(sel, lib, md, img, "md-only").collect()}
    assert md_only == {"Report.md", "report (2).md", "Report (3).md", "A$1.md"}

    out = tempfile.mkdtemp(prefix="quire-export-")
    write_files(files, out)
    assert open(os.path.join(out, "Report_images", "x.png"), "rb").read() == b"PNG"
    assert open(os.path.join(out, "A$1.md")).read() == '<img src="A$1_images/y.png">'
    listed = [x for f in os.listdir(os.path.join(out, "_FILES")) if f.startswith("part-") for x in open(os.path.join(out, "_FILES", f)).read().splitlines()]
    assert sorted(listed) == sorted(got)


def test_empty_export_is_flagged(spark):
    sel, lib, md, img = _inputs(spark)
    none = export_files(sel.filter(F.col("id") == "zz"), lib, md, img)
    assert export_count(none).first().empty


def test_export_to_writes_and_refuses_empty(spark):
    import pytest

    from quire.operators.export import EmptyExportError, export_to

    sel, lib, md, img = _inputs(spark)
    out = tempfile.mkdtemp(prefix="quire-export-")
    assert export_to(sel, lib, md, out, img, "md+images") == 4
    assert os.path.exists(os.path.join(out, "report (2).md"))
    with pytest.raises(EmptyExportError):
        export_to(sel.filter(F.col("id") == "zz"), lib, md, tempfile.mkdtemp(prefix="quire-export-"))
