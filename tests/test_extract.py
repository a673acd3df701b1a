from pyspark.sql import functions as F

from quire.operators import extract as X
from quire.operators.parsers import HtmlParser
from tests.conftest import SF_SMALL


class Flaky:
    opened = 0

    def open(self):
        Flaky.opened += 1

    def parse(self, content, options):
        if "boom" in content:
            raise ValueError("bad page")
        if content == "":
            return "", []
        return content.upper(), [{"type": "text", "text": content, "page_idx": 0}]


def test_failures_are_isolated_per_document(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "boom"), (3, ""), (4, "fine")], "doc_id long, content string")
    out = {r.doc_id: r for r in X.extract(df, Flaky()).collect()}
    assert out[1].markdown == "OK" and out[1].blocks == 1 and out[1].error is None
    assert out[2].error == "ValueError: bad page" and out[2].markdown is None
    assert out[3].error is None and out[3].markdown == "" and out[3].blocks == 0  # empty Markdown is a result
    assert out[4].markdown_chars == 4


def test_html_blocks_match_document_counts(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").withColumnRenamed("page_id", "doc_id")
    res = X.extract(pages, HtmlParser(), "doc_id", "html")
    counts = X.blocks_of(res).groupBy("doc_id").count()
    j = X.documents_of(res).join(counts, "doc_id", "left")
    assert j.filter(F.coalesce(F.col("count"), F.lit(0)) != F.col("blocks")).count() == 0
    assert res.filter(F.col("error").isNotNull()).count() == 0
    # the script's '</p>' never becomes text, every page has its title block
    b = X.blocks_of(res)
    assert b.filter(F.col("text").contains("track(")).count() == 0
    assert b.filter("type = 'title'").select("doc_id").distinct().count() == pages.count()


def test_text_blocks_pages_and_types(spark):
    df = spark.createDataFrame([(1, "# Title\n\n$$x^2$$\n![cap](images/a.png)\fpage two\n<table><tr></tr></table>\n")],
                               "doc_id long, text string")
    b = [(r.block_idx, r.page_idx, r.type, r.text_level, r.latex, r.img_path)
         for r in X.text_blocks(df).orderBy("block_idx").collect()]
    assert b == [(0, 0, "text", 1, None, None), (1, 0, "equation", None, "x^2", None),
                 (2, 0, "image", None, None, "images/a.png"), (3, 1, "text", None, None, None),
                 (4, 1, "table", None, None, None)]
    d = X.text_documents(df).first()
    assert d.blocks == 5


def test_routing(spark):
    df = spark.createDataFrame([("txt", False), ("ocr", True), ("auto", True), ("auto", False), (None, None)],
                               "method string, has_text_layer boolean")
    assert [r.r for r in df.select(X.extraction_route().alias("r")).collect()] == ["text", "ocr", "text", "ocr", "ocr"]


def test_run_summary_has_no_payloads(spark, tmp_path):
    df = spark.createDataFrame([(1, "ok"), (2, "boom")], "doc_id long, content string")
    res = X.extract(df, Flaky())
    X.write_run_summary(res, str(tmp_path / "summary"))
    back = spark.read.json(str(tmp_path / "summary"))
    assert "markdown" not in back.columns and "content_list" not in back.columns
    assert {r.doc_id: r.blocks for r in back.collect()} == {1: 1, 2: None}


class Named:
    def __init__(self, name):
        self.name = name

    def open(self):
        pass

    def parse(self, content, options):
        return (None if content == "none" else f"{self.name}:{content}"), []


def test_each_call_uses_its_own_parser(spark):
    df = spark.createDataFrame([(1, "x"), (2, "none")], "doc_id long, content string")
    for name in "abcdef":  # a parser that is gone may leave its id to the next one
        rows = {r.doc_id: r for r in X.extract(df, Named(name)).collect()}
        assert rows[1].markdown == f"{name}:x" and rows[2].error == X.NO_MARKDOWN_ERROR


def test_text_blocks_number_lines_across_pages(spark):
    text = "\f".join(f"a{i}\n\nb{i}" for i in range(300))
    got = X.text_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("block_idx").collect()
    assert [(r.block_idx, r.page_idx, r.text) for r in got] == [(2 * i + k, i, f"{c}{i}") for i in range(300) for k, c in enumerate("ab")]


class Odd:
    """Returns what its content says."""

    RESULTS = {"none": ("x", None), "level": ("x", [{"text_level": "big"}]), "huge": ("x", [{"page_idx": 1 << 40}]), "text": ("x", "abc"), "item": ("x", [None]),
               "number": (5, []), "half": ("\ud800", []), "short": ("x",), "caption": ("x", [{"img_caption": ["a", 1]}]), "flag": ("x", [{"text_level": True}]),
               "extra": ("x", [{"text": "t", "other": object()}]), "ok": ("x", [{"text": "t", "img_caption": ["a", None]}])}

    def open(self):
        pass

    def parse(self, content, options):
        return self.RESULTS[content]


def test_results_that_do_not_fit_are_error_rows(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([*Odd.RESULTS, "missing"])], "doc_id long, content string").coalesce(1)
    out = {c: r for c, r in zip([*Odd.RESULTS, "missing"], X.extract(df, Odd()).orderBy("doc_id").collect())}
    assert {c for c, r in out.items() if r.error is None} == {"none", "extra", "ok"}
    assert out["none"].blocks == 0 and out["ok"].content_list[0].img_caption == ["a", None] and out["extra"].content_list[0].text == "t"
    assert all(r.markdown is None and r.blocks is None and r.content_list is None for r in out.values() if r.error)
    assert out["missing"].error == "KeyError: 'missing'" and out["level"].error == "TypeError: block 0: text_level does not fit int"


class Counted(Flaky):
    """Says which parser instance of the worker took a row."""

    def __init__(self, name, fails=False):
        self.name, self.fails, self.opens = name, fails, 0

    def open(self):
        if self.fails:
            raise OSError("no model")
        self.opens += 1

    def parse(self, content, options):
        return f"{self.name} {self.opens} {content}", []


def test_routes_run_their_parsers_in_one_pass(spark):
    rows = [(i, f"c{i}", r) for i, r in enumerate(["text", "ocr", None, "text", "gone", "broken", "ocr"] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, content string, r string").coalesce(1)
    out = X.extract_routed(df, {"text": Counted("T"), "ocr": Counted("O"), "broken": Counted("B", True)}, F.col("r"))
    got = {r.doc_id: r for r in out.collect()}
    for i, c, r in rows:
        want = {"text": (f"T 1 {c}", None), "ocr": (f"O 1 {c}", None), "broken": (None, "OSError: no model")}.get(r, (None, f"LookupError: no parser for route {r}"))
        assert (got[i].markdown, got[i].error) == want and got[i].route == r
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert X.extract_routed(df.limit(0), {}, F.col("r")).count() == 0


def test_extract_ships_the_package_on_any_session(tmp_path):
    """A session that knows nothing of the library, and workers that do not find it on their path."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "plain.py"
    script.write_text(f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / 'ckpt')!r}).getOrCreate()
sys.path.insert(0, {root!r})
from quire.operators.extract import extract
from quire.operators.parsers import HtmlParser
df = spark.createDataFrame([(1, "<p>hello</p>")], "doc_id long, content string")
print("RESULT", extract(df, HtmlParser()).first().markdown)
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=170)
    assert "RESULT hello" in done.stdout, done.stderr[-2000:]


def test_run_summary_names_source_device_and_paths(spark):
    result = spark.createDataFrame([(1, "md", 2, [], "a.pdf"), (2, None, None, None, "b.pdf")],
                                   "doc_id long, markdown string, blocks long, content_list array<string>, source string")
    located = spark.createDataFrame([(1, "output/1/auto", "output/1/auto/a.md", None, "output/1/auto/images", "m.json")],
                                    "doc_id long, parse_dir string, markdown_path string, content_list_path string, images_dir string, middle_json_path string")
    out = X.run_summary(result, located=located, source=F.concat(F.lit("/in/"), "source"), device=F.lit("cpu"))
    assert out.columns == ["doc_id", "source", "device", "blocks", "parse_dir", "markdown_path", "content_list_path", "images_dir"]
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [
        (1, "/in/a.pdf", "cpu", 2, "output/1/auto", "output/1/auto/a.md", None, "output/1/auto/images"), (2, "/in/b.pdf", "cpu", None, None, None, None, None)]
    assert X.run_summary(result).columns == ["doc_id", "blocks", "source"]


def test_slices_go_by_the_rows_own_lengths():
    import pyarrow as pa

    for kind in (pa.string(), pa.binary(), pa.large_string()):
        sizes = [10] * 9000 + [600_000] * 40 + [5 << 20] + [0] * 200
        texts = ["x" * n for n in sizes]
        rb = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array([*texts[:-1], None], pa.string()).cast(kind)], names=["doc_id", "content"])
        parts = list(X._slices(rb))
        assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([rb]))
        held = [(p.num_rows, sum(sizes[i] for i in p.column(0).to_pylist())) for p in parts]
        assert all(n == 1 or size <= 1 << 20 for n, size in held), held
        assert max(n for n, _ in held) <= 600  # rows with little content have blocks and buffers too
        assert not list(X._slices(rb.slice(0, 0)))
