import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quire.operators.artifacts import list_tree, locate_outputs, scan_documents, scan_files, suffix_glob
from quire.sources.artifacts_io import get_doc, image_inventory, read_content_lists, read_markdown


def _tree(files):
    root = tempfile.mkdtemp(prefix="quire-src-")
    for rel, data in files.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as fh:
            fh.write(data if isinstance(data, bytes) else data.encode())
    return root


def test_scan_keeps_supported_case_insensitively(spark):
    root = _tree({"a.pdf": "x", "sub/b.PDF": "xy", "c.txt": "z", "d.Docx": "w", "e.jpeg": "v", "sub/f.md": "u"})
    names = sorted(r.name for r in scan_documents(spark, [root]).collect())
    assert names == ["a.pdf", "b.PDF", "d.Docx", "e.jpeg"]
    ordered = [r.path.split(root)[-1] for r in scan_documents(spark, [root], ordered=True).collect()]
    assert ordered == ["/a.pdf", "/d.Docx", "/e.jpeg", "/sub/b.PDF"]
    empty = _tree({"x.txt": "no"})
    with pytest.raises(Exception, match="no file of a supported kind"):
        scan_documents(spark, [empty], require=True)
    assert "[pP][dD][fF]" in suffix_glob()


def test_explicit_files_skip_the_suffix_check_and_missing_fails(spark):
    root = _tree({"notes.txt": "abc"})
    assert scan_files(spark, [os.path.join(root, "notes.txt")]).first().length == 3
    with pytest.raises(Exception):
        scan_files(spark, [os.path.join(root, "missing.pdf")]).collect()


def test_tree_listing_sorts_by_components(spark):
    root = _tree({"a-b/x": "1", "a/x": "2", "a/y/z": "3"})
    assert [r.rel_path for r in list_tree(spark, root).collect()] == ["a/x", "a/y/z", "a-b/x"]


def test_locate_prefers_exact_then_smallest(spark):
    rows = [(1, "d", "s", "s.md"), (1, "d", "s", "a.md"), (1, "d", "s", "z_content_list.json"),
            (1, "d", "s", "images/1.png"), (2, "e", "t", "b.md"), (2, "e", "t", "a.md")]
    df = spark.createDataFrame(rows, "doc_id long, parse_dir string, stem string, file_name string")
    got = {r.doc_id: r for r in locate_outputs(df).collect()}
    assert got[1].markdown_path == "d/s.md" and got[1].content_list_path == "d/z_content_list.json"
    assert got[1].middle_json_path is None and got[1].images_dir == "d/images"
    assert got[2].markdown_path == "e/a.md" and got[2].images_dir is None


def test_storage_readers(spark):
    cl = json.dumps([{"type": "text", "text": "hi", "page_idx": 0}, {"type": "table", "page_idx": 1}])
    root = _tree({"1/doc/auto/doc.md": "# T\n\nbody é", "1/doc/auto/doc_content_list.json": cl,
                  "1/doc/auto/images/b.jpg": b"\x00\x01", "1/doc/auto/images/a.jpg": b"\x02"})
    docs = spark.createDataFrame([("1", "1/doc/auto/doc.md"), ("2", "2/x.md")], "id string, markdown_path string")
    md = {r.id: r.markdown for r in read_markdown(spark, root, docs).collect()}
    assert md == {"1": "# T\n\nbody é", "2": ""}
    blocks = read_content_lists(spark, root).orderBy("block_idx").collect()
    assert [(b.block_idx, b.type) for b in blocks] == [(0, "text"), (1, "table")]
    inv = [(r.image_name, r.length) for r in image_inventory(spark, root).collect()]
    assert inv == [("a.jpg", 1), ("b.jpg", 2)]
    assert get_doc(docs, "2").count() == 1


def test_package_is_shipped_through_shared_storage(spark):
    import io
    import zipfile

    from quire.session import checkpoint_dir

    assert getattr(spark.sparkContext, "_quire_shipped", False)
    root = checkpoint_dir(spark).replace("file:", "")
    zips = [os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f == "quire.zip"]
    assert zips
    names = zipfile.ZipFile(io.BytesIO(open(zips[0], "rb").read())).namelist()
    assert "quire/__init__.py" in names and "quire/operators/throttle.py" in names


def test_a_tree_is_listed_and_read_in_few_tasks(spark):
    """A task for every few files took most of the time (before: about a task per 8 files here, 4 MB of open cost each)."""
    from quire.sources.listing import list_files

    tree = {f"d{i % 40}/e/n {i}%20#é.md": f"text {i}" for i in range(400)} | {"_h/x.md": "no", ".h/x.md": "no", "d0/_y.md": "no", "d0/k=v/_a=b.md": "yes", "d0/X.MD": "no"}
    root = _tree(tree)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        files = list_files(spark, root, r".*\.md", "*.md", content=True)
        want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root).select(*files.columns)
        assert want.rdd.getNumPartitions() > 50 and files.rdd.getNumPartitions() <= max(8, spark.sparkContext.defaultParallelism)
        assert sorted(files.collect()) == sorted(want.collect()) and files.count() == 401
        globbed = list_files(spark, f"{root}/d*", r".*\.md", "*.md")  # left to binaryFile
        assert globbed.count() == 401 and globbed.rdd.getNumPartitions() <= max(8, spark.sparkContext.defaultParallelism)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_markdown_is_not_sent_through_the_driver(spark):
    """The texts were joined as a broadcast: their size was taken for that of the files' names."""
    root = _tree({f"{i}/doc.md": f"é {i} " * 40_000 for i in range(40)} | {"x/doc.md": "not asked for", "0/doc.txt": "no"})
    rows = [(i, f"{i}/doc.md") for i in range(42)] + [(100, "0/doc.md"), (101, None)]
    for id_col, path_col in [("id", "markdown_path"), ("path", "_rel")]:
        docs = spark.createDataFrame(rows, f"{id_col} long, {path_col} string")
        df = read_markdown(spark, root, docs, path_col, id_col)
        got = {r[0]: (r.markdown, r.found) for r in df.collect()}
        assert df.columns == [id_col, "markdown", "found"]
        assert got == {i: (f"é {i} " * 40_000, True) if i < 40 else ("", False) for i in range(42)} | {100: ("é 0 " * 40_000, True), 101: ("", False)}
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    globbed = read_markdown(spark, f"{root}/*", spark.createDataFrame([(1, f"{root}/1/doc.md"), (2, None)], "id long, markdown_path string"))
    assert {r.id: (len(r.markdown), r.found) for r in globbed.collect()} == {1: (160_000, True), 2: (0, False)}
