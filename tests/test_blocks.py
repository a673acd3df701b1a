import json

from pyspark.sql import functions as F

from quire.operators import blocks as B


def test_preview_golden(spark):
    rows = [
        ("image", None, None, ["c", "d"], None, None),
        ("image", None, None, [], "p", None),
        ("image", None, None, ["a", None, "b"], None, None),
        ("table", None, None, None, None, None),
        ("table", None, None, None, None, ["t1"]),
        ("equation", "", "L", None, None, None),
        ("list", "t", None, None, None, None),
        ("text", None, None, None, None, None),
        ("text", "x" * 300, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "type string, text string, latex string, img_caption array<string>, "
                                     "img_path string, table_caption array<string>")
    got = [r.preview for r in B.with_preview(df).collect()]
    assert got == ["c d", "p", "a  b", "[table]", "t1", "L", "t", "", "x" * 220]


def test_content_list_keeps_order_and_unknown_fields(spark):
    js = ('[{"type":"text","text":"a","page_idx":0,"extra":{"k":1}},'
          '{"type":"image","img_path":"images/x.jpg","img_caption":["cap"],"page_idx":1},'
          '{"type":"equation","latex":"x^2","page_idx":1}]')
    df = spark.createDataFrame([(1, js), (2, "not json"), (3, None)], "doc_id long, content_list_json string")
    b = B.blocks_from_content_list(df).orderBy("doc_id", "block_idx").collect()
    assert [(r.doc_id, r.block_idx, r.type) for r in b] == [(1, 0, "text"), (1, 1, "image"), (1, 2, "equation")]
    assert b[1].img_caption == ["cap"]
    raw = B.blocks_from_content_list(df).filter("block_idx = 0").select(
        F.variant_get("raw", "$.extra.k", "int").alias("k")).first()
    assert raw.k == 1
    # filtering keeps the original ordinal
    f = B.filter_type(B.blocks_from_content_list(df), "equation").first()
    assert f.block_idx == 2


def test_page_range_and_toggles(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["text", "table", "equation", "text"])],
                               "page_idx int, type string")
    sel = lambda s, e: [r.page_idx for r in B.select_pages(df.withColumn("start_page", F.lit(s).cast("int"))
                                                       .withColumn("end_page", F.lit(e).cast("int"))).collect()]
    assert sel(1, 2) == [1, 2]
    assert sel(2, None) == [2, 3]
    assert sel(None, 0) == [0]
    off = B.apply_stage_toggles(df.withColumn("formula", F.lit(False)).withColumn("table", F.lit(None).cast("boolean")))
    assert [r.type for r in off.collect()] == ["text", "table", "text"]


def test_block_types_and_summary(spark):
    df = spark.createDataFrame([(1, "b", "xy"), (1, "a", "z"), (1, "b", None), (2, "a", "")],
                               "doc_id long, type string, text string")
    t = {r.doc_id: (r.types, r.label) for r in B.block_types(df).collect()}
    assert t == {1: ("a,b", "all (3)"), 2: ("a", "all (1)")}
    s = {r.doc_id: (r.blocks, r.markdown_chars) for r in B.doc_summary(df).collect()}
    assert s == {1: (3, 3 + 4), 2: (1, 0)}


def test_block_json_keeps_all_fields(spark):
    src = '[{"type":"image","page_idx":0,"img_caption":["a"],"img_path":"p","bbox":[1,2]},{"type":"equation","page_idx":1,"latex":"x"}]'
    b = B.blocks_from_content_list(spark.createDataFrame([(1, src)], "doc_id long, content_list_json string"))
    got = [json.loads(r.json) for r in B.block_json(b).orderBy("block_idx").collect()]
    assert got == json.loads(src)
    typed = [json.loads(r.json) for r in B.block_json(b.drop("raw")).orderBy("block_idx").collect()]
    assert typed[0]["img_caption"] == ["a"] and typed[0]["img_path"] == "p" and typed[1]["latex"] == "x"
