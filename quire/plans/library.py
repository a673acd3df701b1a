"""Library queries over a change log derived from ``orders`` (FIXTURES.md §2),
plus artifact location, path normalisation and stable ids over ``documents``."""
from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import paths as P
from quire.functions.names import sanitize_stem
from quire.operators import library as L
from quire.operators.artifacts import locate_outputs
from quire.operators.buckets import commit_changes, read_buckets
from quire.operators.extract import run_summary, text_documents
from quire.plans import extraction as X
from quire.plans import sqlfrag as Q
from quire.session import read_table, scratch_path
from quire.sources import fixtures as FX

QUERIES = {}
ORACLE = {}


def change_log(spark, sf_dir):
    """id = customer, seq = order key; an 'F' order whose key is a multiple of 5
    deletes the customer's document, every other order upserts it."""
    o = read_table(spark, sf_dir, "orders")
    op = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 5 == 0), "delete").otherwise("upsert")
    name = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderpriority"),
                    F.lit(".pdf"))
    stem = sanitize_stem(name)
    device = F.when(F.col("o_orderstatus") == "O", "cuda").when(F.col("o_orderstatus") == "F", "cpu").otherwise("mps")
    parse_dir = F.concat(F.lit("output/"), F.col("o_custkey").cast("string"), F.lit("/"), stem, F.lit("/"),
                         P.parse_subdir(name, F.lit("pipeline"), F.lit("auto")))
    return o.select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), op.alias("op"),
        name.alias("original_name"), stem.alias("stem"), F.col("o_orderdate").alias("created"),
        device.alias("device"), F.round(F.col("o_totalprice") / 1000, 1).alias("seconds"),
        parse_dir.alias("parse_dir"),
        F.concat(parse_dir, F.lit("/"), stem, F.lit(".md")).alias("markdown_path"),
        F.floor("o_totalprice").cast("bigint").alias("markdown_chars"),
        (F.col("o_orderkey") % 97).alias("blocks"))


_SQL_NAME = "'order ' || o_orderkey || ' ' || o_orderpriority || '.pdf'"
SQL_LOG = Q.with_ctes(
    [f"o AS (SELECT *, {_SQL_NAME} AS nm FROM orders)"] + Q.sanitize_ctes("o", "nm", "stem"),
    "SELECT o_custkey AS id, o_orderkey AS seq, "
    "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 'delete' ELSE 'upsert' END AS op, "
    "nm AS original_name, stem, o_orderdate AS created, "
    "CASE WHEN o_orderstatus = 'O' THEN 'cuda' WHEN o_orderstatus = 'F' THEN 'cpu' ELSE 'mps' END AS device, "
    "round(o_totalprice / 1000, 1) AS seconds, 'output/' || o_custkey || '/' || stem || '/auto' AS parse_dir, "
    "'output/' || o_custkey || '/' || stem || '/auto/' || stem || '.md' AS markdown_path, "
    "CAST(floor(o_totalprice) AS BIGINT) AS markdown_chars, o_orderkey % 97 AS blocks FROM ss5")

_ENTRY_COLS = ["id", "seq", "original_name", "stem", "created", "device", "seconds", "parse_dir",
               "markdown_path", "markdown_chars", "blocks"]


# -- library_upsert (SNK-1, SRC-10, PRJ-12, MTH-1) ------------------------------------------
def q_library_upsert(spark, sf_dir):
    return L.snapshot(change_log(spark, sf_dir)).select(*_ENTRY_COLS)


QUERIES["library_upsert"] = q_library_upsert
ORACLE["library_upsert"] = (
    f"SELECT {', '.join(_ENTRY_COLS)} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn "
    f"FROM ({SQL_LOG})) WHERE rn = 1 AND op = 'upsert'")


# -- library_commits (SNK-1): the same log committed in three parts, by id bucket -------------------
def q_library_commits(spark, sf_dir):
    log, root = change_log(spark, sf_dir), scratch_path(spark, "library-buckets")
    for part in (log.filter("seq % 3 = 0"), log.filter("seq % 3 = 1"), log.filter("seq % 3 = 2")):
        # an older change of an id may come after a newer one here; it must not win
        commit_changes(part.filter("op = 'upsert'"), root, buckets=16)
    last = log.filter("op = 'delete'").join(L.snapshot(log).select("id"), "id", "left_anti")
    commit_changes(last, root)
    return read_buckets(spark, root, log.drop("op").schema).select(*_ENTRY_COLS)


QUERIES["library_commits"] = q_library_commits
# Upserts of all parts, the newest winning; then the deletes of the ids that are gone in the end.
ORACLE["library_commits"] = (
    f"WITH log AS ({SQL_LOG}), "
    "up AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM log WHERE op = 'upsert'), "
    "gone AS (SELECT id FROM (SELECT id, op, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 AND op = 'delete') "
    f"SELECT {', '.join(_ENTRY_COLS)} FROM up WHERE rn = 1 AND id NOT IN (SELECT id FROM gone)")


# -- library_delete (SNK-2) -------------------------------------------------------------------
def q_library_delete(spark, sf_dir):
    return L.delete_report(change_log(spark, sf_dir))


QUERIES["library_delete"] = q_library_delete
ORACLE["library_delete"] = (
    "SELECT id, seq, coalesce(prev_op = 'upsert', false) AS existed FROM ("
    f"SELECT id, seq, op, lag(op) OVER (PARTITION BY id ORDER BY seq) AS prev_op FROM ({SQL_LOG})) "
    "WHERE op = 'delete'")


# -- library_newest (SRT-1) ---------------------------------------------------------------------
def q_library_newest(spark, sf_dir):
    return L.newest_first(change_log(spark, sf_dir))


QUERIES["library_newest"] = q_library_newest
ORACLE["library_newest"] = (
    "WITH lg AS (SELECT id, seq, op, created, lag(op) OVER (PARTITION BY id ORDER BY seq) AS prev_op FROM "
    f"({SQL_LOG})), "
    "snap AS (SELECT id, created FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM lg) "
    "WHERE rn = 1 AND op = 'upsert'), "
    "ins AS (SELECT id, max(seq) AS ins_seq FROM lg WHERE op = 'upsert' AND (prev_op IS NULL OR prev_op = 'delete') "
    "GROUP BY id) "
    "SELECT id, created, ins_seq, row_number() OVER (ORDER BY coalesce(created, TIMESTAMP '1970-01-01') DESC, "
    "ins_seq) AS position FROM snap JOIN ins USING (id)")


# -- artifact_locate (SRC-8, SRC-9) ----------------------------------------------------------------
# Listing per document: '<stem>.md' (German documents only have 'notes.md' and
# 'zz.md'), '<stem>_content_list.json' except for source src5, '<stem>_middle.json'
# for English documents, and images for French ones.
def listing(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    stem = sanitize_stem(F.concat(FX.first_line(F.col("text")), F.lit(".pdf")))
    base = d.select("doc_id", "lang", "source", stem.alias("stem"))
    base = base.withColumn("parse_dir", F.concat(F.lit("output/"), F.col("doc_id").cast("string"), F.lit("/"),
                                                 F.col("stem"), F.lit("/auto")))
    files = F.array_compact(F.array(
        F.when(F.col("lang") != "de", F.concat(F.col("stem"), F.lit(".md"))),
        F.when(F.col("lang") == "de", F.lit("zz.md")),
        F.when(F.col("lang") == "de", F.lit("notes.md")),
        F.when(F.col("source") != "src5", F.concat(F.col("stem"), F.lit("_content_list.json"))),
        F.lit("layout_content_list.json"),
        F.when(F.col("lang") == "en", F.concat(F.col("stem"), F.lit("_middle.json"))),
        F.when(F.col("lang") == "fr", F.lit("images/0001.jpg"))))
    return base.select("doc_id", "parse_dir", "stem", F.explode(files).alias("file_name"))


def q_artifact_locate(spark, sf_dir):
    return locate_outputs(listing(spark, sf_dir)).select(
        "doc_id", "parse_dir", "markdown_path", "content_list_path", "middle_json_path", "images_dir")


_SQL_LISTING = Q.with_ctes(
    ["n AS (SELECT doc_id, lang, source, regexp_extract(text, '^([^\\n]*)', 1) || '.pdf' AS nm FROM documents)"]
    + Q.sanitize_ctes("n", "nm", "stem"),
    "SELECT doc_id, 'output/' || doc_id || '/' || stem || '/auto' AS parse_dir, stem, unnest(list_filter(["
    "CASE WHEN lang <> 'de' THEN stem || '.md' END, CASE WHEN lang = 'de' THEN 'zz.md' END, "
    "CASE WHEN lang = 'de' THEN 'notes.md' END, CASE WHEN source <> 'src5' THEN stem || '_content_list.json' END, "
    "'layout_content_list.json', CASE WHEN lang = 'en' THEN stem || '_middle.json' END, "
    "CASE WHEN lang = 'fr' THEN 'images/0001.jpg' END], lambda x: x IS NOT NULL)) AS file_name FROM ss5")


def _sql_pick(sfx):
    return (f"arg_min(CASE WHEN suffix(file_name, {Q.lit(sfx)}) THEN parse_dir || '/' || file_name END, "
            f"CASE WHEN suffix(file_name, {Q.lit(sfx)}) THEN "
            f"(CASE WHEN file_name = stem || {Q.lit(sfx)} THEN 0 ELSE 1 END, file_name) END)")


QUERIES["artifact_locate"] = q_artifact_locate
ORACLE["artifact_locate"] = (
    f"SELECT doc_id, parse_dir, {_sql_pick('.md')} AS markdown_path, "
    f"{_sql_pick('_content_list.json')} AS content_list_path, {_sql_pick('_middle.json')} AS middle_json_path, "
    "max(CASE WHEN starts_with(file_name, 'images/') THEN parse_dir || '/images' END) AS images_dir "
    f"FROM ({_SQL_LISTING}) GROUP BY doc_id, parse_dir, stem")


# -- run_summary (SNK-5): source, device, paths and counts of a run, without its payloads ------------------
def q_run_summary(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    result = text_documents(docs).join(docs.select("doc_id", F.col("source").alias("from")), "doc_id")
    name = F.concat(F.lit("uploads/"), F.col("from"), F.lit("/"), F.col("doc_id").cast("string"))
    out = run_summary(result, located=q_artifact_locate(spark, sf_dir), source=name, device=F.when(F.col("doc_id") % 2 == 0, "cuda").otherwise("cpu"))
    return out.drop("from")


QUERIES["run_summary"] = q_run_summary
ORACLE["run_summary"] = f"""SELECT doc_id, 'uploads/' || source || '/' || doc_id AS source, CASE WHEN doc_id % 2 = 0 THEN 'cuda' ELSE 'cpu' END AS device,
  t.markdown_chars, t.blocks, t.error, a.parse_dir, a.markdown_path, a.content_list_path, a.images_dir
FROM documents d JOIN ({X.ORACLE['extract_text_documents']}) t USING (doc_id) LEFT JOIN ({ORACLE['artifact_locate']}) a USING (doc_id)"""


# -- path_normalise (PRJ-10, PRJ-11) -----------------------------------------------------------
# Paths built from all words of each document, whatever the white space: two-letter
# words become '..', one-letter words '.', German documents give absolute paths.
def q_path_normalise(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    words = F.split(F.col("text"), r"[ \n]")
    segs = F.transform(words, lambda w: F.when(F.length(w) == 2, "..").when(F.length(w) == 1, ".").otherwise(w))
    path = F.concat(F.when(F.col("lang") == "de", "/").otherwise(""), F.array_join(segs, "/"))
    n = P.normalise("path")
    return d.select("doc_id", path.alias("path")).select(
        "doc_id", "path", n["path"].alias("normalised"), n["escapes"].alias("escapes"),
        P.resolve("path").alias("resolved"), P.relativize("path", F.lit("data/output")).alias("relative"))


_SQL_FOLD = ("list_reduce(string_split(path, '/'), lambda acc, s: CASE WHEN s = '' OR s = '.' THEN acc "
             "WHEN s = '..' THEN CASE WHEN len(acc.st) = 0 THEN {'st': acc.st, 'bad': true} "
             "ELSE {'st': acc.st[1:len(acc.st) - 1], 'bad': acc.bad} END "
             "ELSE {'st': list_append(acc.st, s), 'bad': acc.bad} END, {'st': []::VARCHAR[], 'bad': false})")
QUERIES["path_normalise"] = q_path_normalise
ORACLE["path_normalise"] = f"""WITH
a AS (SELECT doc_id, CASE WHEN lang = 'de' THEN '/' ELSE '' END || array_to_string(list_transform(
        string_split(replace(text, chr(10), ' '), ' '),
        lambda w: CASE WHEN length(w) = 2 THEN '..' WHEN length(w) = 1 THEN '.' ELSE w END), '/') AS path FROM documents),
b AS (SELECT doc_id, path, {_SQL_FOLD} AS f FROM a),
c AS (SELECT doc_id, path, array_to_string(f.st, '/') AS normalised, f.bad OR starts_with(path, '/') AS escapes,
             list_filter(f.st, lambda s: s <> '') AS ps, ['data', 'output'] AS rs FROM b),
d AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(ps), len(rs)) + 1),
                  lambda i: ps[i] = rs[i]), false) - 1, least(len(ps), len(rs))) AS k FROM c)
SELECT doc_id, path, normalised, escapes, CASE WHEN NOT escapes THEN normalised END AS resolved,
  CASE WHEN array_to_string(list_concat(list_transform(range(len(rs) - k), lambda x: '..'), ps[k + 1:]), '/') = ''
       THEN '.' ELSE array_to_string(list_concat(list_transform(range(len(rs) - k), lambda x: '..'), ps[k + 1:]), '/')
  END AS relative
FROM d"""


# -- stable_ids (HSH-1) -------------------------------------------------------------------------
def q_stable_ids(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", P.stable_id("source", "doc_id", "n_chars").alias("id"))


QUERIES["stable_ids"] = q_stable_ids
ORACLE["stable_ids"] = ("SELECT doc_id, substr(sha256(concat_ws(chr(0), source, CAST(doc_id AS VARCHAR), "
                        "CAST(n_chars AS VARCHAR))), 1, 32) AS id FROM documents")
