"""Merkle manifest of a table, with the proof of every row, by a butterfly exchange.

Rows are leaves; per key they are ordered and every ``FANOUT`` consecutive nodes become one, level by
level, until one remains (the key's subroot).  The subroots, ordered by key, become the root likewise.

Leaves are dealt to blocks of ``FANOUT ** BLOCK_LEVELS`` consecutive ones, each a subtree of the key's tree, so a
block computes its lower levels alone.  The upper levels need no second pass downwards: in round r the blocks
whose numbers agree but for the r-th digit (base ``FANOUT``) form a group and swap the roots of the subtrees that
they stand for.  Every member hashes the same parent, notes its siblings and goes on with the parent, so
after log(blocks) rounds each block knows its whole path.  Where the last subtree of a level has fewer blocks
than its siblings, its blocks serve several groups.  A group has at most FANOUT members and digests, so a key that
holds most rows is as many small groups.

Digests are lowercase hex text; a node's digest is the SHA-256 of its children's, concatenated.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import prepare, salted_join
from quire.operators.sequence import global_rank, rank_within_key
from quire.session import materialize

FANOUT, BLOCK_LEVELS = 16, 2
#: Leaves from which a key is ranked by ranges, in several tasks.
HOT_LEAVES = 4096
BLOCK = FANOUT ** BLOCK_LEVELS
PATH = "array<struct<before:string,after:string>>"


def digest(*values: Column) -> Column:
    """SHA-256 of the values, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    def framed(v: Column) -> Column:
        text = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and nothing else changed."""
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return F.translate(text, upper, upper.lower())


def tree_key(source: Column) -> Column:
    """A key that is never null and sorts as wanted: null first, then the text's bytes."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def parent(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def climb(leaves: list[str], whole: bool) -> list[list[str]]:
    """The levels of a block from its leaves up: to its one node if it is the ``whole`` tree, else ``BLOCK_LEVELS`` up."""
    levels = [leaves]
    while len(levels[-1]) > 1 if whole else len(levels) <= BLOCK_LEVELS:
        nodes = levels[-1]
        levels.append([parent(nodes[i:i + FANOUT]) for i in range(0, len(nodes), FANOUT)])
    return levels


def block_paths(leaves: list[str], whole: bool) -> list[list[dict]]:
    """For each leaf its siblings before and after it, at every level of the block."""
    levels, out = climb(leaves, whole)[:-1], []
    for at in range(len(leaves)):
        path = []
        for level in levels:
            run = at - at % FANOUT
            path.append({"before": "".join(level[run:at]), "after": "".join(level[at + 1:run + FANOUT])})
            at //= FANOUT
        out.append(path)
    return out


def make_blocks(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables of blocks ``_k, _b, items`` and of their nodes ``_k, _b, _blocks, node``, from ranked rows ``_k, _pos, _item``.

    ``_item`` is a struct with ``leaf``; ``items`` are in order; ``_blocks`` counts the key's blocks and ``node`` is the
    digest of the block's subtree (of its whole tree where the key has one block)."""
    block = F.floor((F.col("_pos") - 1) / BLOCK).cast("long")
    held = leaves.select("_k", block.alias("_b"), F.struct("_pos", "_item").alias("_x")).groupBy("_k", "_b").agg(F.sort_array(F.collect_list("_x")).alias("_x"))
    held = materialize(held.select("_k", "_b", F.transform("_x", lambda x: x["_item"]).alias("items")), "merkle-blocks")

    def run(batches):
        for batch in batches:
            found = batch.column(2).to_pylist()
            both = [pa.array([climb(x, whole)[-1][0] for x in found], pa.string()) for whole in (True, False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *both], ["_k", "_b", "alone", "inner"])

    nodes = held.select("_k", "_b", F.transform("items", lambda x: x["leaf"]).alias("leaves")).mapInArrow(run, "_k string, _b long, alone string, inner string")
    nodes = materialize(nodes, "merkle-nodes")
    counts = nodes.groupBy("_k").agg((F.max("_b") + 1).alias("_blocks"))
    nodes = salted_join(nodes, counts, "_k", ["_b"])
    return held, nodes.select("_k", "_b", "_blocks", F.when(F.col("_blocks") == 1, F.col("alone")).otherwise(F.col("inner")).alias("node"))


def exchange(nodes: DataFrame) -> DataFrame:
    """The butterfly: ``_k, _b, top`` (the digest of the key's tree) and ``path`` (siblings before and after, a level upwards each).

    ``nodes``: ``_k, _b, _blocks, node``, one row per block.  A key that is done passes through the rounds alone."""
    most = nodes.agg(F.max("_blocks")).first()[0] or 1
    state = nodes.withColumn("path", F.array().cast(PATH))
    width = 1
    while width < most:
        w = F.lit(width)
        number, lane = F.floor(F.col("_b") / w), F.col("_b") % w
        digit, covered = number % FANOUT, F.least(w, F.col("_blocks") - number * w)
        lanes = F.when(digit == 0, F.array(lane)).otherwise(F.sequence(lane, w - 1, covered))
        member = F.struct("_b", "_blocks", "path", digit.alias("digit"))
        sent = state.select("_k", F.floor(number / FANOUT).alias("_g"), F.explode(lanes).alias("_lane"), lane.alias("_own"), F.struct(digit.alias("digit"), "node").alias("_node"), member.alias("_member"))
        sent = sent.withColumn("_member", F.when(F.col("_lane") == F.col("_own"), F.col("_member")))
        groups = sent.groupBy("_k", "_g", "_lane").agg(F.sort_array(F.collect_list("_node")).alias("_nodes"), F.collect_list("_member").alias("_members"))
        each = groups.select("_k", "_nodes", F.explode("_members").alias("_m"))
        side = lambda keep: F.array_join(F.transform(F.filter("_nodes", keep), lambda x: x["node"]), "")
        before, after = side(lambda x: x["digit"] < F.col("_m.digit")), side(lambda x: x["digit"] > F.col("_m.digit"))
        more = F.col("_m._blocks") > w
        up = F.sha2(F.array_join(F.transform("_nodes", lambda x: x["node"]), ""), 256)
        state = each.select("_k", F.col("_m._b").alias("_b"), F.col("_m._blocks").alias("_blocks"), F.when(more, up).otherwise(F.col("_nodes")[0]["node"]).alias("node"),
                            F.when(more, F.array_append("_m.path", F.struct(before.alias("before"), after.alias("after")))).otherwise(F.col("_m.path")).alias("path"))
        width *= FANOUT
    return state.select("_k", "_b", F.col("node").alias("top"), "path")


def proofs(items: DataFrame, carry: list[T.StructField], with_proof: bool) -> DataFrame:
    """One row per leaf from rows ``_k, _b, items, _whole, subroot, root, path`` (path: the block's, up to the root)."""
    fields = [*carry, *[T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], T.StructField("verified", T.BooleanType())]
    if with_proof:
        fields.append(T.StructField("proof", T.ArrayType(T.StringType())))
    schema = T.StructType(fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                whole, subroot, root, upper = (batch.column(c)[i].as_py() for c in ("_whole", "subroot", "root", "path"))
                held = batch.column("items").slice(i, 1).flatten()
                siblings, folds = [], []
                for folded, path in zip(held.field("seen").to_pylist(), block_paths(held.field("leaf").to_pylist(), whole)):
                    path = path + upper
                    for p in path:
                        folded = parent([p["before"], folded, p["after"]])
                    siblings.append("".join(p["before"] + p["after"] for p in path))
                    folds.append(folded)
                n = len(folds)
                columns = [*[held.field(f.name) for f in carry], held.field("leaf"), pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string()),
                           pa.array([parent([x]) for x in siblings], pa.string()), pa.array(folds, pa.string()), pa.array([x == root for x in folds], pa.bool_())]
                if with_proof:
                    columns.append(pa.array([[x[j:j + 64] for j in range(0, len(x), 64)] for x in siblings], pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return items.select("items", "_whole", "subroot", "root", "path").mapInArrow(run, schema)


def manifest(docs: DataFrame, *, id_col: str = "doc_id", key_col: str = "source", fields: list[str] | None = None, seen: dict[str, Column] | None = None,
             carry: list[str] | None = None, with_proof: bool = False, min_hot_rows: int = HOT_LEAVES) -> DataFrame:
    """Columns ``carry`` (default: the id), ``leaf, subroot, root, proof_sha256, folded_root, verified`` and, on request, ``proof``.

    ``fields`` (default: doc_id, source, lang, n_chars, text) make the leaf; ``seen`` maps some of them to their values as found
    later.  The proof (siblings from the leaf up, left to right) belongs to the table as it is; ``folded_root`` is
    what it makes of the leaf as found, ``verified`` whether that is the root.
    Null keys are one key, the first; a null id comes first in its key; rows with equal ids are
    ordered by their leaves, and equal leaves are equal in every result but the proof, whose order among them is that of the rows found;
    an empty table gives an empty result; other columns, also ones named like the results, are not read."""
    prepare(docs.sparkSession)
    fields, carry = fields or ["doc_id", "source", "lang", "n_chars", "text"], carry or [id_col]
    leaf, found = digest(*[F.col(c) for c in fields]), digest(*[(seen or {}).get(c, F.col(c)) for c in fields])
    kinds = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    rows = docs.select(tree_key(F.col(key_col)).alias("_k"), F.col(id_col).alias("_id"),
                       F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], leaf.alias("leaf"), found.alias("seen")).alias("_item"))
    rows = materialize(rows, "merkle-leaves")
    ranked = rank_within_key(rows.withColumn("_leaf", F.col("_item.leaf")), ["_k"], ["_id", "_leaf"], "_pos", min_hot_rows)
    items, nodes = make_blocks(ranked.select("_k", "_pos", "_item"))
    paths = materialize(exchange(nodes), "merkle-paths")
    # the keys' subroots are the leaves of the upper tree
    tops = paths.filter("_b = 0").select(F.col("_k").alias("_id"), F.col("top").alias("leaf"))
    tops = global_rank(tops, ["_id"], "_pos", min_hot_rows).select(F.lit("").alias("_k"), "_pos", F.struct(F.col("_id").alias("c0"), "leaf", F.col("leaf").alias("seen")).alias("_item"))
    held, upper = make_blocks(tops)
    upper = exchange(upper)
    key_paths = materialize(held.join(upper, ["_k", "_b"]).select(F.explode(_in_block("items", F.size("path") == 0)).alias("_x"), "path", "top").select(
        F.col("_x.c0").alias("_k"), F.col("_x.leaf").alias("subroot"), F.col("top").alias("root"), F.concat("_x.path", "path").alias("upper")), "merkle-keys")
    whole = nodes.select("_k", "_b", (F.col("_blocks") == 1).alias("_whole"))
    own = paths.join(whole, ["_k", "_b"]).select("_k", "_b", "_whole", "path")
    own = salted_join(own, key_paths, "_k", ["_b"]).select("_k", "_b", "_whole", "subroot", "root", F.concat("path", "upper").alias("path"))
    out = proofs(items.join(own, ["_k", "_b"]), kinds, with_proof)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *[c for c in out.columns[len(carry):]])


def _in_block(items: str, whole: Column) -> Column:
    """Items ``c0, leaf`` of a block of the upper tree with their paths inside it."""
    paths = F.udf(lambda leaves, alone: block_paths(leaves, alone), f"array<{PATH}>")
    found = paths(F.transform(items, lambda x: x["leaf"]), whole)
    return F.zip_with(items, found, lambda x, p: F.struct(x["c0"].alias("c0"), x["leaf"].alias("leaf"), p.alias("path")))
