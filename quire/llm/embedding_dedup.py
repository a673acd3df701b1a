"""Embedding near-duplicates by sorted projection passes.

In each pass every vector gets a key of random hyperplane signs; vectors are ordered by (pass,
label, key), ranked, and compared with the next ``window`` vectors in that order.  Ranks
are cut into blocks of equal size that overlap by a window, so a label or a group of copies of
any size is spread over many tasks.  Pairs whose cosine reaches the threshold are links; their
union across passes gives the components.

The passes read each distinct vector of a label once, with the number of its copies, and find the
components.  Links are then counted exactly inside each component, whatever its size.  It has a core: the
vectors within half the threshold's angle of one member.  By the triangle inequality any two of them
are linked, so their links are counted without comparing.  All vectors of the component are
packed into blocks, and for each pair of blocks outside the core the angle between
the blocks' centres, with their radii, tells that all or none of the pairs are linked; the pairs of the blocks that this
leaves open are compared.

The first passes grow in number with the logarithm of the table (``passes_for``).  Signs do not split every
table evenly, so the crowding is measured: where a vector shares L leading signs with the neighbours a
window away, whatever shares L + 1 signs with it is compared.  Every second pass takes the signs
about the mean of the label.  Vectors whose links at the threshold may still be missed with more than the probability
``miss`` go through further passes among themselves, and what those leave over is compared by blocks.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import prepare, salted_join
from quire.llm.components import connected_components
from quire.session import materialize

#: Signs in a key.
KEY_BITS = 62
#: So few vectors that may still miss a link are compared by blocks at once.
FEW = 1 << 14
#: Passes after which the vectors that may still miss a link are compared by blocks.
MOST_PASSES = 128
#: Bytes of the vectors of a block.
BLOCK_BYTES = 128 << 10
#: Room for rounding in angles.
SLACK = 1e-7


def passes_for(n: int, window: int, threshold: float, miss: float) -> int:
    """Passes so that a pair at the threshold shares, in some pass, the signs that n vectors are told apart by.

    ``log2(n / window)`` leading signs leave about a window of vectors; one sign agrees with
    probability 1 - angle / pi."""
    bits = max(1.0, math.log2(max(n, 2) / window))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return max(2, math.ceil(math.log(miss) / math.log1p(-min(agree, 1 - 1e-9))))


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision of a list column, and which rows are usable; vectors of different length stand by."""
    rows = [None if v is None or any(x is None for x in v) else np.array(v, np.float64) for v in column.to_pylist()]
    return rows, np.array([v is not None and len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any()) for v in rows], bool)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


def _keys(rows: list[np.ndarray], passes: int, seed: int, first: int = 0, means: list[np.ndarray] | None = None) -> np.ndarray:
    """Sign keys (rows x passes) from pass ``first`` on; the hyperplanes depend on the dimension, the pass and the seed alone.

    With ``means``, odd passes take the signs of the differences from them."""
    out = np.zeros((len(rows), passes), np.int64)
    by_size: dict[int, list[int]] = {}
    for i, v in enumerate(rows):
        by_size.setdefault(len(v), []).append(i)
    weight = (1 << np.arange(KEY_BITS - 1, -1, -1)).astype(np.int64)
    for size, at in by_size.items():
        x = np.stack([rows[i] for i in at])
        y = x if means is None else x - np.stack([means[i] for i in at])
        for p in range(passes):
            plane = np.random.default_rng([seed, first + p, size]).standard_normal((size, KEY_BITS))
            out[at, p] = ((y if (first + p) % 2 else x) @ plane > 0) @ weight
    return out


def _vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """Written table ``v, id, g, k, x``: rows, numbered, with unit vectors as bytes of doubles.

    ``g`` stands for label and length, ``k`` for ``g`` and the vector; both are null where a row is not compared."""
    src = df.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("x"))

    def run(batches):
        for batch in batches:
            rows, ok = _matrix(batch.column("x"))
            x = [_unit(v).tobytes() if k else None for v, k in zip(rows, ok)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(x, pa.binary())], ["id", "label", "x"])

    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(run, f"id {kind}, label string, x binary").withColumn("v", F.monotonically_increasing_id())
    out = out.withColumn("g", F.concat(F.length("x").cast("string"), F.lit(":"), F.col("label")))
    return materialize(out.withColumn("k", F.sha2(F.concat(F.col("g").cast("binary"), F.col("x")), 256)).drop("label"), "vectors")


def _ranked(keyed: DataFrame) -> DataFrame:
    """Adds ``rank``, the place of each row in the order by (pass, label, key, v)."""
    placed = materialize(keyed.repartitionByRange("pass", "g", "key", "v").sortWithinPartitions("pass", "g", "key", "v")
                         .withColumn("at", F.monotonically_increasing_id()), "passes")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()  # one row per shuffle partition
    start, before = {}, 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        start[r["part"]] = before
        before += r["n"]
    if not start:
        return placed.withColumn("rank", F.lit(0).cast("long"))
    first = F.create_map(*[F.lit(x).cast("long") for kv in start.items() for x in kv])
    return placed.withColumn("rank", first[part] + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))


def _means(vectors: DataFrame) -> DataFrame:
    """``g, mean`` of the vectors of each label and length; each task sends one sum a label."""
    def part(batches):
        total: dict[str, list] = {}

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([t[0] for t in total.values()], pa.int64()),
                                               pa.array([t[1].tobytes() for t in total.values()], pa.binary())], ["g", "n", "s"])

        for batch in batches:
            for g, b in zip(batch.column("g").to_pylist(), batch.column("x").to_pylist()):
                t = total.setdefault(g, [0, 0.0])
                t[0] += 1
                t[1] = t[1] + np.frombuffer(b, np.float64)
            if len(total) > 1000:
                yield flush()
                total.clear()
        yield flush()

    def whole(table: pa.Table) -> pa.Table:
        mean = sum(np.frombuffer(b, np.float64) for b in table.column("s").to_pylist()) / sum(table.column("n").to_pylist())
        return pa.table({"g": table.column("g")[:1], "mean": pa.array([mean.tobytes()], pa.binary())})

    return vectors.select("g", "x").mapInArrow(part, "g string, n long, s binary").groupBy("g").applyInArrow(whole, "g string, mean binary")


def _agreement(rows: list[np.ndarray], means: list[np.ndarray], threshold: float) -> np.ndarray:
    """Probability that a sign of a vector and of one at the threshold from it agree (rows x 2): plain, and about the mean."""
    chord = math.sqrt(max(0.0, 2 - 2 * threshold))
    far = np.array([np.sqrt((x - m) @ (x - m)) for x, m in zip(rows, means)])
    about = 1 - 2 * np.arcsin(np.minimum(1.0, chord / 2 / np.maximum(far, 1e-12))) / math.pi
    return np.stack([np.full(len(rows), 1 - math.acos(threshold) / math.pi), about], 1)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading signs that two keys share."""
    x = a ^ b
    high, low = x >> 31, x & ((1 << 31) - 1)
    return KEY_BITS - np.where(high > 0, 31 + np.frexp(high.astype(np.float64))[1], np.frexp(low.astype(np.float64))[1])


def _missing(key: np.ndarray, group: np.ndarray, agree: np.ndarray, window: int) -> np.ndarray:
    """Log-probability that the windows miss a pair at the threshold, for each row in the order of ranks."""
    need = np.zeros(len(key))
    i = np.arange(max(0, len(key) - window))
    i = i[group[i] == group[i + window]]
    share = _shared(key[i], key[i + window]) + 1
    need[i] = share
    need[i + window] = np.maximum(need[i + window], share)
    met = np.where(need > KEY_BITS, 0.0, agree ** need)
    return np.where(met >= 1, -50.0, np.log1p(-np.minimum(met, 1 - 1e-15)))


def _compare(threshold: float, window: int, block: int):
    """Links ``a, b, cos`` of a block's rows with the rows after them, and ``a``, no ``b``, and the log-probability of a miss."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        rank = table.column("rank").to_numpy()
        own = table.column("block")[0].as_py()
        v = table.column("v").to_numpy()
        group = np.array([f"{p}\0{g}" for p, g in zip(table.column("pass").to_pylist(), table.column("g").to_pylist())], object)
        x = [np.frombuffer(b, np.float64) for b in table.column("x").to_pylist()]
        flat = np.zeros((len(x), max(len(a) for a in x)))
        for i, a in enumerate(x):
            flat[i, :len(a)] = a
        mine = np.flatnonzero(rank // block == own)
        lost = _missing(table.column("key").to_numpy(), group, table.column("agree").to_numpy(), window)[mine]
        a_out, b_out, c_out = [], [], []
        for d in range(1, window + 1):
            i = mine[mine < len(x) - d]
            i = i[group[i] == group[i + d]]
            cos = np.einsum("ij,ij->i", flat[i], flat[i + d])
            hit = cos >= threshold
            a_out.append(v[i[hit]])
            b_out.append(v[i[hit] + d])
            c_out.append(cos[hit])
        a, b = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in (a_out, b_out))
        cos = np.concatenate(c_out) if c_out else np.zeros(0)
        return pa.table({"a": pa.array(np.concatenate([np.minimum(a, b), v[mine]])), "b": pa.concat_arrays([pa.array(np.maximum(a, b)), pa.nulls(len(mine), pa.int64())]),
                         "cos": pa.array(np.concatenate([cos, lost]))})
    return run


def _pass_links(vectors: DataFrame, passes: int, first: int, threshold: float, window: int, block: int, seed: int) -> DataFrame:
    """Links ``a, b, cos`` that the windows of ``passes`` orders of the vectors meet; with no ``b``, the log-probability that they miss one of ``a``."""
    def keys(batches):
        for batch in batches:
            x, mean = ([np.frombuffer(b, np.float64) for b in batch.column(c).to_pylist()] for c in ("x", "mean"))
            k, agree = _keys(x, passes, seed, first, mean), _agreement(x, mean, threshold)[:, (first + np.arange(passes)) % 2]
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(passes, dtype=np.int32), m)), batch.column("g").take(pa.array(np.repeat(np.arange(m), passes))),
                 pa.array(k.reshape(-1)), pa.array(agree.reshape(-1)), pa.array(np.repeat(batch.column("v").to_numpy(), passes))], ["pass", "g", "key", "agree", "v"])

    centred = salted_join(vectors.select("v", "g", "x"), _means(vectors), "g", ["v"]).select("v", "g", "x", "mean")
    ranked = _ranked(centred.mapInArrow(keys, "pass int, g string, key long, agree double, v long"))
    places = ranked.select("v", F.struct("pass", "rank", "key", "agree").alias("p")).groupBy("v").agg(F.collect_list("p").alias("ps"))
    spread = vectors.select("v", "g", "x").join(places, "v").select("v", "g", "x", F.explode("ps").alias("p")).select("v", "g", "x", "p.*")
    own, at = F.floor(F.col("rank") / block), F.col("rank") % block
    before = F.when((at < window) & (own > 0), F.array(own - 1)).otherwise(F.array().cast("array<bigint>"))
    after = F.when(at >= block - window, F.array(own + 1)).otherwise(F.array().cast("array<bigint>"))
    dealt = spread.withColumn("block", F.explode(F.concat(F.array(own), before, after)))
    found = dealt.groupBy("block").applyInArrow(_compare(threshold, window, block), "a long, b long, cos double")
    return materialize(found.groupBy("a", "b").agg(F.when(F.col("b").isNull(), F.sum("cos")).otherwise(F.max("cos")).alias("cos")), "vector-links")


def _links(vectors: DataFrame, passes: int | None, threshold: float, window: int, miss: float, block: int, seed: int) -> DataFrame:
    """Links enough for the components: passes over all vectors, then over those that may have missed a link, then blocks of the rest."""
    links, first, rest, n = None, 0, vectors.select("v", "g", "x", F.lit(0.0).alias("lost")), vectors.count()
    while True:
        number = passes or passes_for(n, window, threshold, miss)
        found = _pass_links(rest, number, first, threshold, window, block, seed)
        met = found.filter("b is not null").select("a", "b")
        links = met if links is None else links.union(met)
        if passes:
            return links.distinct()
        first += number
        lost = found.filter("b is null").select(F.col("a").alias("v"), F.col("cos").alias("more"))
        rest = materialize(rest.join(lost, "v").withColumn("lost", F.col("lost") + F.col("more")).drop("more").filter(F.col("lost") > math.log(miss)), "vectors-left")
        before, n = n, rest.count()
        if not n:
            return links.distinct()
        if n <= FEW or n > 0.7 * before or first >= MOST_PASSES:
            return links.union(_block_links(rest, threshold, seed)).distinct()


def _forest(threshold: float):
    """Links that join what the links of a pair of blocks join, fewer than the blocks have vectors."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                va, vb, xa, xb = (batch.column(c)[i].as_py() for c in ("va", "vb", "xa", "xb"))
                va, vb = np.frombuffer(va, np.int64), np.frombuffer(vb, np.int64)
                xa, xb = np.frombuffer(xa, np.float64).reshape(len(va), -1), np.frombuffer(xb, np.float64).reshape(len(vb), -1)
                root: dict[int, int] = {}

                def find(y):
                    while root.get(y, y) != y:
                        y = root[y]
                    return y

                out = []
                for j, k in zip(*np.nonzero(xa @ xb.T >= threshold)):
                    a, b = find(int(va[j])), find(int(vb[k]))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        out.append((min(va[j], vb[k]), max(va[j], vb[k])))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], ["a", "b"])
    return run


def _block_links(vectors: DataFrame, threshold: float, seed: int) -> DataFrame:
    """Links of all vectors of equal ``g`` that join what any of their links join."""
    def key(batches):
        for batch in batches:
            k = _keys([np.frombuffer(b, np.float64) for b in batch.column("x").to_pylist()], 1, seed)[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("g"), batch.column("x"), pa.array(k)], ["v", "g", "x", "key"])

    keyed = vectors.select("v", "g", "x").mapInArrow(key, "v long, g string, x binary, key long")
    one = keyed.groupBy("g").agg(F.min("v").alias("component"))
    dealt = salted_join(keyed, one, "g", ["v"]).withColumn("core", F.lit(False)).withColumn("w", F.lit(1).cast("long"))
    blocks, pairs = _blocks(dealt, threshold)
    packed = blocks.select("blk", "vs", "xs")
    return (pairs.join(packed.toDF("a", "va", "xa"), "a").join(packed.toDF("b", "vb", "xb"), "b").select("va", "vb", "xa", "xb")
            .mapInArrow(_forest(threshold), "a long, b long"))


def near_duplicates(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93,
                    window: int = 32, passes: int | None = None, miss: float = 0.005, block: int = 2048, seed: int = 1) -> DataFrame:
    """Columns id, ``n_links``, ``component_id``, ``kept`` for each row of ``df``.

    Rows are compared when their labels are equal and not null.  Vectors that are null, empty, zero or hold
    null or non-finite components, and vectors of different length, link with nothing; such
    a row is its own component.  Repeated rows are rows of their own and link with each other.
    A component's id is its least row id, null ids aside.  Other columns are not read."""
    spark = df.sparkSession
    prepare(spark)
    rows = _vectors(df, id_col, vec_col, label_col)
    vectors = materialize(rows.filter(F.col("k").isNotNull()).groupBy("k")
                          .agg(F.min("v").alias("v"), F.first("g").alias("g"), F.first("x").alias("x"), F.min("id").alias("least"), F.count("*").alias("w")), "distinct")
    links = materialize(_links(vectors, passes, threshold, window, miss, block, seed), "all-links")
    nodes = connected_components(links, "a", "b")
    known = _count(vectors, links, nodes, threshold, seed)
    out = salted_join(rows.select("id", "v", "k"), known, "k", ["v"], "left")
    out = out.select(F.col("id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias(id_col), "n_links", "component_id", "kept")


def _count(vectors: DataFrame, links: DataFrame, nodes: DataFrame, threshold: float, seed: int) -> DataFrame:
    """``k, n_links, component_id`` of each distinct vector: the core of each component by its size, all other links by blocks."""
    degree = links.select(F.col("a").alias("v")).union(links.select("b")).groupBy("v").agg(F.count("*").alias("deg"))
    member = materialize(nodes.withColumnRenamed("node", "v").join(degree, "v").join(vectors, "v"), "members")
    whole = member.groupBy("component").agg(F.max_by("x", F.struct("deg", -F.col("v"))).alias("px"), F.min("least").alias("component_id"))
    half = math.cos(math.acos(threshold) / 2 - SLACK)

    def core(batches):
        for batch in batches:
            x = [np.frombuffer(b, np.float64) for b in batch.column("x").to_pylist()]
            near = [float(a @ np.frombuffer(p, np.float64)) >= half for a, p in zip(x, batch.column("px").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("v", "component", "component_id", "w", "x")), pa.array(near, pa.bool_()),
                                              pa.array(_keys(x, 1, seed)[:, 0])], ["v", "component", "component_id", "w", "x", "core", "key"])

    kind = member.schema["least"].dataType.simpleString()
    marked = salted_join(member.select("v", "component", "w", "x"), whole, "component", ["v"]).select("v", "component", "component_id", "w", "x", "px")
    marked = materialize(marked.mapInArrow(core, f"v long, component long, component_id {kind}, w long, x binary, core boolean, key long"), "cores")
    size = marked.filter("core").groupBy("component").agg(F.sum("w").alias("in_core"))
    more = _block_counts(marked, threshold)
    linked = (salted_join(marked.select("v", "component", "component_id", "w", "core"), size, "component", ["v"], "left").join(more, "v", "left")
              .select("v", "component_id", (F.when(F.col("core"), F.col("in_core") - F.col("w")).otherwise(0) + F.coalesce("more", F.lit(0))).alias("others")))
    return vectors.select("v", "k", "least", "w").join(linked, "v", "left").select(
        "k", (F.coalesce("others", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))


def _pack(batches):
    """Blocks of consecutive rows that agree in component and core, of ``BLOCK_BYTES`` or less (one vector at least)."""
    names = ["blk", "component", "core", "weight", "vs", "ws", "xs", "centre", "radius"]

    def block(head, part):
        x = np.stack([np.frombuffer(r[2], np.float64) for r in part])
        mean = x.sum(0)
        centre = mean / np.sqrt(mean @ mean) if mean @ mean > 1e-12 else x[0]
        radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max()) + SLACK
        w = np.array([r[1] for r in part], np.int64)
        return (part[0][0], *head, int(w.sum()), np.array([r[0] for r in part], np.int64).tobytes(), w.tobytes(), x.tobytes(), centre.tobytes(), radius)

    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
    head, part = None, []
    for batch in batches:
        done = []
        columns = [batch.column(c).to_pylist() for c in ("component", "core", "v", "w", "x")]
        for component, core, v, w, x in zip(*columns):
            if part and ((component, core) != head or (len(part) + 1) * len(x) > BLOCK_BYTES):
                done.append(block(head, part))
                part = []
            head = (component, core)
            part.append((v, w, x))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
    if part:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(block(head, part), types)], names)


def _bounds(threshold: float):
    """Keeps pairs of blocks that have links, with whether all of their pairs are (``sure``)."""
    limit = math.acos(threshold)

    def run(batches):
        for batch in batches:
            a, b, ra, rb = (batch.column(c).to_pylist() for c in ("ca", "cb", "ra", "rb"))
            angle = np.array([math.acos(min(1.0, max(-1.0, float(np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64))))) for x, y in zip(a, b)])
            reach = np.array(ra) + np.array(rb) + SLACK
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(angle + reach <= limit, pa.bool_())], ["a", "b", "sure"])
            yield out.filter(pa.array(angle - reach <= limit, pa.bool_()))
    return run


def _open_pairs(threshold: float):
    """For each pair of blocks, the linked weight of every vector of either block."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, wa, wb, xa, xb = (batch.column(c)[i].as_py() for c in ("a", "b", "wa", "wb", "xa", "xb"))
                wa, wb = np.frombuffer(wa, np.int64), np.frombuffer(wb, np.int64)
                xa, xb = np.frombuffer(xa, np.float64).reshape(len(wa), -1), np.frombuffer(xb, np.float64).reshape(len(wb), -1)
                hit = xa @ xb.T >= threshold
                if a == b:
                    np.fill_diagonal(hit, False)
                sides = [(a, hit @ wb)] + ([(b, wa @ hit)] if a != b else [])
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in sides]), pa.array([c.astype(np.int64).tobytes() for _, c in sides], pa.binary())], ["blk", "counts"])
    return run


def _add_counts(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist())
    return pa.table({"blk": table.column("blk")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _blocks(marked: DataFrame, threshold: float, salts: int = 16) -> tuple[DataFrame, DataFrame]:
    """Written blocks of each component, and the pairs ``a, b, sure`` of them, but for pairs inside the core, that may have links."""
    order = ("component", "core", "key", "v")
    blocks = materialize(marked.select(*order, "w", "x").repartitionByRange(*order).sortWithinPartitions(*order)
                         .mapInArrow(_pack, "blk long, component long, core boolean, weight long, vs binary, ws binary, xs binary, centre binary, radius double"), "blocks")
    left = blocks.select("component", F.col("blk").alias("a"), F.col("core").alias("core_a"), F.col("centre").alias("ca"), F.col("radius").alias("ra"),
                         F.pmod(F.xxhash64("blk"), F.lit(salts)).cast("int").alias("salt"))
    right = blocks.filter("not core").select("component", F.col("blk").alias("b"), F.col("centre").alias("cb"), F.col("radius").alias("rb"),
                          F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    pairs = left.join(right, ["component", "salt"]).filter(F.col("core_a") | (F.col("a") <= F.col("b")))
    pairs = materialize(pairs.select("a", "b", "ca", "cb", "ra", "rb").mapInArrow(_bounds(threshold), "a long, b long, sure boolean"), "block-pairs")
    return blocks, pairs


def _block_counts(marked: DataFrame, threshold: float) -> DataFrame:
    """``v, more``: the weight of the vectors linked with each vector of a component, but for links inside the core."""
    blocks, pairs = _blocks(marked, threshold)
    weight = blocks.select("blk", "weight")
    sure = pairs.filter("sure")
    whole = (sure.select(F.col("a").alias("to"), F.col("b").alias("blk")).union(sure.filter("a != b").select("b", "a"))
             .join(weight, "blk").groupBy(F.col("to").alias("blk")).agg(F.sum("weight").alias("whole"), F.max(F.col("blk") == F.col("to")).alias("itself")))
    packed = blocks.select("blk", "ws", "xs")
    compared = (pairs.filter("not sure").join(packed.toDF("a", "wa", "xa"), "a").join(packed.toDF("b", "wb", "xb"), "b").select("a", "b", "wa", "wb", "xa", "xb")
                .mapInArrow(_open_pairs(threshold), "blk long, counts binary").groupBy("blk").applyInArrow(_add_counts, "blk long, counts binary"))

    def each(batches):
        for batch in batches:
            for r in batch.to_pylist():
                v, w = np.frombuffer(r["vs"], np.int64), np.frombuffer(r["ws"], np.int64)
                more = np.full(len(v), r["whole"] or 0, np.int64) - (w if r["itself"] else 0) + (np.frombuffer(r["counts"], np.int64) if r["counts"] else 0)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(more)], ["v", "more"])

    return (blocks.select("blk", "vs", "ws").join(whole, "blk", "left").join(compared, "blk", "left").select("vs", "ws", "whole", "itself", "counts")
            .mapInArrow(each, "v long, more long"))
