"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each source has a target number of words.  The document rates of least relative entropy to
"every document once" that meet the targets and stay within ``cap`` are exponentially tilted:
``rate = min(cap, exp(lambda_source * size / mean size))``.  The convex dual has one variable per
source; safeguarded Newton steps solve all of them at once, each step one partial aggregate
over the table of distinct (source, size) pairs.  Rates become whole copies by a hash of the
row, ``floor(rate + u + shift_source)``, with the shift found by section so that a source's taken words
come as near to its target as one document allows.

Sums are of whole numbers, so every rerun gives the same result.  The state (one row per source) is
a table in the shared scratch folder, never collected; only convergence figures reach the driver.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import materialize

#: Rates are summed in units of 1/UNIT.
UNIT = 1 << 30
MAX_STEPS, SECTIONS, ROUNDS = 60, 16, 6


def word_count(text: Column) -> Column:
    """Number of words (runs without space, tab, newline, vertical tab, form feed, return); null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A source as a join key: null is a key of its own, and sorts last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def sized(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (default: the id) as ``c0, c1, ...``, and ``_k`` (source), ``_size`` (words) and ``_u`` (a hash in [0, 1))."""
    u = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(UNIT)) / F.lit(float(UNIT))
    return docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry or [id_col])],
                       _key(F.col(source_col)).alias("_k"), word_count(F.col(text_col)).alias("_size"), u.alias("_u"))


def targets(totals: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Adds ``target`` to a table of sources (``_k``, ``_s``: words in all).

    Sources in key order weigh ``weights``, repeating, and share ``share`` times all words; a target
    stops at ``cap`` times the source's words and the rest is shared again.  In order of
    cap/weight the capped sources come first, so one running sum finds the level."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(Window.orderBy("_k")) - 1).cast("int") % len(weights) + 1)
    t = totals.withColumn("_w", w).withColumn("_max", F.col("_s") * F.lit(float(cap)))
    order = Window.orderBy(F.col("_max") / F.col("_w"), "_k")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("_max").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("_level", (F.sum("_s").over(every) * F.lit(float(share)) - before) / rest)
    fits = F.when(F.col("_level") <= F.col("_max") / F.col("_w"), F.col("_level"))
    t = t.withColumn("_level", F.max(fits).over(every))
    return t.select("_k", "_s", F.least(F.col("_max"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_max"))).alias("target"))


def _rate(size: Column, cap: float) -> Column:
    tilt = F.col("_lam") * size / F.col("_mean")
    return F.least(F.lit(float(cap)), F.exp(F.least(tilt, F.lit(float(cap)))))


def _whole(x: Column) -> Column:
    return F.round(x * F.lit(float(UNIT))).cast("decimal(38,0)")


def balance(rows: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
            tolerance: float = 1e-6) -> DataFrame:
    """One row per source: ``_k, _s, target, _mean, _lam`` and the shifts, from a written table of ``_k, _size, _u``."""
    if share > cap:
        raise ValueError("the targets exceed the cap of all documents together")
    pairs = materialize(rows.groupBy("_k", "_size").agg(F.count("*").alias("_n")), "mix-sizes")
    totals = pairs.groupBy("_k").agg(F.sum(F.col("_size") * F.col("_n")).alias("_s"), F.sum(F.when(F.col("_size") > 0, F.col("_n"))).alias("_docs"),
                                     F.min(F.when(F.col("_size") > 0, F.col("_size"))).alias("_least"))
    state = totals.join(targets(totals.select("_k", "_s"), weights, share, cap).drop("_s"), "_k")
    mean = F.coalesce(F.col("_s") / F.col("_docs"), F.lit(1.0))
    top = F.log(F.lit(float(cap))) * F.col("_mean") / F.coalesce(F.col("_least"), F.lit(1)) + F.lit(1e-6)
    state = state.withColumn("_mean", mean).select(
        "_k", "_s", "target", "_mean", F.when(F.col("target") >= F.col("_s") * F.lit(float(cap)), top).otherwise(0.0).alias("_lam"), (F.lit(-700.0) * F.col("_mean") / F.coalesce(F.col("_least"), F.lit(1))).alias("_lo"), top.alias("_hi"))
    state = materialize(state, "mix-state")
    keep = ["_s", "target", "_mean", "_lam", "_lo", "_hi"]
    pairs = pairs.filter(F.col("_size") > 0)
    for _ in range(MAX_STEPS):
        at = pairs.join(state.filter("_s > 0"), "_k")
        words = F.col("_size") * F.col("_n")
        rate = _rate(F.col("_size"), cap)
        slope = F.when(rate < F.lit(float(cap)), rate * F.col("_size") / F.col("_mean")).otherwise(0.0)
        step = at.groupBy("_k").agg(*[F.first(c).alias(c) for c in keep], F.sum(_whole(rate) * words.cast("decimal(38,0)")).alias("_f"),
                                    F.sum(_whole(slope) * words.cast("decimal(38,0)")).alias("_d"))
        f = F.col("_f").cast("double") / F.lit(float(UNIT)) - F.col("target")
        lo, hi = F.when(f < 0, F.col("_lam")).otherwise(F.col("_lo")), F.when(f > 0, F.col("_lam")).otherwise(F.col("_hi"))
        newton = F.col("_lam") - F.try_divide(f * F.lit(float(UNIT)), F.col("_d").cast("double"))
        step = (step.withColumn("_err", F.abs(f) / F.col("_s")).withColumn("_new", newton).withColumn("_lo2", lo).withColumn("_hi2", hi)
                .withColumn("_new", F.when(F.col("_err") <= F.lit(tolerance), F.col("_lam"))
                            .when((F.col("_new") > F.col("_lo2")) & (F.col("_new") < F.col("_hi2")), F.col("_new"))
                            .otherwise((F.col("_lo2") + F.col("_hi2")) / 2)))
        step = materialize(step.select("_k", "_s", "target", "_mean", F.col("_new").alias("_lam"), F.col("_lo2").alias("_lo"), F.col("_hi2").alias("_hi"), "_err"), "mix-state")
        worst = step.agg(F.max("_err")).first()[0]
        state = step.drop("_err")
        if worst is None or worst <= tolerance:
            break
    solved = materialize(totals.select("_k", "_s").join(state.drop("_s"), "_k", "left").select(
        "_k", "_s", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("_mean", F.lit(1.0)).alias("_mean"), F.coalesce("_lam", F.lit(0.0)).alias("_lam"),
        F.lit(True).alias("_up"), F.lit(-float(cap)).alias("_shift"), F.lit(1 << 62).alias("_limit"), F.lit(-float(cap)).alias("_a"), F.lit(float(cap)).alias("_b")), "mix-state")
    for last in (False, True):
        solved = _section(rows, solved, cap, last)
    return solved


def _copies(size: Column, u: Column, shift: Column, cap: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(float(int(cap))), F.floor(_rate(size, cap) + u + shift)))


def _shift(size: Column, below: Column) -> Column:
    """Rows of up to ``_limit`` words have the shift that is sought, longer ones the shift found before."""
    return F.when(size <= F.col("_limit"), below).otherwise(F.col("_shift"))


def _section(rows: DataFrame, state: DataFrame, cap: float, last: bool) -> DataFrame:
    """Find each source's shift by sections of [_a, _b]; each round is one aggregate over the rows.

    The first call ends at the document that passes the target.  The last one takes both sides of it
    (``_up``: from below, the documents no longer than the gap fill it; from above, they
    are taken back) and keeps the nearer result."""
    rows = rows.select("_k", "_size", "_u").filter(F.col("_size") > 0)
    keep = ["_s", "target", "_mean", "_lam", "_shift", "_limit", "_a", "_b"]
    # words taken at each point of the section, as in ``_copies`` and ``_shift``
    taken = [f"sum(CAST(greatest(0D, least({int(cap)}D, floor(_ru + CASE WHEN _size <= _limit THEN _a + (_b - _a) * {i / SECTIONS}D ELSE _shift END))) AS BIGINT) * _size)"
             for i in range(SECTIONS + 1)]
    for _ in range(ROUNDS):
        at = rows.join(state, "_k").withColumn("_ru", _rate(F.col("_size"), cap) + F.col("_u"))
        sums = at.groupBy("_k", "_up").agg(*[F.first(c).alias(c) for c in keep], F.expr(f"array({', '.join(taken)})").alias("_t"))
        # the last point that takes no more than the target
        sums = sums.withColumn("_i", F.expr(f"greatest(0, {', '.join(f'CASE WHEN _t[{i}] <= target THEN {i} ELSE 0 END' for i in range(1, SECTIONS))})"))
        width = (F.col("_b") - F.col("_a")) / F.lit(float(SECTIONS))
        found = materialize(sums.select(*keep[:-2], "_k", "_up", (F.col("_a") + width * F.col("_i")).alias("_a"), (F.col("_a") + width * (F.col("_i") + 1)).alias("_b"),
                                        F.element_at("_t", F.col("_i") + 1).alias("_ta"), F.element_at("_t", F.col("_i") + 2).alias("_tb")), "mix-shift")
        state = found.drop("_ta", "_tb")
    below, above = F.abs(F.col("_ta") - F.col("target")), F.abs(F.col("_tb") - F.col("target"))
    if not last:
        limit = F.greatest(F.lit(0), F.floor(F.when(F.col("_up"), below).otherwise(above)))
        sides = found.withColumn("_up", F.explode(F.array(F.lit(True), F.lit(False))))
        return sides.select("_k", "_up", *keep[:4], F.when(F.col("_up"), F.col("_a")).otherwise(F.col("_b")).alias("_shift"), limit.alias("_limit"),
                            F.when(F.col("_up"), F.col("_a")).otherwise(F.lit(-float(cap))).alias("_a"), F.when(F.col("_up"), F.lit(float(cap))).otherwise(F.col("_b")).alias("_b"))
    best = F.struct(F.least(below, above).alias("err"), F.col("_up"), F.col("_limit"), F.col("_shift"), F.when(below <= above, F.col("_a")).otherwise(F.col("_b")).alias("_a"))
    sides = found.groupBy("_k").agg(*[F.first(c).alias(c) for c in keep[:4]], F.min(best).alias("best"))
    return sides.select("_k", *keep[:4], "best._shift", "best._limit", "best._a")


def apply(rows: DataFrame, state: DataFrame, cap: float = 2.0) -> DataFrame:
    """``rows`` (of ``sized``) with ``source_size``, ``target``, ``rate``, ``copies`` and ``taken`` (copies x words).

    Documents without words take nothing (0 copies); rows that agree in id, text and source are taken alike."""
    joined = rows.join(state, "_k", "left")
    joined = joined.withColumns({"_s": F.coalesce("_s", F.lit(0)), "target": F.coalesce("target", F.lit(0.0))})
    copies = F.when(F.col("_size") > 0, F.coalesce(_copies(F.col("_size"), F.col("_u"), _shift(F.col("_size"), F.col("_a")), cap), F.lit(0.0))).otherwise(0.0).cast("int")
    return joined.select("*", F.when(F.col("_size") > 0, _rate(F.col("_size"), cap)).alias("rate"), copies.alias("copies"), (copies * F.col("_size")).cast("long").alias("taken"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None,
        weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Columns ``carry`` (default: the id), ``size``, ``source_size``, ``target``, ``rate``, ``copies``, ``taken`` for each row.

    Null texts have size 0; a null source is a source of its own, the last; an empty table gives an
    empty result; other columns of ``docs``, also ones named like the results, are not read unless carried."""
    carry = carry or [id_col]
    rows = sized(docs, id_col=id_col, text_col=text_col, source_col=source_col, carry=carry)
    narrow = materialize(sized(docs, id_col=id_col, text_col=text_col, source_col=source_col), "mix-rows")
    state = balance(narrow.drop("c0"), weights=weights, share=share, cap=cap)
    out = apply(narrow if carry == [id_col] else rows, state, cap)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], F.col("_size").alias("size"), F.col("_s").alias("source_size"), "target", "rate", "copies", "taken")
