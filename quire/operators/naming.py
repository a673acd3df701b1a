"""Collision-safe export names (WIN-1).

Rule: in request order, each row takes the first of ``s``, ``s (2)``,
``s (3)`` ... whose lower-cased form is not taken yet; the taken set includes
generated names (so ``a, a, a (2)`` gives ``a``, ``a (2)``, ``a (2) (2)``).

Decomposition: a candidate of ``s`` never leaves the *family* of ``s`` (its
lower-cased text with all trailing `` (digits)`` groups removed), so families
are independent.

* A family with a single distinct lower-cased stem: the k-th row is ``s``
  (k = 1) or ``s (k)`` - a rank, computed with the skew-safe
  ``rank_within_key`` (the fallback stem 'document' can be a very hot key).
* A family that mixes stems (``a`` and ``a (2)``): the name ``l (j)`` can only
  be claimed by stem ``l`` (as its j-th candidate) or by stem ``l (j)`` itself
  (as its first), so stems form a tree and each parent-child pair competes
  for exactly one name; whoever gets there first blocks it for the other.
  Stem ``l``'s r-th row then takes the r-th index not blocked.  Child ``l (j)`` comes first
  if fewer of the parent's rows precede it than the parent needs to reach j; those counts
  are one running count over the parents' rows.  The conflicts are then resolved per family over its
  *distinct stems* that have a parent (a few numbers each), parents before children, and a
  second running count over the blocked indices gives every row its index.

A null or empty stem counts as the fallback stem; no row is lost.
"""
from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.sequence import MIN_HOT_ROWS, rank_within_key, running_count_within_key
from quire.session import materialize, ship_package

FAMILY_SUFFIX = r"( \([0-9]+\))+\z"
CHILD_OF = r"^(.*) \(([1-9][0-9]{0,17})\)\z"   # parent stem and the index it would generate
FALLBACK_STEM = "document"


def _index_name(stem_col: str, k) -> F.Column:
    return F.when(k == 1, F.col(stem_col)).otherwise(F.format_string("%s (%d)", F.col(stem_col), k))


RESOLVE_OUTPUT = T.StructType([T.StructField("_low", T.StringType()), T.StructField("_index", T.LongType())])


def _resolve_family(pdf: pd.DataFrame) -> pd.DataFrame:
    """Blocked indices of one family's stems, from its stems that have a parent.

    ``before`` counts the parent's rows before the child's first row.  With ``lost`` smaller indices
    blocked already, the parent's row number j - lost would take index j: the child is first
    if that row is not among those before it."""
    children = defaultdict(list)
    for r in pdf.itertuples(index=False):
        children[r.parent].append((int(r.j), int(r.before), r.low))
    own = set(pdf["low"])
    out, queue = [], [(p, 0) for p in children if p not in own]
    while queue:
        parent, lost = queue.pop()
        for j, before, low in sorted(children[parent]):
            child_first = j - lost > before
            out.append((parent, j) if child_first else (low, 1))
            lost += child_first
            if low in children:
                queue.append((low, 0 if child_first else 1))
    return pd.DataFrame(out, columns=["_low", "_index"])


def _mixed_names(d: DataFrame, order_cols: list[str], out: str, min_hot_rows: int) -> DataFrame:
    """Names for the rows of families that mix stems (see module docstring)."""
    ship_package(d.sparkSession)
    timed = rank_within_key(d, ["_fam"], order_cols, "_t", min_hot_rows)          # time within the family
    # row number within the stem; read by three branches below, so written once
    ranked = materialize(rank_within_key(timed, ["_low"], ["_t"], "_r", min_hot_rows), "names-ranked")
    stems = ranked.groupBy("_fam", "_low").agg(F.min("_t").alias("_t"))
    stems = stems.withColumn("parent", F.when(F.col("_low").rlike(CHILD_OF), F.regexp_extract("_low", CHILD_OF, 1))) \
                 .withColumn("j", F.when(F.col("_low").rlike(CHILD_OF),
                                         F.regexp_extract("_low", CHILD_OF, 2).cast("long")))
    kids = materialize(stems.filter(F.col("j") >= 2).join(stems.select(F.col("_low").alias("parent")), "parent", "left_semi")
                       .withColumnRenamed("_low", "low"), "names-children")
    parents = ranked.select(F.col("_low").alias("parent"), "_t").join(kids.select("parent").distinct(), "parent", "left_semi")
    events = kids.unionByName(parents, allowMissingColumns=True)
    counted = running_count_within_key(events, ["parent"], ["_t"], F.col("low").isNull(), "before", min_hot_rows)
    blocked = counted.filter(F.col("low").isNotNull()).select("_fam", "parent", "low", "j", "before") \
        .groupBy("_fam").applyInPandas(_resolve_family, RESOLVE_OUTPUT)
    blocked = rank_within_key(materialize(blocked, "names-blocked"), ["_low"], ["_index"], "_nth", min_hot_rows)
    # index - nth free indices lie below a blocked one: a row with a larger number steps over it
    steps = blocked.select("_low", (F.col("_index") - F.col("_nth")).alias("_r"), F.lit(True).alias("_step"))
    both = ranked.withColumn("_step", F.lit(False)).unionByName(steps, allowMissingColumns=True)
    placed = running_count_within_key(both, ["_low"], ["_r", "_step"], F.col("_step"), "_over", min_hot_rows)
    named = placed.filter(~F.col("_step"))
    return named.withColumn(out, _index_name("_stem_used", F.col("_r") + F.col("_over"))).drop("_t", "_r", "_step", "_over")


def unique_names(df: DataFrame, stem_col: str, order_cols: list[str], out: str = "name",
                 min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Add ``out``: a name unique case-insensitively across all rows of ``df``.
    ``order_cols`` must give a total order (request order)."""
    d = df.withColumn("_stem_used", F.coalesce(F.nullif(F.col(stem_col), F.lit("")), F.lit(FALLBACK_STEM)))
    low = F.lower("_stem_used")
    d = d.withColumn("_low", low).withColumn("_fam", F.regexp_replace(low, FAMILY_SUFFIX, ""))
    fam = d.groupBy("_fam").agg((F.min("_low") == F.max("_low")).alias("_single"))
    d = d.join(fam, "_fam")

    fast = rank_within_key(d.filter("_single"), ["_low"], order_cols, "_k", min_hot_rows)
    fast = fast.withColumn(out, _index_name("_stem_used", F.col("_k"))).drop("_k", "_low", "_fam", "_single", "_stem_used")
    mixed_in = d.filter(~F.col("_single")).drop("_single")
    if mixed_in.limit(1).count() == 0:  # common case: no family mixes stems
        return fast
    mixed = _mixed_names(mixed_in, order_cols, out, min_hot_rows).drop("_low", "_fam", "_stem_used")
    return fast.unionByName(mixed)
