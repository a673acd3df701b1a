import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators.sequence import bucketed, global_rank, previous_in_key, rank_within_key, running_count_within_key


def _data(spark):
    # key 0 holds half the rows; extra payload columns must not disturb buckets
    return spark.range(0, 40000).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 37).alias("k"),
        (F.col("id") * 7919 % 40009).alias("t"), F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))


def test_hot_key_is_split(spark):
    b = bucketed(_data(spark), ["k"], ["t", "id"], min_hot_rows=1000)
    assert b.split
    per = b.df.groupBy("k", "_b").count()
    assert per.filter("k = 0").count() > 4
    assert per.agg(F.max("count")).first()[0] < 20000


def test_rank_lag_count_match_windows(spark):
    df = _data(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    ref = (df.withColumn("rn2", F.row_number().over(w)).withColumn("pt", F.lag("t").over(w))
           .withColumn("rc2", F.sum(F.when(F.col("id") % 3 == 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    r = rank_within_key(df, ["k"], ["t", "id"], "rn", min_hot_rows=1000)
    p = previous_in_key(df, ["k"], ["t", "id"], ["t"], min_hot_rows=1000)
    c = running_count_within_key(df, ["k"], ["t", "id"], F.col("id") % 3 == 0, "rc", min_hot_rows=1000)
    j = ref.join(r.select("id", "rn"), "id").join(p.select("id", "prev_t"), "id").join(c.select("id", "rc"), "id")
    assert j.count() == 40000
    assert j.filter((F.col("rn") != F.col("rn2")) | ~F.col("prev_t").eqNullSafe(F.col("pt"))
                    | (F.col("rc") != F.col("rc2"))).count() == 0


def _odd(spark):
    # null keys (a third of the rows), null order values, text orders with a long shared prefix, floats with NaN
    return spark.range(0, 6000).select(
        F.when(F.col("id") % 3 != 0, F.col("id") % 5).alias("k"),
        F.when(F.col("id") % 11 != 0, F.col("id") * 7919 % 6007).alias("t"),
        F.when(F.col("id") % 13 != 0, F.concat(F.lit("a-long-shared-prefix-"), F.lpad((F.col("id") * 31 % 6007).cast("string"), 5, "0"))).alias("s"),
        F.when(F.col("id") % 19 == 0, F.lit(None)).when(F.col("id") % 7 == 0, F.lit(float("nan"))).when(F.col("id") % 17 == 0, F.lit(float("inf"))).otherwise(F.col("id") * 37 % 999 / 7.0).alias("f"),
        F.col("id"))


@pytest.mark.parametrize("order", ["t", "s", "f"])
def test_same_answer_whatever_is_hot(spark, order):
    df = _odd(spark)
    w = Window.partitionBy("k").orderBy(order, "id")
    ref = df.withColumn("rn2", F.row_number().over(w)).withColumn("p2", F.lag("id").over(w)) \
        .withColumn("c2", F.sum((F.col("id") % 2).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("g2", F.row_number().over(Window.orderBy(order, "id")))
    want = ref.select("id", "rn2", "p2", "c2", "g2").orderBy("id").collect()
    for hot in (1, 100, 100_000):
        r = rank_within_key(df, ["k"], [order, "id"], "rn", min_hot_rows=hot)
        p = previous_in_key(df, ["k"], [order, "id"], ["id"], min_hot_rows=hot)
        c = running_count_within_key(df, ["k"], [order, "id"], F.col("id") % 2 == 1, "c", min_hot_rows=hot)
        g = global_rank(df, [order, "id"], "g", min_hot_rows=hot)
        got = r.join(p.select("id", "prev_id"), "id").join(c.select("id", "c"), "id").join(g.select("id", "g"), "id") \
            .select("id", "rn", "prev_id", "c", "g").orderBy("id").collect()
        assert [tuple(x) for x in got] == [tuple(x) for x in want], (order, hot)
    b = bucketed(df, ["k"], [order, "id"], 100)
    per = b.df.groupBy("k", "_b").count()
    assert b.split and per.filter("k is null").count() > 3 and per.filter("k is null").agg(F.max("count")).first()[0] < 1200


def test_unsplittable_order_raises(spark):
    with pytest.raises(TypeError):
        bucketed(_odd(spark), ["k"], [F.col("t").desc()])
    with pytest.raises(TypeError):
        bucketed(_odd(spark).withColumn("a", F.array("t")), ["k"], ["a"])


@pytest.mark.parametrize("hot", [5, 100_000])
def test_running_sum_with_the_keys_total(spark, hot):
    import random

    from quire.operators.sequence import running_sum_within_key

    rng = random.Random(4)
    rows = [(k, i, rng.randint(0, 3)) for k, n in ((1, 300), (2, 4), (None, 90), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k long, i long, v long")
    got = {(r.k, r.i): (r.upto, r.whole) for r in running_sum_within_key(df, ["k"], ["i"], F.col("v"), "upto", hot, total="whole").collect()}
    assert got == {(k, i): (sum(v for a, b, v in rows if a == k and b <= i), sum(v for a, _, v in rows if a == k)) for k, i, _ in rows}
