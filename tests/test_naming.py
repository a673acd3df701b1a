import itertools
import random

from quire.operators.naming import unique_names


def by_the_rule(stems):
    """Each stem, in order, takes the first of s, s (2), s (3) ... that nobody has, whatever its case."""
    taken, names = set(), []
    for s in stems:
        s = s or "document"
        candidates = itertools.chain([s], (f"{s} ({k})" for k in itertools.count(2)))
        names.append(next(c for c in candidates if c.lower() not in taken))
        taken.add(names[-1].lower())
    return names


def _names(spark, stems, min_hot_rows=100_000):
    df = spark.createDataFrame(list(enumerate(stems)), "ord long, stem string")
    return [r.name for r in unique_names(df, "stem", ["ord"], "name", min_hot_rows).orderBy("ord").collect()]


def test_unique_names_golden(spark):
    assert _names(spark, ["a", "a", "a (2)"]) == ["a", "a (2)", "a (2) (2)"]
    assert _names(spark, ["a (2)", "a", "a"]) == ["a (2)", "a", "a (3)"]
    assert _names(spark, ["Foo", "foo"]) == ["Foo", "foo (2)"]


def test_unique_names_match_the_rule(spark):
    rnd = random.Random(11)
    pool = ["a", "A", "a (2)", "a (3)", "a (2) (2)", "b", "B (2)", "doc", "Σ", "σ", "x (10)", "x"]
    stems = [rnd.choice(pool) for _ in range(600)] + ["document"] * 900
    rnd.shuffle(stems)
    got = _names(spark, stems, min_hot_rows=50)  # force the hot-key split of 'document'
    assert got == by_the_rule(stems)
    assert len({g.lower() for g in got}) == len(got)


def test_hot_mixed_family_is_exact(spark):
    rnd = random.Random(5)
    pool = ["a"] * 30 + ["a (2)", "A (3)", "a (2) (2)", "a (5)", "a (02)", "a (1)"] + ["a (2)"] * 5
    stems = [rnd.choice(pool) for _ in range(1500)]
    got = _names(spark, stems, min_hot_rows=100)  # the family and stem 'a' are cut into buckets
    assert got == by_the_rule(stems)


def test_many_random_families(spark):
    rnd = random.Random(23)
    for _ in range(3):
        base = [rnd.choice(["x", "y"]) for _ in range(4)]
        pool = []
        for b in base:
            pool += [b, f"{b} (2)", f"{b} (3)", f"{b} (2) (2)", f"{b} (2) (3)", f"{b.upper()} (4)"]
        stems = [rnd.choice(pool) for _ in range(300)]
        assert _names(spark, stems) == by_the_rule(stems)


def test_null_and_empty_stems_are_kept(spark):
    stems = ["a", None, "document", "", None, "document (2)", "a (2)", None, "a"]
    for hot in (1, 100_000):
        assert _names(spark, stems, hot) == by_the_rule(stems)


def test_numbered_families(spark):
    rnd = random.Random(9)
    stems = [f"scan ({i})" for i in range(1, 200)] + ["scan"] * 150 + [f"page ({i * 37})" for i in range(1, 30)] + ["page"] * 300
    rnd.shuffle(stems)
    assert _names(spark, stems, 60) == by_the_rule(stems)
