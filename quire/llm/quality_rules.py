"""Quality rules by weak supervision, in DataFrame functions only.

Each rule looks at a few counts of a text and votes that it is good (1), bad (-1), or abstains (0).
Instead of asking for all rules to pass, the votes are weighed by how far each rule can be trusted:
a document is good with probability ``prior``; a rule that does not abstain calls a good document bad with
probability ``false_alarm`` and a bad one bad with probability ``catch``.  Expectation-maximisation estimates
these rates from the votes alone, without labels.  Documents with equal votes have equal posteriors, so the
steps run over the table of distinct vote vectors (at most 3 ** rules rows, whatever the corpus); a step is
one aggregate over it, and only its sums, three numbers a rule, reach the driver.

Posteriors are summed in units of 1/UNIT as whole numbers, so reruns agree.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import materialize

#: Posteriors are summed in units of 1/UNIT.
UNIT = 1 << 20
#: Steps at most, and the change of a rate below which they end.
MAX_STEPS, TOLERANCE = 40, 1e-5
#: Rules are written to spare good documents: no rule is taken to call more than this share of them bad.  Without the bound a
#: kind of rubbish that only one rule sees would be explained away as that rule's false alarms.
MAX_FALSE_ALARM = 0.002
#: Votes that every rate is smoothed by, and the rates they show: good documents, false alarms, catches.
PRIOR_VOTES, PRIOR, FALSE_ALARM, CATCH = 20.0, 0.8, 0.001, 0.3
#: Posterior of good that documents start with if some rule calls them bad, and if none does.
START_BAD, START_GOOD = 0.1, 0.95

WORD_BREAK = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _repeats(words: Column) -> Column:
    """Words covered by a 3-word window that occurs twice or more among ``words``.

    Windows are sorted with their positions; equal neighbours are repeats.  Each repeat adds the words
    that the one before it did not cover."""
    windows = F.when(F.size(words) < 3, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.concat_ws(" ", words[i], words[i + 1], words[i + 2])))

    def covered(t: Column) -> Column:
        ordered = F.sort_array(F.transform(t, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda x, k: F.coalesce(
            (x["w"] == F.get(s, k + 1)["w"]) | (k > 0) & (x["w"] == F.get(s, k - 1)["w"]), (k > 0) & (x["w"] == F.get(s, k - 1)["w"]))))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])

    return let(windows, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(covered(t)))


def measures(text: Column) -> Column:
    """A struct of counts over the whole text (null: no words): words, their code points, symbols, lines with
    a word, those equal to an earlier one, repeated words, letters, capitals, exclamation marks, sentence ends."""
    t = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    left = lambda other: F.length(F.regexp_replace(t, other, "")).cast("long")  # noqa: E731 - cheaper than a match a character
    words = F.filter(F.split(t, WORD_BREAK), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_word = let(words, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeats(w).alias("again")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    return let(F.struct(by_word.alias("w"), by_line.alias("l")), lambda s: F.struct(
        s["w"]["n"].cast("long").alias("n_words"), s["w"]["chars"].cast("long").alias("word_chars"), count(r"[#*$%&|<>]").alias("n_symbols"),
        s["l"]["dup"].cast("long").alias("n_dup_lines"), s["w"]["again"].cast("long").alias("n_repeat_words"), s["l"]["n"].cast("long").alias("n_lines"),
        left(r"\P{L}+").alias("n_letters"), left(r"\P{Lu}+").alias("n_capitals"), count("!").alias("n_exclamations"), count(r"[.?!。？！](?=[\x20\x09-\x0D]|\z)").alias("n_ends")))


@dataclass(frozen=True)
class Rule:
    """Conditions, in SQL over ``measures``, under which a text is called bad or good; else the rule abstains."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words AND n_words > 0"),
    Rule("repeated_words", "10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words <= n_words AND n_words >= 20"),
    Rule("repeated_lines", "n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines", "n_lines >= 4 AND 10 * n_dup_lines <= n_lines"),
    Rule("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)", "word_chars BETWEEN 3 * n_words AND 12 * n_words AND n_words > 0"),
    Rule("capitals", "n_letters >= 20 AND 10 * n_capitals > 4 * n_letters", "n_letters >= 20 AND 10 * n_capitals <= 2 * n_letters"),
    Rule("shouting", "n_words >= 10 AND 5 * n_exclamations > n_words", "n_words >= 10 AND 20 * n_exclamations <= n_words"),
    Rule("letters", "n_words > 0 AND 10 * n_letters < 6 * word_chars", "n_words > 0 AND 10 * n_letters >= 8 * word_chars"),
    Rule("sentences", "n_words >= 200 AND n_ends = 0", "n_words >= 20 AND 100 * n_ends >= 2 * n_words"),
    Rule("length", "n_words < 5", "n_words >= 50"),
)


def votes(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """One column a rule: -1 (bad), 1 (good) or 0 (abstains); both conditions true counts as bad."""
    return [F.expr(f"CAST(CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END AS TINYINT)").alias(f"v_{r.name}") for r in rules]


@dataclass(frozen=True)
class Trust:
    """What the estimation found: the share of good documents and each rule's rates of calling documents bad."""

    prior: float
    false_alarm: tuple[float, ...]
    catch: tuple[float, ...]


def posterior(trust: Trust, rules: tuple[Rule, ...] = RULES) -> Column:
    """Probability that a document with these votes is good.

    The weights of the votes are one array constant (three a rule: bad, abstains, good; the prior's with the first), so that
    the generated code is the same at every step."""
    weights = []
    for a, b in zip(trust.false_alarm, trust.catch):
        weights += [log(a / b), 0.0, log((1 - a) / (1 - b))]
    weights[:3] = [w + log(trust.prior / (1 - trust.prior)) for w in weights[:3]]
    table = f"array({', '.join(f'{w!r}D' for w in weights)})"
    total = " + ".join(f"get({table}, {3 * i + 1} + v_{r.name})" for i, r in enumerate(rules))
    return F.expr(f"1D / (1D + exp(-({total})))")


def estimate(patterns: DataFrame, rules: tuple[Rule, ...] = RULES) -> Trust:
    """Expectation-maximisation over a table of vote vectors and their numbers ``_n``.

    The first posteriors say "bad if any rule says so".  Rates stay within smoothing: an empty table gives the rates of
    the smoothing votes.  A rule that calls bad documents bad no more often than good ones is worth nothing: its catch is
    held at its false alarms, so no rule is turned round."""
    names = [f"v_{r.name}" for r in rules]
    sums = ["sum(_g) AS good", "sum(_b) AS bad"]
    for i, v in enumerate(names):
        sums += [f"sum(if({v} = -1, _{x}, 0L)) AS {x}hit{i}" for x in "gb"] + [f"sum(if({v} <> 0, _{x}, 0L)) AS {x}all{i}" for x in "gb"]
    good = F.expr(f"if(array_min(array({', '.join(names)})) = -1, {START_BAD}D, {START_GOOD}D)")

    def rate(hits: float, of: float, at: float) -> float:
        return (hits + PRIOR_VOTES * at) / (of + PRIOR_VOTES)

    trust = None
    for _ in range(MAX_STEPS):  # each step is one small job
        shares = patterns.withColumn("_g", F.round(good * UNIT).cast("long")).selectExpr(*names, "_g * _n AS _g", f"({UNIT}L - _g) * _n AS _b")
        row = shares.selectExpr(*sums).first()  # one row, whatever the corpus
        x = {k: (y or 0) / UNIT for k, y in row.asDict().items()}
        at = range(len(names))
        false_alarm = tuple(min(MAX_FALSE_ALARM, rate(x[f"ghit{i}"], x[f"gall{i}"], FALSE_ALARM)) for i in at)
        catch = tuple(max(false_alarm[i], rate(x[f"bhit{i}"], x[f"ball{i}"], CATCH)) for i in at)
        new = Trust(rate(x["good"], x["good"] + x["bad"], PRIOR), false_alarm, catch)
        moved = max(abs(p - q) for p, q in zip((new.prior, *new.false_alarm, *new.catch), (trust.prior, *trust.false_alarm, *trust.catch))) if trust else 1.0
        trust, good = new, posterior(new, rules)
        if moved < TOLERANCE:
            break
    return trust


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, rules: tuple[Rule, ...] = RULES,
          min_words: int = 50, max_repeats: float = 0.5, threshold: float = 0.5) -> DataFrame:
    """Columns ``carry`` (default: the id), the counts of ``measures``, a vote a rule, ``quality`` (posterior), ``base_failed`` and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than a share ``max_repeats`` of them repeated; such rows are not
    kept, others are if their posterior is ``threshold`` or more.  All rows take part in the estimate.
    Null and empty texts have no words and fail; repeated rows are judged alike; an empty table gives an empty
    result; other columns, also ones named like the results, are not read unless carried.  A text is held by one task as its words
    and windows, some ten times its bytes."""
    carry = carry or [id_col]
    src = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], measures(F.col(text_col).cast("string")).alias("_m"))
    counted = materialize(src.select(*[f"_c{i}" for i in range(len(carry))], "_m.*"), "quality-counts")
    voted = counted.select("*", *votes(rules))
    patterns = materialize(voted.groupBy(*[f"v_{r.name}" for r in rules]).agg(F.count("*").alias("_n")), "quality-votes")
    trust = estimate(patterns, rules)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.lit(max_repeats) * F.col("n_words"))
    out = voted.withColumn("quality", posterior(trust, rules)).withColumn("base_failed", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], *[c for c in out.columns if not c.startswith("_c")])
