"""Quality rules combined by weak supervision, with DataFrame functions only.

Every rule votes good (+1), bad (-1) or abstains (0). Votes are counted by pattern (at most 3 to the number of rules
patterns, whatever the input), expectation-maximisation on the counted patterns estimates each rule's accuracies and the
share of good documents, and a document's verdict is its posterior probability of being good. Votes are taken to be
independent given the verdict, so each fault has one rule: two rules on one counter would count it twice.

Defined results: null text has no words and fails the base rule; rules that divide by a count of zero abstain; repeated
rows are judged alike; an empty table gives an empty result. Whole texts are measured, of any length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import WHITESPACE, let, materialize, table, words

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated_words(w: Column) -> Column:
    """How many words of the bound array ``w`` lie in a 3-word window that occurs twice or more in it.

    Windows are sorted by hash, so that equal ones are neighbours; no map or quadratic search is needed.
    """
    n = F.size(w)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return F.when(n >= 3, let(F.sort_array(windows), covered)).otherwise(0)


def measures(text: Column) -> Column:
    """Struct of the counts that rules use."""
    t = F.coalesce(text, F.lit(""))
    visible = _without(t, WHITESPACE)
    lines = F.filter(F.split(t, "\n"), lambda x: _without(x, WHITESPACE) != "")

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        ended = F.size(F.filter(x, lambda y: F.rtrim(y).rlike("[.!?:;\"')]$")))
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), ended.cast("long").alias("n_ended"))

    return F.struct(
        let(words(text), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.length(visible).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(_without(t, CAPITALS))).cast("long").alias("n_capitals"),
        (F.length(t) - F.length(_without(t, "!"))).cast("long").alias("n_shouts"),
    )


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains; SQL conditions over the measures."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.expr(f"CASE WHEN {self.bad} THEN -1 WHEN {self.good} THEN 1 ELSE 0 END").alias(self.name)


RULES = (
    Rule("length", "n_words < 20", "n_words >= 50"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words AND n_words > 0"),
    Rule("duplicate_lines", "n_lines >= 6 AND 10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 AND n_lines >= 3"),
    Rule("repetition", "10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words <= n_words AND n_words >= 50"),
    Rule("word_length", "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 12 * n_words)", "word_chars BETWEEN 4 * n_words AND 9 * n_words AND n_words > 0"),
    Rule("shouting", "10 * n_capitals > 3 * word_chars OR 10 * n_shouts > n_words", "10 * n_capitals <= word_chars AND 50 * n_shouts <= n_words AND n_words > 0"),
    Rule("line_ends", "10 * n_ended < 2 * n_lines", "10 * n_ended >= 8 * n_lines AND n_lines > 0"),
)


@dataclass(frozen=True)
class Prior:
    """A beta prior: the expected share, and its weight as a multiple of the votes (or documents) that there are, plus ten."""

    share: float
    weight: float


#: Rules are written to accuse few good documents; that is worth ten times the votes, since a fault that only one rule sees
#: would else be explained as that rule's noise. How often a rule notices a bad document, and how many there are, is left
#: to the votes: 5% and 10% of weight.
ON_GOOD, ON_BAD, GOOD = Prior(0.995, 10.0), Prior(0.2, 0.05), Prior(0.8, 0.1)


@dataclass(frozen=True)
class Model:
    """Share of good documents, and of each rule the share of right votes on good and on bad documents."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]


def fit(votes: DataFrame, rules=RULES, rounds: int = 30, good: Prior = GOOD, on_good: Prior = ON_GOOD, on_bad: Prior = ON_BAD) -> Model:
    """Accuracies of the rules by expectation-maximisation over the counted vote patterns, without labels.

    A rule has two accuracies, since most rules see one kind of fault: many right votes on good documents say little
    about how often it notices a bad one. Each maximisation is that of the posterior under the beta priors; nothing is
    clamped. The patterns are bounded by the number of rules, so the whole fit is one expression over one row.
    """
    names = [r.name for r in rules]
    counted = votes.groupBy(*names).agg(F.count("*").cast("double").alias("n"))
    one = counted.agg(F.sort_array(F.collect_list(F.struct(F.array(*names).alias("v"), F.col("n")))).alias("p"))
    evidence = "aggregate(sequence(0, size(x.v) - 1), ln(s.prior / (1 - s.prior)), (t, j) -> t + CASE x.v[j] WHEN 1 THEN ln(s.good[j] / (1 - s.bad[j])) WHEN -1 THEN ln((1 - s.good[j]) / s.bad[j]) ELSE 0D END)"
    expected = f"transform(p, x -> named_struct('v', x.v, 'n', x.n, 'q', 1 / (1 + exp(-({evidence})))))"

    def total(of: str) -> str:
        return f"aggregate(e, 0D, (t, x) -> t + x.n * ({of}))"

    def share(right: str, all_: str, there: str, prior: Prior) -> str:
        weight = f"({prior.weight}D * {there} + 10)"
        return f"({right} + {weight} * {prior.share}D) / ({all_} + {weight})"

    def accuracy(vote: int, weight: str, prior: Prior) -> str:
        right = total(f"CASE WHEN x.v[j] = {vote} THEN {weight} ELSE 0D END")
        return share(right, total(f"abs(x.v[j]) * ({weight})"), total("abs(x.v[j])"), prior)

    numbers = f"sequence(0, {len(names) - 1})"
    step = f"""transform(array({expected}), e -> named_struct(
        'prior', {share(total("x.q"), total("1D"), total("1D"), good)},
        'good', transform({numbers}, j -> {accuracy(1, "x.q", on_good)}),
        'bad', transform({numbers}, j -> {accuracy(-1, "1 - x.q", on_bad)})))[0]"""
    start = f"named_struct('prior', {good.share}D, 'good', array_repeat({on_good.share}D, {len(names)}), 'bad', array_repeat({on_bad.share}D, {len(names)}))"
    found = one.select(F.expr(f"aggregate(sequence(1, {rounds}), {start}, (s, i) -> {step})").alias("m")).first().m
    return Model(found.prior, tuple(found.good), tuple(found.bad))


def judge(docs: DataFrame, rules=RULES, least: float = 0.5) -> DataFrame:
    """doc_id, the measures, ``probability`` (posterior of being good), ``base_failed`` and ``kept`` for every row of ``docs``.

    The measures are written once (a few numbers a row); texts are read once and never shuffled.
    """
    m = docs.select(docs["doc_id"].alias("doc_id"), measures(docs["text"]).alias("m"))
    flat = m.select("doc_id", "m.w.*", "m.l.*", "m.word_chars", "m.n_symbols", "m.n_capitals", "m.n_shouts")
    measured = materialize(flat, "rule-measures")
    voted = measured.select("*", *(r.vote() for r in rules))
    model = fit(voted, rules)
    logit = F.lit(math.log(model.prior / (1 - model.prior)))
    for r, g, b in zip(rules, model.on_good, model.on_bad, strict=True):
        logit = logit + F.when(F.col(r.name) == 1, math.log(g / (1 - b))).when(F.col(r.name) == -1, math.log((1 - g) / b)).otherwise(0.0)
    judged = voted.withColumn("probability", 1 / (1 + F.exp(-logit)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("probability") >= least))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


QUERIES = {"op10_quality_rules": op10_quality_rules}
SQL: dict[str, str] = {}
