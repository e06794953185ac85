"""Quality rules: a threshold table compiled into one projection of native expressions.

All measures come from one pass over the text inside the JVM; there is no shuffle and no Python worker. The rule table
is data: each rule bounds one ratio of the measures, and ``compile_rules`` turns the table into a single boolean.

Defined results: a null text has no words, fails the base rules and is not kept. Texts without a line or word give zero
counts and zero ratios. Rows are judged one by one, so repeated rows get equal results. Extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for it was on with as be by this are at from or an not "
    "de la le les et des en un une du que qui dans pour par sur est au "
    "der die das und den von zu mit sich auf ein eine ist im dem nicht "
    "el los las y del se por con una para su al lo como es"
).split()


class Rule(NamedTuple):
    """``low <= measure <= high`` must hold; a bound of None is open."""

    name: str
    measure: str
    low: float | None
    high: float | None


# The threshold table. A measure is a ratio over the columns that `measures` adds. Every text has one stop word granted,
# so that short texts without any aren't lost.
RULES = (
    Rule("word_length", "word_chars / n_words", 2.0, 20.0),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.3),
    Rule("stop_word_share", "(n_stop_words + 1) / n_words", 0.02, None),
    Rule("duplicate_line_share", "n_dup_lines / n_lines", None, 0.4),
    Rule("words_per_line", "n_words / n_lines", 1.5, None),
)

# Windows are compared by a 64-bit hash of their words' hashes. Only a text with some repeated window pays for the sort.
_REPEATS = f"""
CASE WHEN n_words <= {WINDOW} THEN 0L ELSE
transform(array(transform(__words, w -> xxhash64(w))), h ->
transform(array(transform(sequence(0, n_words - {WINDOW}),
                          i -> xxhash64({", ".join(f"get(h, CAST(i AS INT) + {k})" for k in range(WINDOW))}))), g ->
CASE WHEN size(array_distinct(g)) = size(g) THEN 0L ELSE
transform(array(sort_array(transform(g, (x, i) -> named_struct('x', x, 'i', i)))), s ->
transform(array(sort_array(transform(
    filter(s, (e, j) -> coalesce(get(s, j - 1).x = e.x, false) OR coalesce(get(s, j + 1).x = e.x, false)),
    e -> e.i))), p ->
aggregate(transform(p, (i, j) -> CASE WHEN j = 0 THEN {WINDOW} ELSE least({WINDOW}, i - get(p, j - 1)) END),
          0L, (total, x) -> total + x))[0])[0] END)[0])[0] END
"""


def _measured(docs: DataFrame, keep: list[Column]) -> DataFrame:
    # Splitting at every single separator gives one part more than there are separators.
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(*keep, F.split(text, r"[\x20\x09-\x0D]").alias("__parts"), lines.alias("__lines"),
                        F.length(text).alias("__length"),
                        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long")
                        .alias("n_symbols"))
    kept = [c for c in first.columns if not c.startswith("__") or c == "__doc"]
    second = first.select(*kept, F.array_remove("__parts", "").alias("__words"),
                          (F.col("__length") - F.size("__parts") + 1).cast("long").alias("word_chars"),
                          F.size("__lines").cast("long").alias("n_lines"),
                          (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"))
    kept = [c for c in second.columns if c != "__words"]
    third = second.select(*kept, "__words", F.size("__words").cast("long").alias("n_words"))
    return third.select(
        *kept, "n_words", F.expr(_REPEATS).alias("n_repeat_words"),
        F.size(F.filter("__words", lambda w: w.isin(STOP_WORDS + [w.title() for w in STOP_WORDS]))).cast("long")
        .alias("n_stop_words"))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each text."""
    return _measured(docs, [F.col("doc_id")])


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression: every rule of the table holds. A ratio without a denominator counts as 0."""
    holds = F.lit(True)
    for rule in rules:
        top, bottom = map(F.expr, rule.measure.split(" / "))
        value = F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))
        if rule.low is not None:
            holds = holds & (value >= rule.low)
        if rule.high is not None:
            holds = holds & (value <= rule.high)
    return holds


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, the measures, ``base_failed`` and ``kept``."""
    return (measures(docs).withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & compile_rules(rules)))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    whole = docs.select(F.struct("*").alias("__doc"), "text")
    good = _measured(whole, [F.col("__doc")]).where(~base_failed() & compile_rules(rules))
    return good.select("__doc.*")
