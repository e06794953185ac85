"""URL filters: rules first, then the ratio of two character language models.

The URLs that a rule judges are the examples: accepted ones train one model, rejected ones the other. A model is a
variable-order Markov chain over characters: for each context length from 0 to ``ORDER`` the counts of what follows are
blended, longer contexts over shorter ones, by Witten-Bell smoothing. Counts are Spark aggregations over all URLs of the
training part (crc32 of the URL modulo 5 isn't 0). Contexts and what follows them are exact keys of Spark tables, which
grow with the input: each distinct run of ``ORDER + 1`` characters is priced once by joins with these tables, and each
distinct host and path sums the prices of its runs. A URL's score is the difference of its log-likelihoods, divided by its length. The threshold is set on the rest of
the examples, so that as large a share of the accepted as of the rejected falls on its own side.

The models see host and path. They give the verdict where no rule fits.

Defined results: a null URL or one without ``://`` has empty host and path and the score 0; like any other URL without a
rule it is allowed if its score reaches the threshold. Without examples of either kind the threshold is minus infinity
and all is allowed. Repeated rows are judged alike and count as often as they come. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import cut, one_table, raw_texts

ORDER = 5
SCORE_BINS = 2_000
MAX_SCORE = 20.0


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"),
         Rule("org", "/fr/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` up to / ? or #, A-Z lower-cased; then up to ? or #. Both empty where there is none."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    bare = F.regexp_extract(rest, r"^[^?#]*", 0)
    host = F.regexp_extract(bare, r"^[^/]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.substring(bare, F.length(host) + 1, F.length(bare))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _grams(raw: bytes) -> np.ndarray:
    """For each character and the end: its byte below the ORDER bytes before it."""
    text = np.frombuffer(b"\x02" * ORDER + raw + b"\x03", dtype=np.uint8).astype(np.int64)
    n = len(text) - ORDER
    found = np.zeros(n, dtype=np.int64)
    for k in range(ORDER + 1):
        found = found << 8 | text[k:k + n]
    return found


def _steps(rows: DataFrame, key: str) -> DataFrame:
    """(key, gram, n): the distinct grams of each row of ``rows(key, text)``."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, column in one_table(batches, [key, "text"]):
            found = [np.unique(_grams(raw), return_counts=True) for raw in raw_texts(column)]
            owners = np.repeat(np.arange(len(found)), [len(grams) for grams, _ in found])
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(owners)), pa.array(np.concatenate([grams for grams, _ in found])),
                 pa.array(np.concatenate([n for _, n in found]))], names=[key, "gram", "n"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "text").mapInArrow(scan, f"{key} {kind}, gram long, n long")


def _orders(grams: DataFrame) -> DataFrame:
    """A row for each context length: order, context (length and bytes) and pair (context and next byte)."""
    before = F.shiftright("gram", 8)
    contexts = F.array(*[before.bitwiseAND(F.lit((1 << 8 * k) - 1)).bitwiseOR(F.lit(k << 8 * ORDER))
                         for k in range(ORDER + 1)])
    return (grams.select("*", F.posexplode(contexts).alias("order", "context"))
            .withColumn("pair", F.shiftleft("context", 8).bitwiseOR(F.col("gram").bitwiseAND(F.lit(255)))))


def train(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of both chains from ``examples(verdict, text)``: of contexts with what follows, and of contexts with the
    number of different characters that follow."""
    grams = _steps(examples, "verdict").groupBy("verdict", "gram").agg(F.sum("n").alias("n"))
    pairs = cut(_orders(grams).groupBy("context", "pair").agg(
        *[F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in ("allow", "block")]))
    # A checkpoint, so that both sides of the join are plain exchanges, which Spark splits where a context is common.
    contexts = cut(pairs.groupBy("context").agg(
        *[c for v in ("allow", "block") for c in (F.sum(v).alias(f"n_{v}"), F.count_if(F.col(v) > 0).alias(f"kinds_{v}"))]))
    return pairs.select("pair", "allow", "block"), contexts


def _log(verdict: str) -> Column:
    """Log-probability by Witten-Bell: a context trusts itself by its count against its kinds."""
    return F.expr(f"aggregate(orders, 1 / 256D, (p, x) -> CASE WHEN x.n_{verdict} > 0 THEN (coalesce(x.{verdict}, 0) "
                  f"+ x.kinds_{verdict} * p) / (x.n_{verdict} + x.kinds_{verdict}) ELSE p END, p -> ln(p))")


def scores(texts: DataFrame, examples: DataFrame) -> DataFrame:
    """(scored, score) of every distinct ``text``: the difference of log-likelihoods a character."""
    pairs, contexts = train(examples)
    numbered = cut(texts.select("text").distinct()).withColumn("number", F.monotonically_increasing_id())
    steps = cut(_steps(numbered, "number"))
    priced = (_orders(steps.select("gram").distinct()).join(contexts, "context", "left").join(pairs, "pair", "left")
              .groupBy("gram").agg(F.array_sort(F.collect_list(F.struct(
                  "order", "allow", "block", "n_allow", "n_block", "kinds_allow", "kinds_block"))).alias("orders"))
              .select("gram", (_log("allow") - _log("block")).alias("log")))
    # Summed in the grams' order, so that a score doesn't depend on how rows were dealt.
    sums = (steps.join(cut(priced), "gram").groupBy(F.col("number").alias("owner"))
            .agg(F.array_sort(F.collect_list(F.struct("gram", "n", "log"))).alias("all"))
            .select("owner", F.expr("aggregate(all, 0D, (s, x) -> s + x.n * x.log)").alias("sum"),
                    F.expr("aggregate(all, 0L, (s, x) -> s + x.n)").alias("length")))
    return cut(numbered.join(sums, F.col("number") == F.col("owner")).select(
        F.col("text").alias("scored"),
        F.when(F.col("text") == "", 0.0).otherwise(F.col("sum") / F.col("length")).alias("score")))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of ``pages``."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    known = split.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"),
                         F.concat("host", "path").alias("text"),
                         (F.crc32(F.coalesce("url", F.lit("")).cast("binary")) % 5 == 0).alias("held"))
    examples = known.where("ruled IS NOT NULL AND NOT held").select(F.col("ruled").alias("verdict"), "text")
    by_text = scores(known, examples)
    scored = cut(known.join(by_text, F.col("text") == F.col("scored"))
                 .select("page_id", "host", "path", "rule", "ruled", "held", "score"))
    at = threshold(scored.where("ruled IS NOT NULL AND held"))
    by_score = F.when(F.col("score") >= at, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_score).alias("verdict"), "score")


def threshold(held: DataFrame, bins: int = SCORE_BINS) -> float:
    """Where equal shares of the accepted and of the rejected are on the wrong side; from a histogram of fixed size."""
    slot = F.floor((F.least(F.greatest("score", F.lit(-MAX_SCORE)), F.lit(MAX_SCORE)) + MAX_SCORE)
                   / (2 * MAX_SCORE) * bins)
    found = {"allow": np.zeros(bins + 2), "block": np.zeros(bins + 2)}
    for row in held.groupBy("ruled", slot.cast("int").alias("slot")).count().collect():
        found[row["ruled"]][row["slot"]] = row["count"]
    if not found["allow"].sum() or not found["block"].sum():
        return float("-inf")
    lost = np.concatenate([[0], np.cumsum(found["allow"] / found["allow"].sum())])  # accepted below a slot
    passed = 1 - np.concatenate([[0], np.cumsum(found["block"] / found["block"].sum())])  # rejected from it on
    best = np.maximum(lost, passed)
    middle = np.flatnonzero(best == best.min())
    return float(middle[len(middle) // 2]) / bins * 2 * MAX_SCORE - MAX_SCORE
