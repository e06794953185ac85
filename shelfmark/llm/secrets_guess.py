"""Secrets: fixed base patterns, and values in credential contexts that are hard to guess.

A value that follows a credential word (``password: ...``, ``pwd=...``) is priced by a minimum-cost segmentation: the
least sum, over all ways to cut it, of the logarithms of the guesses for its parts (after Wheeler, zxcvbn: Low-Budget
Password Strength Estimation, 2016). Parts are words by their rank among the words of the whole corpus, dates, repeats,
keyboard or alphabet walks, and brute force. Values that cost ``MIN_COST`` decimal digits of guesses or more are secrets;
names, words and years in such places are not.

The ranks are those of all words of all documents. Only the values of credential contexts are looked up: their distinct
runs of 3 to 24 letters are joined with the ranked words, and each distinct value is priced with the words it holds. No
word is left out and nothing that grows with the input is sent to all tasks.

Values are priced whole, whatever their length. A credential word may stand inside the value of another one; values that
overlap become one span, from the first that is hard to guess. Base spans always stay; of found values that overlap them,
the parts outside are kept. Defined results: a null text is empty and has no spans; rows
are handled one by one, whatever their doc_id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import cut, one_table, texts
from shelfmark.llm.spans import SPAN_DDL, SPAN_TYPE, Span, as_structs, ordered, uncovered

KINDS = ("assign", "access", "hex", "guess")
MIN_COST = 8.0

# Fixed patterns of the contract; short runs are skipped at once, as nothing else can match within them.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credentials?|auth)["']?"""
                      r"""\x20*[:=]\x20*["']?([!-!#-&(-+\--:<-_a-~]{6,})""", re.IGNORECASE | re.ASCII)

_CUES = ("pass", "pwd", "secret", "token", "api", "credential", "auth")

# Well-known passwords' parts, by rank; the corpus gives the rest.
COMMON = ("password admin welcome letmein login master secret dragon monkey shadow sunshine princess football baseball "
          "superman batman trustno iloveyou qwerty hello freedom whatever charlie access guest default changeme test "
          "user root pass love summer winter spring autumn").split()
COMMON_RANKS = {word: k + 1 for k, word in enumerate(dict.fromkeys(COMMON))}
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "0123456789", "qazwsxedc")
_DATE = re.compile(r"(?:19|20)\d\d|[0-3]?\d[./-][01]?\d[./-](?:19|20)?\d\d|(?:19|20)\d\d[./-]?[01]\d[./-]?[0-3]\d")
_BRUTE = 1.0  # decimal digits of guesses for each character
_JOIN = log10(2)  # for each further part
_LETTERS = re.compile(r"[a-z]+")
_VALUES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))


def _has_context(text: str) -> bool:
    """Whether some pattern with a credential word can match at all."""
    if "=" not in text and ":" not in text:
        return False
    low = text.lower()
    return any(word in low for word in _CUES)


def base_spans(text: str) -> list[Span]:
    out = []
    if _has_context(text):
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return ordered(out, KINDS)


def _walks(value: str) -> list[int]:
    """For each start, the longest run that walks along a row of keys or the alphabet, either way."""
    steps = {pair for row in WALKS for text in (row, row[::-1]) for pair in zip(text, text[1:])}
    ends = [0] * len(value)
    for k in range(len(value) - 1, -1, -1):
        ends[k] = ends[k + 1] + 1 if k + 1 < len(value) and (value[k], value[k + 1]) in steps else 1
    return ends


def guess_cost(value: str, ranks: dict[str, int], limit: float = MIN_COST) -> float:
    """log10 of the guesses for the cheapest segmentation of ``value``, exact below ``limit``; else ``limit`` or more.

    Costs only add up, so places that can't be reached below the limit are not followed. That bounds the chunks of
    repeats, and a long value costs time in proportion to its length.
    """
    low = value.lower()
    n = len(value)
    walks = _walks(low)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    far = 0  # no place after it has been reached below the limit
    brute = np.inf  # the cheapest way to here that ends in brute force
    widest = max(24, int(limit / _BRUTE))  # wider chunks are no words and cost the limit by brute force
    until = [0] * (widest + 1)  # for each width, up to where characters equal those one width ahead
    anchor, run_end, start_cost = -1, 0, 0.0  # of a run of walks: the cheapest start so far, whose walks reach to the end

    for i in range(n):
        brute = min(brute, best[i] + (_JOIN if i else 0.0)) + _BRUTE
        best[i + 1] = min(best[i + 1], brute)
        here = best[i] + (_JOIN if i else 0.0)
        if here >= limit:
            if i > far:
                return limit
            continue
        far = max(far, i + 1)
        for j in range(i + 3, min(n, i + 24) + 1):  # words
            rank = ranks.get(low[i:j])
            if rank is not None:
                upper = value[i:j] != low[i:j]
                far = max(far, j)
                best[j] = min(best[j], here + log10(rank + 1) + (
                    log10(2) if upper and value[i + 1:j] == low[i + 1:j] else log10(j - i + 1) if upper else 0.0))
        for end in range(i + 4, min(n, i + 10) + 1):  # dates
            if m := _DATE.match(value, i, end):
                far = max(far, m.end())
                best[m.end()] = min(best[m.end()], here + (log10(119) if m.end() - i == 4 else log10(119 * 365)))
        if walks[i] >= 3:  # walks
            # A later start of a run that costs more than an earlier one is cheaper only for short walks.
            end = i + walks[i]
            if end != run_end or here <= start_cost:
                anchor, run_end, start_cost, last = i, end, here, end
            else:
                last = min(end, i + 3 + int((i - anchor) / max(10 ** (here - start_cost) - 1, 1e-12)))
            far = max(far, last)
            lengths = np.arange(3, last - i + 1)
            best[i + 3:last + 1] = np.minimum(best[i + 3:last + 1], here + np.log10(40 * lengths))
        for width in range(1, min(widest, (n - i) // 2) + 1):  # repeats of a chunk
            if until[width] <= i:
                k = i
                while k + width < n and low[k] == low[k + width]:
                    k += 1
                until[width] = k
            times = 1 + max(0, until[width] - i) // width
            if times > 1 and times * width >= 3:
                word = ranks.get(low[i:i + width])
                chunk = min(_BRUTE * width, 99.0 if word is None else log10(word + 1))
                far = max(far, i + times * width)
                best[i + times * width] = min(best[i + times * width], here + chunk + log10(times))
    return float(best[n])


def hard_from(value: str, ranks: dict[str, int], min_cost: float = MIN_COST) -> int:
    """Where the first value that is hard to guess starts: at 0 or after a credential word inside; -1 for none."""
    at, seen = 0, 0
    while guess_cost(value[at:], ranks, min_cost) < min_cost:
        m = _CONTEXT.search(value, seen)
        if m is None:
            return -1
        at = seen = m.start(1)
    return at


def word_ranks(docs: DataFrame, top: int | None = None) -> DataFrame:
    """(word, rank) of the words of 3 to 24 letters in all texts, after those of COMMON; ``top``: only so many of them.

    Ranks go by count, ties by the word: words are sorted over all tasks and numbered by the sizes of the parts before.
    """
    words = docs.select(F.explode(F.split(F.lower("text"), r"\P{L}+")).alias("word"))
    counted = words.where(F.length("word").between(3, 24) & ~F.col("word").isin(COMMON)).groupBy("word").count()
    # The checkpoint fixes parts and order; the id holds the part in its upper bits and the place in the lower 33.
    placed = cut(counted.orderBy(F.desc("count"), "word").select("word")).withColumn("at", F.monotonically_increasing_id())
    sizes = dict(placed.groupBy(F.shiftright("at", 33).cast("int")).count().collect())  # a row for each part
    starts = [len(COMMON_RANKS)]
    for part in range(max(sizes, default=0)):
        starts.append(starts[-1] + sizes.get(part, 0))
    rank = (F.get(F.array(*map(F.lit, starts)), F.shiftright("at", 33).cast("int")).cast("long")
            + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    ranked = placed.select("word", rank.alias("rank"))
    return ranked if top is None else ranked.where(F.col("rank") <= len(COMMON_RANKS) + top)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct runs of 3 to 24 letters in each value, lower-cased."""
    for numbers, column in one_table(batches, ["number", "value"]):
        for number, value in zip(numbers.to_pylist(), texts(column)):
            found = {run[i:j] for run in _LETTERS.findall(value.lower()) for i in range(len(run) - 2)
                     for j in range(i + 3, min(len(run), i + 24) + 1)}
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(found), pa.int64()),
                                              pa.array(list(found), pa.string())], names=["number", "part"])


def hard_values(found: DataFrame, ranks: DataFrame, min_cost: float = MIN_COST) -> DataFrame:
    """(value, skip): the distinct ``value`` of ``found(value)`` that cost ``min_cost`` or more from place ``skip`` on."""
    values = cut(found.select("value").distinct()).withColumn("number", F.monotonically_increasing_id())
    parts = values.select("number", "value").mapInArrow(_parts, "number long, part string")
    known = (parts.join(ranks, parts.part == ranks.word).groupBy(F.col("number").alias("owner"))
             .agg(F.collect_list(F.struct("word", "rank")).alias("words")))  # at most 22 a letter of the value

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column, words in one_table(batches, ["value", "words"]):
            hard = [(value, hard_from(value, COMMON_RANKS | {w["word"]: w["rank"] for w in held or []}, min_cost))
                    for value, held in zip(texts(column), words.to_pylist())]
            hard = [(value, skip) for value, skip in hard if skip >= 0]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in hard], pa.string()),
                                              pa.array([k for _, k in hard], pa.int64())], names=["value", "skip"])

    return (values.join(known, values.number == known.owner, "left").select("value", "words")
            .mapInArrow(price, "value string, skip long"))


def guess_values(text: str) -> list[dict]:
    """Places and values of the credential contexts; values inside another one are left to ``hard_from``."""
    out, at, last = [], 0, 0
    if not _has_context(text):
        return out
    while m := _CONTEXT.search(text, at):
        at = m.start(1)
        if at >= last:
            out.append({"start": at, "end": m.end(1), "value": m[1]})
            last = m.end(1)
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, column in one_table(batches, ["doc_id", "text"]):
        rows = texts(column)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array([as_structs(base_spans(text)) for text in rows], SPAN_TYPE),
             pa.array([guess_values(text) for text in rows], _VALUES)], names=["doc_id", "base", "found"])


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All spans of rows with their base spans and hard values."""
    for ids, bases, hard in one_table(batches, ["doc_id", "base", "hard"]):
        alls = []
        for base, extra in zip(bases.to_pylist(), hard.to_pylist()):
            base = [(s["start"], s["end"], s["kind"]) for s in base]
            extra = sorted((s["start"], s["end"], "guess") for s in extra or [])
            alls.append(as_structs(ordered([*base, *uncovered(extra, base)], KINDS)))
        yield pa.RecordBatch.from_arrays([ids, bases, pa.array(alls, SPAN_TYPE)], names=["doc_id", "base", "spans"])


def find(docs: DataFrame, top: int | None = None, min_cost: float = MIN_COST) -> DataFrame:
    """doc_id, base (the base spans) and spans (all) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = cut(docs.select("doc_id", "text").mapInArrow(
        _scan, f"doc_id {kind}, base {SPAN_DDL}, found array<struct<start: long, end: long, value: string>>"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # stable: the checkpoint fixes the rows' order
    found = rows.select("row", F.explode("found").alias("f")).select("row", "f.*")
    hard = cut(hard_values(found, word_ranks(docs, top), min_cost))
    held = (found.join(hard, "value").groupBy(F.col("row").alias("owner"))
            .agg(F.collect_list(F.struct((F.col("start") + F.col("skip")).alias("start"), "end")).alias("hard")))
    return (rows.join(held, F.col("row") == F.col("owner"), "left").select("doc_id", "base", "hard")
            .mapInArrow(_combined, f"doc_id {kind}, base {SPAN_DDL}, spans {SPAN_DDL}"))
