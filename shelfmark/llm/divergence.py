"""How far the sources of a language differ in their words.

Terms are runs of letters (ASCII letters and all characters beyond ASCII), only A-Z lower-cased, counted by language and
source. Counting works on packed terms: a term of up to 8 bytes is one 64-bit word, one of up to 16 bytes two words, and
these are put in order by a radix sort of 16-bit digits and counted as runs. Longer terms go to buckets of 32, 64, ...
bytes, each sorted by its bytes. A task keeps a bounded number of packed terms (``HELD``) before it sends their counts, and
cuts long texts between two terms, so its memory doesn't grow with the texts or the vocabulary.

A term is kept for a language if at least ``LEAST_DOCS`` of its documents hold it. Shares are smoothed over the kept terms
and measured in billionths, with integers throughout. Two results: the divergence of each source from each other source of
its language, and the terms that set a source apart from its language.

Pairs are summed over terms by tiles of ``TILE`` by ``TILE`` sources, in numpy: terms come with the sources that have them,
all other sources have their least share, so no row for a pair and a term is ever made. The list of groups (a language and
a source) is broadcast; the result has a row for each pair of groups of a language, so that list is as small as the
square root of the result.

Defined results: null text, language and source are empty strings. Empty texts count as documents and make their group
occur. Repeated rows count each. A language without kept terms has pairs of value 0 and no terms. Extra columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm.common import one_table, raw_texts
from shelfmark.session import hinted, materialize

LEAST_DOCS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
CHUNK = 4 << 20
HELD = 1 << 20
TILE = 128
TERMS_AT_ONCE = 4096
TILES_HELD = 256

# Lower-case letters and all bytes of longer characters; anything else is zero, which no term holds.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 0 for c in range(256))
_GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
_DIGIT = 16


def radix_order(words: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """The stable order of rows of unsigned words, the first column counting most, by 16-bit digits from the last."""
    order = np.arange(len(words)) if order is None else order
    for column in words.T[::-1]:
        for shift in range(0, 8 * words.itemsize, _DIGIT):
            digit = (column >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]  # a radix sort for 16-bit integers
    return order


def _ordered(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """``order`` put in the order of the keys, stable: words by radix, long terms by their bytes."""
    return radix_order(keys, order) if keys.ndim == 2 else order[np.argsort(keys[order], kind="stable")]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows starts."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= (c[1:] != c[:-1]).any(1) if c.ndim == 2 else c[1:] != c[:-1]
    return np.flatnonzero(new)


def packed(raw: bytes, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The terms of texts that end at ``ends``: (width, keys, number of the text), by width of their bucket."""
    folded = b"\0" + raw.translate(_FOLD) + b"\0"
    inside = np.frombuffer(folded, np.uint8) != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return
    texts = np.searchsorted(ends, starts - 1, side="right")
    widths = 1 << np.maximum(np.ceil(np.log2(sizes)).astype(np.int64), 3)
    for width in np.unique(widths).tolist():
        mine = np.flatnonzero(widths == width)
        at, size = starts[mine], sizes[mine]
        padded = folded + b"\0" * width
        if width <= 16:
            view = np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,))
            words = [view[at + 8 * k].astype(np.uint64) & _mask(size - 8 * k) for k in range(width // 8)]
            yield width, np.stack(words, 1), texts[mine]
        else:
            own = np.ndarray(len(padded) - width + 1, f"S{width}", padded, strides=(1,))[at]
            own.view(np.uint8).reshape(-1, width)[np.arange(width) >= size[:, None]] = 0
            yield width, own, texts[mine]


def _mask(size: np.ndarray) -> np.ndarray:
    """Words whose first ``size`` bytes are all ones."""
    cleared = (8 * np.clip(8 - size, 0, 7)).astype(np.uint64)
    return np.uint64(0xFFFFFFFFFFFFFFFF) << cleared


def _names(keys: np.ndarray) -> pa.Array:
    """Packed terms as strings."""
    if keys.ndim == 2:
        keys = np.ascontiguousarray(keys).astype(">u8").view(f"S{8 * keys.shape[1]}").ravel()
    return pa.array(keys.tolist(), pa.binary()).cast(pa.string())


class Counter:
    """Counts packed terms by text; sums up by group when it has ``HELD`` of them."""

    def __init__(self) -> None:
        self.texts: list[bytes] = []
        self.ids: list[int] = []
        self.size = 0
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.n_held = 0

    def add(self, raw: bytes, number: int) -> None:
        """A text, or a piece of one that was cut between two terms; numbers don't fall."""
        at = 0
        while len(raw) - at > CHUNK:
            gap = _GAP.search(raw, at + CHUNK)
            cut = gap.start() if gap else len(raw)
            self._hold(raw[at:cut], number)
            at = cut
        self._hold(raw[at:], number)

    def _hold(self, piece: bytes, number: int) -> None:
        self.texts.append(piece)
        self.ids.append(number)
        self.size += len(piece) + 1
        if self.size >= CHUNK:
            self.pack()

    def pack(self) -> None:
        """Texts to (term, text, occurrences)."""
        ends = np.cumsum([len(t) + 1 for t in self.texts])
        ids = np.array(self.ids, np.int64)
        for width, keys, texts in packed(b" ".join(self.texts), ends):
            order = _ordered(keys, np.arange(len(keys)))
            keys, numbers = keys[order], ids[texts[order]]
            at = _changes(keys, numbers)
            self.held.setdefault(width, []).append((keys[at], numbers[at], np.diff(at, append=len(keys))))
            self.n_held += len(at)
        self.texts, self.ids, self.size = [], [], 0

    def drain(self, group_of: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """(terms, groups, occurrences, texts) of what is held, for the group of each text's number."""
        self.pack()
        for parts in self.held.values():
            keys, numbers, n = (np.concatenate(x) for x in zip(*parts))
            groups = group_of[numbers]
            order = _ordered(keys, radix_order(groups.astype(np.uint64)[:, None]))  # texts stay in their order
            keys, groups, numbers, n = keys[order], groups[order], numbers[order], n[order]
            at = _changes(keys, groups)
            new_text = np.zeros(len(keys), np.int64)
            new_text[_changes(keys, numbers)] = 1
            yield _names(keys[at]), groups[at], np.add.reduceat(n, at), np.add.reduceat(new_text, at)
        self.held, self.n_held = {}, 0


_COUNTED = "lang string, source string, term string, n long, docs long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter, groups, group_of = Counter(), {}, []

    def out() -> Iterator[pa.RecordBatch]:
        langs, sources = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
        for terms, at, n, docs in counter.drain(np.array(group_of, np.int64)):
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), terms, pa.array(n), pa.array(docs)],
                                             names=["lang", "source", "term", "n", "docs"])
        groups.clear()
        group_of.clear()

    for langs, sources, column in one_table(batches, ["lang", "source", "text"]):
        for group, raw in zip(zip(langs.to_pylist(), sources.to_pylist()), raw_texts(column)):
            group_of.append(groups.setdefault(group, len(groups)))
            counter.add(raw, len(group_of) - 1)
            if counter.n_held >= HELD:
                yield from out()
    yield from out()


def _filled(docs: DataFrame, *names: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, written to the shared folder."""
    found = _filled(docs, "lang", "source", "text").mapInArrow(_scan, _COUNTED)
    return materialize(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
                       "terms")


def _share(n: str, total: str, kept: str) -> Column:
    """1 + floor(UNIT (n + 2) / (total + 2 kept)), in decimals: the product may exceed a long."""
    return F.expr(f"1 + (CAST({UNIT} AS DECIMAL(10,0)) * CAST({n} + 2 AS DECIMAL(20,0))) "
                  f"div CAST({total} + 2 * {kept} AS DECIMAL(20,0))")


def _gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))."""
    d = p - q
    return d * d // (p + q)


def pair_sums(terms: list[tuple[np.ndarray, np.ndarray]], least: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Sums of gaps over terms for each pair of sources, by tiles (first row, first column, sums).

    A term is (sources that have it, their shares); every other source has its share of ``least``.
    """
    rows = np.repeat(np.arange(len(terms)), [len(at) for at, _ in terms])
    sources, shares = np.concatenate([at for at, _ in terms]), np.concatenate([p for _, p in terms])
    tiles: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k in np.unique(sources // TILE).tolist():
        mine = sources // TILE == k
        has = np.unique(rows[mine])
        own = np.repeat(least[None, k * TILE:(k + 1) * TILE], len(has), 0)
        own[np.searchsorted(has, rows[mine]), sources[mine] - k * TILE] = shares[mine]
        tiles[k] = has, own
    n_tiles = -(-len(least) // TILE)
    for i in range(n_tiles):
        for j in range(i, n_tiles):
            left, right = least[i * TILE:(i + 1) * TILE], least[j * TILE:(j + 1) * TILE]
            none = np.zeros(0, np.int64)
            has = np.union1d(tiles[i][0] if i in tiles else none, tiles[j][0] if j in tiles else none)
            total = (len(terms) - len(has)) * gaps(left[:, None], right[None, :])
            if len(has):
                a, b = (_spread(tiles.get(k), has, base) for k, base in ((i, left), (j, right)))
                for row in range(len(left)):
                    total[row] += gaps(a[:, row:row + 1], b).sum(0)
            yield i * TILE, j * TILE, total


def _spread(tile: tuple[np.ndarray, np.ndarray] | None, has: np.ndarray, base: np.ndarray) -> np.ndarray:
    out = np.repeat(base[None, :], len(has), 0)
    if tile is not None:
        out[np.searchsorted(has, tile[0])] = tile[1]
    return out


def _summed(kept: DataFrame, least: dict[str, list[int]]) -> DataFrame:
    """(lang, a, b, value) for the numbers a < b of the sources of a language."""
    sent = kept.sparkSession.sparkContext.broadcast(least)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list] = {}
        sums: dict[tuple[str, int, int], np.ndarray] = {}

        def work(lang: str) -> None:
            for i, j, total in pair_sums(waiting.pop(lang), np.array(sent.value[lang], np.int64)):
                sums[lang, i, j] = sums.get((lang, i, j), 0) + total

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, i, j), total in sums.items():
                a, b = np.indices(total.shape).reshape(2, -1) + np.array([[i], [j]])
                upper = a < b
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * int(upper.sum()), pa.string()), pa.array(a[upper].astype(np.int32)),
                     pa.array(b[upper].astype(np.int32)), pa.array(total.ravel()[upper])],
                    names=["lang", "a", "b", "value"])
            sums.clear()

        for langs, per in one_table(batches, ["lang", "per"]):
            ends = per.offsets.to_numpy() - per.offsets[0].as_py()
            numbers, shares = (per.flatten().field(i).to_numpy() for i in (0, 1))
            for k, lang in enumerate(langs.to_pylist()):
                own = slice(ends[k], ends[k + 1])
                mine = waiting.setdefault(lang, [])
                mine.append((numbers[own].astype(np.int64), shares[own].astype(np.int64)))
                if len(mine) >= TERMS_AT_ONCE:
                    work(lang)
                    if len(sums) > TILES_HELD:
                        yield from out()
        for lang in list(waiting):
            work(lang)
            if len(sums) > TILES_HELD:
                yield from out()
        yield from out()

    found = kept.select("lang", "per").mapInArrow(scan, "lang string, a int, b int, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def diverging(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank); part is 'pair' (item: another source) or 'term' (item: a term)."""
    spark = docs.sparkSession
    counts = term_counts(docs)
    common = (counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
              .where(F.col("docs") >= least_docs).select("lang", "term", "lang_n"))
    own = materialize(counts.select("lang", "source", "term", "n").join(common, ["lang", "term"]), "kept")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (_filled(docs, "lang", "source").distinct().join(totals, ["lang", "source"], "left")
              .orderBy("lang", "source").collect())  # one row a group, see above
    vocabulary = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.countDistinct("term").alias("n")).collect()}

    number: dict[str, int] = {}
    lang_total: dict[str, int] = {}
    for g in groups:
        lang_total[g["lang"]] = lang_total.get(g["lang"], 0) + (g["total"] or 0)
    facts, least = [], {}
    for g in groups:
        lang, total, v = g["lang"], g["total"] or 0, vocabulary.get(g["lang"], 0)
        at = number[lang] = number.get(lang, -1) + 1
        facts.append((lang, g["source"], at, total, lang_total[lang], v))
        least.setdefault(lang, []).append(1 + 2 * UNIT // (total + 2 * v) if v else 1)
    table = spark.createDataFrame(facts, "lang string, source string, at int, total long, lang_total long, v long")
    known = hinted(table, len(facts))

    shares = (own.join(known, ["lang", "source"])
              .select("lang", "source", "term", "at", _share("n", "total", "v").alias("p"),
                      _share("lang_n", "lang_total", "v").alias("q")))
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                         _gap("p", "q").alias("value"))
    per_term = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("at", "p")).alias("per"))
    sums = _summed(per_term, least).withColumnRenamed("lang", "sum_lang")

    left = table.select("lang", "source", F.col("at").alias("x"))
    right = table.select("lang", F.col("source").alias("item"), F.col("at").alias("y"))
    pairs = (left.join(right, "lang").where("x <> y")
             .join(sums, (F.col("lang") == F.col("sum_lang")) & (F.least("x", "y") == F.col("a"))
                   & (F.greatest("x", "y") == F.col("b")), "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item",
                     F.coalesce("value", F.lit(0).cast("long")).alias("value")))

    def ranked(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        return rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))
