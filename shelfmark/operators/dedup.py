"""Near-duplicate albums: all pairs above a threshold, without comparing all pairs.

Score = 0.4 artist + 0.5 title + 0.1 track count, each part at most 1. A pair at
or above the threshold therefore needs

    0.4 (1 - artist) + 0.5 (1 - title) <= 1 - threshold      (the "loss budget")

so at least one of the two names uses no more than half of that budget. That
gives two cases that together find every pair once:

  A. the artists are close (half budget);
  B. the titles are close (half budget) and the artists are not.

Each case works in two steps.

1. Close names. Distinct artists (titles) that are close to each other, whatever
   number of albums they have. Two names within edit distance d share one of two
   kinds of keys: a piece (cut the longer one into d + 1 pieces; one occurs in
   the other at nearly the same place), or two of the rarest two-letter grams (an
   edit takes at most two grams of a name, so if at most m can be lost, two of
   the m + 2 rarest are shared). Each name asks by the kind that promises it the
   fewest partners, from the counts of its own keys, and answers to both.

2. The other name. Once the distance of the close names is known, the rest of the
   budget bounds the distance of the other names. Where a pair of close names has
   few albums they are compared outright. Where it has many, as one artist with
   many albums has with itself, they meet by the pieces of the other name, cut for
   the loss that is left. Where these pieces are so short and so common that most
   names would meet by them, and more than once, all are compared, block by block.

The exact score has the last word; no pair is lost. Cost follows the pairs of
close names, plus the albums of common names, plus the pairs found.

Numbered series have more close names than that is worth: most artists and most
titles are close to each other, and few of the pairs are close in both. So have
few artists with many albums each, whose titles say little to meet by. If the
names, or the albums that share one, expect more meetings than comparing
everything costs, whole albums are compared in ``blocks``, both names and the
count at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.operators import blocks
from shelfmark.refdata import DUPLICATE_THRESHOLD
from shelfmark.session import materialize, spread

EPS = 1e-9

# A pair of close names whose albums make more pairs than this meets by pieces of the other name.
OUTRIGHT = 1024
# Albums of one name that are compared outright are dealt to blocks of this many; two blocks are one group of a join.
BLOCK = 1024
# What a meeting by a piece costs, which is shuffled and made distinct, against comparing two names.
MEETING = 8.0
# What a key costs that a name is filed under, hashed and shuffled as a number.
KEY = 0.1
# Pieces longer than this are taken to be as common as those of this length.
LONGEST_COUNTED = 8
# What a pair costs in blocks of whole albums, of how many albums these are worth their start, and the longest names for them.
IN_BLOCKS = 0.03
LEAST_IN_BLOCKS = 1024
LONGEST_IN_BLOCKS = 256
# Beyond this loss every piece of a name can be lost and pieces say nothing.
LARGEST_PIECE_LOSS = 0.5


def _piece_keys(s: str, length: str, max_loss: float | str) -> Column:
    """Pieces of a string that plays the longer part: one key per piece."""
    d = f"CAST(floor({length} * {max_loss} + {EPS}) AS INT)"
    return F.expr(f"""
        transform(sequence(0, {d}), i -> struct(
            {length} AS len, i AS piece,
            substring({s}, CAST(floor(i * {length} / ({d} + 1)) AS INT) + 1,
                      CAST(floor((i + 1) * {length} / ({d} + 1)) AS INT)
                      - CAST(floor(i * {length} / ({d} + 1)) AS INT)) AS txt))""")


def _window_keys(s: str, length: str, max_loss: float | str) -> Column:
    """Substrings of a string that plays the shorter part, for every longer length it may meet.

    Piece i of a longer string of length L starts at p = floor(i L / (d + 1)). If
    it survives with i errors spent at most to its left and d - i to its right,
    it starts in the shorter one within max(p - i, p + delta - (d - i)) and
    min(p + i, p + delta + (d - i)), where delta is the length difference.
    """
    longest = f"CAST(floor({length} / (1 - {max_loss}) + {EPS}) AS INT)"
    d = f"CAST(floor(len * {max_loss} + {EPS}) AS INT)"
    start = f"CAST(floor(i * len / ({d} + 1)) AS INT)"
    size = f"(CAST(floor((i + 1) * len / ({d} + 1)) AS INT) - {start})"
    lo = f"greatest(0, {start} - i, {start} + ({length} - len) - ({d} - i))"
    hi = f"least({length} - {size}, {start} + i, {start} + ({length} - len) + ({d} - i))"
    return F.expr(f"""
        array_distinct(flatten(flatten(transform(sequence({length}, {longest}), len ->
            transform(sequence(0, {d}), i ->
                CASE WHEN {lo} <= {hi} THEN
                    transform(sequence({lo}, {hi}), p -> struct(
                        len AS len, i AS piece, substring({s}, p + 1, {size}) AS txt))
                ELSE CAST(array() AS array<struct<len:int,piece:int,txt:string>>) END)))))""")


def _counted(strings: DataFrame, keys: Column, out: str) -> DataFrame:
    """The keys of each string with the number of strings that have them, rarest first: ``out`` of struct(n, key)."""
    rows = strings.select("sid", F.explode(keys).alias("key"))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return (rows.join(counts, "key").groupBy("sid")
            .agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias(out)))


def _hashed(keys: Column) -> Column:
    return F.transform(keys, lambda k: F.xxhash64(k["len"], k["piece"], k["txt"]))


def _lost(loss: float) -> Column:
    """How many grams of a name a partner within ``loss`` can lack. One that is k letters longer lacks k fewer."""
    lost = [2 * F.floor((F.length("s") + k) * F.lit(loss) + EPS) - k for k in (0, 1)]
    return F.greatest(*lost).cast("int")


def _weight(keys: Column) -> Column:
    return F.aggregate(keys, F.lit(0.0), lambda s, x: s + x["n"])


def _edits(x: str, y: str, loss: Column | float) -> Column:
    """Edit distance of two names, -1 beyond ``loss`` of the longer one; the computation stops there."""
    most = F.floor(F.greatest(F.length(x), F.length(y)) * F.least(F.lit(1.0), F.lit(loss) if isinstance(loss, float) else loss)
                   + EPS).cast("int")
    return F.call_function("levenshtein", F.col(x), F.col(y), most)


def _share(edits: Column, x: str, y: str) -> Column:
    """Edits as a part of the longer name, 0 for two empty names."""
    return edits.cast("double") / F.greatest(F.length(x), F.length(y), F.lit(1)).cast("double")


def _profiles(strings: DataFrame, loss: float) -> DataFrame:
    """Each of the distinct ``strings(sid, s)`` with the keys it may ask by, the kind that promises it the fewest
    partners (``asks_two``) and their number. The k-th occurrence of a gram in a name is a gram of its own.
    """
    own = strings.withColumn("g", F.expr(
        "transform(sequence(1, length(s) + 1), i -> substring(concat('\u0001', s, '\u0001'), i, 2))"))
    grams = _counted(own, F.expr(
        "transform(g, (x, i) -> xxhash64(x, size(filter(slice(g, 1, i), y -> y = x))))"), "grams")
    pieces = _counted(own, _hashed(_piece_keys("s", "length(s)", loss)), "pieces")
    total = F.lit(float(max(strings.count(), 1)))
    held = strings.join(grams, "sid").join(pieces, "sid").select(
        "sid", "s", "pieces", F.slice("grams", 1, _lost(loss) + 2).alias("two"),
        (F.size("grams") >= _lost(loss) + 2).alias("enough"))
    of_two = (_weight(F.col("two")) ** 2 - F.aggregate(
        "two", F.lit(0.0), lambda s, x: s + x["n"].cast("double") ** 2)) / (2.0 * total)
    of_pieces = _weight(F.col("pieces"))
    return held.select("sid", "s", "pieces", "two", (F.col("enough") & (of_two < of_pieces)).alias("asks_two"),
                       F.when(F.col("enough"), F.least(of_two, of_pieces)).otherwise(of_pieces).alias("partners"))


def _met_names(strings: DataFrame, loss: float) -> DataFrame:
    """Pairs of distinct ``strings(sid, s)`` that may be within ``loss``, the longer one first; with repeats.

    The longer of two asks by the kind of key that it expects the fewest partners from; the shorter one answers to
    both kinds.
    """
    two = F.expr("flatten(transform(two, (x, i) -> transform(slice(two, i + 2, size(two)), "
                 "y -> xxhash64(2, x.key, y.key))))")
    held = _profiles(strings, loss)
    held = materialize(held.select("sid", "s", F.when(F.col("asks_two"), two).otherwise(F.col("pieces.key")).alias("asked"),
                                   F.concat(_hashed(_window_keys("s", "length(s)", loss)), two).alias("answers")), "profiles")
    held = spread(held)  # few bytes, but many pairs to compare

    def side(keys: str, number: int) -> DataFrame:
        return held.select(F.col("sid").alias(f"sid{number}"), F.col("s").alias(f"s{number}"), F.explode(keys).alias("key"))
    longer = (F.length("s1") > F.length("s2")) | ((F.length("s1") == F.length("s2")) & (F.col("sid1") > F.col("sid2")))
    return side("asked", 1).join(side("answers", 2), "key").where(longer).drop("key")


def close_names(strings: DataFrame, loss: float) -> DataFrame:
    """Pairs (sid1, sid2, off) of ``strings(sid, s)`` within ``loss``, once each, and every string with itself."""
    edits = _edits("s1", "s2", loss)
    pairs = (_met_names(strings, loss).withColumn("edits", edits).where("edits >= 0")
             .select("sid1", "sid2", _share(F.col("edits"), "s1", "s2").alias("off")).distinct())
    return pairs.unionByName(strings.select(F.col("sid").alias("sid1"), F.col("sid").alias("sid2"), F.lit(0.0).alias("off")))


def _piece_length(length: float, loss: float) -> int:
    return max(int(length / (int(length * loss + EPS) + 1)), 1)


def _chances(names: DataFrame, c: str, least: float, most: float) -> tuple[float, dict[int, float]]:
    """Mean length of the distinct ``c``, and how often two of their pieces are the same, for each length of pieces
    that a loss from ``least`` to ``most`` leaves."""
    texts = names.select(F.col(c).alias("s")).distinct()
    mean = max(texts.agg(F.avg(F.length("s"))).first()[0] or 1.0, 1.0)
    longest = min(_piece_length(mean, least), LONGEST_COUNTED)
    sizes = list(range(min(_piece_length(mean, most), longest), longest + 1))
    grams = texts.select("s", F.explode(F.array(*map(F.lit, sizes))).alias("size")).select("size", F.explode(F.expr(
        "transform(sequence(1, greatest(length(s) - size + 1, 1)), i -> xxhash64(substring(s, i, size)))")).alias("gram"))
    n = F.col("n").cast("double")
    rates = (grams.groupBy("size", "gram").agg(F.count(F.lit(1)).alias("n")).groupBy("size")
             .agg((F.sum(n * n) / F.sum(n) ** 2).alias("rate")).collect())  # a row for each of at most eight lengths
    return mean, {r["size"]: r["rate"] for r in rates} or {1: 1.0}


def _by_pieces(mean: float, rates: dict[int, float]) -> Column:
    """What it costs that ``n1`` and ``n2`` names meet by pieces, where comparing two names costs 1."""
    edits = F.floor(F.lit(mean) * F.col("left") + EPS).cast("double")
    places = (edits + 1) * (edits / 2 + 1)  # pieces times the starts that each may have
    size = F.greatest(F.floor(F.lit(mean) / (edits + 1)), F.lit(min(rates)))
    rate = F.lit(rates[max(rates)])
    for k in sorted(rates, reverse=True):
        rate = F.when(size <= k, F.lit(rates[k])).otherwise(rate)
    keys = (F.lit(mean) / (1 - F.least(F.col("left"), F.lit(LARGEST_PIECE_LOSS))) - F.lit(mean) + 1) * places
    both = F.col("n1").cast("double") * F.col("n2")
    return F.lit(KEY) * (F.col("n1") + F.col("n2")) * keys + F.lit(MEETING) * both * places * rate


def _compared(close: DataFrame, held: DataFrame) -> DataFrame:
    """All pairs of albums of ``close(sid1, sid2, blocks1, blocks2, off, left)``, a group for two blocks of them."""
    at = ["sid1", "at1", "sid2", "at2"]
    blocks = (close.withColumn("at1", F.explode(F.sequence(F.lit(0), F.col("blocks1") - 1)))
              .withColumn("at2", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1))))
    parts = 4 * close.sparkSession.sparkContext.defaultParallelism  # few bytes, but many pairs to compare

    def side(k: int, extra: list[str]) -> DataFrame:
        own = held.select(*[F.col(c).alias(f"{c}{k}") for c in ("sid", "at", "id", "loose")])
        return blocks.select(*at, *extra).join(own, [f"sid{k}", f"at{k}"]).repartition(parts, *at)
    return side(1, ["off", "left"]).join(side(2, []), at)


def _case(names: DataFrame, strict: str, loose: str, strict_weight: float, loose_weight: float, budget: float) -> DataFrame:
    """Pairs of ``names`` with close strict names whose loose names may be within the rest of the budget.

    Columns: id1, id2, loose1, loose2, off (of the strict names) and left (the loss that is left).
    """
    strings = materialize(names.groupBy(F.col(strict).alias("s")).agg(F.count(F.lit(1)).alias("n"))
                          .withColumn("sid", F.monotonically_increasing_id()), "strings")
    sizes = strings.select("sid", "n")
    left = (F.lit(budget) - F.col("off") * strict_weight) / loose_weight
    both = F.col("n1").cast("double") * F.col("n2")
    # either way gives the same pairs
    pays = _by_pieces(*_chances(names, loose, budget / 2 / loose_weight, budget / loose_weight)) < both
    many = both > OUTRIGHT

    def blocks(n: str) -> Column:
        return F.ceil(F.col(n) / BLOCK).cast("int")
    close = materialize(close_names(strings.select("sid", "s"), budget / 2 / strict_weight)
                        .join(sizes.withColumnsRenamed({"sid": "sid1", "n": "n1"}), "sid1")
                        .join(sizes.withColumnsRenamed({"sid": "sid2", "n": "n2"}), "sid2")
                        .withColumn("left", left)
                        .select("sid1", "sid2", "off", "left", blocks("n1").alias("blocks1"), blocks("n2").alias("blocks2"),
                                (many & (F.col("left") <= LARGEST_PIECE_LOSS + EPS) & pays).alias("common"),
                                many.alias("many")), "close")
    held = materialize(names.join(strings.select(F.col("s").alias(strict), "sid", "n"), strict)
                       .select("sid", "id", F.col(loose).alias("loose"),
                               F.pmod(F.xxhash64("id"), blocks("n")).cast("int").alias("at")), "albums")
    close = spread(close)

    def of(number: int) -> DataFrame:
        return held.select(*[F.col(c).alias(f"{c}{number}") for c in ("sid", "id", "loose")])
    apart = (F.col("sid1") != F.col("sid2")) | (F.col("id1") < F.col("id2"))
    found = ["id1", "id2", "loose1", "loose2", "off", "left"]
    outright = (close.where("NOT many").join(of(1), "sid1").join(of(2), "sid2").where(apart).select(*found)
                .unionByName(_compared(close.where("many AND NOT common"), held).where(apart).select(*found)))

    common = close.where("common").withColumn("pair", F.xxhash64("sid1", "sid2"))
    single = F.col("sid1") == F.col("sid2")
    sides = common.select("pair", "off", "left", single.alias("single"), F.lit(1).alias("side"), F.col("sid1").alias("sid")
                          ).unionByName(common.where(~single).select(
                              "pair", "off", "left", F.lit(False).alias("single"), F.lit(2).alias("side"),
                              F.col("sid2").alias("sid")))
    rows = sides.join(held.drop("at"), "sid").withColumn("len", F.length("loose"))
    # every album asks as the longer and answers as the shorter of two
    asks = rows.select("pair", "off", "left", "single", *[F.col(c).alias(f"{c}1") for c in ("side", "id", "loose", "len")],
                       F.explode(_hashed(_piece_keys("loose", "length(loose)", "left"))).alias("key"))
    answers = rows.select("pair", *[F.col(c).alias(f"{c}2") for c in ("side", "id", "loose", "len")],
                          F.explode(_hashed(_window_keys("loose", "length(loose)", "left"))).alias("key"))
    first = (F.col("len1") > F.col("len2")) | ((F.col("len1") == F.col("len2")) & F.when(
        F.col("side1") == F.col("side2"), F.col("id1") > F.col("id2")).otherwise(F.col("side1") < F.col("side2")))
    keyed = (asks.join(answers, ["pair", "key"]).where(first & (F.col("single") | (F.col("side1") != F.col("side2"))))
             .select(*found).distinct())
    return outright.unionByName(keyed).where(
        F.abs(F.length("loose1") - F.length("loose2")) <= F.floor(
            F.greatest(F.length("loose1"), F.length("loose2")) * F.col("left") + EPS))


def _refuse_beyond(budget: float) -> None:
    if budget / tx.ARTIST_WEIGHT > 1 + EPS:
        raise ValueError("the threshold is too low: two albums may match without sharing any part of a name")


def _cases(names: DataFrame, budget: float) -> list[tuple[str, str, DataFrame]]:
    _refuse_beyond(budget)
    return [("a", "t", _case(names, "a", "t", tx.ARTIST_WEIGHT, tx.TITLE_WEIGHT, budget)),
            ("t", "a", _case(names, "t", "a", tx.TITLE_WEIGHT, tx.ARTIST_WEIGHT, budget))]


def candidates(names: DataFrame, threshold: float = DUPLICATE_THRESHOLD) -> DataFrame:
    """Pairs (id1 < id2) of ``names(id, a, t)`` that are compared: all near-duplicates and some others. For inspection."""
    (_, _, first), (_, _, second) = _cases(names, 1.0 - threshold)
    return first.unionByName(second).select(
        F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).distinct()


def close_albums(names: DataFrame, threshold: float = DUPLICATE_THRESHOLD) -> DataFrame:
    """Pairs (id1, id2, a_sim, t_sim) of distinct ``names(id, a, t)`` within the loss budget, once each."""
    budget = 1.0 - threshold
    out = None
    for strict, loose, met in _cases(names, budget):
        edits = _edits("loose1", "loose2", F.col("left"))
        off = _share(F.col("edits"), "loose1", "loose2")
        near = met.withColumn("edits", edits).where("edits >= 0").withColumn("off2", off)
        if strict == "t":  # close artists are the other case's; both compute the same part from the same two names
            near = near.where(F.col("off2") > F.lit(budget / 2 / tx.ARTIST_WEIGHT) + EPS)
        found = near.select("id1", "id2", (1 - F.col("off")).alias(f"{strict}_sim"), (1 - F.col("off2")).alias(f"{loose}_sim"))
        out = found if out is None else out.unionByName(found)
    return out


def _signature() -> list[Column]:
    return [F.coalesce(F.lower("artist"), F.lit("")).alias("a"), F.coalesce(F.lower("album"), F.lit("")).alias("t"),
            F.coalesce("track_count", F.lit(0)).alias("n")]


def signatures(albums: DataFrame) -> DataFrame:
    """Albums that the score cannot tell apart, as one row: names without case and track count.

    An unknown name is an empty one and an unknown count is 0, which the score rates as half.
    """
    return (albums.groupBy(*_signature())
            .agg(F.min("album_key").alias("canonical_key"), F.count(F.lit(1)).alias("members")))


def duplicate_members(albums: DataFrame) -> DataFrame:
    """Every album that repeats an earlier signature, linked to its canonical album.

    One row per album, not one per pair: the pairs inside a group of copies all
    score 1 and follow from these links.
    """
    sig = signatures(albums)
    return (albums.select("album_key", "artist", "album", *_signature())
            .join(sig.where("members > 1"), ["a", "t", "n"]).where("album_key <> canonical_key")
            .select("album_key", "artist", "album", "canonical_key", "members"))


def _blocks_pay(sig: DataFrame, budget: float) -> int:
    """The number of signatures if comparing them all in blocks costs less than their close names, else 0."""
    total, longest = sig.agg(F.count(F.lit(1)), F.max(F.greatest(F.length("a"), F.length("t")))).first()
    if total < LEAST_IN_BLOCKS or longest > LONGEST_IN_BLOCKS:
        return 0
    cost = IN_BLOCKS * total * (total - 1) / 2
    names = (("a", tx.ARTIST_WEIGHT), ("t", tx.TITLE_WEIGHT))
    for (strict, _), (loose, weight) in (names, names[::-1]):
        if _of_one_name(sig, strict, loose, budget, weight) > cost:
            return total
    for name, weight in names[::-1]:
        strings = materialize(sig.select(F.col(name).alias("s")).distinct()
                              .withColumn("sid", F.monotonically_increasing_id()), "strings")
        if MEETING * _profiles(strings, budget / 2 / weight).agg(F.sum("partners")).first()[0] > cost:
            return total
    return 0


def _of_one_name(sig: DataFrame, strict: str, loose: str, budget: float, loose_weight: float) -> float:
    """What comparing the albums costs that share their ``strict`` name, by the cheaper way."""
    n = F.col("n").cast("double")
    groups = sig.groupBy(strict).agg(F.count(F.lit(1)).alias("n"))
    outright = groups.agg(F.sum(n * n)).first()[0] / 2
    if outright <= IN_BLOCKS * sig.count() ** 2 / 2 or budget / loose_weight > LARGEST_PIECE_LOSS + EPS:
        return outright
    by_pieces = _by_pieces(*_chances(sig, loose, budget / 2 / loose_weight, budget / loose_weight))
    sides = groups.select(n.alias("n1"), n.alias("n2"), F.lit(budget / loose_weight).alias("left"))
    both = F.col("n1") * F.col("n2")
    return sides.agg(F.sum(F.when(both > OUTRIGHT, F.least(by_pieces, both)).otherwise(both))).first()[0] / 2


def duplicate_pairs(albums: DataFrame, threshold: float = DUPLICATE_THRESHOLD) -> DataFrame:
    """Pairs of distinct signatures at or above ``threshold``, one row per pair.

    Output: key1 < key2 (canonical album keys), similarity, members1, members2.
    With ``duplicate_members`` this holds every near-duplicate pair of the
    library: two albums match when they share a signature or their signatures
    are listed here. Thresholds below 0.6 leave nothing to block on and are
    refused. Signatures feed several branches and are written to the shared
    folder once.
    """
    return _pairs(materialize(signatures(albums), "signatures"), threshold)


def named_pairs(albums: DataFrame, threshold: float = DUPLICATE_THRESHOLD) -> DataFrame:
    """``duplicate_pairs`` with the names of both albums as written: artist1, album1, artist2, album2.

    A key that several albums have gives a row for each of them. Where no key does, the names go with the signatures,
    so that the pairs need no join.
    """
    names = albums.where("album_key IS NOT NULL").select("album_key", "artist", "album")
    sig = materialize(signatures(albums), "signatures")
    if names.groupBy("album_key").count().where("count > 1").limit(1).count() == 0:
        own = names.withColumnsRenamed({"album_key": "canonical_key", "album": "title"})
        return (_pairs(materialize(sig.join(own, "canonical_key", "left"), "named"), threshold, ("artist", "title"))
                .where("key1 IS NOT NULL").withColumnsRenamed({"title1": "album1", "title2": "album2"}))
    return (_pairs(sig, threshold)
            .join(names.withColumnsRenamed({"album_key": "key1", "artist": "artist1", "album": "album1"}), "key1")
            .join(names.withColumnsRenamed({"album_key": "key2", "artist": "artist2", "album": "album2"}), "key2"))


def _pairs(sig: DataFrame, threshold: float, carried: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of the written signatures ``sig``, with their ``carried`` columns."""
    rows = sig.select("a", "t", "n", F.col("canonical_key").alias("k"), F.col("members").alias("m"), *carried)
    _refuse_beyond(1.0 - threshold)
    total = _blocks_pay(sig, 1.0 - threshold)
    if total:  # two counts of the same names need two keys
        found = blocks.pairs(rows, total, threshold).where("a1 <> a2 OR t1 <> t2 OR k1 <> k2")
    else:
        found = _pairs_of_close_names(rows, threshold, carried)
    in_order = F.col("k1") < F.col("k2")
    # where one has no key, the other one's stands for both
    first, last = F.col("k2").isNull() | in_order, F.col("k2").isNull() | (F.col("k1") > F.col("k2"))
    return found.select(F.least("k1", "k2").alias("key1"), F.greatest("k1", "k2").alias("key2"), "similarity",
                        F.when(in_order, F.col("m1")).otherwise(F.col("m2")).alias("members1"),
                        F.when(in_order, F.col("m2")).otherwise(F.col("m1")).alias("members2"),
                        *[F.when(side, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(f"{c}{i}")
                          for i, side in ((1, first), (2, last)) for c in carried])


def _pairs_of_close_names(sig: DataFrame, threshold: float, carried: tuple[str, ...]) -> DataFrame:
    """Pairs of ``sig(a, t, n, k, m, carried)`` at or above ``threshold``, by the two cases."""
    names = materialize(sig.select("a", "t").distinct().withColumn("id", F.monotonically_increasing_id()), "names")
    close = close_albums(names, threshold)
    same = names.select(F.col("id").alias("id1"), F.col("id").alias("id2"), F.lit(1.0).alias("a_sim"),
                        F.lit(1.0).alias("t_sim"))
    held = materialize(sig.join(names, ["a", "t"]).select("id", "n", "k", "m", *carried), "counts")
    left, right = (held.select(*[F.col(c).alias(f"{c}{i}") for c in held.columns]) for i in (1, 2))
    score = tx.weighted_similarity(F.col("a_sim"), F.col("t_sim"), tx.count_similarity("n1", "n2"))

    def scored(pairs: DataFrame) -> DataFrame:
        return (pairs.join(left, "id1").join(right, "id2").withColumn("similarity", score)
                .where(F.col("similarity") >= threshold))
    return scored(close).unionByName(scored(same).where("k1 < k2"))
