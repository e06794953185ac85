"""Chat formatting by quotation linking, with native expressions only.

A line's quote level is the number of ``>`` before its text. Consecutive lines of one level are a passage, whose words
(lower case, split at white space) are joined across line breaks, so a quote that was wrapped anew is still the same
passage. Every passage is filed under the hashes of its five-word shingles; one of fewer words under the hash of the whole,
which the passages of fewer words and the short lines that a message wrote itself meet.

Each shingle of a quoted passage points to the latest earlier turn that wrote it at level 0. The turn that most shingles of
the passage point to (ties: the later turn) is its origin, if that turn wrote at least 4 in 5 of the passage's shingles.
A message replies to the origin of most shingles at its least level that has an origin (ties: the later turn). Replies make
trees: ``thread`` is the turn at the root, ``depth`` the number of steps to it. ``ORDER BY conv_id, thread, depth, turn``
lists a conversation so that every message follows the one it answers.

A shingle that thousands of turns wrote and quoted costs a row each, not a pair. The texts of a conversation of ordinary size
meet in one task, which makes the shingles and finds the latest earlier turn of each: texts are shuffled and shingles are not.
In a larger conversation shingles are dealt out by themselves, and the latest earlier turn is found by running maxima inside
buckets of turns, over buckets, and over buckets of buckets. Roots are found by pointer doubling, so a chain of n replies
takes log n joins.

Defined results: a null text is empty; lines without words end no passage of their level and are never linked; quoted lines
are dropped from the text whether they link or not. A message without links is a root. Rows with a null conv_id or turn are
roots of depth 0. Repeated (conv_id, turn) rows share their links, each keeps its own text; a passage quoted twice by a turn
at one level counts once. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import cut
from shelfmark.session import hinted

MARKER = r"^(?:[ \t]*>)+"
SPACE = r"[ \t\n\x0B\f\r]+"
SHINGLE = 5
# An origin wrote at least COVERED[0] of COVERED[1] shingles of a passage.
COVERED = (4, 5)
# Turns of one bucket, and buckets of one bucket above it, as a power of two.
BUCKET_BITS = 10
_QUOTING = r"(?m)^[ \t]*>"
# Messages and letters of a conversation that is left to one task.
MESSAGES, LETTERS = 1024, 1 << 21


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for the row, also where ``use`` reads it in a lambda."""
    return F.transform(F.array(value), use)[0]


def _join(words: Column) -> Column:
    return F.array_join(words, " ")


def _lines(text: Column) -> Column:
    """(level, words) of each line."""
    def line(raw: Column) -> Column:
        return _let(F.regexp_extract(raw, MARKER, 0), lambda marker: F.struct(
            F.length(F.regexp_replace(marker, "[^>]", "")).alias("level"),
            F.filter(F.split(F.lower(F.substr(raw, F.length(marker) + 1)), SPACE), lambda w: w != "").alias("words")))
    return F.transform(F.split(text, "\n"), line)


def _passages(lines: Column) -> Column:
    """(level, words) of each run of lines of one level, and of each short line at level 0."""
    def runs(starts: Column) -> Column:
        def run(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(lines))
            return F.struct(lines[start]["level"].alias("level"),
                            F.flatten(F.transform(F.slice(lines, start + 1, end - start), lambda x: x["words"])).alias("words"))
        return F.transform(starts, run)
    begins = F.filter(F.sequence(F.lit(0), F.size(lines) - 1),
                      lambda i: (i == 0) | (lines[i]["level"] != F.get(lines, i - 1)["level"]))
    short = F.filter(lines, lambda x: (x["level"] == 0) & (F.size(x["words"]) < SHINGLE))
    return F.filter(F.concat(_let(begins, runs), short), lambda x: F.size(x["words"]) > 0)


def _grams(words: Column) -> Column:
    """Distinct hashes of the shingles of ``words``, or of all of them if they are fewer."""
    many = F.transform(F.sequence(F.lit(1), F.size(words) - SHINGLE + 1),
                       lambda i: F.xxhash64(_join(F.slice(words, i, SHINGLE))))
    return F.array_distinct(F.when(F.size(words) >= SHINGLE, many).otherwise(F.array(F.xxhash64(_join(words)))))


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, passage, grams) of every passage with words."""
    found = (messages.where("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL")
             .select("conv_id", "turn", F.explode(_let(_lines(F.col("text")), _passages)).alias("p")))
    return found.select("conv_id", "turn", F.col("p.level").alias("level"), F.xxhash64(_join(F.col("p.words"))).alias("passage"),
                        _let(F.col("p.words"), _grams).alias("grams"))


def _before(rows: DataFrame, keys: list[str], levels: int = 2) -> DataFrame:
    """``rows(keys, place, value)`` with ``before``, the greatest value at lesser places of the same keys.

    A place occurs once for its keys. A window holds at most 2 ** BUCKET_BITS rows, but for the top level's.
    """
    earlier = F.max("value").over(Window.partitionBy(*keys, *(["bucket"] if levels else [])).orderBy("place")
                                  .rowsBetween(Window.unboundedPreceding, -1))
    if not levels:
        return rows.withColumn("before", earlier)
    placed = rows.withColumn("bucket", F.shiftright("place", BUCKET_BITS))
    totals = placed.groupBy(*keys, "bucket").agg(F.max("value").alias("value")).withColumnRenamed("bucket", "place")
    above = _before(totals, keys, levels - 1).select(*keys, F.col("place").alias("bucket"), F.col("before").alias("carried"))
    return (placed.withColumn("inside", earlier).join(above, [*keys, "bucket"])
            .select(*keys, "place", "value", F.coalesce("inside", "carried").alias("before")))


def _linked_across(messages: DataFrame) -> DataFrame:
    """The linked passages of ``messages``, whose shingles are dealt out one by one."""
    parsed = passages(messages)
    unit = ["conv_id", "turn", "level", "passage"]
    asked = cut(parsed.where("level > 0").dropDuplicates(unit)
                .select(*unit, F.size("grams").alias("n_grams"), F.explode("grams").alias("gram")))
    wrote = cut(parsed.where("level = 0").select("conv_id", "turn", F.explode("grams").alias("gram"))
                .join(asked.select("conv_id", "gram").distinct(), ["conv_id", "gram"], "left_semi").distinct())
    turns = (wrote.withColumn("value", F.col("turn").cast("long"))
             .unionByName(asked.select("conv_id", "gram", "turn").withColumn("value", F.lit(None).cast("long")))
             .groupBy("conv_id", "gram", F.col("turn").cast("long").alias("place")).agg(F.max("value").alias("value")))
    points = (_before(cut(turns), ["conv_id", "gram"]).where("before IS NOT NULL")
              .select("conv_id", "gram", F.col("place").alias("turn"), F.col("before").alias("origin")))
    votes = asked.join(points, ["conv_id", "gram", "turn"]).groupBy(*unit, "n_grams", "origin").agg(F.count("*").alias("n"))
    origin = cut(votes.groupBy(*unit).agg(F.max(F.struct("n", "origin"))["origin"].alias("origin")))
    written = wrote.select("conv_id", "gram", F.col("turn").alias("origin"))
    return _covered(asked.join(origin, unit).join(written, ["conv_id", "gram", "origin"]))


def _covered(held: DataFrame) -> DataFrame:
    """The linked passages of ``held``, which has a row for each shingle that the origin of its passage wrote."""
    return (held.groupBy("conv_id", "turn", "level", "passage", "n_grams", "origin").agg(F.count("*").alias("n"))
            .where(F.col("n") * COVERED[1] >= F.col("n_grams") * COVERED[0]))


def _linked_in_place(messages: DataFrame) -> DataFrame:
    """The linked passages of ``messages`` that are dealt out by conversation: no shingle leaves its task."""
    own = F.col("level") == 0  # a turn's own passages are one, as it matters only what it wrote
    row = ["conv_id", "turn", "level", "passage", "n_grams"]
    grams = (passages(messages)
             .select("conv_id", "turn", "level", F.when(~own, F.col("passage")).alias("passage"),
                     F.when(~own, F.size("grams")).alias("n_grams"), F.explode("grams").alias("gram"))
             .groupBy(*row, "gram").agg(F.count("*").alias("copies")).drop("copies")
             .withColumn("place", F.col("turn").cast("long")))
    unit = ["conv_id", "turn", "level", "passage"]
    earlier = Window.partitionBy("conv_id", "gram").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    votes = (grams.withColumn("before", F.max(F.when(own, F.col("place"))).over(earlier))
             .withColumn("n", F.count("*").over(Window.partitionBy(*unit, "before"))))
    best = F.max(F.when(F.col("before").isNotNull(), F.struct("n", F.col("before").alias("origin")))).over(Window.partitionBy(*unit))
    origins = votes.withColumn("origin", F.when(own, F.col("place")).otherwise(best["origin"])).where("origin IS NOT NULL")
    wrote = F.max(own).over(Window.partitionBy("conv_id", "gram", "origin"))
    return _covered(origins.withColumn("wrote", wrote).where(~own & F.col("wrote")))


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked) of messages that quote an earlier turn; n_linked counts the linked passages."""
    quoting = cut(messages.where("conv_id IS NOT NULL").groupBy("conv_id").agg(
        F.max(F.col("text").rlike(_QUOTING)).alias("quotes"),
        ((F.count("*") > MESSAGES) | (F.coalesce(F.sum(F.length("text")), F.lit(0)) > LETTERS)).alias("large"))
        .where("quotes").select("conv_id", "large"))
    large = quoting.where("large").select("conv_id")
    n_large = large.count()
    # a merge join deals the texts out by conversation and so does no broadcast
    small = messages.join(hinted(large, n_large), "conv_id", "left_anti") if n_large else messages
    linked = _linked_in_place(small.join(quoting.where("NOT large").select("conv_id").hint("merge"), "conv_id", "left_semi"))
    if n_large:
        linked = linked.unionByName(_linked_across(messages.join(hinted(large, n_large), "conv_id", "left_semi")))
    by_level = linked.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("n").alias("n"), F.count("*").alias("n_passages"))
    return by_level.groupBy("conv_id", "turn").agg(
        F.max(F.struct((-F.col("level")).alias("order"), "n", "origin"))["origin"].alias("reply_to"),
        F.sum("n_passages").alias("n_linked"))


def threads(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, thread, depth) of ``parents(conv_id, turn, reply_to)``, by pointer doubling."""
    up = cut(parents.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("thread"),
                            F.lit(1).cast("long").alias("depth")))
    while True:
        above = up.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("higher"),
                          F.col("depth").alias("more"))
        after = cut(up.join(above, (F.col("conv_id") == F.col("c")) & (F.col("thread") == F.col("t")), "left")
                    .select("conv_id", "turn", "reply_to", F.coalesce("higher", "thread").alias("thread"),
                            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                            F.col("higher").isNotNull().alias("moved")))
        up = after.drop("moved")
        if after.where("moved").isEmpty():
            return up


def format_chat(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, text without quotes, reply_to, thread, depth, n_quoted, n_linked, chat."""
    linked = cut(links(messages.select("conv_id", "turn", "text")))
    trees = threads(linked).join(linked.drop("reply_to"), ["conv_id", "turn"]).select(
        F.col("conv_id").alias("c"), F.col("turn").alias("t"), "reply_to", "thread", "depth", "n_linked")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    own = F.regexp_replace(F.array_join(F.filter(lines, lambda x: ~x.rlike(MARKER)), "\n"), r"^\n+|\n+$", "")
    rows = messages.select("conv_id", "turn", "role", own.alias("text"),
                           F.size(F.filter(lines, lambda x: x.rlike(MARKER))).cast("long").alias("n_quoted"))
    return rows.join(cut(trees), (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left").select(
        "conv_id", "turn", "role", "text", "reply_to", F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), "n_quoted",
        F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("text")).alias("chat"))


def quoting(messages: DataFrame, width: int = 9) -> DataFrame:
    """``messages(conv_id, turn, role, text)`` as a mail client would send replies: the data for a round trip.

    Every message but turn 0 answers the one ``1 + turn % 2`` turns before it (turn 1: turn 0). The answered text comes
    first, each line behind ``> `` and wrapped anew at ``width`` words; above it, behind ``> > ``, the text of the turn
    that one answers. Every third turn drops the last word of what it quotes.

    The texts of a conversation of ordinary size are dealt out once, by conversation; those of a larger one by turn.
    """
    own = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))

    def words(text: str) -> Column:
        return F.filter(F.split(text, SPACE), lambda w: w != "").alias(text)

    def wrapped(words: Column, marker: str) -> Column:
        return F.transform(F.when(F.size(words) > 0, F.sequence(F.lit(0), F.floor((F.size(words) - 1) / width)))
                           .otherwise(F.array()),
                           lambda i: F.concat(F.lit(marker), _join(F.slice(words, (i * width + 1).cast("int"), width))))
    turn = F.col("turn")
    answered = F.when(turn >= 1, F.greatest(turn - 1 - turn % 2, F.lit(0)))
    above = F.when(answered >= 1, F.greatest(answered - 1 - answered % 2, F.lit(0)))
    cropped = F.when((turn % 3 == 0) & (F.size("one") > 0), F.slice("one", F.lit(1), F.size("one") - 1)).otherwise(F.col("one"))
    sizes = own.groupBy("conv_id").agg((F.count("*") > MESSAGES) | (F.sum(F.length("text")) > LETTERS))
    large = cut(sizes.toDF("conv_id", "large").where("large AND conv_id IS NOT NULL").select("conv_id"))
    n_large = large.count()

    def joined(own: DataFrame, by_turn: bool) -> DataFrame:
        rows = own.withColumn("answered", answered).withColumn("above", above)
        for at, text in (("answered", "one"), ("above", "two")):  # whole texts are joined: lists of words are wider
            kept = own.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("text").alias(text))
            # a range is no key of the shuffle, so that all three texts meet by conversation
            same = F.col("t") == F.col(at) if by_turn else F.col("t").between(F.col(at), F.col(at))
            rows = rows.join(kept if by_turn else kept.hint("merge"), (F.col("conv_id") == F.col("c")) & same, "left").drop("c", "t")
        return rows
    alone = own.where("conv_id IS NULL")
    rows = joined(own.where("conv_id IS NOT NULL").join(hinted(large, n_large), "conv_id", "left_anti") if n_large
                  else own.where("conv_id IS NOT NULL"), False)
    if n_large:
        rows = rows.unionByName(joined(own.join(hinted(large, n_large), "conv_id", "left_semi"), True))
    none_of = F.lit(None).cast("string")
    rows = rows.select("conv_id", "turn", "role", "text", "one", "two").unionByName(
        alone.select("conv_id", "turn", "role", "text", none_of.alias("one"), none_of.alias("two")))
    rows = rows.select("conv_id", "turn", "role", "text", words("one"), words("two"))
    none = F.array().cast("array<string>")
    lines = F.concat(F.coalesce(wrapped(F.col("two"), "> > "), none), F.coalesce(wrapped(cropped, "> "), none), F.array("text"))
    return rows.select("conv_id", "turn", "role", F.array_join(lines, "\n").alias("text"))
