"""Rule-based category suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import genres as gx
from shelfmark.functions.core import bind, col, constant, list_map, no_strings, or_empty, strings, strip
from shelfmark.functions.tags import path_year
from shelfmark.operators.common import percent, unnest
from shelfmark.operators.genres import with_normalized
from shelfmark.refdata import ARTIST_KEYWORDS, COUNTRY_HINTS, ERAS, LABEL_HINTS, PATH_KEYWORDS, TITLE_KEYWORDS, \
    Taxonomy, era_df, hint_df

ARTIST, PATH, CONTEXT = "artist_analysis", "directory_analysis", "contextual_analysis"

SUGGESTION = "struct<genres:array<string>,confidence:double,reasoning:string,source:string>"


def artist_profiles(albums: DataFrame, tax: Taxonomy, strict: bool = False) -> DataFrame:
    """Main and secondary genres per artist.

    Shares are of the albums *with* genres, coverage is of all albums. Genres
    are counted per (artist, genre) before they meet in one row, and only those
    above the lower share bound are collected, so the lists stay short for any
    number of albums.
    """
    named = albums.select(strip("artist").alias("artist"), "genres").where("artist <> ''")
    sizes = named.groupBy("artist").agg(F.count(F.lit(1)).alias("total_albums"),
                                        F.count_if(F.size("genres") > 0).alias("albums_with_genres"))
    counts = (unnest(with_normalized(named, tax, strict), ["artist"], F.col("normalized"), "genre")
              .groupBy("artist", "genre").agg(F.count(F.lit(1)).alias("n")))
    share = F.col("n") / F.col("albums_with_genres") * 100
    shared = counts.join(sizes, "artist").withColumn("share", share)
    entry = F.struct((-F.col("n")).alias("o"), "genre")
    lists = shared.groupBy("artist").agg(
        F.count(F.lit(1)).alias("n_genres"),
        F.array_sort(F.collect_list(F.when(F.col("share") >= 60, entry))).alias("p"),
        F.array_sort(F.collect_list(F.when((F.col("share") >= 30) & (F.col("share") < 60), entry))).alias("s"))
    names = {c: F.coalesce(F.transform(F.col(c), lambda x: x["genre"]), no_strings()) for c in ("p", "s")}
    coverage = F.col("albums_with_genres") / F.col("total_albums")
    consistency = F.when(F.col("n_genres") > 0, F.size("primary_genres") / F.col("n_genres")).otherwise(F.lit(0.0))
    return (sizes.join(lists, "artist", "left")
            .withColumn("primary_genres", names["p"]).withColumn("secondary_genres", names["s"])
            .withColumn("n_genres", F.coalesce("n_genres", F.lit(0)))
            .withColumn("coverage", coverage)
            .withColumn("confidence", (coverage * 0.7 + consistency * 0.3) * 100)
            .drop("p", "s"))


def _suggestion(genres: Column, confidence: Column, reasoning: Column, source: str) -> Column:
    return F.struct(genres.alias("genres"), confidence.cast("double").alias("confidence"),
                    reasoning.alias("reasoning"), F.lit(source).alias("source"))


def artist_suggestion(albums: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds ``by_artist``: a suggestion out of the artist's profile, or null.

    At least 30 % confidence; three main genres, and two secondary ones when
    there are fewer than two main ones.
    """
    main = F.slice("primary_genres", 1, 3)
    extra = F.when(F.size(main) < 2, F.slice("secondary_genres", 1, 2)).otherwise(no_strings())
    genres = F.concat(main, extra)
    reasoning = F.format_string("Based on %d/%d albums by this artist. Primary genres: %s", "albums_with_genres",
                                "total_albums", F.array_join("primary_genres", ", "))
    p = profiles.where("confidence >= 30").select(
        F.col("artist").alias("profile_artist"),
        F.when(F.size(genres) > 0, _suggestion(genres, F.col("confidence"), reasoning, ARTIST)).alias("by_artist"))
    return albums.join(p, strip(albums["artist"]) == p["profile_artist"], "left").drop("profile_artist")


_VOCABULARY: dict[tuple, dict[str, list[str]]] = {}


def rule_vocabulary(tax: Taxonomy, words: list[str]) -> dict[str, list[str]]:
    """Normalised list of each category the rules can name.

    The rules name a few dozen fixed categories, so they are normalised once,
    in one small job, instead of in every row.
    """
    key = (tax.to_json(), tuple(sorted(set(words))))
    if key not in _VOCABULARY:
        spark = SparkSession.active()
        rows = spark.createDataFrame([(w,) for w in key[1]], "word string")
        found = rows.select("word", gx.normalize_list(F.array("word"), tax).alias("names")).collect()
        _VOCABULARY[key] = {r["word"]: list(r["names"]) for r in found}
    return _VOCABULARY[key]


def _spread(vocabulary: dict[str, list[str]], words: list[str]) -> list[str]:
    return [name for w in words for name in vocabulary[w]]


def _first_three(c: Column) -> Column:
    return F.slice(gx.distinct_ignoring_case(F.array_sort(F.array_distinct(c))), 1, 3)


def keyword_hits(path: Column | str, keywords: dict[str, list[str]] | None = None) -> Column:
    """(genre, keyword) for each genre with a keyword in the lower-cased path; its first keyword counts."""
    table = constant([{"genre": g, "words": ws} for g, ws in (keywords or PATH_KEYWORDS).items()],
                     "array<struct<genre:string,words:array<string>>>")

    def hits(text: Column) -> Column:
        found = F.transform(table, lambda k: F.struct(
            k["genre"].alias("genre"),
            F.get(F.filter(k["words"], lambda w: text.contains(w)), F.lit(0)).alias("keyword")))
        return F.filter(found, lambda k: k["keyword"].isNotNull())
    return bind(F.lower(F.replace(col(path), F.lit("/"), F.lit(" "))), hits)


def era_genres(year: Column | str) -> Column:
    """Genres of the decade of a year; null outside the known eras."""
    out = None
    for start, end, genres in ERAS:
        hit = col(year).between(start, end)
        out = F.when(hit, strings(genres)) if out is None else out.when(hit, strings(genres))
    return out


def with_era(df: DataFrame, year: str) -> DataFrame:
    """Range lookup of a year in the era table (seven rows)."""
    eras = era_df(df.sparkSession)
    return df.join(eras, F.col(year).between(F.col("era_start"), F.col("era_end")), "left")


def path_suggestion(path: Column | str, tax: Taxonomy, keywords: dict[str, list[str]] | None = None) -> Column:
    """Suggestion out of path keywords and the year in the path, or null."""
    table = keywords or PATH_KEYWORDS
    vocabulary = rule_vocabulary(tax, [*table, *(g for *_, gs in ERAS for g in gs)])
    names = list_map({g: _spread(vocabulary, [g]) for g in table})
    seen = F.struct(keyword_hits(path, table).alias("hits"), path_year(path).alias("year"))

    def era(year: Column) -> Column:
        out = F.when(F.lit(False), no_strings())
        for start, end, genres in ERAS:
            out = out.when(year.between(start, end), strings(_spread(vocabulary, genres[:2])))
        return F.coalesce(out, no_strings())

    def build(s: Column) -> Column:
        from_era = era(s["year"])
        found = F.concat(F.flatten(F.transform(s["hits"], lambda h: F.try_element_at(names, h["genre"]))), from_era)
        reasons = F.concat(
            F.transform(s["hits"], lambda h: F.concat(F.lit("'"), h["keyword"], F.lit("' found in path"))),
            F.when(F.size(from_era) > 0, F.array(F.concat(F.lit("era-based ("), s["year"].cast("string"), F.lit(")"))))
            .otherwise(no_strings()))
        return F.when(F.size(reasons) > 0, bind(_first_three(found), lambda g: _suggestion(
            g, F.least(F.lit(70), F.size(g) * 20 + 30),
            F.concat(F.lit("Directory analysis: "), F.array_join(reasons, ", ")), PATH)))
    return bind(seen, build)


def _mentions(text: Column, word: str, word_boundary: bool) -> Column:
    return text.rlike(rf"(?U)\b{word}\b") if word_boundary else text.contains(word)


def context_suggestion(artist: Column | str, album: Column | str, track_count: Column | str, tax: Taxonomy,
                       word_boundary: bool = False) -> Column:
    """Suggestion out of track count, artist name and title words, or null."""
    n = F.coalesce(col(track_count), F.lit(0))
    who, title = F.lower(or_empty(artist)), F.lower(or_empty(album))
    rule = "struct<genres:array<string>,reason:string>"
    vocabulary = rule_vocabulary(tax, ["Compilation", "Various Artists", "EP", "Single", "Hip Hop", "Electronic",
                                       *(g for gs in TITLE_KEYWORDS.values() for g in gs)])

    def when(hit: Column, genres: list[str], reason: Column) -> Column:
        names = strings(_spread(vocabulary, genres))
        return F.when(hit, F.struct(names.alias("genres"), reason.alias("reason"))).cast(rule)
    by_artist = None
    for word in ARTIST_KEYWORDS:
        hit = _mentions(who, word, word_boundary)
        by_artist = hit if by_artist is None else by_artist | hit
    count_text = n.cast("string")
    rules = [
        when(n >= 15, ["Compilation", "Various Artists"],
             F.concat(F.lit("high track count ("), count_text, F.lit(")"))),
        when(n <= 4, ["EP", "Single"], F.concat(F.lit("short release ("), count_text, F.lit(" tracks)"))),
        when(by_artist, ["Hip Hop", "Electronic"], F.lit("artist name pattern")),
        *[when(_mentions(title, word, word_boundary), genres, F.lit(f"album title contains '{word}'"))
          for word, genres in TITLE_KEYWORDS.items()],
    ]

    def build(found: Column) -> Column:
        return F.when(F.size(found) > 0, _suggestion(
            _first_three(F.flatten(F.transform(found, lambda r: r["genres"]))), F.least(F.lit(60), F.size(found) * 15 + 20),
            F.concat(F.lit("Contextual analysis: "), F.array_join(F.transform(found, lambda r: r["reason"]), ", ")),
            CONTEXT))
    return bind(F.filter(F.array(*rules), lambda r: r.isNotNull()), build)


def hint_suggestions(df: DataFrame, column: str, kind: str = "label") -> DataFrame:
    """Genres hinted by a label or a country, matched without case."""
    hints = hint_df(df.sparkSession, LABEL_HINTS if kind == "label" else COUNTRY_HINTS, "hint_key")
    return df.join(hints, F.lower(strip(column)) == F.col("hint_key"), "left").drop("hint_key")


def with_suggestions(albums: DataFrame, tax: Taxonomy, profiles: DataFrame | None = None) -> DataFrame:
    """Adds ``suggestions``: zero to three of them per album (artist, path, context).

    ``file_path`` is the album's first path. Only the artist profile needs a
    join; the rest is computed in the row.
    """
    found = artist_suggestion(albums, profiles if profiles is not None else artist_profiles(albums, tax))
    every = F.array(F.col("by_artist"), path_suggestion("file_path", tax),
                    context_suggestion("artist", "album", "track_count", tax))
    return found.withColumn("suggestions", F.filter(every, lambda s: s.isNotNull())).drop("by_artist")


def all_suggestions(albums: DataFrame, tax: Taxonomy) -> DataFrame:
    """One row per album and suggestion."""
    return (unnest(with_suggestions(albums, tax), ["album_key"], F.col("suggestions"), "s")
            .select("album_key", "s.genres", "s.confidence", "s.reasoning", "s.source"))


def combine_suggestions(c: Column | str) -> Column:
    """Best single suggestion out of a list, or null.

    A genre weighs a tenth of its suggestion's confidence, rounded down; the
    three heaviest stay, ties in order of first mention.
    """
    def weight(s: Column) -> Column:
        return F.floor(s["confidence"] / 100 * 10).cast("int")

    def build(all_s: Column) -> Column:
        voiced = F.filter(all_s, lambda s: weight(s) > 0)
        names = F.array_distinct(F.flatten(F.transform(voiced, lambda s: s["genres"])))

        def total(g: Column) -> Column:
            return F.aggregate(voiced, F.lit(0), lambda acc, s: acc + weight(s) * F.size(
                F.filter(s["genres"], lambda x: x == g)))
        ranked = F.array_sort(F.transform(names, lambda g, i: F.struct((-total(g)).alias("w"), i.alias("i"),
                                                                       g.alias("g"))))
        top = F.transform(F.slice(ranked, 1, 3), lambda r: r["g"])
        mean = F.aggregate(all_s, F.lit(0.0), lambda acc, s: acc + s["confidence"]) / F.size(all_s)
        parts = F.transform(all_s, lambda s: F.concat(
            s["source"], F.lit(" ("), F.format_string("%.0f", s["confidence"]), F.lit("%)")))
        return F.when(F.size(names) > 0, _suggestion(
            top, mean, F.concat(F.lit("Combined analysis: "), F.array_join(parts, ", ")), "smart_combined"))
    return bind(col(c), build)


def best_suggestions(albums: DataFrame, tax: Taxonomy) -> DataFrame:
    """One combined suggestion per album that has any."""
    return (unnest(with_suggestions(albums, tax), ["album_key"], F.array(combine_suggestions("suggestions")), "s")
            .select("album_key", "s.genres", "s.confidence", "s.reasoning", "s.source"))


def _gaps(albums: DataFrame, tax: Taxonomy) -> DataFrame:
    return (with_normalized(with_suggestions(albums, tax), tax)
            .withColumn("has_genres", F.size("genres") > 0)
            .withColumn("has_suggestion", F.size("suggestions") > 0)
            .withColumn("poor", F.col("has_genres") & (F.col("n_invalid") > F.col("n_valid"))))


def suggestion_gaps(albums: DataFrame, tax: Taxonomy) -> DataFrame:
    """One row: albums, albums with a suggestion, coverage, albums without and with poor genres among them."""
    out = _gaps(albums, tax).agg(
        F.count(F.lit(1)).alias("total_albums"), F.count_if("has_suggestion").alias("albums_with_suggestions"),
        F.count_if(F.col("has_suggestion") & ~F.col("has_genres")).alias("albums_without_genres"),
        F.count_if(F.col("has_suggestion") & F.col("poor")).alias("albums_with_poor_genres"))
    return out.withColumn("coverage_percentage", percent(F.col("albums_with_suggestions"), F.col("total_albums")))


def suggestion_sources(albums: DataFrame, tax: Taxonomy) -> DataFrame:
    """Albums per kind of suggestion."""
    return all_suggestions(albums, tax).groupBy("source").agg(F.count(F.lit(1)).alias("n_albums"))


def suggestion_report(albums: DataFrame, tax: Taxonomy, n: int = 20) -> DataFrame:
    """First ``n`` albums without genres and half as many with poor ones, with their combined suggestion."""
    found = (_gaps(albums, tax).where("has_suggestion AND (poor OR NOT has_genres)")
             .withColumn("kind", F.when(F.col("has_genres"), "poor").otherwise("missing"))
             .withColumn("best", combine_suggestions("suggestions"))
             .select("kind", "album_key", "artist", "album", "genres", F.col("best.genres").alias("suggested"),
                     F.col("best.confidence").alias("confidence")))
    missing = found.where("kind = 'missing'").orderBy("album_key").limit(n)
    return missing.unionByName(found.where("kind = 'poor'").orderBy("album_key").limit(n // 2))
