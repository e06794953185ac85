"""Quality rules, scores and reports. Every rule yields rows of the issue schema."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import genres as gx
from shelfmark.functions.core import is_blank, or_empty, strip
from shelfmark.operators import dedup
from shelfmark.operators.common import one_row, percent, unnest
from shelfmark.operators.genres import with_normalized
from shelfmark.refdata import DUPLICATE_THRESHOLD, Taxonomy

ISSUE_COLUMNS = ["issue_type", "severity", "album_key", "artist", "album", "description", "suggested_fix",
                 "confidence"]

FULL = 100.0


def finding(issue_type: str, severity: str, description: Column, fix: Column | str, confidence: float = FULL) -> Column:
    """What a value rule returns when it applies."""
    return F.struct(F.lit(issue_type).alias("issue_type"), F.lit(severity).alias("severity"),
                    description.alias("description"), (F.lit(fix) if isinstance(fix, str) else fix).alias("suggested_fix"),
                    F.lit(confidence).alias("confidence"))


def _quoted(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix + ': "'), value, F.lit('"'))


# name -> rule: column of the raw category -> finding or null
ValueRule = Callable[[Column], Column]


def value_rules(tax: Taxonomy, strict: bool = False) -> dict[str, ValueRule]:
    """Rules over a single category string. Add entries to extend the check."""
    def words(g: Column) -> Column:
        return F.filter(F.split(F.lower(strip(g)), r"(?U)\s+"), lambda w: w != "")

    def hints(g: Column) -> Column:
        return F.concat(F.lit("Consider mapping to: "), F.array_join(gx.suggest(g, tax, 3), ", "))

    return {
        "empty_genre": lambda g: F.when(is_blank(g), finding(
            "empty_genre", "warning", F.lit("Empty or whitespace-only genre"),
            "Remove empty genre or replace with valid genre")),
        "invalid_characters": lambda g: F.when(g.rlike(r"(?U)[^\w\s\-&/().]"), finding(
            "invalid_characters", "warning", _quoted("Genre contains invalid characters", g),
            "Remove special characters and normalize")),
        "too_long": lambda g: F.when(F.length(g) > 50, finding(
            "too_long", "info", F.concat(F.lit("Genre name is very long ("), F.length(g).cast("string"),
                                         F.lit(' chars): "'), F.substring(g, 1, 30), F.lit('..."')),
            "Use shorter, more standard genre name")),
        "numeric_only": lambda g: F.when(strip(g).rlike(r"(?U)^\d+$"), finding(
            "numeric_only", "critical", _quoted("Genre is numeric only", g), "Replace with proper genre name")),
        "duplicate_words": lambda g: F.when(F.size(words(g)) != F.size(F.array_distinct(words(g))), finding(
            "duplicate_words", "info", _quoted("Genre has duplicate words", g), "Remove duplicate words")),
        "invalid_format": lambda g: F.when(g.rlike(r"(?U)/{2,}|&{2,}|\s{3,}"), finding(
            "invalid_format", "warning", _quoted("Genre has formatting issues", g),
            "Clean up spacing and punctuation")),
        "unknown_genre": lambda g: F.when(~gx.is_valid(gx.normalize_category(g, tax, strict), tax), finding(
            "unknown_genre", "info", _quoted("Unknown genre", g), hints(g), 50.0)),
    }


def value_findings(values: DataFrame, column: str, rules: dict[str, ValueRule]) -> DataFrame:
    """Findings of all rules for each value, one row per finding."""
    g = F.col(column)
    every = F.array(*[rule(g) for rule in rules.values()])
    return unnest(values, values.columns, every, "f").select(*values.columns, "f.*")


def genre_issues(albums: DataFrame, tax: Taxonomy, rules: dict[str, ValueRule] | None = None,
                 strict: bool = False) -> DataFrame:
    """Rules over each raw category of each album.

    The rules are evaluated once per distinct category; the findings are joined
    back to the albums. A category used by a third of all albums is one value
    there, and the join back has one row per finding on the small side, which
    AQE broadcasts or splits by its measured size.
    """
    uses = albums.select("album_key", "artist", "album", F.explode("genres").alias("genre"))
    found = value_findings(uses.select("genre").distinct(), "genre", rules or value_rules(tax, strict))
    return uses.join(found, "genre").select(*ISSUE_COLUMNS)


def artist_consistency(albums: DataFrame, tax: Taxonomy, strict: bool = False) -> DataFrame:
    """Per artist: albums, albums with and without genres, distinct normalised genres."""
    sizes = albums.groupBy("artist").agg(F.count(F.lit(1)).alias("n_albums"),
                                         F.count_if(F.size("genres") > 0).alias("with_genres"))
    spread = (unnest(with_normalized(albums, tax, strict), ["artist"], F.col("normalized"), "genre")
              .groupBy("artist").agg(F.count_distinct("genre").alias("unique_genres")))
    spread = spread.withColumnRenamed("artist", "_artist")  # a missing artist is an artist of its own
    return (sizes.join(spread, F.col("artist").eqNullSafe(F.col("_artist")), "left").drop("_artist")
            .withColumn("unique_genres", F.coalesce("unique_genres", F.lit(0)))
            .withColumn("without_genres", F.col("n_albums") - F.col("with_genres"))
            .withColumn("percentage_missing", percent(F.col("without_genres"), F.col("n_albums"))))


def artist_issues(albums: DataFrame, tax: Taxonomy, strict: bool = False) -> DataFrame:
    """Artists with very many genres, and artists with many albums lacking genres."""
    checked = artist_consistency(albums, tax, strict).where("n_albums >= 2 AND with_genres >= 2")
    many = F.when((F.col("unique_genres") > 10) & (F.col("with_genres") > 5), finding(
        "artist_inconsistency", "warning",
        F.format_string("Artist has %d different genres across %d albums", "unique_genres", "with_genres"),
        "Review and standardize artist's primary genres", 70.0))
    lacking = F.when((F.col("without_genres") > 0) & (F.col("percentage_missing") > 30), finding(
        "missing_genres", "info",
        F.format_string("%d/%d albums missing genres (%.0f%%)", "without_genres", "n_albums", "percentage_missing"),
        "Add genres to albums based on artist's common genres", 80.0))
    return (unnest(checked, ["artist"], F.array(many, lacking), "f")
            .select("f.*", "artist", F.lit("").alias("album_key"), F.lit("").alias("album")).select(*ISSUE_COLUMNS))


def duplicate_issues(albums: DataFrame, threshold: float = DUPLICATE_THRESHOLD) -> DataFrame:
    """Near-duplicates: one issue per pair of distinct albums, one per further copy of an album."""
    def described(df: DataFrame, other_artist: str, other_album: str, sim: Column) -> DataFrame:
        return df.select(
            F.lit("potential_duplicate").alias("issue_type"), F.lit("warning").alias("severity"), "album_key",
            "artist", "album",
            F.format_string('Potential duplicate: "%s - %s" (similarity: %.0f%%)', F.col(other_artist),
                            F.col(other_album), sim * 100).alias("description"),
            F.lit("Review and remove duplicate or mark as different edition").alias("suggested_fix"),
            (sim * 100).alias("confidence"))
    names = albums.select("album_key", "artist", "album")
    pairs = dedup.named_pairs(albums, threshold).withColumnsRenamed(
        {"key1": "album_key", "artist1": "artist", "album1": "album"})
    copies = dedup.duplicate_members(albums).join(
        names.withColumnsRenamed({"album_key": "canonical_key", "artist": "artist2", "album": "album2"}),
        "canonical_key")
    return described(pairs, "artist2", "album2", F.col("similarity")).unionByName(
        described(copies, "artist2", "album2", F.lit(1.0)))


def completeness_issues(albums: DataFrame) -> DataFrame:
    """Missing artist, missing title, artist equal to title."""
    none = F.lit("")
    rules = F.array(
        F.when(is_blank("artist"), F.struct(
            finding("missing_artist", "critical", F.lit("Missing artist name"),
                    "Add artist name from file metadata or directory").alias("f"),
            none.alias("artist"), or_empty("album").alias("album"))),
        F.when(is_blank("album"), F.struct(
            finding("missing_album", "critical", F.lit("Missing album title"),
                    "Add album title from file metadata or directory").alias("f"),
            or_empty("artist").alias("artist"), none.alias("album"))),
        F.when(F.col("artist").eqNullSafe(F.col("album")), F.struct(
            finding("suspicious_metadata", "warning", F.lit("Artist and album names are identical"),
                    "Verify metadata is correct").alias("f"),
            or_empty("artist").alias("artist"), or_empty("album").alias("album"))))
    return (unnest(albums, ["album_key"], rules, "x")
            .select("album_key", "x.f.*", "x.artist", "x.album").select(*ISSUE_COLUMNS))


def track_issues(albums: DataFrame, tracks: DataFrame) -> DataFrame:
    """Unnamed tracks and many track artists in albums of two or more tracks."""
    per_album = (tracks.groupBy("album_key")
                 .agg(F.count(F.lit(1)).alias("n"), F.count_if(is_blank("title")).alias("unnamed"),
                      F.count_distinct(F.nullif(F.col("artist"), F.lit(""))).alias("n_artists"))
                 .where("n >= 2 AND (unnamed > 0 OR n_artists > 3)"))
    rules = F.array(
        F.when(F.col("unnamed") > 0, finding(
            "missing_track_names", "warning", F.format_string("%d/%d tracks missing names", "unnamed", "n"),
            "Add track names from file metadata")),
        F.when(F.col("n_artists") > 3, finding(
            "multiple_artists", "info", F.format_string("Album has %d different track artists", "n_artists"),
            "Consider if this is a compilation album")))
    return (per_album.join(albums.select("album_key", "artist", "album"), "album_key")
            .select("album_key", "artist", "album", F.explode_outer(rules).alias("f")).where("f IS NOT NULL")
            .select("album_key", "artist", "album", "f.*").select(*ISSUE_COLUMNS))


def all_issues(albums: DataFrame, tracks: DataFrame | None, tax: Taxonomy, duplicates: bool = True,
               rules: dict[str, ValueRule] | None = None) -> DataFrame:
    """Union of all rules."""
    parts = [genre_issues(albums, tax, rules), artist_issues(albums, tax), completeness_issues(albums)]
    if tracks is not None:
        parts.append(track_issues(albums, tracks))
    if duplicates:
        parts.append(duplicate_issues(albums))
    return reduce(DataFrame.unionByName, parts)


def severity_rank(severity: Column | str) -> Column:
    s = F.col(severity) if isinstance(severity, str) else severity
    return F.when(s == "critical", 3).when(s == "warning", 2).otherwise(1)


def issue_summary(issues: DataFrame) -> DataFrame:
    """Counts in total, by severity and by type, in one pass."""
    counted = issues.groupingSets([[], ["severity"], ["issue_type"]], "severity", "issue_type").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("severity").alias("gs"), F.grouping("issue_type").alias("gt"))
    return counted.select(
        F.when((F.col("gs") == 1) & (F.col("gt") == 1), "total").when(F.col("gs") == 0, "severity")
        .otherwise("type").alias("level"),
        F.coalesce("severity", "issue_type", F.lit("all")).alias("name"), "n")


def scores(albums: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: totals by severity, quality score and consistency score, exact and rounded."""
    of_issues = issues.agg(
        F.count(F.lit(1)).alias("total_issues"), F.count_if(F.col("severity") == "critical").alias("critical_issues"),
        F.count_if(F.col("severity") == "warning").alias("warning_issues"),
        F.count_if(F.col("severity") == "info").alias("info_issues"),
        F.count_if(F.col("issue_type").isin("artist_inconsistency", "unknown_genre", "invalid_format"))
        .alias("consistency_issues"))
    of_albums = albums.agg(F.count(F.lit(1)).alias("total_albums"),
                           F.count_if(F.size("genres") > 0).alias("albums_with_genres"))
    n = F.col("total_albums")
    penalty = (F.col("critical_issues") * 5 + F.col("warning_issues") * 2 + F.col("info_issues") * F.lit(0.5)) / n
    cover = F.col("albums_with_genres") / n * 100 - F.col("consistency_issues") / n * 20

    def capped(score: Column) -> Column:
        return F.when(n > 0, F.greatest(F.lit(0.0), score)).otherwise(F.lit(100.0))
    return (one_row(of_albums, of_issues)
            .withColumn("quality_exact", capped(F.lit(100.0) - penalty))
            .withColumn("consistency_exact", capped(cover))
            .withColumn("quality_score", F.round("quality_exact", 1))
            .withColumn("consistency_score", F.round("consistency_exact", 1)))


def top_issues(issues: DataFrame, n: int = 20) -> DataFrame:
    """Worst issues: severity, then confidence, then a fixed order."""
    return issues.orderBy(F.desc(severity_rank("severity")), F.desc("confidence"), "issue_type", "album_key",
                          "artist", "description").limit(n)
