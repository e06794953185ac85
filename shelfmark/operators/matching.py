"""Candidate matching, vote aggregation and match reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import genres as gx
from shelfmark.functions import text as tx
from shelfmark.functions.core import no_strings
from shelfmark.operators.common import first_by, percent
from shelfmark.refdata import LOW_THRESHOLD, MATCH_THRESHOLD, SOURCE_ORDER, VOTE_FLOOR

CORRECTION_LIMIT = 98.0


def source_rank(source: Column | str) -> Column:
    """Order in which sources win a tie; unknown sources come last."""
    name = F.col(source) if isinstance(source, str) else source
    position = F.array_position(F.array(*[F.lit(s) for s in SOURCE_ORDER]), name)
    return F.when(position > 0, position).otherwise(len(SOURCE_ORDER) + 1)


def strategy_keys(albums: DataFrame) -> DataFrame:
    """Five lookup variants per album."""
    return (albums.select("album_key", F.explode(tx.match_strategies("artist", "album")).alias("s"))
            .select("album_key", "s.strategy", F.col("s.artist").alias("key_artist"),
                    F.col("s.album").alias("key_album"), F.col("s.query").alias("query")))


def scored_candidates(entities: DataFrame, candidates: DataFrame, metric: str = "levenshtein",
                      threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Candidates of each entity with their score, at or above the threshold.

    Candidates come paired with their entity, as a source's search result does.
    With the Python metric, repeated name pairs are scored once and pairs whose
    lengths alone keep them under the threshold are dropped natively first.
    """
    pairs = candidates.join(entities.select(F.col("album_key").alias("entity_key"), "artist", "album"), "entity_key")
    names = ["artist", "album", "cand_artist", "cand_title"]
    if metric == "levenshtein":
        scored = pairs.withColumn("score", tx.pair_score(*names))
        return scored.where(F.col("score") >= threshold)
    bound = (tx.sequence_ratio_bound("artist", "cand_artist") + tx.sequence_ratio_bound("album", "cand_title")) / 2.0
    hopeful = pairs.where(bound >= threshold)
    scores = hopeful.select(*names).distinct().withColumn("score", tx.pair_score(*names, metric=metric))
    same = [F.col(f"p.{n}").eqNullSafe(F.col(f"s.{n}")) for n in names]
    return (hopeful.alias("p").join(scores.alias("s"), same).select("p.*", "s.score")
            .where(F.col("score") >= threshold))


def best_match(entities: DataFrame, candidates: DataFrame, metric: str = "levenshtein",
               threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Best candidate per entity over all sources; entities without one are ``skipped``.

    Ties: source order, then position in the source's result, then names.
    """
    scored = scored_candidates(entities, candidates, metric, threshold)
    rank = F.struct(-F.col("score"), source_rank("source"), F.col("position"), F.col("cand_artist"),
                    F.col("cand_title"))
    best = first_by(scored, ["entity_key"], rank, ["source", "cand_artist", "cand_title", "position", "score"])
    return (entities.select(F.col("album_key").alias("entity_key"), "artist", "album")
            .join(best, "entity_key", "left")
            .withColumn("match_confidence", F.coalesce(F.col("score") * 100, F.lit(0.0)))
            .withColumn("status", review_status(F.col("match_confidence"))))


def best_per_source(entities: DataFrame, candidates: DataFrame, metric: str = "levenshtein",
                    threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Best candidate per entity and source."""
    scored = scored_candidates(entities, candidates, metric, threshold)
    rank = F.struct(-F.col("score"), F.col("position"), F.col("cand_artist"), F.col("cand_title"))
    return first_by(scored, ["entity_key", "source"], rank, ["cand_artist", "cand_title", "position", "score"])


SEARCH_TIERS = ["exact", "quoted", "broad", "album_focused"]


def _search_keys(artist: str, album: str) -> Column:
    """(rank, key) of the four lookups: exact, without case, normalised names, normalised title."""
    mark = F.lit("\u0001")
    keys = [F.concat(F.col(artist), mark, F.col(album)),
            F.concat(F.lower(artist), mark, F.lower(album)),
            F.concat(tx.normalize_name(artist), mark, tx.normalize_name(album)),
            tx.normalize_name(album)]
    return F.array(*[F.struct(F.lit(i).alias("rank"), k.alias("key")) for i, k in enumerate(keys, start=1)])


def _shelf(catalog: DataFrame) -> DataFrame:
    """(found_key, rank, lookup_key) of every album under each of its lookups."""
    return (catalog.select(F.col("album_key").alias("found_key"), F.explode(_search_keys("artist", "album")).alias("s"))
            .select("found_key", "s.rank", F.col("s.key").alias("lookup_key")).where("lookup_key <> ''"))


def _tier() -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in SEARCH_TIERS]), F.col("rank")).alias("tier")


def tiered_search(entities: DataFrame, catalog: DataFrame) -> DataFrame:
    """The first lookup of each entity that finds anything.

    Output: entity_key, tier, lookup_key, n_hits. The catalogue is one row per
    lookup key before the join, so a title shared by very many albums meets its
    entities as one row. ``search_hits`` lists what each lookup finds, whole.
    """
    counts = _shelf(catalog).groupBy("rank", "lookup_key").agg(F.count(F.lit(1)).alias("n_hits"))
    asked = (entities.select(F.col("album_key").alias("entity_key"), F.explode(_search_keys("artist", "album")).alias("s"))
             .select("entity_key", "s.rank", F.col("s.key").alias("lookup_key")))
    won = first_by(asked.join(counts, ["rank", "lookup_key"]), ["entity_key"], F.col("rank"),
                   ["rank", "lookup_key", "n_hits"])
    return won.select("entity_key", _tier(), "lookup_key", "n_hits")


def search_hits(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """(tier, lookup_key, found_key): all albums under the lookups that ``tiered_search`` settled on."""
    used = found.select("tier", "lookup_key").distinct()
    return _shelf(catalog).select(_tier(), "lookup_key", "found_key").join(used, ["tier", "lookup_key"], "left_semi")


def metadata_corrections(matches: DataFrame, metric: str = "levenshtein") -> DataFrame:
    """Proposed artist and title of the best candidate, with per-field confidence and a reason.

    ``matches``: album_key, artist, album, cand_artist, cand_title.
    """
    sim = tx.METRICS[metric]
    out = (matches.withColumn("artist_confidence", sim("artist", "cand_artist") * 100)
           .withColumn("album_confidence", sim("album", "cand_title") * 100)
           .withColumn("overall_confidence", (F.col("artist_confidence") + F.col("album_confidence")) / 2.0)
           .withColumn("corrected_artist", F.when(F.col("artist_confidence") < CORRECTION_LIMIT, F.col("cand_artist")))
           .withColumn("corrected_album", F.when(F.col("album_confidence") < CORRECTION_LIMIT, F.col("cand_title"))))

    def part(label: str, old: str, new: str, confidence: str) -> Column:
        return F.when(F.col(new).isNotNull(), F.format_string(
            f'{label}: "%s" → "%s" (%.1f%%)', F.col(old), F.col(new), F.col(confidence)))
    reason = F.concat_ws("; ", part("Artist", "artist", "corrected_artist", "artist_confidence"),
                         part("Album", "album", "corrected_album", "album_confidence"))
    missing = F.col("cand_artist").isNull()
    return (out.withColumn("reason", F.when(missing, "No metadata found").when(reason == "", "No corrections needed")
                           .otherwise(reason))
            .withColumn("overall_confidence", F.coalesce("overall_confidence", F.lit(0.0)))
            .withColumn("status", review_status(F.col("overall_confidence"))))


def review_status(confidence: Column, review_floor: float = LOW_THRESHOLD, auto_floor: float | None = None) -> Column:
    """Matcher decision; without ``auto_floor`` every match goes to review."""
    decided = F.when(confidence >= review_floor, "needs_review").otherwise("skipped")
    return decided if auto_floor is None else F.when(confidence >= auto_floor, "completed").otherwise(decided)


# fixed format of a stored correction
CORRECTION_PATTERN = r'{label}:\s*"([^"]+)"\s*→\s*"([^"]+)"\s*\(([0-9.]+)%\)'


def parse_corrections(reason: Column | str) -> dict[str, Column]:
    """Corrected artist and album out of a stored reason; null when absent."""
    def part(label: str) -> Column:
        return F.nullif(F.regexp_extract(reason, CORRECTION_PATTERN.format(label=label), 2), F.lit(""))
    return {"corrected_artist": part("Artist"), "corrected_album": part("Album")}


def as_percent(confidence: Column | str) -> Column:
    """Confidence stored either as a fraction or as a percentage."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.when(c <= 1.0, c * 100.0).otherwise(c)


def vote_scores(votes: DataFrame) -> DataFrame:
    """Summed weight of each genre per entity: entity_key, genre, score, sources."""
    cast = votes.select("entity_key", "source", (F.col("weight") * (F.col("confidence") / 100)).alias("vote"),
                        F.explode("genres").alias("raw"))
    by_source = (cast.groupBy("entity_key", gx.source_genre_name("raw").alias("genre"), "source")
                 .agg(F.sum("vote").alias("v")))
    return (by_source.groupBy("entity_key", "genre")
            .agg(F.round(F.sum("v"), 9).alias("score"),
                 F.array_sort(F.collect_set("source")).alias("sources")))


def aggregate_votes(entities: DataFrame, votes: DataFrame, floor: float = VOTE_FLOOR, top: int = 10) -> DataFrame:
    """Final genres and confidence per entity; entities without votes stay, at confidence 0.

    ``entities``: entity_key. ``votes``: one row per entity and source. The
    ranking window carries a row limit, which Spark applies before the shuffle,
    so an entity with very many genres sends only its best ones.
    """
    by_score = Window.partitionBy("entity_key").orderBy(F.desc("score"), "genre")
    ranked = (vote_scores(votes).where(F.col("score") >= floor)
              .withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top))
    label = F.concat(F.col("genre"), F.lit(" ("), F.array_join("sources", ", "), F.lit(")"))
    best = (ranked.groupBy("entity_key")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "genre", label.alias("label")))).alias("g"))
            .select("entity_key", F.transform("g", lambda x: x["genre"]).alias("final_genres"),
                    F.transform(F.slice("g", 1, 3), lambda x: x["label"]).alias("labels")))
    used = (votes.where(F.size("genres") > 0).groupBy("entity_key")
            .agg(F.count(F.lit(1)).alias("n_sources"), F.array_sort(F.collect_set("source")).alias("sources_used")))
    n_genres = F.size("final_genres")
    confidence = F.least(F.lit(100), F.when(n_genres > 0, 60).otherwise(0) + F.col("n_sources") * 10
                         + F.least(F.lit(20), n_genres * 5)).cast("double")
    return (entities.select("entity_key").join(used, "entity_key", "left").join(best, "entity_key", "left")
            .withColumn("final_genres", F.coalesce("final_genres", no_strings()))
            .withColumn("sources_used", F.coalesce("sources_used", no_strings()))
            .withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))
            .withColumn("confidence", F.when(F.col("n_sources") == 0, F.lit(0.0)).otherwise(confidence))
            .withColumn("reasoning", F.when(F.col("n_sources") == 0, F.lit("No sources returned genres")).otherwise(
                F.concat(F.lit("Aggregated from "), F.col("n_sources").cast("string"), F.lit(" sources: "),
                         F.array_join(F.coalesce("labels", no_strings()), "; "))))
            .drop("labels"))


def match_library(albums: DataFrame, candidates: DataFrame, votes: DataFrame, metric: str = "levenshtein") -> DataFrame:
    """Best candidate and merged genres of every album; votes count only where a candidate matched."""
    matched = best_match(albums, candidates, metric)
    keys = albums.select(F.col("album_key").alias("entity_key"))
    usable = votes.join(matched.where("score IS NOT NULL").select("entity_key"), "entity_key", "left_semi")
    genres = aggregate_votes(keys, usable)
    return matched.join(genres, "entity_key").withColumn("overall_confidence", F.col("match_confidence"))


def match_rate(albums: DataFrame, aggregated: DataFrame, threshold: float) -> DataFrame:
    """One-row report: processed, matched, no match, errors, improved, with and without genres."""
    joined = albums.select(F.col("album_key").alias("entity_key"), "genres").join(aggregated, "entity_key", "left")
    failed = F.col("confidence").isNull()
    matched = (F.col("confidence") >= threshold) & (F.size("final_genres") > 0)
    improved = matched & (F.size(F.array_except("final_genres", "genres")) > 0)
    out = joined.agg(
        F.count_if(~failed).alias("processed"), F.count_if(matched).alias("matched"),
        F.count_if(~failed & ~F.coalesce(matched, F.lit(False))).alias("no_match"), F.count_if(failed).alias("errors"),
        F.count_if(improved).alias("improved"), F.count_if(F.size("genres") > 0).alias("with_genres"),
        F.count_if(F.size("genres") <= 0).alias("without_genres"))
    out = (out.withColumn("match_rate", percent(F.col("matched"), F.col("processed")))
           .withColumn("improvement_rate", percent(F.col("improved"), F.col("processed"))))
    return (out.withColumn("match_band", match_band("match_rate"))
            .withColumn("improvement_band", improvement_band("improvement_rate")))


def match_band(rate: Column | str) -> Column:
    r = F.col(rate) if isinstance(rate, str) else rate
    return F.when(r >= 70, "excellent").when(r >= 50, "good").otherwise("low")


def improvement_band(rate: Column | str) -> Column:
    r = F.col(rate) if isinstance(rate, str) else rate
    return F.when(r >= 50, "high").when(r >= 25, "moderate").otherwise("limited")


def source_usage(aggregated: DataFrame) -> DataFrame:
    """Entities per source."""
    return (aggregated.select(F.explode("sources_used").alias("source")).groupBy("source")
            .agg(F.count(F.lit(1)).alias("n_albums")))


def top_matches(albums: DataFrame, aggregated: DataFrame, n: int = 10, least: float = 20.0) -> DataFrame:
    """Best ``n`` matches by confidence."""
    return (albums.select(F.col("album_key").alias("entity_key"), "artist", "album", "genres")
            .join(aggregated.where(F.col("confidence") > least), "entity_key")
            .withColumn("would_improve", F.size(F.array_except("final_genres", "genres")) > 0)
            .orderBy(F.desc("confidence"), "entity_key").limit(n))


def unexpired(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def best_cached(albums: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Best unexpired cache entry per album by confidence times weight, names compared without case."""
    live = (unexpired(cache, now).where("confidence * weight > 0")
            .select(F.lower("artist").alias("ka"), F.lower("album").alias("kb"), "source",
                    F.col("genres").alias("cached_genres"), F.col("confidence").alias("raw_confidence"), "weight"))
    rank = F.struct(-(F.col("raw_confidence") * F.col("weight")), -F.col("weight"), F.col("source"))
    best = first_by(live, ["ka", "kb"], rank, ["source", "cached_genres", "raw_confidence", "weight"])
    return (albums.withColumn("ka", F.lower("artist")).withColumn("kb", F.lower("album"))
            .join(best, ["ka", "kb"], "left").drop("ka", "kb")
            .withColumn("cached_confidence", as_percent("raw_confidence")))


def review_worklist(results: DataFrame, albums: DataFrame, cache: DataFrame, now: Column, threshold: float = 0.0,
                    statuses: tuple[str, ...] = ("failed", "needs_review", "skipped")) -> DataFrame:
    """Unsettled results of known albums, one per album, with their best cached match."""
    open_results = results.where(F.col("status").isin(*statuses))
    one = first_by(open_results, ["album_key"], F.struct(-F.col("confidence"), F.col("job_id"), F.col("created_at")),
                   ["job_id", "confidence", "status"])
    known = one.join(albums.select("album_key", "artist", "album"), "album_key")
    return best_cached(known, cache, now).where(F.coalesce("cached_confidence", F.lit(0.0)) >= threshold)


def compare_names(pairs: DataFrame) -> DataFrame:
    """Whole-percent artist, album and mean ratio of a pair of names; repeated pairs are scored once."""
    names = ["artist", "album", "cand_artist", "cand_title"]
    scores = (pairs.select(*names).distinct()
              .withColumn("artist_pct", tx.percent_ratio("artist", "cand_artist"))
              .withColumn("album_pct", tx.percent_ratio("album", "cand_title"))
              .withColumn("mean_pct", (F.col("artist_pct") + F.col("album_pct")) / 2.0))
    return pairs.join(scores, names)


def cache_statistics(cache: DataFrame, now: Column) -> DataFrame:
    """Entries and live entries per source."""
    live = F.col("expires_at").isNull() | (F.col("expires_at") > now)
    return cache.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(live).alias("unexpired"))
