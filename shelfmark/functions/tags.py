"""Track attributes out of tag bags, paths and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.core import bind, col, non_empty, or_empty, strip
from shelfmark.refdata import TAG_ALIASES, TRUE_WORDS, VARIOUS_ARTISTS


def non_empty_tags(tags: Column | str) -> Column:
    """Tags whose first value is not empty."""
    return F.map_filter(col(tags), lambda _, v: F.get(v, F.lit(0)) != "")


def first_tag(tags: Column | str, names: list[str], cleaned: bool = False) -> Column:
    """First value of the first named tag that has a non-empty one; ``''`` if none.

    Pass ``cleaned`` for a bag that went through ``non_empty_tags`` already.
    """
    bag = col(tags) if cleaned else non_empty_tags(tags)
    return F.coalesce(*[bag[n][0] for n in names], F.lit(""))


def extract_year(c: Column | str) -> Column:
    """First run of four digits."""
    return F.regexp_extract(col(c), r"(\d{4})", 1).try_cast("int")


def extract_track_number(c: Column | str) -> Column:
    """Digits at the start: ``1/12`` is 1."""
    return F.regexp_extract(col(c), r"^(\d+)", 1).try_cast("int")


def is_compilation(c: Column | str) -> Column:
    return F.coalesce(F.lower(col(c)).isin(TRUE_WORDS), F.lit(False))


def album_artist(artist: Column | str, album_artist_tag: Column | str, compilation: Column | None = None) -> Column:
    """Album artist tag, else Various Artists for compilations, else the track artist."""
    fallback = or_empty(artist)
    if compilation is not None:
        fallback = F.when(compilation, F.lit(VARIOUS_ARTISTS)).otherwise(fallback)
    return F.coalesce(non_empty(album_artist_tag), fallback)


def display_artist(artist: Column | str, compilation: Column | str) -> Column:
    return F.when(col(compilation), F.lit(VARIOUS_ARTISTS)).otherwise(col(artist))


def album_key(artist: Column | str, album: Column | str, compilation: Column | str) -> Column:
    """``artist|album``; compilations share ``Various Artists|album``."""
    return F.concat(display_artist(artist, compilation), F.lit("|"), col(album))


def valid_track(album: Column | str, artist: Column | str) -> Column:
    return (or_empty(album) != "") & (or_empty(artist) != "")


def suffix(path: Column | str) -> Column:
    """Lower-cased file suffix with its dot; empty for none and for dot files."""
    return F.lower(F.regexp_extract(col(path), r"[^/](\.[^./]+)$", 1))


def file_format(path: Column | str) -> Column:
    return F.regexp_replace(suffix(path), r"^\.", "")


def parent_directory(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def raw_metadata(fmt: Column | str, tags: Column | str, technical: Column | str) -> Column:
    """JSON document with everything read from a file."""
    return F.to_json(F.struct(col(fmt).alias("format"), col(tags).alias("tags"), col(technical).alias("technical")))


def parse_directory(name: Column | str) -> Column:
    """``Artist - Album (Year) [x]`` as a struct of artist and album; null without `` - ``."""
    text = col(name)

    def parts(p: Column) -> Column:
        album = F.substring_index(F.substring_index(strip(p[1]), " (", 1), " [", 1)
        return F.struct(strip(p[0]).alias("artist"), strip(album).alias("album"))
    return F.when(text.contains(" - "), bind(F.split(text, " - ", 2), parts))


def track_paths(tracks: Column | str) -> Column:
    """Non-empty file paths of a list of track structs."""
    return F.filter(F.transform(col(tracks), lambda t: t["file_path"]), lambda p: F.coalesce(p, F.lit("")) != "")


def paths_hash(paths: Column | str) -> Column:
    """md5 of the sorted paths joined by ``|``."""
    return F.md5(F.array_join(F.array_sort(col(paths)), "|").cast("binary"))


def cache_key(artist: Column | str, album: Column | str, source: Column | str) -> Column:
    return F.md5(F.concat(F.lower(col(artist)), F.lit("|"), F.lower(col(album)), F.lit("|"), col(source)).cast("binary"))


def path_year(path: Column | str) -> Column:
    """First stand-alone year from 1950 to 2049."""
    return F.regexp_extract(col(path), r"\b(19[5-9]\d|20[0-4]\d)\b", 1).try_cast("int")


def attributes(tags: Column | str, aliases: dict[str, list[str]] | None = None) -> dict[str, Column]:
    """Named columns read through the alias lists from a bag that went through ``non_empty_tags``."""
    names = aliases or TAG_ALIASES
    out = {k: first_tag(tags, v, cleaned=True) for k, v in names.items()}
    if "year" in out:
        out["year"] = extract_year(out["year"])
    if "track_number" in out:
        out["track_number"] = extract_track_number(out["track_number"])
    return out
