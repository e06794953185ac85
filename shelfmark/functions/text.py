"""Text normalisation and similarity."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from shelfmark.functions.core import bind, col, strip


def title_case(c: Column | str) -> Column:
    """Capital after every non-letter ("90S", "Hip-Hop"), unlike ``initcap``."""
    runs = F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def clean_category(c: Column | str) -> Column:
    """Canonical spelling of a raw category before any lookup."""
    text = F.regexp_replace(strip(c), r"(?U)\s+", " ")
    text = F.regexp_replace(text, r"(?iU)^(The|A|An)\s+", "")
    text = F.regexp_replace(text, r"(?iU)\s+(Music|Genre)$", "")
    text = F.replace(F.replace(text, F.lit("&"), F.lit("and")), F.lit("/"), F.lit(" "))
    return title_case(F.regexp_replace(text, r"(?U)[^\w\s-]", ""))


def _accent_table() -> tuple[str, str]:
    """Precomposed letters below U+2000 whose base is a single character."""
    accented, plain = [], []
    for code in range(0x00C0, 0x2000):
        ch = chr(code)
        base = "".join(p for p in unicodedata.normalize("NFD", ch) if unicodedata.category(p) != "Mn")
        if base != ch and len(base) == 1:
            accented.append(ch)
            plain.append(base)
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accent_table()


def strip_accents(c: Column | str) -> Column:
    """Letters without their accents: a native lookup plus removal of loose marks."""
    return F.regexp_replace(F.translate(col(c), _ACCENTED, _PLAIN), r"\p{Mn}+", "")


EDITION_WORDS = "Deluxe|Remastered|Expanded|Special|Extended|Bonus"


def normalize_name(c: Column | str) -> Column:
    """Comparison form of an artist or title."""
    text = strip_accents(F.coalesce(col(c), F.lit("")))
    text = F.regexp_replace(text, r"(?iU)^(The|A|An)\s+", "")
    text = F.regexp_replace(text, rf"(?iU)\s+\(({EDITION_WORDS}).*\)$", "")
    text = F.regexp_replace(text, rf"(?iU)\s+\[({EDITION_WORDS}).*\]$", "")
    text = F.regexp_replace(text, r"(?U)[^\w\s]", "")
    return F.lower(strip(F.regexp_replace(text, r"(?U)\s+", " ")))


def levenshtein_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - distance / longer length, on lower case; two empty strings are equal."""
    left, right = F.lower(col(a)), F.lower(col(b))
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.levenshtein(left, right).cast("double") / longest.cast("double"))


@F.pandas_udf(DoubleType())
def _sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)],
                     dtype="float64")


def sequence_ratio(a: Column | str, b: Column | str) -> Column:
    """Longest-matching-block ratio; argument order matters."""
    return _sequence_ratio(F.lower(col(a)), F.lower(col(b)))


def sequence_ratio_bound(a: Column | str, b: Column | str) -> Column:
    """Upper bound of ``sequence_ratio`` from the lengths: 2 * min / sum."""
    la, lb = F.length(col(a)), F.length(col(b))
    return F.when(la + lb == 0, F.lit(1.0)).otherwise(F.lit(2.0) * F.least(la, lb) / (la + lb))


METRICS = {"levenshtein": levenshtein_similarity, "sequence": sequence_ratio}


def percent_ratio(a: Column | str, b: Column | str) -> Column:
    """Sequence ratio as a whole percentage."""
    return F.round(sequence_ratio(a, b) * 100).cast("int")


def pair_score(artist: Column | str, album: Column | str, cand_artist: Column | str, cand_album: Column | str,
               metric: str = "levenshtein") -> Column:
    """Mean of artist and title similarity."""
    sim = METRICS[metric]
    return (sim(artist, cand_artist) + sim(album, cand_album)) / F.lit(2.0)


ARTIST_WEIGHT, TITLE_WEIGHT, COUNT_WEIGHT = 0.4, 0.5, 0.1


def count_similarity(n1: Column | str, n2: Column | str) -> Column:
    """Closeness of two track counts; one half when either side has none."""
    a, b = col(n1), col(n2)
    known = F.lit(1.0) - F.abs(a - b).cast("double") / F.greatest(a, b).cast("double")
    return F.when((a > 0) & (b > 0), known).otherwise(F.lit(0.5))


def weighted_similarity(artist_sim: Column, title_sim: Column, count_sim: Column) -> Column:
    return artist_sim * F.lit(ARTIST_WEIGHT) + title_sim * F.lit(TITLE_WEIGHT) + count_sim * F.lit(COUNT_WEIGHT)


def album_similarity(artist1, album1, count1, artist2, album2, count2) -> Column:
    """Weighted similarity of two albums."""
    return weighted_similarity(levenshtein_similarity(artist1, artist2), levenshtein_similarity(album1, album2),
                               count_similarity(count1, count2))


STRATEGIES = ["exact", "normalized", "fuzzy_artist", "fuzzy_album", "loose"]


def match_strategies(artist: Column | str, album: Column | str) -> Column:
    """Array of (strategy, artist, album, query): five ways to look an album up."""
    def variant(name: str, a: Column, b: Column, loose: bool = False) -> Column:
        query = F.concat_ws(" ", a, b) if loose else F.concat(
            F.lit('artist:"'), a, F.lit('" AND release:"'), b, F.lit('"'))
        return F.struct(F.lit(name).alias("strategy"), a.alias("artist"), b.alias("album"), query.alias("query"))

    raw = F.struct(col(artist).alias("a"), col(album).alias("b"), normalize_name(artist).alias("na"),
                   normalize_name(album).alias("nb"))
    return bind(raw, lambda r: F.array(
        variant("exact", r["a"], r["b"]), variant("normalized", r["na"], r["nb"]),
        variant("fuzzy_artist", r["na"], r["b"]), variant("fuzzy_album", r["a"], r["nb"]),
        variant("loose", r["a"], r["b"], loose=True)))
