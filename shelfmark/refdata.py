"""Reference dimensions: the taxonomy, source weights, keyword tables, thresholds."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import hinted

# ---------------------------------------------------------------------------
# Fixed values. They must equal the published dictionaries for right results.
# ---------------------------------------------------------------------------

# variant -> canonical category
GENRE_MAPPINGS: dict[str, str] = {
    "Hip-Hop": "Hip Hop", "Hip Hop": "Hip Hop", "Hiphop": "Hip Hop", "Rap": "Hip Hop", "Hip-hop": "Hip Hop",
    "Electronic": "Electronic", "Electronica": "Electronic", "IDM": "IDM", "Ambient": "Ambient", "Techno": "Techno",
    "House": "House", "Drum & Bass": "Drum & Bass", "Drum and Bass": "Drum & Bass", "DnB": "Drum & Bass",
    "Dubstep": "Dubstep", "Synthpop": "Synthpop", "Synth-pop": "Synthpop", "New Wave": "New Wave",
    "Rock": "Rock", "Rock & Roll": "Rock", "Rock and Roll": "Rock", "Rock/Blues": "Rock", "Hard Rock": "Rock",
    "Soft Rock": "Rock", "Classic Rock": "Rock", "Progressive Rock": "Rock", "Prog Rock": "Rock",
    "Psychedelic Rock": "Rock", "Psych Rock": "Rock", "Indie Rock": "Indie Rock", "Alternative Rock": "Alternative",
    "Punk Rock": "Punk", "Post-Rock": "Post-Rock", "Art Rock": "Art Rock", "Garage Rock": "Garage Rock",
    "Glam Rock": "Glam Rock", "Alternative": "Alternative", "Alt": "Alternative", "Indie": "Alternative",
    "Independent": "Alternative",
    "Jazz": "Jazz", "Bebop": "Jazz", "Cool Jazz": "Jazz", "Free Jazz": "Jazz", "Fusion": "Jazz",
    "Jazz Fusion": "Jazz", "Smooth Jazz": "Jazz", "Contemporary Jazz": "Jazz",
    "Blues": "Blues", "Delta Blues": "Blues", "Chicago Blues": "Blues", "Electric Blues": "Blues",
    "Blues Rock": "Blues",
    "Country": "Country", "Country Music": "Country", "Country Rock": "Country", "Alt-Country": "Country",
    "Alternative Country": "Country", "Americana": "Country", "Folk Country": "Country",
    "Folk": "Folk", "Folk Music": "Folk", "Traditional Folk": "Folk", "Contemporary Folk": "Folk",
    "Folk Rock": "Folk", "Singer-Songwriter": "Folk",
    "Reggae": "Reggae", "Dub": "Reggae", "Ska": "Reggae", "Rocksteady": "Reggae", "Dancehall": "Reggae",
    "Roots Reggae": "Reggae",
    "Latin": "Latin", "Latin Music": "Latin", "Salsa": "Latin", "Cumbia": "Latin", "Bachata": "Latin",
    "Merengue": "Latin", "Reggaeton": "Latin", "Bossa Nova": "Latin",
    "Pop": "Pop", "Pop Music": "Pop", "Dance Pop": "Pop", "Electropop": "Pop", "Synth Pop": "Pop",
    "Teen Pop": "Pop", "Adult Contemporary": "Pop",
    "Classical": "Classical", "Classical Music": "Classical", "Baroque": "Classical", "Romantic": "Classical",
    "Contemporary Classical": "Classical", "Opera": "Classical", "Symphony": "Classical",
    "R&B": "R&B", "Soul": "R&B", "Rhythm and Blues": "R&B", "Neo-Soul": "R&B", "Contemporary R&B": "R&B",
    "Motown": "R&B", "Funk": "R&B",
    "Metal": "Metal", "Heavy Metal": "Heavy Metal", "Death Metal": "Death Metal", "Black Metal": "Black Metal",
    "Thrash Metal": "Thrash Metal", "Progressive Metal": "Progressive Metal", "Doom Metal": "Doom Metal",
    "Power Metal": "Power Metal",
    "Punk": "Punk", "Post-Punk": "Punk", "Hardcore Punk": "Punk", "Pop Punk": "Punk",
    "World": "World", "World Music": "World", "African": "World", "Celtic": "World", "Indian": "World",
    "Middle Eastern": "World", "Asian": "World",
    "Other": "Other", "Unknown": "Other", "Unclassified": "Other", "Various": "Other",
    "Soundtrack": "Soundtrack", "Film Score": "Soundtrack", "Game Music": "Soundtrack",
    "Easy Listening": "Easy Listening", "Vocal": "Vocal", "Instrumental": "Instrumental",
    "Experimental": "Experimental", "Avant-Garde": "Experimental", "Noise": "Experimental",
}

# child -> direct parents
GENRE_PARENTS: dict[str, list[str]] = {
    "Ambient": ["Electronic"], "Techno": ["Electronic"], "House": ["Electronic"], "Drum & Bass": ["Electronic"],
    "Dubstep": ["Electronic"], "IDM": ["Electronic"], "Synthpop": ["Electronic", "Pop"],
    "New Wave": ["Electronic", "Rock"],
    "Hard Rock": ["Rock"], "Progressive Rock": ["Rock"], "Psychedelic Rock": ["Rock"],
    "Punk Rock": ["Rock", "Punk"], "Alternative Rock": ["Rock", "Alternative"], "Indie Rock": ["Rock", "Alternative"],
    "Post-Rock": ["Rock"], "Art Rock": ["Rock"], "Garage Rock": ["Rock"], "Glam Rock": ["Rock"],
    "Bebop": ["Jazz"], "Cool Jazz": ["Jazz"], "Free Jazz": ["Jazz"], "Fusion": ["Jazz"], "Smooth Jazz": ["Jazz"],
    "Delta Blues": ["Blues"], "Chicago Blues": ["Blues"], "Electric Blues": ["Blues"],
    "Blues Rock": ["Blues", "Rock"],
    "Country Rock": ["Country", "Rock"], "Alt-Country": ["Country", "Alternative"], "Americana": ["Country", "Folk"],
    "Folk Rock": ["Folk", "Rock"], "Contemporary Folk": ["Folk"], "Singer-Songwriter": ["Folk"],
    "Dub": ["Reggae"], "Ska": ["Reggae"], "Rocksteady": ["Reggae"], "Dancehall": ["Reggae"],
    "Roots Reggae": ["Reggae"],
    "Salsa": ["Latin"], "Cumbia": ["Latin"], "Bachata": ["Latin"], "Merengue": ["Latin"], "Reggaeton": ["Latin"],
    "Bossa Nova": ["Latin", "Jazz"],
    "Dance Pop": ["Pop"], "Electropop": ["Pop", "Electronic"], "Teen Pop": ["Pop"],
    "Neo-Soul": ["R&B"], "Funk": ["R&B"], "Motown": ["R&B"],
    "Heavy Metal": ["Metal"], "Death Metal": ["Metal"], "Black Metal": ["Metal"], "Thrash Metal": ["Metal"],
    "Progressive Metal": ["Metal"], "Doom Metal": ["Metal"], "Power Metal": ["Metal"],
    "Post-Punk": ["Punk"], "Hardcore Punk": ["Punk"], "Pop Punk": ["Punk", "Pop"],
    "Baroque": ["Classical"], "Romantic": ["Classical"], "Contemporary Classical": ["Classical"],
    "Opera": ["Classical"],
    "African": ["World"], "Celtic": ["World"], "Indian": ["World"], "Middle Eastern": ["World"], "Asian": ["World"],
}

SOURCE_WEIGHTS: dict[str, float] = {
    "spotify": 1.0, "allmusic": 0.9, "musicbrainz": 0.85, "discogs": 0.8, "deezer": 0.75, "lastfm": 0.7,
}

# order in which sources win a tied score
SOURCE_ORDER: list[str] = ["spotify", "musicbrainz", "deezer", "discogs", "lastfm", "allmusic"]

# names a source may use, after title-casing
SOURCE_GENRE_NAMES: dict[str, str] = {
    "Hip-Hop": "Hip Hop", "R&B": "R&B", "Electronic/Dance": "Electronic", "Rock/Pop": "Rock",
    "Alternative Rock": "Alternative Rock",
}

PATH_KEYWORDS: dict[str, list[str]] = {
    "metal": ["metal", "doom", "black", "death", "thrash", "heavy"],
    "electronic": ["electronic", "techno", "house", "ambient", "edm", "synth"],
    "rock": ["rock", "indie", "alternative", "punk", "grunge"],
    "jazz": ["jazz", "bebop", "fusion", "swing"],
    "classical": ["classical", "baroque", "romantic", "symphony", "opera"],
    "folk": ["folk", "acoustic", "singer-songwriter"],
    "country": ["country", "bluegrass", "americana"],
    "hip hop": ["hip-hop", "hiphop", "rap", "hip hop"],
    "reggae": ["reggae", "dub", "ska", "dancehall"],
    "latin": ["latin", "salsa", "cumbia", "bachata"],
    "world": ["world", "ethnic", "traditional"],
    "blues": ["blues", "delta", "chicago"],
}

ERAS: list[tuple[int, int, list[str]]] = [
    (1950, 1959, ["Rock", "Blues", "Country", "Jazz"]),
    (1960, 1969, ["Rock", "Folk", "Psychedelic Rock", "Motown"]),
    (1970, 1979, ["Rock", "Punk", "Funk", "Disco"]),
    (1980, 1989, ["New Wave", "Electronic", "Metal", "Pop"]),
    (1990, 1999, ["Alternative", "Grunge", "Hip Hop", "Electronic"]),
    (2000, 2009, ["Indie", "Electronic", "Pop", "Alternative"]),
    (2010, 2024, ["Indie", "Electronic", "Hip Hop", "Pop"]),
]

TITLE_KEYWORDS: dict[str, list[str]] = {
    "symphony": ["Classical"], "concerto": ["Classical"], "mass": ["Classical"], "requiem": ["Classical"],
    "remix": ["Electronic"], "live": ["Live Recording"], "unplugged": ["Acoustic", "Folk"],
    "greatest hits": ["Compilation"], "best of": ["Compilation"], "collection": ["Compilation"],
}

ARTIST_KEYWORDS: list[str] = ["dj", "mc", "lil", "young"]

LABEL_HINTS: dict[str, list[str]] = {
    "sub pop": ["Alternative", "Indie Rock"], "matador": ["Indie Rock", "Alternative"],
    "merge": ["Indie", "Electronic"], "xl recordings": ["Electronic", "Alternative"],
    "ninja tune": ["Electronic", "Hip Hop"], "warp": ["Electronic", "IDM"], "kranky": ["Ambient", "Post-Rock"],
    "constellation": ["Post-Rock", "Experimental"], "sacred bones": ["Punk", "Experimental"],
    "captured tracks": ["Indie", "Pop"], "jagjaguwar": ["Indie Rock", "Folk"], "epitaph": ["Punk", "Alternative"],
    "metal blade": ["Metal"], "relapse": ["Metal", "Death Metal"], "blue note": ["Jazz"],
    "ecm": ["Jazz", "Classical"], "nonesuch": ["Classical", "Contemporary"], "deutsche grammophon": ["Classical"],
    "def jam": ["Hip Hop"], "roc-a-fella": ["Hip Hop"], "young money": ["Hip Hop"], "island": ["Reggae", "Rock"],
    "trojan": ["Reggae", "Ska"],
}

COUNTRY_HINTS: dict[str, list[str]] = {
    "jamaica": ["Reggae", "Dub", "Ska"], "brazil": ["Bossa Nova", "Samba", "Latin"],
    "cuba": ["Salsa", "Latin", "Afro-Cuban"], "argentina": ["Tango", "Latin"], "colombia": ["Cumbia", "Latin"],
    "india": ["Indian Classical", "World"], "japan": ["J-Pop", "Noise", "Electronic"],
    "germany": ["Electronic", "Krautrock"], "uk": ["Britpop", "Electronic", "Punk"],
    "united kingdom": ["Britpop", "Electronic", "Punk"], "france": ["Chanson", "Electronic"],
    "norway": ["Black Metal", "Electronic"], "sweden": ["Death Metal", "Pop"], "finland": ["Metal", "Electronic"],
}

AUDIO_EXTENSIONS: list[str] = [".mp3", ".flac", ".m4a", ".ogg", ".wav", ".wma", ".aiff", ".aif"]

PLAYLIST_EXTENSIONS: list[str] = [".m3u", ".m3u8", ".pls", ".xspf", ".wpl", ".asx", ".b4s", ".smil", ".ram"]

MEDIA_EXTENSIONS: list[str] = [
    ".mp3", ".flac", ".wav", ".aac", ".ogg", ".wma", ".m4a", ".opus", ".ape", ".dsd",
    ".aiff", ".alac", ".mp2", ".mpc", ".tta", ".wv", ".ac3", ".dts", ".amr", ".au",
    ".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".webm", ".m4v", ".mpg", ".mpeg",
    ".cue", ".log",
]

TAG_ALIASES: dict[str, list[str]] = {
    "title": ["TIT2", "TITLE", "Title", "title", "©nam"],
    "artist": ["TPE1", "ARTIST", "Artist", "artist", "©ART"],
    "album": ["TALB", "ALBUM", "Album", "album", "©alb"],
    "album_artist": ["TPE2", "ALBUMARTIST", "AlbumArtist", "albumartist", "aART"],
    "year": ["TDRC", "TYER", "DATE", "Year", "date", "©day"],
    "genre": ["TCON", "GENRE", "Genre", "genre", "©gen"],
    "track_number": ["TRCK", "TRACKNUMBER", "TrackNumber", "tracknumber", "trkn"],
    "compilation": ["TCMP", "COMPILATION", "Compilation", "compilation"],
}

TRUE_WORDS: list[str] = ["1", "true", "yes"]

VARIOUS_ARTISTS = "Various Artists"

# job options and their defaults
DEFAULT_OPTIONS: dict[str, object] = {
    "confidence_threshold": 95.0, "auto_update_high_confidence": False, "max_genres_per_album": 5,
    "api_rate_limit": 1.0, "batch_size": 100,
}

AUTO_THRESHOLD = 95.0
MEDIUM_THRESHOLD = 70.0
LOW_THRESHOLD = 40.0
MATCH_THRESHOLD = 0.7
DUPLICATE_THRESHOLD = 0.85
VOTE_FLOOR = 0.3
SECONDS_PER_ALBUM = 2

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Taxonomy:
    """Category variants and their parents, held on the driver as a small config.

    Edits return a new taxonomy; a later entry replaces an earlier one with the
    same key. The valid set is derived: canonical targets, children and parents.
    """

    mappings: dict[str, str] = field(default_factory=dict)
    hierarchy: dict[str, list[str]] = field(default_factory=dict)

    @staticmethod
    def default() -> "Taxonomy":
        return Taxonomy(dict(GENRE_MAPPINGS), {c: list(p) for c, p in GENRE_PARENTS.items()})

    @property
    def valid(self) -> list[str]:
        known = set(self.mappings.values()) | set(self.hierarchy)
        for parents in self.hierarchy.values():
            known.update(parents)
        return sorted(known)

    @property
    def lookup(self) -> dict[str, str]:
        """Lower-cased variant to canonical name."""
        return {variant.lower(): canonical for variant, canonical in self.mappings.items()}

    def with_mapping(self, variant: str, canonical: str) -> "Taxonomy":
        return replace(self, mappings={**self.mappings, variant: canonical})

    def with_parents(self, child: str, parents: list[str]) -> "Taxonomy":
        return replace(self, hierarchy={**self.hierarchy, child: list(parents)})

    def to_json(self) -> str:
        return json.dumps({"mappings": self.mappings, "hierarchy": self.hierarchy, "valid_genres": self.valid})

    @staticmethod
    def from_json(text: str) -> "Taxonomy":
        doc = json.loads(text)
        return Taxonomy(dict(doc.get("mappings", {})), {k: list(v) for k, v in doc.get("hierarchy", {}).items()})

    def mapping_df(self, spark: SparkSession) -> DataFrame:
        rows = list(self.lookup.items())
        return hinted(spark.createDataFrame(rows, "variant string, canonical string"), len(rows))

    def hierarchy_df(self, spark: SparkSession) -> DataFrame:
        rows = [(child, parent) for child, parents in self.hierarchy.items() for parent in parents]
        return hinted(spark.createDataFrame(rows, "child string, parent string"), len(rows))

    def valid_df(self, spark: SparkSession) -> DataFrame:
        rows = [(name,) for name in self.valid]
        return hinted(spark.createDataFrame(rows, "genre string"), len(rows))


@dataclass(frozen=True)
class TaxonomyTables:
    """A taxonomy that stays in tables, of any size: ``mappings(variant, canonical)`` and ``parents(child, parent)``.

    Variants are compared in lower case; of several canonical names of a variant the first in order counts.
    """

    mappings: DataFrame
    parents: DataFrame

    def mapping_df(self, spark: SparkSession) -> DataFrame:
        return self.mappings.groupBy(F.lower("variant").alias("variant")).agg(F.min("canonical").alias("canonical"))

    def hierarchy_df(self, spark: SparkSession) -> DataFrame:
        return self.parents.select("child", "parent").distinct()

    def valid_df(self, spark: SparkSession) -> DataFrame:
        return (self.mappings.select(F.col("canonical").alias("genre"))
                .unionByName(self.parents.select(F.explode(F.array("child", "parent")).alias("genre"))).distinct())


def era_df(spark: SparkSession) -> DataFrame:
    rows = [(start, end, genres) for start, end, genres in ERAS]
    return hinted(spark.createDataFrame(rows, "era_start int, era_end int, era_genres array<string>"), len(rows))


def hint_df(spark: SparkSession, hints: dict[str, list[str]], key: str) -> DataFrame:
    """Label or country hints as ``key, hint_genres``."""
    return hinted(spark.createDataFrame(list(hints.items()), f"{key} string, hint_genres array<string>"), len(hints))


def source_weight_df(spark: SparkSession, weights: dict[str, float] | None = None) -> DataFrame:
    rows = list((weights or SOURCE_WEIGHTS).items())
    return hinted(spark.createDataFrame(rows, "source string, weight double"), len(rows))


def extension_df(spark: SparkSession) -> DataFrame:
    """Known file suffixes with their class."""
    rows = [(e, "playlist") for e in PLAYLIST_EXTENSIONS] + [(e, "media") for e in MEDIA_EXTENSIONS]
    return hinted(spark.createDataFrame(rows, "ext string, class string"), len(rows))


def with_default_options(overrides: dict[str, object] | None = None) -> dict[str, object]:
    """Options file laid over the defaults."""
    return {**DEFAULT_OPTIONS, **(overrides or {})}
