"""Category standardisation as column expressions.

Lookups are literal maps and arrays inside the expression: a list column is
normalised, expanded, sorted and de-duplicated in the row it lives in, without
explode, shuffle or regrouping. That suits a taxonomy of some hundred entries.
``operators.genres`` has the same work as joins, for a taxonomy of any size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.core import bind, col, constant, list_map, no_strings, string_map, strings, strip
from shelfmark.functions.text import clean_category, title_case
from shelfmark.refdata import SOURCE_GENRE_NAMES, Taxonomy


def parse_list(c: Column | str) -> Column:
    """Read a stored list: JSON array text, or text split at ``;``."""
    text = col(c)
    as_json = F.coalesce(F.from_json(text, "array<string>"), F.array(text))
    parts = F.filter(F.transform(F.split(text, ";"), strip), lambda x: x != "")
    return (F.when(text.isNull() | text.isin("", "null"), no_strings())
            .when(text.startswith("["), as_json)
            .otherwise(parts))


def _known(tax: Taxonomy, longest_first: bool) -> Column:
    names = sorted(tax.valid, key=lambda g: ((-len(g) if longest_first else len(g)), g))
    return constant([{"lower": g.lower(), "name": g} for g in names], "array<struct<lower:string,name:string>>")


def partial_match(c: Column | str, tax: Taxonomy, min_len: int = 1) -> Column:
    """A valid category inside the text (longest wins), else one around it (shortest wins)."""
    def find(text: Column) -> Column:
        inside = F.filter(_known(tax, True), lambda k: text.contains(k["lower"]))
        around = F.filter(_known(tax, False), lambda k: k["lower"].contains(text))
        return F.when(F.trim(text) == "", F.lit(None).cast("string")).otherwise(F.coalesce(
            F.get(inside, F.lit(0))["name"],
            F.when(F.length(text) >= min_len, F.get(around, F.lit(0))["name"])))
    return bind(F.lower(col(c)), find)


def normalize_category(c: Column | str, tax: Taxonomy, strict: bool = False, min_len: int = 1) -> Column:
    """Canonical name of one raw category; the cleaned text when nothing matches.

    ``strict`` skips the lookup of the raw spelling, so that "R&B" is cleaned to
    "Randb" first and stays unknown.
    """
    lookup = string_map(tax.lookup)
    raw = col(c)

    def resolve(cleaned: Column) -> Column:
        steps = [] if strict else [F.try_element_at(lookup, F.lower(strip(raw)))]
        steps += [F.try_element_at(lookup, F.lower(cleaned)), partial_match(cleaned, tax, min_len)]
        return F.coalesce(*steps, F.when(F.trim(cleaned) == "", F.lit("")).otherwise(cleaned))

    return F.when(raw.isNull() | (raw == ""), F.lit("")).otherwise(bind(clean_category(raw), resolve))


def split_items(c: Column | str) -> Column:
    """Elements of a list column, with ``;``-joined elements split; no blanks or repeats."""
    parts = F.transform(
        F.coalesce(col(c), no_strings()),
        lambda x: F.when(x.contains(";"), F.filter(F.transform(F.split(x, ";"), strip), lambda p: p != ""))
        .otherwise(F.filter(F.array(x), lambda p: F.coalesce(p, F.lit("")) != "")))
    return F.array_distinct(F.flatten(parts))


def parents_of(c: Column | str, tax: Taxonomy) -> Column:
    """Direct parents of one category."""
    return F.coalesce(F.try_element_at(list_map(tax.hierarchy), col(c)), no_strings())


def expand_with_parents(c: Column | str, tax: Taxonomy) -> Column:
    """The list, then the direct parents it lacks in alphabetical order."""
    parents = F.flatten(F.transform(col(c), lambda g: parents_of(g, tax)))
    return F.array_union(col(c), F.array_sort(parents))


def distinct_ignoring_case(c: Column | str) -> Column:
    """First spelling of each element, order kept."""
    def keep(items: Column) -> Column:
        lowered = F.transform(items, F.lower)
        return F.filter(items, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
    return bind(col(c), keep)


def normalize_list(c: Column | str, tax: Taxonomy, strict: bool = False) -> Column:
    """Normalise every element, add direct parents, sort, de-duplicate."""
    known = F.filter(F.array_distinct(F.transform(split_items(c), lambda g: normalize_category(g, tax, strict))),
                     lambda g: g != "")
    return distinct_ignoring_case(F.array_sort(bind(known, lambda k: expand_with_parents(k, tax))))


def is_valid(c: Column | str, tax: Taxonomy) -> Column:
    return F.array_contains(strings(tax.valid), col(c))


def validate_list(c: Column | str, tax: Taxonomy, strict: bool = False) -> Column:
    """Struct of ``valid`` (normalised) and ``invalid`` (as given) elements."""
    pairs = F.transform(F.coalesce(col(c), no_strings()), lambda g: F.struct(
        g.alias("raw"), normalize_category(g, tax, strict).alias("norm")))

    def parts(p: Column) -> Column:
        return F.struct(
            F.transform(F.filter(p, lambda x: is_valid(x["norm"], tax)), lambda x: x["norm"]).alias("valid"),
            F.transform(F.filter(p, lambda x: ~is_valid(x["norm"], tax)), lambda x: x["raw"]).alias("invalid"))
    return bind(pairs, parts)


def suggest(c: Column | str, tax: Taxonomy, limit: int = 5) -> Column:
    """First ``limit`` valid categories, alphabetically, that contain the text."""
    names = strings(tax.valid)
    return bind(F.lower(col(c)), lambda t: F.slice(F.filter(names, lambda g: F.lower(g).contains(t)), 1, limit))


def source_genre_name(c: Column | str) -> Column:
    """Spelling used when votes of different sources are added up."""
    return bind(title_case(strip(c)), lambda t: F.coalesce(F.try_element_at(string_map(SOURCE_GENRE_NAMES), t), t))


def vote_filtered_tags(release_tags: Column | str, artist_tags: Column | str, release_min: int = 2,
                       artist_min: int = 3, limit: int = 10) -> Column:
    """Tags with enough votes, release tags first; each list holds (name, count-as-text)."""
    def names(tags: Column | str, least: int) -> Column:
        kept = F.filter(F.coalesce(col(tags), F.expr("CAST(array() AS array<struct<name:string,count:string>>)")),
                        lambda t: F.coalesce(t["count"].try_cast("int"), F.lit(0)) >= least)
        return F.transform(kept, lambda t: title_case(t["name"]))
    release = names(release_tags, release_min)
    return F.slice(F.concat(release, F.array_except(names(artist_tags, artist_min), release)), 1, limit)


def merge_preserving(existing: Column | str, new: Column | str) -> Column:
    """Existing elements first, then new ones; the first spelling wins."""
    return distinct_ignoring_case(F.concat(F.coalesce(col(existing), no_strings()), F.coalesce(col(new), no_strings())))


def merge_for_update(original: Column | str, suggested: Column | str, tax: Taxonomy,
                     limit: int | None = None) -> Column:
    """Original then suggested, normalised, then missing parents; the first ``limit`` of them if one is given."""
    both = F.array_distinct(F.concat(normalize_list(original, tax), normalize_list(suggested, tax)))
    merged = bind(both, lambda b: expand_with_parents(b, tax))
    return merged if limit is None else F.slice(merged, 1, limit)


def list_diff(original: Column | str, suggested: Column | str, final: Column | str) -> Column:
    """Struct of added, removed, kept and suggested_only elements, compared without case.

    Of several spellings in one list the last is shown.
    """
    def lowered(c: Column) -> Column:
        return F.transform(c, F.lower)

    def without(a: Column, b: Column) -> Column:
        return F.filter(a, lambda x: ~F.array_contains(lowered(b), F.lower(x)))

    def tidy(a: Column) -> Column:
        return F.array_sort(distinct_ignoring_case(F.reverse(a)))

    o, s, f = (F.coalesce(col(c), no_strings()) for c in (original, suggested, final))
    kept = F.filter(f, lambda x: F.array_contains(lowered(o), F.lower(x)))
    return bind(
        F.struct(tidy(without(f, o)).alias("added"), tidy(without(o, f)).alias("removed"), tidy(kept).alias("kept"),
                 tidy(without(s, f)).alias("suggested_only")),
        lambda d: F.struct(d["added"], d["removed"], d["kept"], d["suggested_only"],
                           ((F.size(d["added"]) > 0) | (F.size(d["removed"]) > 0)).alias("has_changes")))


def matches_category(c: Column | str, query: Column | str, tax: Taxonomy) -> Column:
    """True when the list, with parents of raw and normalised elements, names the category."""
    items = split_items(c)
    known = F.array_union(items, F.transform(items, lambda g: normalize_category(g, tax)))
    spread = F.transform(bind(known, lambda k: expand_with_parents(k, tax)), F.lower)
    query_col = F.lit(query) if isinstance(query, str) else query
    return F.array_contains(spread, F.lower(query_col))
