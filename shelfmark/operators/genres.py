"""Category standardisation over tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.functions import genres as gx
from shelfmark.functions.core import no_strings, strip
from shelfmark.functions.text import clean_category
from shelfmark.operators.common import percent
from shelfmark.refdata import Taxonomy, TaxonomyTables
from shelfmark.session import materialize


GRAM = 3

# Taxonomies of up to this many names are written into expressions over the distinct lists; larger ones are joined.
# Both forms give the same lists.
LITERAL_NAMES = 1_000

AnyTaxonomy = Taxonomy | TaxonomyTables


def _grams(c: str) -> Column:
    """The distinct pieces of ``GRAM`` letters of a text, and the shorter ones: three rows a letter at most."""
    return F.expr(f"""array_distinct(flatten(transform(sequence(1, {GRAM}), n -> transform(
        sequence(1, greatest(length({c}) - n + 1, 1)), i -> substring({c}, i, n)))))""")


def _key_size(c: str) -> Column:
    return F.least(F.length(c), F.lit(GRAM))


def containing(texts: DataFrame, valid: DataFrame) -> DataFrame:
    """(text, genre, lower) for each name that has a distinct non-empty ``text`` inside it, whatever their number.

    Names are filed under all their grams; a text looks under the one that the fewest names have. One of its grams
    that no name has rules the text out.
    """
    names = valid.select("genre", F.lower("genre").alias("lower"))
    filed = names.select("genre", "lower", F.explode(_grams("lower")).alias("gram"))
    counts = filed.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    asked = (texts.select("text", F.explode(_grams("text")).alias("gram"))
             .where(F.length("gram") == _key_size("text")).join(counts, "gram", "left")
             .groupBy("text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
             .where("best.n > 0").select("text", F.col("best.gram").alias("gram")))
    return asked.join(filed, "gram").where(F.contains("lower", "text")).select("text", "genre", "lower")


def contained(texts: DataFrame, valid: DataFrame) -> DataFrame:
    """(text, genre, lower) for each non-empty name inside a distinct ``text``, whatever their number and lengths.

    A name is filed under the one of its grams that the fewest names have; a text looks under all of its own.
    """
    names = valid.select("genre", F.lower("genre").alias("lower")).where("lower <> ''")
    grams = names.select("genre", "lower", F.explode(_grams("lower")).alias("gram")).where(
        F.length("gram") == _key_size("lower"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    filed = (grams.join(counts, "gram").groupBy("genre", "lower").agg(F.min(F.struct("n", "gram")).alias("best"))
             .select("genre", "lower", F.col("best.gram").alias("gram")))
    asked = texts.select("text", F.explode(_grams("text")).alias("gram"))
    return asked.join(filed, "gram").where(F.contains("text", "lower")).select("text", "genre", "lower")


def partial_lookup(values: DataFrame, valid: DataFrame, min_len: int = 1) -> DataFrame:
    """Containment match of distinct texts with any number of valid names.

    Input: ``text`` (lower case); ``genre``. Output: text, genre, one row per
    text that matches: a name inside the text wins, longest first; else a name
    around it, shortest first.
    """
    texts = values.where("trim(text) <> ''").select("text").distinct()
    inside = contained(texts, valid).select("text", "genre", F.lit(0).alias("tier"), (-F.length("genre")).alias("size"))
    around = containing(texts.where(F.length("text") >= min_len), valid).select(
        "text", "genre", F.lit(1).alias("tier"), F.length("genre").alias("size"))
    best = F.min(F.struct("tier", "size", "genre")).alias("b")
    return inside.unionByName(around).groupBy("text").agg(best).select("text", F.col("b.genre").alias("genre"))


def suggestions(df: DataFrame, column: str, tax: AnyTaxonomy, out: str = "suggestions", limit: int = 5) -> DataFrame:
    """Adds the first ``limit`` valid categories, alphabetically, that contain the text of ``column``, case apart.

    An empty text is in every name; a null one in none.
    """
    valid = tax.valid_df(df.sparkSession)
    texts = df.select(F.lower(column).alias("text")).where("text IS NOT NULL").distinct()
    order = Window.partitionBy("text").orderBy("genre")
    found = (containing(texts.where("text <> ''"), valid).withColumn("place", F.row_number().over(order))
             .where(F.col("place") <= limit))
    first = valid.orderBy("genre").limit(limit).select(F.lit("").alias("text"), "genre")
    lists = (found.select("text", "genre").unionByName(first).groupBy("text")
             .agg(F.array_sort(F.collect_list("genre")).alias("_names")))  # `limit` names at most
    return (df.join(lists, F.lower(df[column]) == F.col("text"), "left").drop("text")
            .withColumn(out, F.coalesce("_names", no_strings())).drop("_names"))


def normalize_values(df: DataFrame, column: str, tax: AnyTaxonomy, out: str = "normalized", strict: bool = False,
                     min_len: int = 1) -> DataFrame:
    """Canonical name of a scalar column through its distinct values.

    The cleaning and the lookups run once per distinct raw value. The value
    table is joined back without a hint: AQE broadcasts it when its measured
    size allows and otherwise splits hot values as a skewed join.
    """
    spark = df.sparkSession
    lookup = tax.mapping_df(spark)
    raw = (df.select(F.col(column).alias("raw")).where("raw IS NOT NULL AND raw <> ''").distinct()
           .withColumn("cleaned", clean_category("raw")))
    by_clean = lookup.select(F.col("variant").alias("clean_key"), F.col("canonical").alias("c_clean"))
    found = raw.withColumn("clean_key", F.lower("cleaned")).join(by_clean, "clean_key", "left")
    if strict:
        found = found.withColumn("c_raw", F.lit(None).cast("string"))
    else:
        by_raw = lookup.select(F.col("variant").alias("raw_key"), F.col("canonical").alias("c_raw"))
        found = found.withColumn("raw_key", F.lower(strip("raw"))).join(by_raw, "raw_key", "left")
    exact = found.select("raw", "cleaned", "clean_key", F.coalesce("c_raw", "c_clean").alias("exact"))
    partial = partial_lookup(exact.where("exact IS NULL").select(F.col("clean_key").alias("text")),
                             tax.valid_df(spark), min_len)
    table = (exact.join(partial.select(F.col("text").alias("clean_key"), F.col("genre").alias("partial")),
                        "clean_key", "left")
             .select("raw", F.coalesce("exact", "partial", F.when(F.trim("cleaned") == "", F.lit(""))
                                       .otherwise(F.col("cleaned"))).alias(out)))
    return (df.join(table, df[column] == table["raw"], "left").drop("raw")
            .withColumn(out, F.coalesce(out, F.lit(""))))


def _small(tax: AnyTaxonomy) -> bool:
    return isinstance(tax, Taxonomy) and len(tax.mappings) + len(tax.hierarchy) <= LITERAL_NAMES


def _over_lists(df: DataFrame, column: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Joins what ``make`` finds for each distinct list back to the rows that have it.

    Many rows carry the same list. Only distinct lists leave a task; AQE broadcasts the result when its measured
    size allows and otherwise splits lists that very many rows share. A null list counts as an empty one.
    """
    own = df.withColumn(column, F.coalesce(column, no_strings()))
    table = make(own.select(F.col(column).alias("_list")).distinct())
    return own.join(table, F.col(column) == F.col("_list"), "left").drop("_list")


def _numbered(lists: DataFrame) -> DataFrame:
    """The lists with a number each, ``_no``, written once.

    An element carries the number of its list, not the list: a list of n names would be shuffled n times.
    """
    return materialize(lists.withColumn("_no", F.monotonically_increasing_id()), "lists")


def _lists_by_joins(lists: DataFrame, tax: AnyTaxonomy, strict: bool) -> DataFrame:
    spark, lists = lists.sparkSession, _numbered(lists)
    items = lists.select("_no", F.explode(gx.split_items("_list")).alias("_item"))
    own = normalize_values(items, "_item", tax, "genre", strict).where("genre <> ''").select("_no", "genre").distinct()
    parents = own.join(tax.hierarchy_df(spark), F.col("genre") == F.col("child")).select("_no", F.col("parent").alias("genre"))
    found = own.unionByName(parents).groupBy("_no").agg(F.collect_set("genre").alias("_found"))  # one list's own names
    return lists.join(found, "_no", "left").select("_list", gx.distinct_ignoring_case(
        F.array_sort(F.coalesce("_found", no_strings()))).alias("normalized"))


def normalize_lists(df: DataFrame, column: str, tax: AnyTaxonomy, out: str = "normalized", strict: bool = False,
                    joins: bool | None = None) -> DataFrame:
    """Every element normalised, direct parents added, sorted, without repeats; once for each distinct list.

    ``joins`` chooses the form; by itself it follows the size of the taxonomy.
    """
    def make(lists: DataFrame) -> DataFrame:
        if joins or (joins is None and not _small(tax)):
            found = _lists_by_joins(lists, tax, strict)
        else:
            found = lists.withColumn("normalized", gx.normalize_list("_list", tax, strict))
        return found.select("_list", F.col("normalized").alias(out))
    return _over_lists(df, column, make)


def validate_lists(df: DataFrame, column: str, tax: AnyTaxonomy, out: str = "checked", strict: bool = False,
                   joins: bool | None = None) -> DataFrame:
    """Adds a struct of ``valid`` (normalised) and ``invalid`` (as given) elements, in their order."""
    def by_joins(lists: DataFrame) -> DataFrame:
        lists = _numbered(lists)
        items = lists.select("_no", F.posexplode("_list").alias("_at", "_item"))
        names = normalize_values(items, "_item", tax, "_name", strict)
        valid = tax.valid_df(lists.sparkSession).select(F.col("genre").alias("_known"))
        told = names.join(valid, F.col("_name") == F.col("_known"), "left")

        def listed(kind: Column, value: str) -> Column:
            return F.transform(F.array_sort(F.collect_list(F.when(kind, F.struct("_at", value)))), lambda x: x[value])
        known = F.col("_known").isNotNull()
        found = told.groupBy("_no").agg(listed(known, "_name").alias("valid"), listed(~known, "_item").alias("invalid"))
        return lists.join(found, "_no", "left").select("_list", F.struct(
            F.coalesce("valid", no_strings()).alias("valid"), F.coalesce("invalid", no_strings()).alias("invalid")).alias(out))

    def make(lists: DataFrame) -> DataFrame:
        if joins or (joins is None and not _small(tax)):
            return by_joins(lists)
        return lists.withColumn(out, gx.validate_list("_list", tax, strict))
    return _over_lists(df, column, make)


def with_parents(df: DataFrame, column: str, tax: AnyTaxonomy, out: str, joins: bool | None = None) -> DataFrame:
    """The list, then the direct parents it lacks in alphabetical order; once for each distinct list."""
    def by_joins(lists: DataFrame) -> DataFrame:
        lists = _numbered(lists)
        found = (lists.select("_no", F.explode("_list").alias("_item"))
                 .join(tax.hierarchy_df(lists.sparkSession), F.col("_item") == F.col("child"))
                 .groupBy("_no").agg(F.array_sort(F.collect_set("parent")).alias("_parents")))
        return lists.join(found, "_no", "left").select("_list", F.array_union(
            "_list", F.coalesce("_parents", no_strings())).alias(out))

    def make(lists: DataFrame) -> DataFrame:
        if joins or (joins is None and not _small(tax)):
            return by_joins(lists)
        return lists.withColumn(out, gx.expand_with_parents("_list", tax))
    return _over_lists(df, column, make)


def with_merged(df: DataFrame, original: str, suggested: str, tax: AnyTaxonomy, out: str, limit: int | None = None,
                joins: bool | None = None) -> DataFrame:
    """Original then suggested elements, normalised, then missing parents; the first ``limit`` of them if one is given."""
    named = df.withColumns({"_first": F.col(original), "_second": F.col(suggested)})
    for column in ("_first", "_second"):
        named = normalize_lists(named, column, tax, f"{column}_normal", joins=joins)
    both = named.withColumn("_both", F.array_distinct(F.concat("_first_normal", "_second_normal")))
    merged = with_parents(both, "_both", tax, "_merged", joins)
    kept = F.col("_merged") if limit is None else F.slice("_merged", 1, limit)
    return merged.withColumn(out, kept).drop("_first", "_second", "_first_normal", "_second_normal", "_both", "_merged")


def with_normalized(albums: DataFrame, tax: AnyTaxonomy, strict: bool = False, joins: bool | None = None) -> DataFrame:
    """Adds ``normalized`` (list with parents) and the numbers of its valid and invalid elements."""
    def make(lists: DataFrame) -> DataFrame:
        named = normalize_lists(lists.withColumnRenamed("_list", "_own"), "_own", tax, "normalized", strict, joins)
        return validate_lists(named, "normalized", tax, "_v", strict, joins).select(
            F.col("_own").alias("_list"), "normalized", F.size("_v.valid").alias("n_valid"), F.size("_v.invalid").alias("n_invalid"))

    def at_once(lists: DataFrame) -> DataFrame:
        named = lists.withColumn("normalized", gx.normalize_list("_list", tax, strict))
        return named.withColumn("_v", gx.validate_list("normalized", tax, strict)).select(
            "_list", "normalized", F.size("_v.valid").alias("n_valid"), F.size("_v.invalid").alias("n_invalid"))
    return _over_lists(albums, "genres", make if joins or (joins is None and not _small(tax)) else at_once)


def category_counts(albums: DataFrame, tax: AnyTaxonomy, strict: bool = False) -> DataFrame:
    """Distinct raw categories with their number of uses, canonical name and validity."""
    counts = albums.select(F.explode("genres").alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    if _small(tax):
        return (counts.withColumn("canonical", gx.normalize_category("raw", tax, strict))
                .withColumn("is_valid", gx.is_valid("canonical", tax)))
    known = tax.valid_df(albums.sparkSession).select(F.col("genre").alias("_known"))
    return (normalize_values(counts.withColumnRenamed("raw", "given"), "given", tax, "canonical", strict)
            .join(known, F.col("canonical") == F.col("_known"), "left")
            .select(F.col("given").alias("raw"), "n", "canonical", F.col("_known").isNotNull().alias("is_valid")))


def descendants(spark: SparkSession, tax: AnyTaxonomy) -> DataFrame:
    """(ancestor, descendant, depth) for every category below another, at the least depth.

    Paths are joined with themselves, so their length doubles each round and a hierarchy of depth d takes log2(d) + 1
    rounds. Cycle rule: nothing is below itself, so a category of a cycle is below the others of it and not below
    itself; rounds end when no pair is new.
    """
    edges = tax.hierarchy_df(spark).where("child <> parent").select(
        F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("depth")).distinct()
    paths = materialize(edges, "paths")
    known = paths.agg(F.count(F.lit(1)), F.sum("depth")).first()
    while True:
        lower = paths.select(F.col("ancestor").alias("descendant"), F.col("descendant").alias("below"),
                             F.col("depth").alias("more"))
        longer = paths.join(lower, "descendant").where("ancestor <> below").select(
            "ancestor", F.col("below").alias("descendant"), (F.col("depth") + F.col("more")).alias("depth"))
        paths = materialize(paths.unionByName(longer).groupBy("ancestor", "descendant").agg(
            F.min("depth").alias("depth")), "paths")
        now = paths.agg(F.count(F.lit(1)), F.sum("depth")).first()
        if now == known:
            return paths
        known = now


def unmapped_categories(albums: DataFrame, tax: Taxonomy) -> DataFrame:
    """Raw categories without a valid canonical name."""
    return category_counts(albums, tax).where("NOT is_valid").select("raw", "canonical", "n")


def category_variants(albums: DataFrame, tax: Taxonomy) -> DataFrame:
    """Canonical names written in more than one way, one row per spelling."""
    counts = category_counts(albums, tax)
    many = counts.groupBy("canonical").agg(F.count(F.lit(1)).alias("n_variants")).where("n_variants > 1")
    return counts.join(many, "canonical").select("canonical", F.col("raw").alias("variant"), "n", "n_variants")


def missing_parents(albums: DataFrame, tax: AnyTaxonomy) -> DataFrame:
    """Parents that an album's raw categories imply but do not include, one row per album."""
    if _small(tax):
        gaps = F.filter(F.flatten(F.transform("genres", lambda g: gx.parents_of(g, tax))),
                        lambda p: ~F.array_contains(F.col("genres"), p))
        return albums.select("album_key", gaps.alias("missing")).where(F.size("missing") > 0)
    spread = with_parents(albums.select("album_key", "genres"), "genres", tax, "spread")
    return spread.select("album_key", F.array_except("spread", "genres").alias("missing")).where(F.size("missing") > 0)


def consistency_statistics(albums: DataFrame, tax: Taxonomy) -> DataFrame:
    """One row: uses, distinct raw values, valid and invalid uses, share of valid ones."""
    totals = category_counts(albums, tax).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_instances"),
        F.count(F.lit(1)).alias("unique_genres"),
        F.coalesce(F.sum(F.when(F.col("is_valid"), F.col("n"))), F.lit(0)).cast("bigint").alias("valid_instances"))
    return (totals.withColumn("invalid_instances", F.col("total_instances") - F.col("valid_instances"))
            .withColumn("consistency_rate", percent(F.col("valid_instances"), F.col("total_instances"))))


def albums_with_category(albums: DataFrame, query: str, tax: AnyTaxonomy) -> DataFrame:
    """Albums with a category, as given or normalised, that is ``query`` or anywhere below it, case of ``query`` apart."""
    spark = albums.sparkSession
    wanted = (descendants(spark, tax).where(F.lower("ancestor") == query.lower())
              .select(F.lower("descendant").alias("_name"))
              .unionByName(spark.range(1).select(F.lit(query.lower()).alias("_name"))).distinct())
    lists = _numbered(albums.select(F.col("genres").alias("_list")).distinct())
    items = lists.select("_no", F.explode(gx.split_items("_list")).alias("_item"))
    names = normalize_values(items, "_item", tax, "_canonical").select(
        "_no", F.explode(F.array("_item", "_canonical")).alias("_any"))
    hits = lists.join(names.join(wanted, F.lower("_any") == F.col("_name"), "left_semi")
                      .select("_no").distinct(), "_no", "left_semi").select("_list")
    return albums.join(hits, F.col("genres") == F.col("_list"), "left_semi")
