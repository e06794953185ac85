"""Category standardisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import genres as gx
from shelfmark.functions.text import clean_category, normalize_name, title_case
from shelfmark.operators import genres as gn
from shelfmark.refdata import TaxonomyTables
from suite import bindings as b

QUERIES = {}


def add(name, fn, sql=None, extra=None):
    QUERIES[name] = (fn, None if sql is None else b.with_sql(sql, extra))


RAW = {
    "instances": f"SELECT o_orderkey AS k, {b._RAW} AS raw FROM orders",
    "nonempty": "SELECT * FROM instances WHERE raw <> ''",
}


def instances(s, d):
    return b.table(s, d, "orders").select(F.col("o_orderkey").alias("k"), b.raw_genre().alias("raw"))


add("parse_list",
    lambda s, d: instances(s, d).select("k", F.array_join(gx.parse_list("raw"), "~").alias("parsed")),
    """SELECT k, array_to_string(list_filter(list_transform(string_split(raw, ';'), lambda x: trim(x)),
              lambda x: x <> ''), '~') AS parsed FROM instances""", RAW)

add("parse_json_list",
    lambda s, d: instances(s, d).select("k", F.array_join(gx.parse_list(
        F.to_json(F.array("raw", F.lit("a;b")))), "~").alias("parsed")),
    "SELECT k, raw || '~a;b' AS parsed FROM instances", RAW)

add("clean_category",
    lambda s, d: instances(s, d).select("k", "raw", clean_category("raw").alias("cleaned")),
    f"SELECT k, raw, {b.clean_sql('raw')} AS cleaned FROM instances", RAW)

add("title_case",
    lambda s, d: b.table(s, d, "part").select("p_partkey", title_case(F.concat_ws("-", "p_brand", "p_name", "p_type"))
                                              .alias("t")),
    f"SELECT p_partkey, {b.title_sql('concat_ws(chr(45), p_brand, p_name, p_type)')} AS t FROM part")

add("normalize_category",
    lambda s, d: instances(s, d).select("k", gx.normalize_category("raw", b.TAX).alias("canonical")),
    "SELECT k, canonical FROM instances i JOIN canon c ON i.raw = c.raw", {**RAW, **b.names_sql("instances", "raw")})

add("normalize_values",
    lambda s, d: gn.normalize_values(instances(s, d), "raw", b.TAX, "canonical").select("k", "canonical"),
    "SELECT k, canonical FROM instances i JOIN canon c ON i.raw = c.raw", {**RAW, **b.names_sql("instances", "raw")})

STRICT = {
    **RAW, **b.names_sql("instances", "raw"),
    "strict_canon": """
        SELECT raw, CASE WHEN raw = '' THEN '' ELSE coalesce(
            (SELECT max(canonical) FROM tax_map WHERE variant = lower(cleaned)),
            CASE WHEN trim(cleaned) = '' THEN '' END,
            (SELECT arg_min(genre, lpad(CAST(1000 - length(genre) AS VARCHAR), 4, '0') || genre) FROM tax_valid
             WHERE contains(lower(cleaned), lower(genre))),
            (SELECT arg_min(genre, lpad(CAST(length(genre) AS VARCHAR), 4, '0') || genre) FROM tax_valid
             WHERE contains(lower(genre), lower(cleaned))),
            cleaned) END AS canonical FROM canon_raw""",
}
add("normalize_strict",
    lambda s, d: instances(s, d).select("k", gx.normalize_category("raw", b.TAX, strict=True).alias("canonical")),
    "SELECT k, canonical FROM instances i JOIN strict_canon c ON i.raw = c.raw", STRICT)

add("partial_match",
    lambda s, d: gn.partial_lookup(
        b.table(s, d, "part").select(F.concat_ws(" ", F.lower("p_name"), F.lower(b.choose("p_type", b.GENRE_OF_TYPE)))
                                     .alias("text")), b.TAX.valid_df(s)),
    f"""SELECT text, coalesce(
            (SELECT arg_min(genre, lpad(CAST(1000 - length(genre) AS VARCHAR), 4, '0') || genre) FROM tax_valid
             WHERE contains(text, lower(genre))),
            (SELECT arg_min(genre, lpad(CAST(length(genre) AS VARCHAR), 4, '0') || genre) FROM tax_valid
             WHERE contains(lower(genre), text))) AS genre
        FROM (SELECT DISTINCT lower(p_name) || ' ' || lower({b._case('p_type', b.GENRE_OF_TYPE)}) AS text FROM part)
        WHERE genre IS NOT NULL""")

LISTS = b.lists_sql("part_albums")
add("normalize_list",
    lambda s, d: b.part_albums(s, d).select("album_key", F.array_join(gx.normalize_list("genres", b.TAX), "~")
                                            .alias("genres")),
    """SELECT album_key, array_to_string(list_sort(list(genre)), '~') AS genres FROM norm_list GROUP BY 1""", LISTS)

add("direct_parents",
    lambda s, d: instances(s, d).select("k", F.explode(gx.parents_of(gx.normalize_category("raw", b.TAX), b.TAX))
                                        .alias("parent")),
    "SELECT k, parent FROM instances i JOIN canon c ON i.raw = c.raw JOIN tax_parents ON child = canonical",
    {**RAW, **b.names_sql("instances", "raw")})

add("expand_with_parents",
    lambda s, d: b.part_albums(s, d).select("album_key", F.array_join(F.array_sort(gx.expand_with_parents(
        F.concat("genres", F.array(F.lit("Synthpop"), F.lit("Americana"))), b.TAX)), "~").alias("genres")),
    """SELECT album_key, array_to_string(list_sort(list_distinct(list(genre))), '~') AS genres
       FROM (SELECT * FROM plus UNION ALL SELECT album_key, parent FROM plus JOIN tax_parents ON child = genre) GROUP BY 1""",
    {"plus": "SELECT album_key, unnest(list_concat(genres, ['Synthpop', 'Americana'])) AS genre FROM part_albums"})

add("validate_categories",
    lambda s, d: gn.validate_lists(b.order_albums(s, d), "genres", b.TAX, "v").select(
        "album_key", F.array_join("v.valid", "~").alias("valid"), F.array_join("v.invalid", "~").alias("invalid")),
    """SELECT album_key, coalesce(string_agg(canonical, '~') FILTER (g IS NOT NULL AND ok), '') AS valid,
              coalesce(string_agg(g, '~') FILTER (g IS NOT NULL AND NOT ok), '') AS invalid
       FROM (SELECT album_key, CASE WHEN genre = '' THEN NULL ELSE genre END AS g FROM order_albums) a
       LEFT JOIN (SELECT raw, canonical, canonical IN (SELECT genre FROM tax_valid) AS ok FROM canon) c ON a.g = c.raw
       GROUP BY 1""", {**b.names_sql("order_albums", "genre")})

add("suggest_categories",
    lambda s, d: gn.suggestions(wanted(s, d), "raw", b.TAX).select("k", F.array_join("suggestions", "~").alias("s")),
    """SELECT k, coalesce(s, '') AS s FROM wanted LEFT JOIN (
           SELECT t.raw, string_agg(genre, '~' ORDER BY genre) AS s FROM (
               SELECT t.raw, v.genre FROM (SELECT DISTINCT raw FROM wanted) t JOIN tax_valid v
               ON contains(lower(v.genre), lower(t.raw))
               QUALIFY row_number() OVER (PARTITION BY t.raw ORDER BY v.genre) <= 5) t GROUP BY 1) x USING (raw)""",
    {**RAW, "wanted": """SELECT k, raw FROM instances UNION ALL
                         SELECT k, string_split(raw, ' ')[-1] FROM instances"""})


def wanted(s, d):
    """The categories of all orders, whole, and their last words."""
    own = instances(s, d)
    return own.unionByName(own.select("k", F.element_at(F.split("raw", " "), -1).alias("raw")))


def _edited():
    return b.TAX.with_mapping("Xyzzy Core", "Xyzzy").with_parents("Xyzzy", ["Experimental", "Noise Wall"])


def tax_sql(tax):
    """The tables of another taxonomy in place of the usual one."""
    return {"tax_map": b._values(list(tax.lookup.items()), "variant, canonical"),
            "tax_valid": b._values([(g,) for g in tax.valid], "genre"),
            "tax_parents": b._values([(c, p) for c, ps in tax.hierarchy.items() for p in ps], "child, parent")}


add("edited_taxonomy",
    lambda s, d: instances(s, d).where("raw <> ''").select(
        gx.normalize_list(F.array("raw"), _edited()).alias("l"), "raw").groupBy("raw", F.array_join("l", "~").alias(
            "genres")).agg(F.count(F.lit(1)).alias("n")),
    """SELECT i.raw, g AS genres, count(*) AS n
       FROM nonempty i LEFT JOIN (SELECT album_key, array_to_string(list_sort(list(genre)), '~') AS g
                                  FROM norm_list GROUP BY 1) l ON l.album_key = i.raw
       GROUP BY 1, 2""",
    {**RAW, "raw_lists": "SELECT DISTINCT raw AS album_key, [raw] AS genres FROM nonempty", **b.lists_sql("raw_lists"),
     **tax_sql(_edited())})


def nations(s, d):
    """A taxonomy that stays in tables: customers named after their nation, nations below regions and their alliance."""
    own = b.table(s, d, "customer").join(b.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        b.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    of_regions = own.select(F.initcap("n_name").alias("child"), F.initcap("r_name").alias("parent"))
    of_world = own.select(F.initcap("r_name").alias("child"), F.lit("World").alias("parent"))
    return TaxonomyTables(own.select(F.col("c_name").alias("variant"), F.initcap("n_name").alias("canonical")),
                          of_regions.unionByName(of_world))


def customer_lists(s, d):
    """Customers by the day of their orders, and the lower-case name of a supplier, which only holds no known name."""
    return b.table(s, d, "orders").join(b.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("o_orderdate").cast("date").alias("day")).agg(F.array_sort(F.collect_set("c_name")).alias("names"))  # one order, however often it is computed


NATIONS = {
    "people": f"""SELECT c_name, {b.title_sql('n_name')} AS nation, {b.title_sql('r_name')} AS region FROM customer
                  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
}
add("table_taxonomy_lists",
    lambda s, d: gn.normalize_lists(customer_lists(s, d), "names", nations(s, d)).select(
        F.col("day").cast("string").alias("day"), F.array_join("normalized", "~").alias("genres")),
    """SELECT CAST(day AS VARCHAR) AS day, array_to_string(list_sort(list(DISTINCT g)), '~') AS genres
       FROM (SELECT CAST(o_orderdate AS DATE) AS day, unnest([nation, region]) AS g
             FROM orders JOIN customer ON o_custkey = c_custkey JOIN people USING (c_name)) GROUP BY 1""", NATIONS)

add("table_taxonomy_below",
    lambda s, d: gn.descendants(s, nations(s, d)).select("ancestor", "descendant", "depth"),
    """SELECT DISTINCT region AS ancestor, nation AS descendant, CAST(1 AS INTEGER) AS depth FROM people
       UNION SELECT 'World', region, 1 FROM people UNION SELECT 'World', nation, 2 FROM people""", NATIONS)

add("source_genre_names",
    lambda s, d: instances(s, d).select(gx.source_genre_name("raw").alias("g")).groupBy("g").agg(
        F.count(F.lit(1)).alias("n")),
    f"""SELECT CASE t WHEN 'Hip-Hop' THEN 'Hip Hop' ELSE t END AS g, count(*) AS n
        FROM (SELECT {b.title_sql('trim(raw)')} AS t FROM instances) GROUP BY 1""", RAW)


def _tags(s, d):
    """What a user clicked as the tags of a release, all else as those of an artist; counts as text, some no numbers."""
    e = b.table(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    tag = F.struct(F.concat(F.lit("style "), (k % 30).cast("string")).alias("name"),
                   F.when(k % 11 == 0, "many").otherwise((k % 7).cast("string")).alias("count"))
    return e.groupBy("user_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("event_type") == "click", tag))).alias("release"),
        F.array_sort(F.collect_set(F.when(F.col("event_type") != "click", tag))).alias("artist"))


add("vote_filtered_tags",
    lambda s, d: _tags(s, d).select("user_id", F.array_join(gx.vote_filtered_tags("release", "artist"), "~").alias("kept")),
    """SELECT user_id, array_to_string(list_concat(rel, list_filter(art, lambda x, i: NOT list_contains(rel, x)
                                                                   AND list_position(art, x) = i))[1:10], '~') AS kept
       FROM (SELECT user_id,
                    list_transform(list_filter(release, lambda t: coalesce(try_cast(t.c AS INTEGER), 0) >= 2),
                                   lambda t: 'Style ' || t.n[7:]) AS rel,
                    list_transform(list_filter(artist, lambda t: coalesce(try_cast(t.c AS INTEGER), 0) >= 3),
                                   lambda t: 'Style ' || t.n[7:]) AS art
             FROM (SELECT user_id, coalesce(list_sort(list(DISTINCT tag) FILTER (click)), []) AS release,
                          coalesce(list_sort(list(DISTINCT tag) FILTER (NOT click)), []) AS artist
                   FROM (SELECT user_id, event_type = 'click' AS click,
                                {'n': 'style ' || (k % 30), 'c': CASE WHEN k % 11 = 0 THEN 'many' ELSE CAST(k % 7 AS VARCHAR)
                                 END} AS tag
                         FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
                   GROUP BY 1))""")

add("merge_preserving",
    lambda s, d: b.part_albums(s, d).select("album_key", F.array_join(gx.merge_preserving(
        "genres", F.array(F.lit("ROCK & ROLL"), F.lit("Jazz"), F.lit("r&b"), F.lit("jazz"))), "~").alias("merged")),
    """SELECT album_key, array_to_string(list_filter(g, lambda x, i: list_position(low, lower(x)) = i), '~') AS merged
       FROM (SELECT *, list_transform(g, lambda x: lower(x)) AS low
             FROM (SELECT album_key, list_concat(genres, ['ROCK & ROLL', 'Jazz', 'r&b', 'jazz']) AS g FROM part_albums))""")

MERGE = {
    **b.lists_sql("part_albums"),
    "own": "SELECT album_key, list_sort(list(genre)) AS g FROM norm_list GROUP BY 1",
    "both_lists": """SELECT album_key, list_concat(g, list_filter(['Electronic', 'House', 'Pop'],
                            lambda x: NOT list_contains(g, x))) AS g FROM own""",
    "spread": """SELECT album_key, list_concat(g, coalesce((SELECT list_sort(list(DISTINCT parent)) FROM tax_parents
                        WHERE list_contains(g, child) AND NOT list_contains(g, parent)), [])) AS g FROM both_lists""",
}
add("merge_for_update",
    lambda s, d: b.part_albums(s, d).select("album_key", F.array_join(gx.merge_for_update(
        "genres", F.array(F.lit("house"), F.lit("Pop Music")), b.TAX), "~").alias("merged")),
    "SELECT album_key, array_to_string(g, '~') AS merged FROM spread", MERGE)


def _diff(s, d):
    r = b.job_results(s, d).withColumn("k", F.col("created_at"))
    return r.select("album_key", "created_at", gx.list_diff("original_genres", "suggested_genres", "final_genres")
                    .alias("x"))


add("list_diff",
    lambda s, d: _diff(s, d).select(
        "album_key", F.date_format("created_at", "HH:mm:ss.SSSSSS").alias("at"),
        *[F.array_join(f"x.{c}", "~").alias(c) for c in ("added", "removed", "kept", "suggested_only")],
        F.col("x.has_changes").alias("has_changes")),
    """SELECT album_key, strftime(created_at, '%H:%M:%S.%f') AS at,
              CASE WHEN len(final_genres) > 1 THEN final_genres[2] ELSE '' END AS added, '' AS removed,
              original_genres[1] AS kept,
              array_to_string(list_sort(list_filter(suggested_genres, lambda x: NOT list_contains(
                  list_transform(final_genres, lambda y: lower(y)), lower(x)))), '~') AS suggested_only,
              len(final_genres) > 1 AS has_changes
       FROM job_results""")

BELOW = {
    "below": """SELECT lower(name) AS name FROM (
                    WITH RECURSIVE t AS (SELECT 'metal' AS name UNION SELECT child FROM tax_parents JOIN t
                                         ON lower(parent) = lower(name)) SELECT name FROM t)""",
    "listed": """SELECT album_key, genre AS g FROM known UNION ALL SELECT album_key, item FROM items""",
}
BELOW_SQL = "SELECT DISTINCT album_key FROM listed WHERE lower(g) IN (SELECT name FROM below)"
add("hierarchical_search",
    lambda s, d: gn.albums_with_category(b.part_albums(s, d), "metal", b.TAX).select("album_key"),
    BELOW_SQL, {**b.lists_sql("part_albums"), **BELOW})


def _deep():
    """A third and a fourth level below metal."""
    return b.TAX.with_parents("Rock & Roll", ["Black Metal"]).with_parents("Soul", ["Rock & Roll"])


add("hierarchical_search_levels",
    lambda s, d: gn.albums_with_category(b.part_albums(s, d), "metal", _deep()).select("album_key"),
    BELOW_SQL, {**b.lists_sql("part_albums"), **BELOW, **tax_sql(_deep())})

COUNTED = {
    **b.names_sql("pieces", "raw"),
    "pieces": "SELECT album_key, unnest(genres) AS raw FROM part_albums",
    "counted": """SELECT p.raw, canonical, count(*) AS n, canonical IN (SELECT genre FROM tax_valid) AS ok
                  FROM pieces p JOIN canon c ON p.raw = c.raw GROUP BY 1, 2""",
    "o_pieces": "SELECT album_key, genre AS o_raw FROM order_albums WHERE genre <> ''",
}
O_COUNTED = {
    **b.names_sql("pieces", "raw"),
    "pieces": "SELECT album_key, genre AS raw FROM order_albums WHERE genre <> ''",
    "counted": COUNTED["counted"],
}
add("unmapped_categories",
    lambda s, d: gn.unmapped_categories(b.order_albums(s, d), b.TAX),
    "SELECT raw, canonical, n FROM counted WHERE NOT ok", O_COUNTED)

add("category_variants",
    lambda s, d: gn.category_variants(b.order_albums(s, d), b.TAX),
    """SELECT canonical, raw AS variant, n, nv AS n_variants FROM counted JOIN (
           SELECT canonical AS c2, count(*) AS nv FROM counted GROUP BY 1 HAVING count(*) > 1) ON c2 = canonical""",
    O_COUNTED)

add("missing_parents",
    lambda s, d: gn.missing_parents(b.part_albums(s, d).withColumn("genres", F.transform(
        "genres", lambda g: F.when(g == "R&B", "Funk").when(g == "rock & roll", "Blues Rock").otherwise(g))), b.TAX)
    .select("album_key", F.array_join("missing", "~").alias("missing")),
    """SELECT album_key, string_agg(p, '~' ORDER BY i, p) AS missing
       FROM (SELECT album_key, CASE x WHEN 'R&B' THEN 1 ELSE 2 END AS i,
                    unnest(CASE x WHEN 'R&B' THEN ['R&B'] WHEN 'rock & roll' THEN ['Blues', 'Rock'] END) AS p
             FROM (SELECT album_key, unnest(genres) AS x FROM part_albums)) GROUP BY 1""")

add("consistency_statistics",
    lambda s, d: gn.consistency_statistics(b.order_albums(s, d), b.TAX).withColumn(
        "consistency_rate", F.round("consistency_rate", 6)),
    """SELECT CAST(sum(n) AS BIGINT) AS total_instances, count(*) AS unique_genres,
              CAST(sum(n) FILTER (ok) AS BIGINT) AS valid_instances,
              CAST(sum(n) FILTER (NOT ok) AS BIGINT) AS invalid_instances,
              round(sum(n) FILTER (ok) / sum(n) * 100, 6) AS consistency_rate FROM counted""", O_COUNTED)

add("normalize_names",
    lambda s, d: b.table(s, d, "pages").select("page_id", normalize_name(
        F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("name")),
    r"""SELECT page_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
              strip_accents(regexp_extract(html, '<title>([^<]*)</title>', 1)),
              '^(The|A|An)\s+', '', 'i'),
              '\s+\((Deluxe|Remastered|Expanded|Special|Extended|Bonus).*\)$', '', 'i'),
              '\s+\[(Deluxe|Remastered|Expanded|Special|Extended|Bonus).*\]$', '', 'i'),
              '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))) AS name FROM pages""")

add("normalize_documents",
    lambda s, d: b.table(s, d, "documents").select("doc_id", F.md5(normalize_name("text").cast("binary")).alias("h")),
    r"""SELECT doc_id, md5(lower(trim(regexp_replace(regexp_replace(regexp_replace(
              strip_accents(text), '^(The|A|An)\s+', '', 'i'), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))))
              AS h FROM documents""")
