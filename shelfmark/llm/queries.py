"""Registered queries of this subpackage: each applies one operator to its whole table, with SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import (
    centroids,
    decontaminate,
    divergence,
    language_gru,
    packing,
    pii_crf,
    quality_pu,
    quality_rules,
    quote_chat,
    secrets_guess,
    simhash_dedup,
    toxicity_ftrl,
    url_filter,
)
from shelfmark.llm.common import prepare, table
from shelfmark.session import materialize

Query = Callable[[SparkSession, str], DataFrame]


def _listed(spans: str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, kinds), F.sha2(_listed("base"), 256).alias("base_sha256"),
                        _listed("spans").alias("spans"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_pu.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_quote_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quote_chat.format_chat(table(spark, sf_dir, "conversations"))


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op6 over the conversations with their replies quoted, wrapped, nested and cropped."""
    prepare(spark)
    # format_chat reads its messages several times: the replies are joined together once
    return quote_chat.format_chat(materialize(quote_chat.quoting(table(spark, sf_dir, "conversations")), "replies"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _digest(pii_crf.find(table(spark, sf_dir, "documents")), pii_crf.KINDS)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity_ftrl.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _digest(secrets_guess.find(table(spark, sf_dir, "documents")), secrets_guess.KINDS[:3])


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return language_gru.predict(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return divergence.diverging(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return centroids.inertia(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


_WORD_SQL = r"[^\x20\x09-\x0D]+"
_STOP_SQL = ", ".join("'" + w + "'" for s in quality_rules.STOP_WORDS for w in (s, s.title()))

OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
ws AS (SELECT rid, regexp_extract_all(t, '{_WORD_SQL}') AS ws FROM d),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM ws),
per AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars,
               count(*) FILTER (w IN ({_STOP_SQL})) AS stops FROM w GROUP BY rid),
g AS (SELECT rid, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' '
             || lead(w, 4) OVER o AS s FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM g WHERE s IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, s) > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, range(0, 5) AS x(k) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dups FROM l
       WHERE regexp_matches(line, '{_WORD_SQL}') GROUP BY rid),
m AS (SELECT d.doc_id, coalesce(per.n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             coalesce(stops, 0) AS stops, coalesce(n_lines, 0) AS n_lines
      FROM d LEFT JOIN per USING (rid) LEFT JOIN ln USING (rid) LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2 AND 20 AND n_symbols / n_words <= 0.3::DOUBLE
       AND (stops + 1) / n_words >= 0.02::DOUBLE AND n_dup_lines / n_lines <= 0.4::DOUBLE
       AND n_words / n_lines >= 1.5::DOUBLE AS kept
FROM b
"""

_OP6_SOURCE = "SELECT conv_id, turn, role, text FROM conversations"

_OP6_QUOTING = r"""SELECT conv_id, turn, role, array_to_string(list_concat(
    ['> > ' || array_to_string(two[i * 9 + 1:i * 9 + 9], ' ') for i in range(0, (len(two) + 8) // 9)],
    ['> ' || array_to_string(one[i * 9 + 1:i * 9 + 9], ' ') for i in range(0, (len(one) + 8) // 9)], [t]), chr(10)) AS text
  FROM (SELECT a.conv_id, a.turn, a.role, a.t, coalesce(b.ws, []) AS two, CASE WHEN o.ws IS NULL THEN []
          WHEN a.turn % 3 = 0 AND len(o.ws) > 0 THEN o.ws[:len(o.ws) - 1] ELSE o.ws END AS one
        FROM (SELECT *, CASE WHEN x >= 1 THEN greatest(x - 1 - x % 2, 0) END AS y FROM
              (SELECT conv_id, turn, role, coalesce(text, '') AS t,
                 CASE WHEN turn >= 1 THEN greatest(turn - 1 - turn % 2, 0) END AS x FROM conversations)) a
        LEFT JOIN k o ON a.conv_id = o.conv_id AND a.x = o.turn LEFT JOIN k b ON a.conv_id = b.conv_id AND a.y = b.turn)"""

_OP6_SQL = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, [w for w in string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+') if w <> ''] AS ws
                     FROM conversations),
src AS ({source}),
m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS t FROM src),
raw AS (SELECT rid, conv_id, turn, unnest(string_split(t, chr(10))) AS line,
               generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM m),
l AS (SELECT *, regexp_extract(line, '^(?:[ \t]*>)+') AS marker FROM raw),
n AS (SELECT rid, conv_id, turn, pos, length(regexp_replace(marker, '[^>]', '', 'g')) AS level,
        [w for w in string_split_regex(lower(line[length(marker) + 1:]), '[ \t\n\x0B\f\r]+') if w <> ''] AS ws FROM l),
s AS (SELECT *, level IS DISTINCT FROM lag(level) OVER (PARTITION BY rid ORDER BY pos) AS new FROM n),
r AS (SELECT *, sum(new::INT) OVER (PARTITION BY rid ORDER BY pos) AS run FROM s),
ps AS (SELECT conv_id, turn, level, flatten(array_agg(ws ORDER BY pos)) AS ws FROM r GROUP BY rid, conv_id, turn, level, run
       UNION ALL SELECT conv_id, turn, level, ws FROM n WHERE level = 0 AND len(ws) < 5),
pg AS (SELECT DISTINCT conv_id, turn, level, array_to_string(ws, ' ') AS passage, unnest(CASE WHEN len(ws) < 5
         THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] END) AS gram
       FROM ps WHERE len(ws) > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL),
wrote AS (SELECT DISTINCT conv_id, turn, gram FROM pg WHERE level = 0),
asked AS (SELECT *, count(*) OVER (PARTITION BY conv_id, turn, level, passage) AS n_grams FROM pg WHERE level > 0),
pt AS (SELECT a.conv_id, a.turn, level, passage, w.turn AS origin FROM asked a ASOF JOIN wrote w
       ON a.conv_id = w.conv_id AND a.gram = w.gram AND a.turn > w.turn),
best AS (SELECT conv_id, turn, level, passage, first(origin ORDER BY c DESC, origin DESC) AS origin FROM
         (SELECT conv_id, turn, level, passage, origin, count(*) AS c FROM pt GROUP BY ALL) GROUP BY ALL),
held AS (SELECT a.conv_id, a.turn, a.level, a.passage, a.n_grams, b.origin, count(*) AS c FROM asked a JOIN best b
         ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.level = b.level AND a.passage = b.passage
         JOIN wrote w ON w.conv_id = a.conv_id AND w.gram = a.gram AND w.turn = b.origin GROUP BY ALL),
v AS (SELECT conv_id, turn, level, origin, sum(c) AS c, count(*) AS n FROM held WHERE c * 5 >= n_grams * 4 GROUP BY ALL),
p AS (SELECT conv_id, turn, first(origin ORDER BY level, c DESC, origin DESC) AS reply_to, sum(n) AS n_linked FROM v GROUP BY ALL),
up AS (SELECT conv_id, turn, reply_to AS root, 1 AS depth FROM p
       UNION ALL SELECT up.conv_id, up.turn, p.reply_to, depth + 1 FROM up JOIN p
       ON up.conv_id = p.conv_id AND up.root = p.turn),
top AS (SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM up GROUP BY ALL),
own AS (SELECT rid, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (marker = ''), ''),
               '^\n+|\n+$', '', 'g') AS text, count(*) FILTER (marker <> '') AS n_quoted FROM l GROUP BY rid)
SELECT m.conv_id, m.turn, m.role, own.text, p.reply_to, coalesce(top.root, m.turn) AS thread,
       coalesce(top.depth, 0)::BIGINT AS depth, n_quoted::BIGINT AS n_quoted,
       coalesce(n_linked, 0)::BIGINT AS n_linked, '<|' || coalesce(m.role, '') || '|>' || chr(10) || own.text AS chat
FROM m JOIN own USING (rid) LEFT JOIN p ON m.conv_id = p.conv_id AND m.turn = p.turn
LEFT JOIN top ON m.conv_id = top.conv_id AND m.turn = top.turn
"""

OP6_SQL = _OP6_SQL.replace("{source}", _OP6_SOURCE)
QUOTED_SQL = _OP6_SQL.replace("{source}", _OP6_QUOTING)

OP2_SQL = r"""
WITH b AS (SELECT iid, item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, least(len(ws), 13) AS span
           FROM (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark)),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
      FROM (SELECT rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d)),
bg AS (SELECT item_id, span, array_agg(w) OVER (PARTITION BY iid ORDER BY i
              ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)[:span] AS g FROM b),
spans AS (SELECT DISTINCT span FROM b),
dg AS (SELECT rid, i, span, array_agg(w) OVER (PARTITION BY rid, span ORDER BY i
              ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)[:span] AS g FROM w, spans),
hit AS (SELECT rid, i, dg.span, item_id FROM dg JOIN (SELECT DISTINCT * FROM bg WHERE len(g) = span) bg
        ON dg.span = bg.span AND dg.g = bg.g),
per AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT rid, i, span FROM hit), range(0, 13) AS x(k)
        WHERE k < span GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id::VARCHAR) AS n_items,
               string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY rid),
n AS (SELECT rid, count(*) AS n_words FROM w GROUP BY rid),
r AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
             coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256
      FROM d LEFT JOIN n USING (rid) LEFT JOIN per USING (rid) LEFT JOIN its USING (rid))
SELECT *, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM r
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 10),
l AS (SELECT lang, sum(n) AS total, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gt AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g
       LEFT JOIN (SELECT c.* FROM c SEMI JOIN k USING (lang, term)) c USING (lang, source) GROUP BY ALL),
s AS (SELECT gt.lang, gt.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gt.total + 2 * l.v) AS p,
             1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
      FROM gt JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
         FROM s a JOIN s b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
          FROM s WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
      FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""


def _op13_sql(rounds: int = centroids.ROUNDS, clusters: int = centroids.CLUSTERS) -> str:
    """Lloyd's rounds by comparing every vector with every centroid, one set of tables a round."""
    steps = ["""v AS (SELECT row_number() OVER () AS rid, vec_id,
      [floor(64.0::DOUBLE * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
      WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64)""",
             f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS k, v FROM v
       QUALIFY k < {clusters})"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS (SELECT rid, vec_id, v.v, k,
       list_sum([(v.v[i] - c{n}.v[i]) * (v.v[i] - c{n}.v[i]) for i in range(1, 65)])::BIGINT AS d FROM v, c{n}
       QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1)""")
        if n < rounds:
            steps.append(f"""m{n} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x,
       generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY ALL)""")
            steps.append(f"""c{n + 1} AS (SELECT c{n}.k, coalesce(m.v, c{n}.v) AS v FROM c{n} LEFT JOIN (SELECT k,
       array_agg(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM m{n} GROUP BY k) m USING (k))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia,
       sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)"""


OP13_SQL = _op13_sql()

QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_quality": (op1_quality, None),
    "op2_decontamination": (op2_decontamination, OP2_SQL),
    "op3_simhash": (op3_simhash, None),
    "op4_packing": (op4_packing, None),
    "op5_quality_rules": (op5_quality_rules, OP5_SQL),
    "op6_quote_chat": (op6_quote_chat, OP6_SQL),
    "quoted_conversations": (quoted_conversations, QUOTED_SQL),
    "op7_pii": (op7_pii, None),
    "op8_url_filter": (op8_url_filter, None),
    "op9_toxicity": (op9_toxicity, None),
    "op10_secrets": (op10_secrets, None),
    "op11_language": (op11_language, None),
    "op12_divergence": (op12_divergence, OP12_SQL),
    "op13_centroids": (op13_centroids, OP13_SQL),
    "pipeline": (pipeline, None),
}
