"""The corpus operators as queries over whole given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from listingflow.llm import (
    bpe,
    centroids,
    decontaminate,
    exact_dedup,
    language,
    lm_score,
    main_text,
    packing,
    phrases,
    pii,
    simhash,
    token_files,
    url_rules,
)
from listingflow.llm.common import table

QUERIES: dict[str, object] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
# The rules of the URL query, as (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query(
    r"""
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                      regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
    SELECT doc_id,
           first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS kept,
           sha256(t) AS text_sha256
    FROM d
    """
)
def op1_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf, "documents"))


@query(
    r"""
    WITH dw AS (SELECT doc_id, regexp_extract_all(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
         iw AS (SELECT item_id, regexp_extract_all(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
         g AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
               FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
         k AS (SELECT DISTINCT k FROM g),
         dg AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram
                FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, k WHERE len(w) >= k)),
         h AS (SELECT doc_id, i, dg.k AS k, item_id FROM dg JOIN g ON dg.k = g.k AND dg.gram = g.gram),
         c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
         t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
               FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
    SELECT dw.doc_id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM dw LEFT JOIN c ON dw.doc_id = c.doc_id LEFT JOIN t ON dw.doc_id = t.doc_id
    """
)
def op2_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.find_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"), n=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query()
def op3_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    return lm_score.score(table(spark, sf, "documents"))


@query()
def op4_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.encode_to_files(table(spark, sf, "documents"), TOKENIZER)


@query(
    rf"""
    WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
         p AS (SELECT page_id,
                      translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
         r AS (SELECT * FROM (VALUES {_RULES_SQL}) AS t(rh, rp, v)),
         f AS (SELECT page_id, rh || rp AS rule, v, row_number() OVER (
                      PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS n
               FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
    SELECT p.page_id AS page_id, host, path, rule, coalesce(v, 'allow') AS verdict
    FROM p LEFT JOIN f ON p.page_id = f.page_id AND n = 1
    """
)
def op5_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return url_rules.judge(pages, spark.createDataFrame(list(RULES), "host string, path string, verdict string"))


@query()
def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.find_near_copies(table(spark, sf, "documents"))


@query()
def op7_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf, "documents"), TOKENIZER)


@query()
def op8_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(table(spark, sf, "documents"))


@query()
def op9_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return main_text.extract_text(table(spark, sf, "pages"))


@query()
def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find(table(spark, sf, "documents"))


def _centroids_sql(rounds: int = 5) -> str:
    """Rounds written one after the other; vectors as one row a component."""

    def nearest(i: int) -> str:
        return f"""
    d{i} AS MATERIALIZED (SELECT r, min_by(c, (d, c)) AS c, min(d) AS d FROM (
            SELECT v.r AS r, m.c AS c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN m{i} AS m ON v.i = m.i GROUP BY v.r, m.c)
        GROUP BY r)"""

    def moved(i: int) -> str:
        return f"""
    m{i + 1} AS MATERIALIZED (SELECT m.c AS c, m.i AS i, coalesce(s.x, m.x) AS x FROM m{i} AS m LEFT JOIN (
            SELECT c, i, CAST((t - ((t % n) + n) % n) // n AS HUGEINT) AS x FROM (
                SELECT c, i, CAST(sum(x) AS HUGEINT) AS t, count(*) AS n FROM v JOIN d{i} ON v.r = d{i}.r GROUP BY c, i))
        AS s ON m.c = s.c AND m.i = s.i)"""

    steps = ",".join(f"{nearest(i)},{moved(i)}" for i in range(rounds))
    return f"""
    WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
            WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    v AS MATERIALIZED (SELECT r, i, CAST(floor(256 * CAST(embedding[i] AS DOUBLE)) AS HUGEINT) AS x
            FROM (SELECT r, embedding, unnest(range(1, 65)) AS i FROM k)),
    f AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), embedding) - 1 AS c FROM k),
    m0 AS MATERIALIZED (SELECT f.c AS c, v.i AS i, v.x AS x FROM f JOIN v ON f.r = v.r WHERE f.c < 40),{steps},{nearest(rounds)},
    h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS s FROM m{rounds} GROUP BY c)
    SELECT k.vec_id AS vec_id, CAST(d.c AS INTEGER) AS cluster, CAST(d.d AS BIGINT) AS distance,
           CAST(sum(d.d) OVER (PARTITION BY d.c) AS BIGINT) AS cluster_inertia,
           CAST(sum(d.d) OVER () AS BIGINT) AS inertia, h.s AS centroid_sha256
    FROM k JOIN d{rounds} AS d ON k.r = d.r JOIN h ON d.c = h.c
    """


@query(_centroids_sql())
def op11_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return centroids.describe(table(spark, sf, "embeddings"))


@query()
def op12_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.describe(table(spark, sf, "documents"), WORD_TOKENIZER)


@query(
    r"""
    WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
         t AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
         f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (
                SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
                    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k))
            GROUP BY lang, k, phrase HAVING count(*) >= 100),
         c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
         x AS (SELECT c.lang AS lang, c.phrase AS phrase, a, l.f AS l, r.f AS r, t.n AS n, cut,
                      (1000::HUGEINT * a::HUGEINT * t.n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
               FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) AS c
               JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ')
               JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:c.k], ' ')
               JOIN t ON t.lang = c.lang),
         s AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS first FROM x),
         g AS (SELECT lang, max(f) AS f, phrase FROM (
                SELECT lang, f, unnest([array_to_string(w[i:i + j - 1], ' ') for i in range(1, k - j + 2)]) AS phrase FROM (
                    SELECT lang, k, w, a AS f, unnest(range(2, k)) AS j FROM c WHERE k > 2)) GROUP BY lang, phrase),
         o AS (SELECT s.* FROM s LEFT JOIN g ON s.lang = g.lang AND s.phrase = g.phrase
               WHERE first = 1 AND (g.f IS NULL OR 100 * g.f < 100 * a)),
         q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM o)
    SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM q WHERE rank <= 2000
    """
)
def op13_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)
