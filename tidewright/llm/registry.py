"""The operators' queries over the whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import embedding_dedup, exact_dedup, html_extraction, language_model, lexical_search, mixing, ngram_join, quality, secret_scan, sentencepieces, source_audit, toxicity, url_filter
from tidewright.llm.common import stash


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"), n=3, num=90, den=100).drop("_hash")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "expected_severity", "grade", "toxic")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mixing.mix(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "n_shards")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_links(read(spark, sf_dir, "embeddings"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(read(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.digest(secret_scan.scan(docs, secret_scan.train(docs)))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and their decoding, as counts and hashes."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sentencepieces.encode(docs, decoded_col="decoded")
    return rows.select(
        "doc_id",
        F.size("pieces").cast("long").alias("n_pieces"),
        F.xxhash64("pieces").alias("pieces_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = stash(quality.measure(read(spark, sf_dir, "documents").select("doc_id", "text")))
    held_out = fold(F.col("doc_id"), 5) == 0
    model = quality.train(measured.where(~held_out), read(spark, sf_dir, "labels"))
    return quality.score(measured, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"), keep="max")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_extraction.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_language_model": op6_language_model,
    "op7_secret_scan": op7_secret_scan,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality": op9_quality,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_html_extraction": op11_html_extraction,
    "op12_lexical_search": op12_lexical_search,
    "op13_source_audit": op13_source_audit,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op4_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_sum([x * x FOR x IN e])) AS n FROM v WHERE label IS NOT NULL AND list_count(e) = len(e) AND len([x FOR x IN e IF isnan(x) OR isinf(x)]) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
c(r, z) AS (SELECT vec_id, vec_id FROM v UNION SELECT c.r, l.b FROM c JOIN l ON c.z = l.a),
m AS (SELECT r AS vec_id, min(z) AS component_id FROM c GROUP BY r), k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN k USING (vec_id)""",
    "op1_ngram_join": f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [list_aggregate(w, 'string_agg', ' ')]
  ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM w),
n AS (SELECT r, doc_id, len(s) AS n, list_aggregate(list_sort(s), 'string_agg', chr(10)) AS k FROM s),
g AS (SELECT k, any_value(n) AS n, min(r) AS r, count(*) AS rows FROM n WHERE n > 0 GROUP BY k),
t AS (SELECT g.r, g.n, unnest(s.s) AS x FROM g JOIN s USING (r)),
e AS (SELECT a.r AS a, b.r AS b FROM t AS a JOIN t AS b USING (x) WHERE a.r <> b.r AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
c(r, z) AS (SELECT r, r FROM g UNION SELECT c.r, e.b FROM c JOIN e ON c.z = e.a),
m AS (SELECT c.r, min(n.doc_id) AS component_id FROM c JOIN g ON c.z = g.r JOIN n ON n.k = g.k AND n.n > 0 GROUP BY c.r),
p AS (SELECT e.a AS r, sum(g.rows) AS others FROM e JOIN g ON e.b = g.r GROUP BY e.a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(m.component_id, n.doc_id) AS component_id, CAST(coalesce(p.others, 0) + coalesce(g.rows - 1, 0) AS BIGINT) AS n_links
FROM n LEFT JOIN g ON g.k = n.k AND n.n > 0 LEFT JOIN m ON m.r = g.r LEFT JOIN p ON p.r = g.r""",
    "op5_url_filter": f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
t AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(h, f, v)),
m AS (SELECT page_id, arg_max(h || f, length(h || f)) AS rule, arg_max(v, length(h || f)) AS v FROM p JOIN t ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN regexp_matches(host, '(^|\\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\\.') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m USING (page_id)""",
    "op10_exact_dedup": f"""
WITH n AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""",
    # What the article of these pages holds; the operator itself does not ask for an element of that name.
    "op11_html_extraction": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS a FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(regexp_replace(a, '</?b>', '', 'g'), '</?(h1|p)>'),
  lambda x: trim(regexp_replace(replace(regexp_replace(replace(x, '<br>', ' '), '&quot;?', '"', 'g'), '&amp;', '&'), '\s+', ' ', 'g'))) AS b FROM a),
t AS (SELECT page_id, url, coalesce(list_aggregate(list_filter(b, lambda x: x <> ''), 'string_agg', chr(10)), '') AS text FROM b)
SELECT page_id, url, regexp_replace(text, '&amp(\n|$)', '&\1', 'g') AS text, CAST(length(regexp_replace(text, '&amp(\n|$)', '&\1', 'g')) AS BIGINT) AS n_chars FROM t""",
    "op12_lexical_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
i AS (SELECT row_number() OVER () AS k, item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS x FROM benchmark),
q AS (SELECT k, item_id, x, count(*) AS times FROM i GROUP BY ALL),
p AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS x FROM d), f AS (SELECT r, doc_id, n, x, count(*) AS tf FROM p GROUP BY ALL),
w AS (SELECT x, CAST(floor(1000 * ln(((SELECT 2 * n + 2 FROM s))::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM f GROUP BY x),
c AS (SELECT q.k, q.item_id, f.r, f.doc_id, sum(q.times * w.w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * f.n * s.n) // s.l)))))::BIGINT AS score FROM q JOIN f USING (x) JOIN w USING (x), s GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 20""",
    "op13_source_audit": f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d), o AS (SELECT r, lang, source, unnest(t) AS x FROM d),
k AS (SELECT lang, x FROM o GROUP BY lang, x HAVING count(DISTINCT r) >= 30), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, x, count(*) AS c FROM o JOIN k USING (lang, x) GROUP BY ALL),
n AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
ln AS (SELECT lang, sum(n)::HUGEINT AS n FROM n GROUP BY lang),
p AS (SELECT g.lang, g.source, k.x, coalesce(c.c, 0) AS c, (1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (n.n + 5 * v.v))::BIGINT AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, x)),
q AS (SELECT lang, x, (1 + (1000000000::HUGEINT * (t.c + 5)) // (ln.n + 5 * v.v))::BIGINT AS q FROM (SELECT lang, x, sum(c)::HUGEINT AS c FROM c GROUP BY ALL) AS t JOIN ln USING (lang) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.x = b.x AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.x, p.p - q.q FROM p JOIN q USING (lang, x) WHERE p.c > 0 AND p.p > q.q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM u)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM z WHERE part = 'pair' OR rank <= 50""",
}
