"""Registered queries of the numbered operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.llm import fertility, filteraudit, jaccard, linededup, packing, pii, piece_codec, quality, secrets, substrings, toxicity, vectorcodes, vptree
from leadweave.llm.tables import read

#: Folder of the public vocabularies where the package that holds them is missing, and the key of surrogates where the session has none.
TOKENIZERS = "/opt/tokenizers"
SURROGATE_KEY = "change-me"


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


def surrogate_key(spark: SparkSession) -> str:
    """The secret of surrogates; a deployment sets spark.leadweave.surrogateKey."""
    return spark.conf.get("spark.leadweave.surrogateKey", SURROGATE_KEY)


def _host() -> Column:
    return F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark))


def op3_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.measure(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op5_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(read(spark, sf_dir, "embeddings"))


def op6_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the lines of their markup that their host repeats dropped; block tags end a line; null markup is empty."""
    pages = read(spark, sf_dir, "pages")
    split = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?i)(</(?:p|div|li|ul|nav|footer|article|h[1-6]|title|head|style|script|table|tr)>|<br\s*/?>|-->)", "$1\n")
    return linededup.drop_site_lines(pages.withColumn("html", split), _host(), "html", removed_col="n_removed").select("page_id", "n_removed", F.sha2("html", 256).alias("html_sha256"))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_decode(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.shingle_components(read(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(read(spark, sf_dir, "embeddings")).drop("label")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.drop_repeated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_secret_scan, op2_pii_surrogates, op3_tokeniser_fertility, op4_quality, op5_vantage_point_search, op6_site_lines, op7_piece_codec, op8_best_fit_packing, op9_toxicity, op10_shingle_join, op11_vector_codes, op12_substring_dedup, op13_filter_audit, pipeline)
}  # fmt: skip

_SHINGLES = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM base
), sizes AS (
  SELECT base.doc_id, count(s) AS n FROM base LEFT JOIN sets USING (doc_id) GROUP BY 1
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links), walk AS (
  SELECT doc_id, doc_id AS c FROM sizes UNION SELECT edges.b, walk.c FROM walk JOIN edges ON edges.a = walk.doc_id
)
SELECT doc_id, n AS n_shingles, min(c) AS component_id FROM sizes JOIN walk USING (doc_id) GROUP BY 1, 2
"""

_VECTORS = """
WITH fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), far AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_distance(q.v, c.v) AS score FROM fine q JOIN fine c ON q.vec_id <> c.vec_id AND q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM far
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""

_SITE_LINES = r"""
WITH base AS (
  SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host,
    string_split(regexp_replace(coalesce(html, ''), '(</(?:p|div|li|ul|nav|footer|article|h[1-6]|title|head|style|script|table|tr)>|<br\s*/?>|-->)', '\1' || chr(10), 'gi'), chr(10)) AS ls FROM pages
), flat AS (SELECT page_id, host, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM base),
often AS (
  SELECT host, trim(l) AS l FROM flat JOIN (SELECT host, count(*) AS pages FROM base GROUP BY 1) USING (host) WHERE length(trim(l)) >= 1
  GROUP BY host, trim(l), pages HAVING count(DISTINCT page_id) >= 2 AND count(DISTINCT page_id) > 0.2 * pages
)
SELECT page_id, count(o.l) AS n_removed, sha256(coalesce(string_agg(flat.l, chr(10) ORDER BY i) FILTER (o.l IS NULL), '')) AS html_sha256
FROM flat LEFT JOIN often o ON o.host = flat.host AND o.l = trim(flat.l) GROUP BY page_id
"""

_CODES = r"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS (
  SELECT vec_id, p, v[4 * p + 1] AS x0, v[4 * p + 2] AS x1, v[4 * p + 3] AS x2, v[4 * p + 4] AS x3 FROM kept, range(16) t(p)
), b0 AS (
  SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, x0 AS y0, x1 AS y1, x2 AS y2, x3 AS y3 FROM cut WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)
), a0 AS (
  SELECT vec_id, p, any_value(x0) AS x0, any_value(x1) AS x1, any_value(x2) AS x2, any_value(x3) AS x3,
    min(((x0 - y0) * (x0 - y0) + (x1 - y1) * (x1 - y1) + (x2 - y2) * (x2 - y2) + (x3 - y3) * (x3 - y3)) * 64 + e) AS m FROM cut JOIN b0 USING (p) GROUP BY vec_id, p
), m0 AS (
  SELECT p, m % 64 AS e, floor(sum(x0) / count(*)) AS z0, floor(sum(x1) / count(*)) AS z1, floor(sum(x2) / count(*)) AS z2, floor(sum(x3) / count(*)) AS z3 FROM a0 GROUP BY ALL
), b1 AS (
  SELECT p, e, CAST(coalesce(z0, y0) AS BIGINT) AS y0, CAST(coalesce(z1, y1) AS BIGINT) AS y1, CAST(coalesce(z2, y2) AS BIGINT) AS y2, CAST(coalesce(z3, y3) AS BIGINT) AS y3 FROM b0 LEFT JOIN m0 USING (p, e)
), a1 AS (
  SELECT vec_id, p, any_value(x0) AS x0, any_value(x1) AS x1, any_value(x2) AS x2, any_value(x3) AS x3,
    min(((x0 - y0) * (x0 - y0) + (x1 - y1) * (x1 - y1) + (x2 - y2) * (x2 - y2) + (x3 - y3) * (x3 - y3)) * 64 + e) AS m FROM cut JOIN b1 USING (p) GROUP BY vec_id, p
), m1 AS (
  SELECT p, m % 64 AS e, floor(sum(x0) / count(*)) AS z0, floor(sum(x1) / count(*)) AS z1, floor(sum(x2) / count(*)) AS z2, floor(sum(x3) / count(*)) AS z3 FROM a1 GROUP BY ALL
), b2 AS (
  SELECT p, e, CAST(coalesce(z0, y0) AS BIGINT) AS y0, CAST(coalesce(z1, y1) AS BIGINT) AS y1, CAST(coalesce(z2, y2) AS BIGINT) AS y2, CAST(coalesce(z3, y3) AS BIGINT) AS y3 FROM b1 LEFT JOIN m1 USING (p, e)
), a2 AS (
  SELECT vec_id, p, min(((x0 - y0) * (x0 - y0) + (x1 - y1) * (x1 - y1) + (x2 - y2) * (x2 - y2) + (x3 - y3) * (x3 - y3)) * 64 + e) AS m FROM cut JOIN b2 USING (p) GROUP BY vec_id, p
), coded AS (
  SELECT vec_id, string_agg(lpad(printf('%x', m % 64), 2, '0'), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id
), named AS (SELECT coded.*, label FROM coded JOIN kept USING (vec_id)),
totals AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM named GROUP BY label),
books AS (SELECT sha256(string_agg(y0 || ',' || y1 || ',' || y2 || ',' || y3, ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM named JOIN totals ON named.label IS NOT DISTINCT FROM totals.label, books
"""

_SUBSTRINGS = r"""
WITH base AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-]+'), lambda w: w <> '') AS w FROM documents
), flat AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM base),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM base)),
twice AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
starts AS (SELECT doc_id, i, true AS hit FROM windows SEMI JOIN twice USING (s)),
covered AS (SELECT flat.doc_id, flat.i, word, max(hit) OVER (PARTITION BY flat.doc_id ORDER BY flat.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM flat LEFT JOIN starts USING (doc_id, i))
SELECT doc_id, count(word) AS n_words, count(word) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone IS NULL), '')) AS kept_sha256
FROM base LEFT JOIN covered USING (doc_id) GROUP BY doc_id
"""

_AUDIT = r"""
WITH base AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-]+'), lambda w: w <> '') AS w FROM documents
), said AS (
  SELECT part, CAST(coalesce(quality = 1, false) AS INTEGER) AS good, CAST(coalesce(toxic = 1, false) AS INTEGER) AS toxic,
    [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS f
  FROM base LEFT JOIN labels USING (doc_id)
), letters AS (SELECT unnest(range(1, 6)) AS k), orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), steps AS (SELECT o, s, o[s] AS mine FROM orders, range(1, 6) t(s)),
each AS (
  SELECT part, o, s, mine, good, toxic, f[mine] AS fails, len(list_filter(o[1:s - 1], lambda k: f[k])) > 0 AS earlier, len(list_filter(f, lambda x: x)) AS failed FROM said, steps
), counted AS (
  SELECT part, o, s, mine, count(*) FILTER (NOT fails AND NOT earlier) AS kept, count(*) FILTER (fails AND NOT earlier) AS removed, count(*) FILTER (fails AND earlier) AS redundant,
    count(*) FILTER (fails AND failed = 1) AS unique_fails, count(*) FILTER (fails AND NOT earlier AND good = 1) AS good_lost, count(*) FILTER (fails AND NOT earlier AND toxic = 1) AS toxic_lost
  FROM each GROUP BY ALL
)
SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, CAST(s AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, mine) AS BIGINT) AS shapley FROM counted
"""

ORACLE_SQL = {"op11_vector_codes": _CODES, "op12_substring_dedup": _SUBSTRINGS, "op13_filter_audit": _AUDIT, "op10_shingle_join": _SHINGLES, "op5_vantage_point_search": _VECTORS, "op6_site_lines": _SITE_LINES}
