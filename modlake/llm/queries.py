"""The queries of this subpackage over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, lines, minhash, packing, phrases, pieces, pii, quality, search, substrings, tokens, urls, vectors


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"), 512)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_template_lines(spark, _table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, _table(spark, sf_dir, "documents"), _path("word_bpe_49k.json"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(spark, _table(spark, sf_dir, "pages"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode_pieces(_table(spark, sf_dir, "documents"), _path("piece_bpe_32k.model"))
    n_spans = (F.octet_length("spans") / 8).cast("long")
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), n_spans.alias("n_spans"), F.sha2("spans", 256).alias("spans_sha256"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link_vectors(spark, _table(spark, sf_dir, "embeddings"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_digests(spark, _table(spark, sf_dir, "documents"), stored=True)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return search.search(spark, docs, docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_spans(spark, _table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)), F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(spark, _table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode_vectors(spark, _table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_line_dedup, op3_best_fit_packing, op4_url_filter, op5_pieces, op6_embedding_near_dedup, op7_minhash_near_dedup, op8_substring_dedup, op9_quality_classifier, op10_top_k_search, op11_personal_data, op12_phrase_mining, op13_vector_codes)
}

def _codes_sql(rounds: int) -> str:
    """Lloyd's rounds of op13 one after another: a{n} assigns to the entries b{n - 1}, b{n} holds the means."""
    sql = """
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (SELECT vec_id, p, x[p * (len(x) // 4) + 1 : (p + 1) * (len(x) // 4)] AS x FROM v, range(4) r(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM s QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 256)
"""
    for n in range(1, rounds + 2):
        sql += f"""
, a{n} AS (
  SELECT vec_id, p, any_value(x) AS x, min({{'d': d, 'e': e}}) AS best FROM (
    SELECT s.vec_id, s.p, s.x, b.e, list_inner_product(s.x, s.x) - 2 * list_inner_product(s.x, b.x) + list_inner_product(b.x, b.x) AS d FROM s JOIN b{n - 1} b ON b.p = s.p
  ) GROUP BY vec_id, p
)"""
        if n <= rounds:
            sql += f"""
, m{n} AS (
  SELECT p, e, list(mean ORDER BY k) AS x FROM (
    SELECT p, e, k, floor(sum(c) / count(*)) AS mean FROM (SELECT p, best.e AS e, unnest(x) AS c, unnest(range(len(x))) AS k FROM a{n}) GROUP BY p, e, k
  ) GROUP BY p, e
), b{n} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{n - 1} b LEFT JOIN m{n} m ON m.p = b.p AND m.e = b.e)"""
    return sql + f"""
, h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda c: c::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS h FROM b{rounds}),
c AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds + 1} GROUP BY vec_id),
l AS (SELECT label, sum(error)::BIGINT AS label_error FROM c JOIN v USING (vec_id) GROUP BY label)
SELECT c.vec_id, c.code, c.error, l.label_error, h.h AS codebooks_sha256 FROM c JOIN v USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM v.label CROSS JOIN h
"""


ORACLES: dict[str, str] = {
    "op12_phrase_mining": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM w, range(1, 6) s(size)),
f AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*)::HUGEINT AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (
  SELECT lang, size, phrase, f, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS le, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS ri
  FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1)
), s AS (
  SELECT c.lang, c.size, c.phrase, c.f AS a, c.k, x.f AS l, y.f AS r, n.n, (1000 * c.f * n.n) // (x.f * y.f) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = c.le JOIN f y ON y.lang = c.lang AND y.phrase = c.ri JOIN n ON n.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s
  WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = s.lang AND f.size > s.size AND contains(' ' || f.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * f.f >= 100 * s.a)
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
""",
    "op13_vector_codes": _codes_sql(codes.ROUNDS),
    "op10_top_k_search": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), n AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM w),
p AS (SELECT doc_id, t, count(*)::DOUBLE AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w)::DOUBLE AS dl, unnest(w) AS t FROM w) GROUP BY doc_id, t),
f AS (SELECT t, count(*)::DOUBLE AS df FROM p GROUP BY t),
s AS (
  SELECT q.doc_id AS query_id, p.doc_id, round(sum(ln(1 + (n.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / n.mean))), 6) AS score
  FROM p q JOIN f USING (t) JOIN p ON p.t = q.t CROSS JOIN n WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, p.doc_id
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10
""",
    "op8_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
k AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM s),
f AS (SELECT g, min(doc_id) AS first FROM k GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT k.doc_id, unnest(range(k.i, k.i + 13)) AS i FROM k JOIN f USING (g) WHERE f.first < k.doc_id),
gone AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
""",
}
