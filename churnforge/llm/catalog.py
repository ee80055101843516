"""Registered queries of the operators: (spark, sf_dir) -> DataFrame, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from churnforge.llm import bpe, decontam, embdedup, extract, langid, licenses, lm, negatives, quality, ranked, simhash, substrings, urlfilter
from churnforge.llm.textbatch import held_out, materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole text and the bytes they decode to, as digests."""
    out = bpe.bpe_round_trip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text; learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_language_model(docs, ~held_out("doc_id"))
    return langid.identify_language(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    out = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text without the passages of 35 words that stand anywhere else."""
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, i, array_to_string(w[i:i + 34], ' ') AS body
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35) t
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY body) AS n FROM windows) t WHERE n > 1
), covered AS (
  SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM repeated) t
), gone AS (
  SELECT r, count(*) AS n_removed FROM covered GROUP BY r
), words AS (
  SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM docs
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS body FROM words ANTI JOIN covered USING (r, p) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text; learned from labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality_model(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    return quality.score_quality(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in an occurrence of a benchmark window, and the items they come from."""
    out = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


ASCII_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP7_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {ASCII_WORDS} AS w FROM documents
), items AS (
  SELECT item_id, {ASCII_WORDS} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, w[i:i + 9] AS win FROM (
    SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0) t
), places AS (
  SELECT r, i, n, w[i:i + n - 1] AS win FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
    FROM docs, (SELECT DISTINCT len(win) AS n FROM windows) l WHERE len(w) >= n) t
), hits AS (
  SELECT r, i, n, item_id FROM places JOIN windows USING (win)
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) t GROUP BY r
), listed AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
    SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) t GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN listed USING (r)
"""


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every whole text under a network trained on all of them."""
    docs = table(spark, sf_dir, "documents")
    counts = materialise(lm.count_words(docs, "text"))
    vocabulary = lm.fit_vocabulary(docs, "text", lm.LMConfig(), counts)
    coded = materialise(lm.code_texts(docs, vocabulary))
    model = lm.fit_language_scorer(docs, vocabulary=vocabulary, coded=coded)
    return lm.score_documents(docs, model, rest=lm.rest_words(counts, vocabulary), coded=coded)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    out = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                      F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"),
                      "score")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)


OP5_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, text, {ASCII_WORDS} AS w FROM documents
), phrases(phrase, label) AS (
  VALUES {_values(list(licenses.PHRASES.items()))}
), templates AS (
  SELECT label, list_distinct(string_split(notice, ' ')) AS t, CAST(ceil(len(string_split(notice, ' ')) / 0.8 - 1e-9) AS INTEGER) AS width
  FROM (VALUES {_values(list(licenses.TEMPLATES.items()))}) v(label, notice)
), places AS (
  SELECT r, i - 1 AS start, label
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs) d, phrases
  WHERE array_to_string(w[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase
), base AS (
  SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY r
), blocks AS (
  SELECT r, label, len(list_intersect(t, w[i:i + width - 1])) AS hit, len(t) AS n FROM (
    SELECT r, w, label, t, width, unnest(range(1, greatest(len(w) - width + 1, 1) + 1)) AS i FROM docs, templates) x
), met AS (
  SELECT r, label, max(hit / n) AS score FROM blocks WHERE hit >= ceil(n * 0.8) GROUP BY r, label
), labels AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM (SELECT r, label, score FROM met UNION ALL SELECT r, label, 1.0 FROM places) t GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN base USING (r) LEFT JOIN labels USING (r)
"""


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate components of all embeddings with equal labels."""
    return embdedup.embedding_links(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE vectors AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), good AS (
  SELECT r, vec_id, label, v FROM vectors
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT r AS a, r AS b FROM vectors UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), components AS (
  SELECT reach.a AS r, min(vec_id) AS component_id FROM reach JOIN vectors ON reach.b = vectors.r GROUP BY reach.a
), counts AS (
  SELECT a AS r, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM vectors JOIN components USING (r) LEFT JOIN counts USING (r)
"""


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, longest fitting rule and verdict of every page's url."""
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), urlfilter.rules_frame(spark, urlfilter.RULES))


OP9_SQL = f"""
WITH rests AS (
  SELECT row_number() OVER () AS r, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
), rules(h, p, v) AS (
  VALUES {_values(urlfilter.RULES)}
), best AS (
  SELECT r, arg_max(h || p, (len(h || p), len(h))) AS rule, arg_max(v, (len(h || p), len(h))) AS v
  FROM urls JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM urls LEFT JOIN best USING (r)
"""


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the wrapper of its host."""
    return extract.extract_text(table(spark, sf_dir, "pages"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor's positives among all embeddings."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(
        F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return negatives.mine_negatives(rows, F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.r AS a_row, a.vec_id AS anchor_id, a.label = b.label AS same, b.r AS b_row, b.vec_id,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT a_row, anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY a_row ORDER BY score DESC, vec_id NULLS LAST, b_row) AS place
  FROM scores WHERE same QUALIFY place <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (
         PARTITION BY p.a_row, place ORDER BY score DESC, vec_id NULLS LAST, b_row) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON p.a_row = s.a_row AND NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of every benchmark item."""
    return ranked.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {ASCII_WORDS} AS w FROM documents
), items AS (
  SELECT row_number() OVER () AS i, item_id, list_distinct({ASCII_WORDS}) AS terms FROM benchmark
), wanted AS (
  SELECT i, unnest(terms) AS term FROM items
), totals AS (
  SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS nw FROM docs WHERE len(w) > 0
), counts AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) t
  SEMI JOIN wanted USING (term) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * max(nd) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM counts, totals GROUP BY term
), impacts AS (
  SELECT r, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w) * nd) // nw))) AS impact
  FROM counts JOIN weights USING (term) JOIN docs USING (r), totals
), scores AS (
  SELECT i, r, CAST(sum(impact) AS BIGINT) AS score FROM wanted JOIN impacts USING (term) GROUP BY i, r HAVING sum(impact) > 0
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores JOIN items USING (i) JOIN docs USING (r) QUALIFY rank <= 10
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over documents."""
    return corpus_pipeline.run(spark, sf_dir)


REGISTRY = {
    "op1_byte_bpe": (op1_byte_bpe, None),
    "op2_language_id": (op2_language_id, None),
    "op3_substring_dedup": (op3_substring_dedup, OP3_SQL),
    "op4_lm_score": (op4_lm_score, None),
    "op5_license_scan": (op5_license_scan, OP5_SQL),
    "op6_quality": (op6_quality, None),
    "op7_decontamination": (op7_decontamination, OP7_SQL),
    "op8_embedding_dedup": (op8_embedding_dedup, OP8_SQL),
    "op9_url_filter": (op9_url_filter, OP9_SQL),
    "op10_simhash_dedup": (op10_simhash_dedup, None),
    "op11_html_extraction": (op11_html_extraction, None),
    "op12_hard_negatives": (op12_hard_negatives, OP12_SQL),
    "op13_ranked_search": (op13_ranked_search, OP13_SQL),
    "pipeline": (pipeline, corpus_pipeline.ORACLE_SQL),
}
