"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, language_mixture, line_dedup, minhash_dedup, packing, quality_knn, quality_rules, sentencepiece_viterbi, substring_dedup, toxicity_cnn
from .tables import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text: how many, their checksum, and whether decoding gives the text back."""
    return sentencepiece_viterbi.encode(table(spark, sf_dir, "documents"), keep_ids=False)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the line numbers that fuzzy line dedup removes."""
    return line_dedup.summary(table(spark, sf_dir, "documents"))


def op3_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_knn.classify(docs, quality_knn.fit(docs, table(spark, sf_dir, "labels")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links(table(spark, sf_dir, "embeddings"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.components(table(spark, sf_dir, "documents"), width=2, percent=80)


def op8_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_cnn.classify(docs, toxicity_cnn.fit(docs, table(spark, sf_dir, "labels")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_mixture.identify(docs, language_mixture.fit(docs))


QUERIES = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_line_dedup, op3_quality_knn, op4_quality_rules, op5_substring_dedup, op6_embedding_dedup, op7_minhash_dedup, op8_toxicity_cnn, op9_best_fit_packing, op10_language_mixture)
}
#: Exact windows by grouping them all: fine for a check, not the way to run it at scale.
_SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM starts),
least_doc AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
hit AS (SELECT DISTINCT win.doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least_doc USING (k) WHERE m < win.doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

#: All pairs that share a shingle and whose sizes allow the similarity, then the closure of the links.
_MINHASH_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
item AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM item GROUP BY 1),
coded AS (SELECT doc_id, n, hash(s) AS s FROM item JOIN size USING (doc_id)),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS t, count(*) AS c FROM coded a JOIN coded b ON a.s = b.s AND a.doc_id > b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
link AS (SELECT a, b FROM pair WHERE 100 * c >= 80 * (t - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(low.b, d.doc_id) AS kept
FROM d LEFT JOIN size ON d.doc_id = size.doc_id LEFT JOIN low ON d.doc_id = low.a
"""

#: All pairs of a label.
_EMBEDDING_SQL = """
WITH RECURSIVE good AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, e.b FROM reach r JOIN link e ON r.b = e.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY 1),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY 1)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(low.b, v.vec_id)) AS component_id, v.vec_id <= coalesce(low.b, v.vec_id) AS kept
FROM embeddings v LEFT JOIN low ON v.vec_id = low.a LEFT JOIN degree ON v.vec_id = degree.a
"""

ORACLES: dict[str, str] = {"op5_substring_dedup": _SUBSTRING_SQL, "op6_embedding_dedup": _EMBEDDING_SQL, "op7_minhash_dedup": _MINHASH_SQL}
