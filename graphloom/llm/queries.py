"""One query per training-data operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    out = pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_encode_decode

    out = bpe_encode_decode(table(spark, sf_dir, "documents"), vocabulary_path())
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import cross_entropy_difference

    return cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify_language

    return identify_language(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import predict_toxicity

    return predict_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document with words: its lines with words, and the numbers of those that earlier lines are near to, joined by commas."""
    from .line_dedup import repeated_lines

    dropped, counts = repeated_lines(table(spark, sf_dir, "documents"))
    gone = dropped.groupBy("doc_id", "copy").agg(F.sort_array(F.collect_set("line")).alias("dropped"))
    out = counts.join(gone, ["doc_id", "copy"], "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("dropped")).alias("n_kept"), F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import document_fingerprints

    return document_fingerprints(table(spark, sf_dir, "documents"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan_licences

    return scan_licences(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_bpe": op2_bpe,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_fingerprints": op8_fingerprints,
    "op9_near_vectors": op9_near_vectors,
    "op10_licences": op10_licences,
}

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
""",
    # a line goes when an earlier one is equal, or has 8 words like it and all but one word of the longer in common prefix and suffix
    "op7_line_dedup": r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i - 1 AS line, list_filter(regexp_split_to_array(ls[i], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM t)),
l AS MATERIALIZED (SELECT *, len(ws) AS n FROM w WHERE len(ws) > 0),
f AS MATERIALIZED (SELECT ws, any_value(n) AS n, min((doc_id, line)) AS p FROM l GROUP BY ws),
h AS (SELECT p, k, 0 AS side, ws[1:k] AS half FROM (SELECT *, unnest(list_distinct([n // 2, (n - 1) // 2])) AS k FROM f WHERE n >= 8)
  UNION ALL SELECT p, k, 1, ws[n - k + 1:n] FROM (SELECT *, unnest(list_distinct([n // 2, (n - 1) // 2])) AS k FROM f WHERE n >= 8)),
c AS (SELECT DISTINCT a.p AS a, b.p AS b FROM h a JOIN h b ON a.k = b.k AND a.side = b.side AND a.half = b.half AND a.p < b.p),
v AS (SELECT c.b, x.ws AS x, y.ws AS y, least(x.n, y.n) AS m, x.n AS xn, y.n AS yn FROM c JOIN f x ON x.p = c.a JOIN f y ON y.p = c.b WHERE abs(x.n - y.n) <= 1),
u AS (SELECT *, coalesce(list_position(list_transform(range(1, m + 1), lambda i: x[i] <> y[i]), true) - 1, m) AS pre,
  coalesce(list_position(list_transform(range(0, m), lambda i: x[xn - i] <> y[yn - i]), true) - 1, m) AS suf FROM v),
near AS (SELECT DISTINCT b FROM u WHERE pre + suf >= m - CASE WHEN xn = yn THEN 1 ELSE 0 END),
gone AS (SELECT l.doc_id, l.line FROM l JOIN f ON f.ws = l.ws WHERE (l.doc_id, l.line) <> f.p UNION SELECT b[1], b[2] FROM near)
SELECT l.doc_id, count(*) AS n_lines, count(*) - count(g.line) AS n_kept, coalesce(string_agg(g.line::VARCHAR, ',' ORDER BY g.line), '') AS dropped
FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id
""",
    "op9_near_vectors": """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(m.b, e.vec_id)) AS component_id, e.vec_id <= coalesce(m.b, e.vec_id) AS kept
FROM embeddings e LEFT JOIN m ON m.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
""",
}
