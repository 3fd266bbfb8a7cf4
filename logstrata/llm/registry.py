"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import capfilter, chat, editprint, linejoin, minhash, mixing, packing, quality, substring, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linejoin.classes(_read(spark, sf_dir, "documents"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), vocabulary_path())


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are made of control strings."""
    tricky = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.segments(turns))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilter.near_groups(_read(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.plan(_read(spark, sf_dir, "documents"), keep=("doc_id", "source"))
    return drawn.select(F.col("_doc.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("_doc.source").alias("source"), "copies")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(_read(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.compare_neighbours(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (op1_line_dedup, op2_packing, op3_chat_formatting, op4_quality, op5_embedding_dedup, op6_mixing, op7_substring_dedup, op8_toxicity, op9_minhash_dedup, op10_fingerprints)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_formatting": CHAT_SQL, "op5_embedding_dedup": EMBEDDING_SQL, "op7_substring_dedup": SUBSTRING_SQL, "op9_minhash_dedup": MINHASH_SQL}


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), steps AS (
  SELECT *, lag(role, 1, '') OVER w AS before, lead(role) OVER w AS after,
    replace(replace(text, '\', '\\'), '<|', '<\|') AS shown
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(shown) + 24) AS BIGINT) AS formatted_chars,
  bool_and((before, role) IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')))
    AND bool_and(after IS NOT NULL OR role = 'assistant') AS valid
FROM steps GROUP BY conv_id
"""

SUBSTRING_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM split WHERE len(ws) >= 13)
), least AS (
  SELECT k, min(doc_id) AS m FROM windows GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM windows JOIN least USING (k) WHERE m < doc_id
), kept AS (
  SELECT s.doc_id, count(g.j) AS n_removed, coalesce(string_agg(s.w, ' ' ORDER BY s.j) FILTER (WHERE g.j IS NULL), '') AS t
  FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS j FROM split) s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.j = s.j
  GROUP BY s.doc_id
)
SELECT split.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split LEFT JOIN kept ON kept.doc_id = split.doc_id
"""

MINHASH_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), grams AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) AS g FROM split WHERE len(ws) >= 5
    UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM split WHERE len(ws) BETWEEN 1 AND 4)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common.n >= 75 * (p.n + q.n - common.n)
), reach AS (
  SELECT a AS node, a AS other FROM links UNION SELECT node, b FROM reach JOIN links ON a = other
), parts AS (
  SELECT node, min(other) AS c FROM reach GROUP BY node
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN parts p ON p.node = d.doc_id
"""

EMBEDDING_SQL = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT r, vec_id, e, len(e) AS d, sqrt(list_dot_product(e, e)) AS size FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0
), links AS (
  SELECT x.r AS a, y.r AS b FROM good x JOIN good y ON x.r <> y.r AND x.d = y.d AND list_dot_product(x.e, y.e) / (x.size * y.size) >= 0.95
), reach AS (
  SELECT a AS node, a AS other FROM links UNION SELECT node, b FROM reach JOIN links ON a = other
), parts AS (
  SELECT node, min(w.vec_id) AS c FROM reach JOIN v w ON w.r = other GROUP BY node
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, v.vec_id) AS component_id, coalesce(c, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN counts ON counts.a = v.r LEFT JOIN parts ON parts.node = v.r
"""
