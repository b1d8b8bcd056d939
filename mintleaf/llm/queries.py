"""The registered queries of the corpus operators. Each reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mintleaf.llm import bpe, byte_bpe, exact_dedup, html_text, language, licenses, merkle, mixing, near_dedup, prefix_trie, sharding, substring_dedup, topk
from mintleaf.llm.common import ascii_lower, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in every pass that the mix takes them, for a repetition of any source of 1.5 at most."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.count_words(F.col("text")).alias("n_words"))
    mixed = mixing.mix(written(docs, "wordcounts"), tokens=F.col("n_words"), plan_columns=True, repetition_limit=1.5)
    return mixed.select("doc_id", "source", "mix.*")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best license match of every document, over its lines and the whole."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards of near equal bytes (law ``bytes``)."""
    placed = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), 16)
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id of the row that stays of its group of equal texts."""
    found = exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best candidates of every embedding whose id is divisible by 50, by exact inner product."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), 5, 50)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html_text.extract_text(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


OP9_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

OP3_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words under windows of 20 words that start earlier elsewhere."""
    cut = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), 20)
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near copies (5-word shingles, similarity 0.75)."""
    found = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learnt from the documents that aren't held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs)
    return found.select("doc_id", language.is_held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang_pred").alias("lang_pred"), F.col("language.score").alias("score"))


def op8_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the word-splitting tokenizer of 49k tokens."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id", F.col("encoded.n_tokens").alias("n_tokens"), F.sha2("encoded.ids", 256).alias("ids_sha256"), F.sha2("encoded.decoded", 256).alias("decoded_sha256")
    )


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the byte-level vocabulary of 50k tokens for many languages."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", F.col("encoded.n_tokens").alias("n_tokens"), F.sha2("encoded.ids", 256).alias("ids_sha256"), F.sha2("encoded.decoded", 256).alias("decoded_sha256")
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, folded again after texts of some documents are lower-cased."""
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(drawn, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    return merkle.verify(_table(spark, sf_dir, "documents"), {"text": changed}).withColumnRenamed("id", "doc_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the conversations, each begun with turns of the conversation at the start of its five."""
    turns = prefix_trie.turns_of(_table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.with_borrowed_start(turns, 5, 8))


#: crc32 of a decimal number in SQL: eight steps of the polynomial for each digit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}::VARCHAR) + 1), lambda i: ascii(({0}::VARCHAR)[i])::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

OP11_SQL = f"""
WITH RECURSIVE f AS (
  SELECT doc_id, coalesce('+' || lang, '') AS g, text, CASE WHEN {_CRC32.format("doc_id")} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS low,
    concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head
  FROM documents),
leaf AS (SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h, sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS x FROM f),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM leaf),
nodes AS (
  SELECT g, 0 AS level, p, h, n FROM placed
  UNION ALL
  SELECT g, level + 1, p // 8, sha256(string_agg(h, '' ORDER BY p)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY g, level, p // 8, n),
subroots AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, p, h, n FROM subroots
  UNION ALL
  SELECT level + 1, p // 8, sha256(string_agg(h, '' ORDER BY p)), (n + 7) // 8 FROM upper WHERE n > 1 GROUP BY level, p // 8, n),
sides AS (
  SELECT g, level, p, coalesce(string_agg(h, '' ORDER BY p) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '' ORDER BY p) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes WHERE n > 1 WINDOW w AS (PARTITION BY g, level, p // 8 ORDER BY p)),
above AS (
  SELECT level, p, coalesce(string_agg(h, '' ORDER BY p) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '' ORDER BY p) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM upper WHERE n > 1 WINDOW w AS (PARTITION BY level, p // 8 ORDER BY p)),
steps AS (
  SELECT c.g, c.p, s.level, s.l, s.r FROM placed c JOIN sides s ON s.g = c.g AND s.p = c.p // (8 ** s.level)::BIGINT
  UNION ALL
  SELECT c.g, c.p, 1000 + a.level, a.l, a.r FROM placed c JOIN subroots s USING (g) JOIN above a ON a.p = s.p // (8 ** a.level)::BIGINT),
paths AS (SELECT g, p, list({{'l': l, 'x': '', 'r': r}} ORDER BY level) AS path FROM steps GROUP BY g, p),
done AS (
  SELECT c.doc_id, c.h AS leaf, s.h AS subroot, (SELECT h FROM upper WHERE n = 1) AS root, sha256(coalesce(array_to_string(list_transform(path, lambda a: a.l || a.r), ''), '')) AS proof_sha256,
    list_reduce(list_prepend({{'l': '', 'x': c.x, 'r': ''}}, coalesce(path, [])), lambda a, b: {{'l': '', 'x': sha256(b.l || a.x || b.r), 'r': ''}}).x AS folded_root
  FROM placed c JOIN subroots s USING (g) LEFT JOIN paths ON paths.g = c.g AND paths.p = c.p)
SELECT *, folded_root = root AS verified FROM done
"""

OP13_SQL = f"""
WITH own AS (
  SELECT conv_id, strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said, strlen(coalesce(text, '')) AS bytes,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(said)) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS b, {_CRC32.format("conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM own)),
turns AS (
  SELECT c.conv_id, p, said, bytes FROM c JOIN own o ON o.conv_id = b WHERE p < h
  UNION ALL SELECT conv_id, p + 9, said, bytes FROM c JOIN own USING (conv_id) WHERE p >= h),
path AS (
  SELECT conv_id, row_number() OVER w AS depth, sha256(string_agg(sha256(said), '' ORDER BY p) OVER w) AS node, bytes FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY p)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
steps AS (SELECT *, lag(node) OVER w AS up, lead(node) OVER w IS NULL AS last FROM path WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
nodes AS (
  SELECT node, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM steps GROUP BY node, depth),
kids AS (SELECT n.*, (SELECT count(*) FROM nodes k WHERE k.up = n.node AND k.depth = n.depth + 1) AS n_children FROM nodes n),
below AS (
  SELECT p.node, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * k.bytes) AS BIGINT) AS saved_tokens
  FROM kids k JOIN path p ON p.conv_id = k.conv_id AND p.depth <= k.depth GROUP BY p.node)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, k.ends_sha256
FROM kids k JOIN below USING (node) LEFT JOIN nodes p ON p.node = k.up AND p.depth = k.depth - 1
"""


QUERIES = {"op13_prefix_trie": op13_prefix_trie, "op11_merkle_manifest": op11_merkle_manifest, "op12_byte_bpe": op12_byte_bpe, "op1_mix_sources": op1_mix_sources, "op7_license_scan": op7_license_scan, "op10_html_text": op10_html_text, "op9_topk_search": op9_topk_search, "op6_language_id": op6_language_id, "op5_near_dedup": op5_near_dedup, "op4_substring_dedup": op4_substring_dedup, "op8_bpe_roundtrip": op8_bpe_roundtrip, "op2_shard_by_bytes": op2_shard_by_bytes, "op3_exact_dedup": op3_exact_dedup}
ORACLE_SQL = {"op11_merkle_manifest": OP11_SQL, "op13_prefix_trie": OP13_SQL, "op9_topk_search": OP9_SQL, "op3_exact_dedup": OP3_SQL}
