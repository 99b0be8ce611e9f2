"""The queries opN_<name> over the driver's tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, embedding_dedup, fingerprint, html_extract, minhash, mixing, packing, substring_tree, suffix_array, toxicity
from .common import pick


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op2_pack_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0, digest=True)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_sparse_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, words inside passages of 50 and more that a smaller doc_id has too, and the digest of the rest."""
    found = suffix_array.without_repeats(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "source").withColumn("size", mixing.word_count()).drop("text")
    return mixing.mix(docs, size="size").select("doc_id", "size", "source_size", "target", "taken")


def op5_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op6_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    lexicon = toxicity.learn(*toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score_texts(docs, lexicon, threshold=0.3).withColumn("held_out", F.coalesce(toxicity.held_out(), F.lit(False))).select("doc_id", "held_out", "score", "predicted")


def op7_prefix_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_tree.without_repeats(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    done = chat_format.read_back(chat_format.format_rows(rows.unionByName(planted)))
    said = F.array_join(F.transform("read_turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("read_turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op9_fast_similarity_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2, similarity=(80, 100))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_with_neighbours(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_inverted_multi_index": op1_inverted_multi_index,
    "op2_pack_patterns": op2_pack_patterns,
    "op3_sparse_suffix_arrays": op3_sparse_suffix_arrays,
    "op4_mix_sources": op4_mix_sources,
    "op5_extract_html": op5_extract_html,
    "op6_score_toxicity": op6_score_toxicity,
    "op7_prefix_suffix_trees": op7_prefix_suffix_trees,
    "op8_format_chats": op8_format_chats,
    "op9_fast_similarity_sketch": op9_fast_similarity_sketch,
    "op10_weighted_sampling": op10_weighted_sampling,
}

#: Words of passages of 50 and more that a smaller doc_id has too: d (words), gone (places that go), kept (the rest).
_PASSAGES = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w)::BIGINT - 48)) AS i FROM d)
), own AS (
  SELECT h, min(doc_id) AS least FROM win GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT win.doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN own USING (h) WHERE least < doc_id)
), pos AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1)::BIGINT AS p FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
), n AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (p - coalesce(before, -1) > 1) AS n_spans
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, {more}sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_inverted_multi_index": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), c AS (
  SELECT x, min(y) AS component_id FROM r GROUP BY x
)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON vec_id = x
""",
    "op3_sparse_suffix_arrays": _PASSAGES.replace("{more}", "coalesce(n_spans, 0) AS n_spans, "),
    "op7_prefix_suffix_trees": _PASSAGES.replace("{more}", ""),
    "op9_fast_similarity_sketch": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(g) AS g FROM (
    SELECT doc_id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w)::BIGINT)) AS i FROM d)
    UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), c AS (
  SELECT x, min(y) AS component_id FROM r GROUP BY x
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c ON d.doc_id = x
""",
    "op4_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), o AS (
  SELECT *, source_size * (CASE weight WHEN 5 THEN 2 WHEN 2 THEN 5 ELSE 10 END) AS level FROM w
), p AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_w,
    coalesce(sum(source_size) OVER b, 0) AS size_before, coalesce(sum(weight) OVER b, 0) AS w_before
  FROM o WINDOW b AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, 4 * source_size * (all_w - w_before) <= weight * (3 * total - 4 * size_before) AS is_full FROM p
), g AS (
  SELECT *, sum(CASE WHEN NOT is_full THEN weight END) OVER () AS open_w, coalesce(sum(CASE WHEN is_full THEN source_size END) OVER (), 0) AS full_size FROM f
), t AS (
  SELECT source, source_size, CASE WHEN is_full THEN (2 * source_size)::DOUBLE
    ELSE (weight * (3 * total - 4 * full_size))::DOUBLE / (2 * open_w)::DOUBLE END AS target FROM g
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
""",
    "op8_format_chats": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(role || text) + length(regexp_replace(role || text, '[^\\<#:]', '', 'g')) + 14 AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""",
}
