"""One query for each operator of this subpackage over its whole test table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracepairs.llm.bpe_tree import token_digests
from tracepairs.llm.exact_dedup import exact_dedup
from tracepairs.llm.langid import identify_documents
from tracepairs.llm.media import decode_avi, feature, text_to_avi
from tracepairs.llm.mixing import mix
from tracepairs.llm.ngram_join import ngram_jaccard_components
from tracepairs.llm.shuffle_shards import shuffled_shards
from tracepairs.llm.spelling import spelling_variants
from tracepairs.llm.suffix_dedup import remove_repeats
from tracepairs.llm.token_counts import count_tokens
from tracepairs.llm.vector_codes import vector_codes
from tracepairs.llm.warc import page_records
from tracepairs.llm.winnowing import contamination, item_digest


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(_documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only the queries that need a vocabulary need the package

    return token_digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _documents(spark, sf_dir).select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    stored = text_to_avi(texts, "text", "media").drop("text")
    stored = stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    read = decode_avi(stored, "media", keep_media=False)
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        feature(F.col("n_frames"), F.col("clips")).alias("feature"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"), length=200)
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return spans.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        n_removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(_documents(spark, sf_dir))


def op7_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shuffled_shards(_documents(spark, sf_dir).select("doc_id", "text"), 8)
    text = F.coalesce("text", F.lit(""))
    return sharded.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", item_digest(F.col("items")).alias("items_sha256"), "contaminated")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_ALL = (
    op1_ngram_jaccard_join,
    op2_byte_bpe,
    op3_media_columns,
    op4_warc,
    op5_suffix_dedup,
    op6_language_id,
    op7_external_shuffle,
    op8_exact_dedup,
    op9_token_counts,
    op10_mix_sources,
    op11_spelling_variants,
    op12_winnowing,
    op13_vector_codes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4_SQL, "op8_exact_dedup": OP8_SQL, "op10_mix_sources": OP10_SQL, "op12_winnowing": OP12_SQL, "op13_vector_codes": OP13_SQL}


OP4_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM g
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1 AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, 3 * source_size AS cap,
         CAST(coalesce(sum(3 * source_size) OVER before, 0) AS BIGINT) AS cap_before,
         CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS BIGINT) AS w_rest
  FROM s WINDOW before AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, CAST(total - cap_before AS DOUBLE) / w_rest AS level, w * (CAST(total - cap_before AS DOUBLE) / w_rest) > cap AS held FROM r
), f AS (
  SELECT *, arg_min(CASE WHEN NOT held THEN level END, CASE WHEN NOT held THEN cap_before END) OVER () AS final FROM l
), t AS (
  SELECT source, source_size,
         least(CASE WHEN held OR final IS NULL THEN CAST(cap AS DOUBLE) ELSE w * final END, CAST(cap AS DOUBLE)) AS target
  FROM f
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM p
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NEXT = ", ".join(["word"] + [f"lead(word, {j}) OVER (PARTITION BY r ORDER BY pos)" for j in range(1, 10)])


def _words_sql(table: str, name: str) -> str:
    """Rows ``r, name, n, pos, next``: a word's place, and it and the nine words after it."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    rows = f"SELECT row_number() OVER () AS r, {name} AS name, {words} AS w FROM {table}"
    places = f"SELECT r, name, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS pos FROM ({rows})"
    return f"SELECT r, name, n, pos, [{_NEXT}] AS next FROM ({places})"


OP12_SQL = f"""
WITH b AS (
  SELECT DISTINCT coalesce(CAST(name AS VARCHAR), '') AS item, least(n, 10) AS m, array_to_string(next[1 : least(n, 10)], ' ') AS span
  FROM ({_words_sql("benchmark", "item_id")}) WHERE pos + least(n, 10) <= n
), d AS ({_words_sql("documents", "doc_id")}
), found AS (
  SELECT d.r, d.pos, b.m, b.item
  FROM d JOIN (SELECT DISTINCT m FROM b) l ON d.pos + l.m <= d.n JOIN b ON b.m = l.m AND b.span = array_to_string(d.next[1 : l.m], ' ')
), hit AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(pos, pos + m)) AS place FROM found) GROUP BY r
), items AS (
  SELECT r, list_sort(list_distinct(list(item))) AS items FROM found GROUP BY r
), docs AS (
  SELECT row_number() OVER () AS r, doc_id FROM documents
), sizes AS (
  SELECT r, count(*) AS n FROM d GROUP BY r
)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN sizes USING (r) LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""


def _assigned_sql(books: str) -> str:
    """Parts with the distance to their nearest entry and its index: 64 * distance + index."""
    return f"SELECT r, p, any_value(x) AS x, min(CAST({' + '.join(f'(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])' for i in (1, 2, 3, 4))} AS HUGEINT) * 64 + e) AS near FROM parts JOIN {books} USING (p) GROUP BY r, p"


def _moved_sql(books: str, assigned: str) -> str:
    means = ", ".join(f"CAST(floor(sum(x[{i}]) / count(*)) AS BIGINT)" for i in (1, 2, 3, 4))
    return f"SELECT p, e, coalesce(m, c) AS c FROM {books} LEFT JOIN (SELECT p, near % 64 AS e, [{means}] AS m FROM {assigned} GROUP BY ALL) USING (p, e)"


OP13_SQL = f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT r, p, v[4 * p + 1 : 4 * p + 4] AS x FROM k, range(16) t(p)
), b0 AS (
  SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 64
), a0 AS ({_assigned_sql("b0")}
), b1 AS ({_moved_sql("b0", "a0")}
), a1 AS ({_assigned_sql("b1")}
), b2 AS ({_moved_sql("b1", "a1")}
), a2 AS ({_assigned_sql("b2")}
), sha AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2
), coded AS (
  SELECT r, string_agg(lower(printf('%02x', CAST(near % 64 AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(near // 64) AS BIGINT) AS error FROM a2 GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN k USING (r), sha
"""
