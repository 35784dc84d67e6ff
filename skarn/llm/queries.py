"""Queries over the test tables, one for each operator of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.session import table


def vocabulary() -> str:
    """Where the public word tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens, each document ending with id 0."""
    from skarn.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary(), capacity=2048, end_id=0)


def op2_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged records of a replica of all pages' WARC archives, found from the trees of both."""
    from skarn.llm.warc import audit, damaged_copy, records, write_archives

    original = write_archives(records(table(spark, sf_dir, "pages")))
    return audit(original, damaged_copy(original))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of all documents, as digests."""
    from skarn.llm.tokens import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary())


def op4_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stays of each group of equal texts."""
    from skarn.llm.radix_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of each document, for a Jaccard similarity of 5-word shingles of 0.8."""
    from skarn.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and verdict of the quality rules for all documents."""
    from skarn.llm.quality import judged

    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written as Arrow files of equal-length sequences, and read back."""
    from skarn.llm.tokenfile import read_documents, write

    return read_documents(write(table(spark, sf_dir, "documents"), vocabulary(), end_id=2))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents by code length; learned from those not held out."""
    from skarn.llm.langid import predict, train

    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    model = train(docs.where(~F.col("held_out") & F.col("lang").isNotNull()))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of each document without 50-byte strings of earlier documents."""
    from skarn.llm.suffix import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data and of terms that disclose them, for all documents."""
    from skarn.llm.pii import find

    return find(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline: all its stages over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_best_fit_packing, op2_merkle_audit, op3_bpe, op4_radix_dedup, op5_jaccard_join, op6_quality_rules, op7_token_files, op8_language_id, op9_suffix_dedup, op10_sanitise, pipeline)
    return {f.__name__: f for f in own}


def _stop_list() -> str:
    from skarn.llm.quality import STOP_WORDS

    return ", ".join(f"'{w}'" for s in STOP_WORDS for w in (s, s.capitalize()))


def oracle_sql() -> dict[str, str]:
    nl = "chr(13) || chr(10)"
    return {
        "op2_merkle_audit": f"""
WITH p AS (SELECT page_id, page_id // 4096 AS archive, coalesce(url, '') AS u, coalesce(html, '') AS h FROM pages),
d AS (SELECT archive, page_id, u, 'WARC/1.1' || {nl} || 'WARC-Type: resource' || {nl} || 'WARC-Date: 1970-01-01T00:00:00Z' || {nl} || 'WARC-Target-URI: ' || u || {nl}
             || 'WARC-Record-ID: <urn:page:' || page_id || '>' || {nl} || 'Content-Type: text/html' || {nl}
             || 'Content-Length: ' || strlen(h) || {nl} || {nl} || h || {nl} || {nl} AS data FROM p),
o AS (SELECT archive, page_id, data, row_number() OVER w - 1 AS record_no,
             coalesce(sum(strlen(data)) OVER (PARTITION BY archive ORDER BY page_id, u, data ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
      FROM d WINDOW w AS (PARTITION BY archive ORDER BY page_id, u, data))
SELECT archive, CAST(record_no AS BIGINT) AS record_no, CAST(place AS BIGINT) AS "offset", CAST(strlen(data) AS BIGINT) AS length, page_id,
       sha256(data) AS expected_sha256, CASE WHEN page_id % 211 = 5 THEN NULL ELSE sha256('X' || substr(data, 2)) END AS actual_sha256
FROM o WHERE page_id % 97 = 13 OR page_id % 211 = 5""",
        "op4_radix_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)""",
        "op6_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
t AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM t) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
             len(list_filter(ws, lambda x: x IN ({_stop_list()}))) AS n_stop
      FROM w LEFT JOIN p ON p.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words >= 50 AND CAST(word_chars AS DOUBLE) / n_words BETWEEN 2.0 AND 15.0
       AND CAST(n_symbols AS DOUBLE) / n_words <= 0.1 AND CAST(n_stop AS DOUBLE) / n_words >= 0.02
       AND coalesce(CAST(n_dup_lines AS DOUBLE) / nullif(n_lines, 0) <= 0.3, TRUE) AS kept
FROM b""",
    }
