"""Queries on bytes, codes, formats and event time, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.functions import checksums
from skarn.functions import scalar as S
from skarn.operators import stats as T
from skarn.plans.registry import query
from skarn.streaming import realtime

BYTES = "(SELECT h, unnest(range(1, length(h) // 2 + 1)) AS i FROM (SELECT hex(encode(text)) AS h FROM documents))"


def _after(order: int) -> str:
    return f"""
SELECT substr(h, CAST(i * 2 - 1 AS INT), {2 * order}) AS prev, substr(h, CAST(i * 2 - 1 + {2 * order} AS INT), 2) AS cur, CAST(count(*) AS BIGINT) AS cnt
FROM {BYTES} WHERE i + {order} <= length(h) // 2 GROUP BY 1, 2"""


@query(f"SELECT substr(h, CAST(i * 2 - 1 AS INT), 2) AS cur, CAST(count(*) AS BIGINT) AS cnt FROM {BYTES} GROUP BY 1")
def byte_freq_o0(t):
    return T.byte_counts(t("documents"), "text")


@query(_after(1))
def byte_freq_o1(t):
    return T.byte_counts(t("documents"), "text", 1)


@query(_after(2))
def byte_freq_o2(t):
    return T.byte_counts(t("documents"), "text", 2)


@query(f"""
WITH c AS ({_after(2)}), s AS (SELECT cnt, sum(cnt) OVER (PARTITION BY prev) AS total FROM c)
SELECT round(-sum(cnt * log2(cnt / total)) / 8, 1) AS bytes FROM s""")
def entropy_o2(t):
    return T.entropy_bytes(T.byte_counts(t("documents"), "text", 2), ["prev"]).select(F.round("bytes", 1).alias("bytes"))


@query("SELECT doc_id, hex(encode(text)) AS digits, text AS back FROM documents WHERE text IS NOT NULL")
def hex_codec(t):
    digits = t("documents").where("text is not null").select("doc_id", F.hex("text").alias("digits"))
    return digits.select("doc_id", "digits", S.hex_decode(F.col("digits")).alias("back"))


@query("SELECT doc_id, text AS back FROM documents WHERE text IS NOT NULL")
def c_escape_round_trip(t):
    # A backslash and a letter put before the text make every kind of escape meet.
    own = F.concat(F.lit('\\n\\\\"\t'), F.col("text"))
    back = S.c_unescape(S.c_escape(own))
    return t("documents").where("text is not null").select("doc_id", F.substring(back, 7, 2**31 - 1).alias("back"))


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x5E\\x60\\x7B-\\x7F]+'), lambda w: w = 'the')) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def whole_words(t):
    return t("documents").where("text is not null").select("doc_id", S.whole_word_count(F.col("text"), "the").alias("n"))


@query("SELECT c_custkey, regexp_replace(hex(encode(c_name)), '(..)', '00\\1', 'g') AS units FROM customer")
def utf16_units(t):
    return t("customer").select("c_custkey", S.utf16_hex(F.col("c_name")).alias("units"))


@query("SELECT o_orderkey, printf('%012.2f|%08d', o_totalprice, CAST(o_custkey AS INT)) AS shown FROM orders")
def number_formats(t):
    return t("orders").select("o_orderkey", F.format_string("%012.2f|%08d", F.col("o_totalprice").cast("double"), F.col("o_custkey").cast("int")).alias("shown"))


@query()
def crc_codes(t):
    text = F.coalesce("text", F.lit(""))
    return t("documents").select("doc_id", checksums.crc32c(text).alias("crc32c"), checksums.crc16(text).alias("crc16"), F.crc32(text.cast("binary")).alias("crc32"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def session_windows(t):
    return realtime.sessions(t("events"), "ts", "user_id", "30 minutes")
