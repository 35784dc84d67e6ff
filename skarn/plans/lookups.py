"""Queries on dictionary cursors, bits, order and joins, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.operators import dictionary as D
from skarn.operators import ordered as O
from skarn.operators import patterns as P
from skarn.operators import setops as A
from skarn.plans.registry import query

#: Characters that two columns of SQL share at their start.
SHARED = "CAST(list_count(list_filter(range(1, least(length({0}), length({1})) + 1), lambda i: left({0}, i) = left({1}, i))) AS BIGINT)"


def _suppliers_as_customers(t):
    return t("supplier").select(F.replace("s_name", F.lit("Supplier#0"), F.lit("Customer#0")).alias("probe"))


@query(f"""
WITH d AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS id FROM (SELECT DISTINCT c_name AS w FROM customer WHERE c_custkey % 3 = 0)),
q AS (SELECT DISTINCT replace(s_name, 'Supplier#0', 'Customer#0') AS q FROM supplier UNION SELECT 'Z'),
b AS (SELECT q, count(w) AS idx FROM q LEFT JOIN d ON w < q GROUP BY q)
SELECT q AS probe, CAST(idx AS BIGINT) AS idx, w AS word, CASE WHEN w IS NULL THEN 0 ELSE {SHARED.format("q", "w")} END AS matched, coalesce(w = q, FALSE) AS found FROM b LEFT JOIN d ON id = idx""")
def dict_seek(t):
    d = D.dictionary(t("customer").where("c_custkey % 3 = 0"), "c_name")
    end = d.sparkSession.createDataFrame([("Z",)], "probe string")
    return D.seek(d, _suppliers_as_customers(t).unionByName(end).distinct())


@query("""
WITH q AS (SELECT DISTINCT replace(s_name, 'Supplier#0', 'Customer#0') AS q FROM supplier)
SELECT q AS probe, CAST(max(i) AS BIGINT) AS matched FROM q, generate_series(0, length(q)) g(i)
WHERE left(q, CAST(i AS INT)) IN (SELECT left(c_name, CAST(k AS INT)) FROM customer, generate_series(0, length(c_name)) h(k) WHERE c_custkey % 3 = 0) GROUP BY q""")
def dict_max_prefix(t):
    return D.longest_shared_prefix(D.word_set(t("customer").where("c_custkey % 3 = 0"), "c_name"), _suppliers_as_customers(t))


@query("SELECT w AS word, lag(w) OVER (ORDER BY w) AS before, lead(w) OVER (ORDER BY w) AS after FROM (SELECT DISTINCT c_name AS w FROM customer)")
def dict_neighbours(t):
    return D.neighbours(D.dictionary(t("customer"), "c_name"))


@query("""
WITH d AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS id FROM (SELECT DISTINCT left(word, 3) AS w FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark) WHERE word <> '')),
q AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents))
SELECT q.word AS text, CAST(max(length(w)) AS BIGINT) AS matched, max_by(w, length(w)) AS word, CAST(max_by(id, length(w)) AS BIGINT) AS id FROM q JOIN d ON w IN (left(q.word, 1), left(q.word, 2), left(q.word, 3)) GROUP BY q.word""")
def match_dictionary_longest(t):
    words = lambda name: t(name).select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''")
    starts = D.dictionary(words("benchmark").select(F.left("word", F.lit(3)).alias("w")), "w")
    return D.longest_word_prefix(starts, words("documents").select(F.col("word").alias("text")).distinct(), "text")


@query("""
WITH w AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS w FROM pages WHERE url IS NOT NULL),
s AS (SELECT w, string_split(w, '/') AS parts FROM w),
p AS (SELECT w, i, array_to_string(parts[1:i], '/') AS path FROM (SELECT w, parts, unnest(range(1, len(parts) + 1)) AS i FROM s)),
c AS (SELECT path, i, count(*) AS cnt FROM p GROUP BY path, i)
SELECT p.w AS probe, p.i AS step, CAST(c.cnt AS BIGINT) AS cnt FROM p JOIN c ON c.path = p.path AND c.i = p.i""")
def path_steps(t):
    words = t("pages").where("url is not null").select(F.regexp_replace("url", "^[a-z]+://", "").alias("word")).distinct()
    return D.step_counts(words, words.withColumnRenamed("word", "probe"), "/")


@query("SELECT w AS word, (row_number() OVER (ORDER BY w) - 1) / greatest(count(*) OVER () - 1, 1) AS rank FROM (SELECT DISTINCT c_name AS w FROM customer)")
def dict_rank_share(t):
    return D.approximate_ranks(D.dictionary(t("customer"), "c_name"))


@query("SELECT DISTINCT c_name AS word FROM customer WHERE md5(c_name) < '07ae147a'")
def dict_sample(t):
    return D.sampled(D.word_set(t("customer"), "c_name"), 0.03)


@query("SELECT word FROM (SELECT DISTINCT c_name AS word FROM customer) ORDER BY md5('7:' || word), word LIMIT 20")
def random_keys(t):
    return D.random_words(D.word_set(t("customer"), "c_name"), 20, 7)


@query(f"""
SELECT shared, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT {SHARED.format("b", "w")} AS shared FROM (SELECT w, lag(w) OVER (ORDER BY w) AS b FROM (SELECT DISTINCT c_name AS w FROM customer)) WHERE b IS NOT NULL) GROUP BY shared""")
def key_difference_stat(t):
    return D.first_difference_counts(D.word_set(t("customer"), "c_name"))


@query("""
WITH w AS (SELECT DISTINCT c_name AS w FROM customer)
SELECT CAST(count(*) AS BIGINT) AS words, CAST(sum(length(w)) AS BIGINT) AS total_len, CAST(max(length(w)) AS BIGINT) AS max_len,
       (SELECT CAST(count(DISTINCT left(w, CAST(k AS INT))) AS BIGINT) FROM w, generate_series(0, length(w)) g(k)) AS prefixes FROM w""")
def word_stats(t):
    return D.word_stats(D.word_set(t("customer"), "c_name"))


# --- Bits and order

CLICKS = "(SELECT event_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS b FROM events)"


@query(f"""
SELECT event_id, CAST(sum(b) OVER w AS BIGINT) AS rank1, CAST(sum(1 - b) OVER w AS BIGINT) AS rank0 FROM {CLICKS} WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def bit_rank_both(t):
    events = t("events").select("event_id", "event_type")
    return O.bit_ranks(events, ["event_id"], F.col("event_type") == "click").drop("event_type")


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS k FROM events WHERE event_type = 'click'")
def bit_select(t):
    events = t("events").select("event_id", "event_type")
    return O.select_bits(events, ["event_id"], F.col("event_type") == "click").drop("event_type")


@query(f"""
SELECT min(event_id) AS start, CAST(count(*) AS BIGINT) AS len FROM (SELECT event_id, b, sum(1 - b) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS z FROM {CLICKS}) WHERE b = 1 GROUP BY z""")
def runs_of_ones(t):
    events = t("events").select("event_id", "event_type")
    return O.runs_of_ones(events, "event_id", F.col("event_type") == "click")


@query("""
WITH s AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS n FROM documents),
o AS (SELECT n, sum(n) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n AS a, sum(n) OVER () AS total FROM s)
SELECT CAST(floor(a * 8 / total) AS BIGINT) AS part, CAST(min(a) AS BIGINT) AS "offset", CAST(sum(n) AS BIGINT) AS length FROM o GROUP BY 1""")
def split_ranges(t):
    docs = t("documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))
    return O.split_ranges(docs, ["doc_id"], F.col("n") + 1, 8)


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY substr(p_name, 1, 3), p_partkey) - 1 AS BIGINT) AS place FROM part")
def record_sort(t):
    # Records of a key of three characters and a value: the value takes no part, equal keys keep their order.
    rows = t("part").select("p_partkey", F.substring("p_name", 1, 3).alias("key"))
    return O.with_ordinal(rows, "key", "p_partkey", name="place").select("p_partkey", "place")


@query("""
SELECT p_partkey AS seq, p_name AS word, CAST(row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS BIGINT) AS place FROM part ORDER BY seq""")
def sort_by_sequence(t):
    # Sorted strings put back into the order they came in.
    rows = O.with_ordinal(t("part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("word")), "word", "seq", name="place")
    return rows.orderBy("seq")


# --- Joins

@query("""
SELECT key, CAST(count(*) FILTER (way = 0) AS BIGINT) AS first, CAST(count(*) FILTER (way > 0) AS BIGINT) AS rest FROM
(SELECT o_custkey AS key, 0 AS way FROM orders UNION ALL SELECT user_id, 1 FROM events UNION ALL SELECT c_custkey, 2 FROM customer) GROUP BY key""")
def group_sizes(t):
    return A.group_sizes([t("orders").select("o_custkey"), t("events").select("user_id"), t("customer").select("c_custkey")])


@query("""
WITH w AS (SELECT DISTINCT p_name AS w FROM part UNION SELECT DISTINCT replace(replace(p_name, 'ri', 'ir'), 'al', 'la') FROM part)
SELECT a.w AS a, b.w AS b FROM w a, w b WHERE a.w < b.w AND damerau_levenshtein(a.w, b.w) <= 1""")
def fuzzy_join_swaps(t):
    names = t("part").select(F.col("p_name").alias("word"))
    other = names.select(F.replace(F.replace("word", F.lit("ri"), F.lit("ir")), F.lit("al"), F.lit("la")).alias("word"))
    return P.fuzzy_join_swaps(names.unionByName(other).distinct())
