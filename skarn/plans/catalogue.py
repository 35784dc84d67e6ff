"""Queries of the core over the test tables, each with its SQL."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions import scalar as S
from skarn.operators import dictionary as D
from skarn.operators import etl as E
from skarn.operators import kv as K
from skarn.operators import ordered as O
from skarn.operators import patterns as P
from skarn.operators import setops as A
from skarn.operators import stats as T
from skarn.plans.registry import query

def words(df: DataFrame, column: str) -> DataFrame:
    """``word``, repeats kept."""
    return df.select(F.explode(F.split(column, " ")).alias("word")).where("word <> ''")


# --- Scans and sinks

@query("""
SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, rtrim(ls[i], chr(13) || chr(10)) AS line
FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))""")
def line_scan(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("long"), S.chomp(F.col("line")).alias("line"))


@query("SELECT p_type || chr(9) || p_brand AS key, CAST(p_partkey AS VARCHAR) || chr(9) || p_name AS val FROM part")
def splitkv(t):
    line = F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name", "p_brand", "p_type")
    return E.split_kv(t("part").select(line.alias("line")), "line", [3, 2])


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name || chr(9) || c_mktsegment AS value FROM customer")
def text_to_kv(t):
    return E.split_first_tab(t("customer").select(F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment").alias("line")), "line")


@query("""
SELECT o_orderkey, CAST(sum(brk) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run
FROM (SELECT o_orderkey, CASE WHEN lag(o_orderpriority) OVER (ORDER BY o_orderkey) > o_orderpriority THEN 1 ELSE 0 END AS brk FROM orders) t""")
def sorted_runs(t):
    return E.sorted_runs(t("orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"], "o_orderpriority").select("o_orderkey", "run")


@query("SELECT lower(hex(encode(c_name))) AS record, CAST(strlen(c_name) AS BIGINT) AS length FROM customer")
def length_prefixed(t):
    from skarn.sources.io import little_endian

    record = F.concat(little_endian(F.octet_length("c_name")), F.col("c_name").cast("binary"))
    return t("customer").select(record.alias("r")).select(
        F.lower(F.hex(F.expr("substring(r, 5)"))).alias("record"), F.conv(F.hex(F.expr("concat(substring(r, 4, 1), substring(r, 3, 1), substring(r, 2, 1), substring(r, 1, 1))")), 16, 10).cast("long").alias("length")
    )


# --- Projections, filters, predicates

@query("SELECT p_brand || chr(9) || CAST(p_partkey AS VARCHAR) AS line FROM part")
def field_projection(t):
    lines = t("part").select(F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name", "p_brand").alias("raw"))
    return E.project_fields(lines, "raw", [3, 1])


@query("""
SELECT p_partkey, starts_with(p_name, 'l') AS starts, ends_with(p_name, 'e') AS ends, substr(p_name, 3, 2) = 'wi' AS at_place,
       CAST(strpos(p_name, 'wi') - 1 AS BIGINT) AS found FROM part""")
def string_predicates(t):
    n = F.col("p_name")
    return t("part").select(
        "p_partkey", n.startswith("l").alias("starts"), n.endswith("e").alias("ends"), (F.substring(n, 3, 2) == "wi").alias("at_place"), (F.instr(n, "wi") - 1).cast("long").alias("found")
    )


@query("SELECT DISTINCT o_orderpriority AS word FROM orders WHERE o_orderpriority >= '2' AND o_orderpriority < '4'")
def dict_range(t):
    return D.word_range(D.word_set(t("orders"), "o_orderpriority"), "2", "4")


@query("SELECT DISTINCT substr(c_name, 17) AS suffix FROM customer WHERE starts_with(c_name, 'Customer#0000000')")
def dict_prefix(t):
    return D.suffixes(D.word_set(t("customer"), "c_name"), "Customer#0000000")


@query("""
SELECT w AS word, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) t
WHERE w <> '' AND strlen(w) <= 8 GROUP BY w HAVING count(*) >= 5""")
def frequent_short_words(t):
    return T.word_counts(words(t("documents"), "text").where(F.octet_length("word") <= 8), F.col("word")).where("cnt >= 5")


@query("SELECT event_id, upper(event_type) AS kind FROM events WHERE NOT (event_type = 'click' OR value < 10)")
def remove_if(t):
    return t("events").where(~((F.col("event_type") == "click") | (F.col("value") < 10))).select("event_id", F.upper("event_type").alias("kind"))


@query("SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM documents")
def byte_case_fold(t):
    lower = F.when(F.octet_length("text") == F.char_length("text"), F.lower("text"))
    return t("documents").select("doc_id", lower.otherwise(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).alias("folded"))


@query("SELECT c_custkey FROM customer WHERE c_name IN (SELECT replace(s_name, 'Supplier', 'Customer') FROM supplier)")
def exact_match(t):
    keys = t("supplier").select(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("c_name"))
    return t("customer").join(keys, "c_name", "left_semi").select("c_custkey")


# --- Joins

@query("""
SELECT o.o_orderkey, coalesce(c.c_name, '') AS c_name, coalesce(n.n_name, '') AS n_name
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def lookup_join(t):
    first = E.lookup_join(t("orders").select("o_orderkey", "o_custkey"), t("customer"), {"o_custkey": "c_custkey"}, {"c_name": "c_name", "nation": "c_nationkey"})
    return E.lookup_join(first.withColumn("nation", F.expr("try_cast(nation AS int)")), t("nation"), {"nation": "n_nationkey"}, {"n_name": "n_name"}).select("o_orderkey", "c_name", "n_name")


@query("""
SELECT l.l_orderkey, l.l_linenumber, coalesce(p.s, '') AS seen FROM lineitem l LEFT JOIN
(SELECT l_partkey AS pk, l_suppkey AS sk, min(l_returnflag) AS s FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2) p ON l.l_partkey = p.pk AND l.l_suppkey = p.sk""")
def composite_lookup(t):
    line = t("lineitem")
    dim = line.where("l_quantity > 25").groupBy(F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk")).agg(F.min("l_returnflag").alias("s"))
    return E.lookup_join(line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), dim, {"l_partkey": "pk", "l_suppkey": "sk"}, {"seen": "s"}).select("l_orderkey", "l_linenumber", "seen")


@query("SELECT l_orderkey AS key FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def multiset_intersection(t):
    return A.multiset_intersection(t("lineitem").select(F.col("l_orderkey").alias("key")), t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key")), "key")


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def multiset_intersection2(t):
    return A.multiset_intersection(t("orders").select(F.col("o_orderkey").alias("key")), t("lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("key")), "key")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def subtract(t):
    dear = t("orders").where("o_totalprice > 200000")
    return t("customer").join(dear, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""
WITH m AS (SELECT o_orderkey, o_custkey // 100 * 100 AS lo FROM orders)
SELECT o_orderkey, CAST(lo AS BIGINT) AS start_id FROM m WHERE lo IN (SELECT DISTINCT c_custkey // 100 * 100 FROM customer)""")
def doc_range_join(t):
    ranges = t("customer").select((F.floor(F.col("c_custkey") / 100) * 100).cast("long").alias("start_id")).distinct().withColumn("end_id", F.col("start_id") + 100)
    return E.range_lookup(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", ranges, "start_id", "end_id", 100, []).select("o_orderkey", "start_id")


@query("""
WITH q(qid, pattern) AS (VALUES (0, 'STANDARD|SMALL'), (1, 'ECON[A-Z]+'), (2, '[A-Z]+ B'))
SELECT DISTINCT qid, p_type AS word FROM part, q WHERE regexp_matches(p_type, '^(?:' || pattern || ')')""")
def regex_dictionary_join(t):
    patterns = {0: "STANDARD|SMALL", 1: "ECON[A-Z]+", 2: "[A-Z]+ B"}
    return P.matching_words(D.word_set(t("part"), "p_type"), "word", patterns)


@query("""
WITH d(w) AS (VALUES ('S'), ('SM'), ('STANDARD'), ('ECON'), ('P'), ('LARGER')), q AS (SELECT DISTINCT p_type AS s FROM part)
SELECT q.s AS probe, CAST(max(length(d.w)) AS BIGINT) AS matched FROM q JOIN d ON starts_with(q.s, d.w) GROUP BY q.s""")
def match_prefix_longest(t):
    part = t("part")
    own = part.sparkSession.createDataFrame([(w,) for w in ("S", "SM", "STANDARD", "ECON", "P", "LARGER")], "word string")
    return D.longest_prefix(own, part.select(F.col("p_type").alias("probe")).distinct(), "probe")


@query("""
SELECT a.p_name AS a, b.p_name AS b, CAST(levenshtein(a.p_name, b.p_name) AS INT) AS d
FROM (SELECT DISTINCT p_name FROM part) a, (SELECT DISTINCT p_name FROM part) b WHERE a.p_name < b.p_name AND levenshtein(a.p_name, b.p_name) <= 2""")
def fuzzy_join(t):
    return P.fuzzy_join(D.word_set(t("part"), "p_name"), 2)


# --- Aggregations

@query("""
SELECT w AS word, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) t WHERE w <> '' GROUP BY w""")
def wordcount(t):
    return T.word_counts(words(t("documents"), "text"), F.col("word"))


@query("SELECT p_brand AS word, CAST(sum(greatest(p_size - 20, 1)) AS BIGINT) AS cnt FROM part GROUP BY p_brand")
def wordcount_weighted(t):
    return T.word_counts(t("part"), F.rtrim("p_brand"), F.col("p_size") - 20)


@query("""
SELECT w AS word, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) t WHERE w <> ''
GROUP BY w ORDER BY cnt DESC, word LIMIT 50""")
def wordcount_topk(t):
    return T.most_frequent(T.word_counts(words(t("documents"), "text"), F.col("word")), 50)


@query("SELECT CAST(strlen(text) AS BIGINT) AS len, CAST(count(*) AS BIGINT) AS cnt FROM documents GROUP BY 1")
def length_histogram(t):
    return T.histogram(t("documents"), F.octet_length("text"))


@query("""
WITH h AS (SELECT CAST(strlen(p_name) AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS c FROM part GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS distinct_key_cnt, CAST(sum(c) AS BIGINT) AS cnt_sum, CAST(sum(c * k) AS BIGINT) AS total_key_len, min(k) AS min_key, max(k) AS max_key,
(SELECT k FROM h ORDER BY c, k LIMIT 1) AS min_cnt_key, (SELECT k FROM h ORDER BY c DESC, k LIMIT 1) AS max_cnt_key FROM h""")
def histogram_summary(t):
    return T.histogram_summary(T.histogram(t("part"), F.octet_length("p_name")))


@query("""
SELECT substr(c_name, CAST(i AS INT), 1) AS cur, CAST(count(*) AS BIGINT) AS cnt FROM customer, generate_series(1, length(c_name)) g(i) GROUP BY 1""")
def char_freq_o0(t):
    return T.symbol_counts(t("customer"), "c_name")


@query("""
SELECT substr(c_name, CAST(i AS INT), 1) AS prev, substr(c_name, CAST(i AS INT) + 1, 1) AS cur, CAST(count(*) AS BIGINT) AS cnt
FROM customer, generate_series(1, length(c_name) - 1) g(i) GROUP BY 1, 2""")
def char_freq_o1(t):
    return T.symbol_counts(t("customer"), "c_name", 1)


@query("""
SELECT substr(c_name, CAST(i AS INT), 2) AS prev, substr(c_name, CAST(i AS INT) + 2, 1) AS cur, CAST(count(*) AS BIGINT) AS cnt
FROM customer, generate_series(1, length(c_name) - 2) g(i) GROUP BY 1, 2""")
def char_freq_o2(t):
    return T.symbol_counts(t("customer"), "c_name", 2)


@query("""
WITH f AS (SELECT substr(c_name, CAST(i AS INT), 1) AS ch, count(*) AS c FROM customer, generate_series(1, length(c_name)) g(i) GROUP BY 1)
SELECT round(-sum(c * log2(c / (SELECT sum(c) FROM f))) / 8, 4) AS bytes FROM f""")
def entropy_o0(t):
    return T.entropy_bytes(T.symbol_counts(t("customer"), "c_name"))


@query("""
WITH f AS (SELECT substr(c_name, CAST(i AS INT), 1) AS p, substr(c_name, CAST(i AS INT) + 1, 1) AS ch, count(*) AS c FROM customer, generate_series(1, length(c_name) - 1) g(i) GROUP BY 1, 2),
n AS (SELECT p, sum(c) AS total FROM f GROUP BY p)
SELECT round(-sum(c * log2(c / total)) / 8, 4) AS bytes FROM f JOIN n USING (p)""")
def entropy_o1(t):
    return T.entropy_bytes(T.symbol_counts(t("customer"), "c_name", 1), ["prev"])


@query("""
SELECT key, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT c_nationkey AS key FROM customer UNION ALL SELECT s_nationkey FROM supplier) t GROUP BY key HAVING count(*) >= 2""")
def equal_count(t):
    return A.equal_counts([t("customer").select("c_nationkey"), t("supplier").select("s_nationkey")], 2)


NATIONS = "SELECT c_nationkey AS key FROM customer {0} SELECT s_nationkey FROM supplier {0} SELECT n_nationkey FROM nation"


def _nations(t):
    return [t("customer").select("c_nationkey"), t("supplier").select("s_nationkey"), t("nation").select("n_nationkey")]


@query("""
SELECT key FROM (SELECT DISTINCT 0 AS w, c_nationkey AS key FROM customer UNION ALL SELECT DISTINCT 1, s_nationkey FROM supplier
UNION ALL SELECT DISTINCT 2, n_nationkey FROM nation) t GROUP BY key HAVING count(*) >= 2""")
def at_least_two_inputs(t):
    return A.in_at_least(_nations(t), 2)


@query(f"SELECT (SELECT count(*) FROM ({NATIONS.format('UNION')})) AS union_size, (SELECT count(*) FROM ({NATIONS.format('INTERSECT')})) AS intersection_size")
def set_sizes(t):
    return A.sizes(_nations(t))


@query("SELECT CAST(sum(o_custkey) AS BIGINT) AS total, round(CAST(sum(CAST(o_totalprice AS DECIMAL(38, 4))) AS DOUBLE), 2) AS price FROM orders WHERE o_orderkey BETWEEN 100 AND 5000")
def range_sum(t):
    return t("orders").where("o_orderkey BETWEEN 100 AND 5000").agg(F.sum("o_custkey").alias("total"), F.round(F.sum(F.col("o_totalprice").cast("decimal(28,4)")).cast("double"), 2).alias("price"))


@query("SELECT substr(p_name, 1, 2) AS prefix, CAST(count(DISTINCT p_name) AS BIGINT) AS cnt FROM part GROUP BY 1")
def dict_suffix_cnt(t):
    return D.word_set(t("part"), "p_name").groupBy(F.substring("word", 1, 2).alias("prefix")).agg(F.count("*").alias("cnt"))


@query("""
WITH d AS (SELECT DISTINCT p_name AS w FROM part), q AS (SELECT DISTINCT p_brand AS s FROM part)
SELECT q.s AS probe, CAST(i AS BIGINT) AS len, CAST((SELECT count(*) FROM d WHERE starts_with(d.w, substr(q.s, 1, CAST(i AS INT)))) AS BIGINT) AS cnt
FROM q, generate_series(0, length(q.s)) g(i)""")
def dict_path_suffix_cnt(t):
    part = t("part")
    return D.path_suffix_counts(D.word_set(part, "p_name"), part.select(F.col("p_brand").alias("probe")))


@query("""
SELECT left(w, CAST(i AS INT)) AS prefix, CAST(count(DISTINCT substr(w, CAST(i AS INT) + 1, 1)) AS BIGINT) AS children
FROM (SELECT DISTINCT p_type AS w FROM part), generate_series(0, 6) g(i) WHERE i < length(w) GROUP BY 1""")
def trie_child_stats(t):
    return D.child_stats(D.word_set(t("part"), "p_type"), 6)


@query("""
SELECT CAST(min(strlen(c_name)) AS BIGINT) AS min_len, CAST(max(strlen(c_name)) AS BIGINT) AS max_len, count(*) AS n, CAST(sum(strlen(c_name)) AS BIGINT) AS total,
min(c_name) AS min_key, max(c_name) AS max_key FROM customer""")
def key_stat(t):
    n = F.octet_length("c_name").cast("long")
    return t("customer").agg(F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.count("*").alias("n"), F.sum(n).alias("total"), F.min("c_name").alias("min_key"), F.max("c_name").alias("max_key"))


@query("SELECT user_id, CAST(bit_or(1 << (event_id % 30)) AS BIGINT) AS bits, CAST(bit_count(bit_or(1 << (event_id % 30))) AS INT) AS ones FROM events GROUP BY user_id")
def bitmaps(t):
    bits = F.bit_or(F.expr("shiftleft(1L, cast(event_id % 30 as int))"))
    return t("events").groupBy("user_id").agg(bits.alias("bits")).select("user_id", "bits", F.bit_count("bits").alias("ones"))


# --- Order statistics

@query("SELECT c_name AS word, CAST(row_number() OVER (ORDER BY c_name) - 1 AS BIGINT) AS id FROM (SELECT DISTINCT c_name FROM customer) t")
def dict_index(t):
    return D.dictionary(t("customer"), "c_name")


@query("""
SELECT s AS probe, CAST(coalesce(d.id, -1) AS BIGINT) AS id FROM (SELECT DISTINCT p_brand AS s FROM part UNION SELECT 'none') q
LEFT JOIN (SELECT p_brand AS w, row_number() OVER (ORDER BY p_brand) - 1 AS id FROM (SELECT DISTINCT p_brand FROM part WHERE p_size > 25)) d ON d.w = q.s""")
def dict_rank(t):
    part = t("part")
    probes = part.select(F.col("p_brand").alias("probe")).unionByName(part.sparkSession.createDataFrame([("none",)], "probe string")).distinct()
    return D.rank(D.dictionary(part.where("p_size > 25"), "p_brand"), probes)


@query("""
SELECT id, word FROM (SELECT p_name AS word, CAST(row_number() OVER (ORDER BY p_name) - 1 AS BIGINT) AS id FROM (SELECT DISTINCT p_name FROM part) t) u WHERE id % 7 = 0""")
def dict_nth(t):
    return D.nth_words(D.dictionary(t("part"), "p_name"), F.col("id") % 7 == 0)


@query("""
WITH d AS (SELECT DISTINCT c_name AS w FROM customer), q AS (SELECT DISTINCT replace(s_name, 'Supplier', 'Customer') AS q FROM supplier)
SELECT q.q AS probe, CAST(count(d.w) AS BIGINT) AS idx FROM q LEFT JOIN d ON d.w < q.q GROUP BY q.q""")
def dict_lower_bound(t):
    probes = t("supplier").select(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("probe"))
    return D.lower_bound(D.word_set(t("customer"), "c_name"), probes)


@query("SELECT p_brand, p_type, CAST(row_number() OVER (ORDER BY p_brand, p_type) - 1 AS BIGINT) AS id FROM (SELECT DISTINCT p_brand, p_type FROM part) t")
def composite_rank(t):
    return O.with_ordinal(t("part").select("p_brand", "p_type").distinct(), "p_brand", "p_type")


@query("""
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS rnk, CAST(sum(o_custkey) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS vsum FROM orders""")
def running_sum_rank(t):
    return O.running_sums(t("orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], {"rnk": F.lit(1).cast("long"), "vsum": F.col("o_custkey")}).select("o_orderkey", "rnk", "vsum")


@query("""
SELECT term, CAST(sum(df) OVER (ORDER BY term ROWS UNBOUNDED PRECEDING) - df AS BIGINT) AS begin_at, df
FROM (SELECT 'source:' || source AS term, count(DISTINCT doc_id) AS df FROM documents GROUP BY 1) t""")
def prefix_sum_offsets(t):
    df = E.metadata_terms(t("documents"), "doc_id", ["source"]).groupBy("term").agg(F.count("*").alias("df"))
    return O.running_sums(df, ["term"], {"s": F.col("df")}).select("term", (F.col("s") - F.col("df")).alias("begin_at"), "df")


@query("SELECT CAST(count(*) FILTER (l_quantity < 17) AS BIGINT) AS lower_bound, CAST(count(*) FILTER (l_quantity <= 17) AS BIGINT) AS upper_bound FROM lineitem")
def equal_range(t):
    return t("lineitem").agg(F.count_if(F.col("l_quantity") < 17).alias("lower_bound"), F.count_if(F.col("l_quantity") <= 17).alias("upper_bound"))


@query("""
SELECT event_id, CAST(sum(b) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS rank1 FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS b FROM events) t""")
def bit_rank(t):
    return O.running_sums(t("events").select("event_id", "event_type"), ["event_id"], {"rank1": F.when(F.col("event_type") == "click", 1).otherwise(0).cast("long")}).select("event_id", "rank1")


@query("""
SELECT event_id, coalesce(lag(user_id) OVER (ORDER BY event_id), -1) AS before FROM events""")
def previous_row(t):
    return O.with_previous(t("events").select("event_id", "user_id"), ["event_id"], "user_id", "before").select("event_id", F.coalesce("before", F.lit(-1)).cast("long").alias("before"))


# --- Sorts

@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS BIGINT) AS place FROM part")
def string_sort(t):
    return O.with_ordinal(t("part").select("p_partkey", "p_name"), "p_name", "p_partkey", name="place").select("p_partkey", "place")


@query("SELECT p_partkey, array_to_string(list_sort(list_transform(range(1, length(p_name) // 3 + 1), lambda i: substr(p_name, CAST(i * 3 - 2 AS INT), 3))), '') AS units FROM part")
def sort_units(t):
    n = F.floor(F.char_length("p_name") / 3).cast("int")
    units = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col("p_name"), i * 3 - 2, F.lit(3)))
    return t("part").select("p_partkey", F.array_join(F.array_sort(units), "").alias("units"))


@query("SELECT p_partkey, reverse(p_name) AS reversed FROM part")
def reverse_strings(t):
    return t("part").select("p_partkey", F.reverse("p_name").alias("reversed"))


# --- Set operations

@query(NATIONS.format("UNION ALL"))
def merge_k(t):
    return A.merge(_nations(t))


@query(NATIONS.format("UNION"))
def union_k(t):
    return A.union(_nations(t))


@query(NATIONS.format("INTERSECT"))
def intersect_k(t):
    return A.intersection(_nations(t))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def unique_rows(t):
    return t("lineitem").select("l_returnflag", "l_linestatus").dropDuplicates()


@query("SELECT DISTINCT p_name AS word FROM part WHERE p_size < 20 EXCEPT SELECT p_name FROM part WHERE p_size > 45")
def word_difference(t):
    part = t("part")
    return D.word_set(part.where("p_size < 20"), "p_name").subtract(D.word_set(part.where("p_size > 45"), "p_name"))


def _has(t, terms):
    docs = t("documents")
    return docs.select("doc_id", F.explode(F.filter(F.array(*(F.when(F.col("text").contains(x), F.lit(x)) for x in terms)), lambda x: x.isNotNull())).alias("term"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'th') INTERSECT SELECT doc_id FROM documents WHERE contains(text, 'an')")
def posting_and(t):
    return A.matching(_has(t, ["th", "an"]), A.has("th") & A.has("an"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'the') UNION SELECT doc_id FROM documents WHERE contains(text, 'ein')")
def posting_or(t):
    return A.matching(_has(t, ["the", "ein"]), A.has("the") | A.has("ein"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'an') EXCEPT SELECT doc_id FROM documents WHERE contains(text, 'the')")
def posting_sub(t):
    return A.matching(_has(t, ["an", "the"]), A.has("an") - A.has("the"))


@query("""
(SELECT doc_id FROM documents WHERE contains(text, 'an') EXCEPT SELECT doc_id FROM documents WHERE contains(text, 'the'))
UNION (SELECT doc_id FROM documents WHERE contains(text, 'the') EXCEPT SELECT doc_id FROM documents WHERE contains(text, 'an'))""")
def posting_xor(t):
    return A.matching(_has(t, ["an", "the"]), A.has("an") ^ A.has("the"))


@query("""
SELECT doc_id FROM documents, (VALUES ('th'), ('an'), ('sch')) v(t) WHERE contains(text, t) GROUP BY doc_id HAVING count(DISTINCT t) >= 2""")
def posting_minmatch(t):
    return A.matching(_has(t, ["th", "an", "sch"]), A.at_least(2, "th", "an", "sch"))


@query("""
SELECT doc_id FROM documents WHERE (lang = 'en' OR lang = 'fr') AND source <> 'src1' AND (source = 'src2' OR source = 'src3')""")
def boolean_query(t):
    terms = E.metadata_terms(t("documents"), "doc_id", ["lang", "source"])
    return A.matching(terms, (A.has("lang:en") | A.has("lang:fr")) & (A.has("source:src2") | A.has("source:src3")) - A.has("source:src1"))


# --- Keys and values

@query("SELECT o_custkey AS key, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS vals FROM orders GROUP BY o_custkey")
def kv_multi_val(t):
    return K.multi_values(t("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value")))


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS key, v AS value, CAST(i AS INT) AS col
FROM (SELECT p_partkey, unnest([p_name, p_brand, p_type]) AS v, unnest([1, 2, 3]) AS i FROM part) t""")
def kv_multi_col(t):
    return K.columns_to_rows(t("part"), "p_partkey", ["p_name", "p_brand", "p_type"])


@query("SELECT o_custkey AS key, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1")
def kv_unique_violations(t):
    return K.unique_violations(t("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("value")))


@query("""
SELECT c_custkey AS key, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) END AS value
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def kv_unique_val(t):
    return K.unique_values(t("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("value")), t("customer").select(F.col("c_custkey").alias("key")))


KEYS = "(VALUES ('S', 'x1'), ('SM', 'x2'), ('SMALL', 'x3'), ('E', 'x4'), ('E', 'x5'), ('PROMO ', 'x6')) k(key, value)"


def _keys(spark):
    return spark.createDataFrame([("S", "x1"), ("SM", "x2"), ("SMALL", "x3"), ("E", "x4"), ("E", "x5"), ("PROMO ", "x6")], "key string, value string")


@query(f"SELECT DISTINCT p_type, CAST(length(key) AS BIGINT) AS matched, value FROM part JOIN {KEYS} ON starts_with(p_type, key)")
def match_key(t):
    part = t("part")
    return K.match_keys(_keys(part.sparkSession), part.select("p_type").distinct(), "p_type")


@query(f"""
SELECT DISTINCT p_type, CAST(length(key) AS BIGINT) AS matched, value FROM part JOIN {KEYS} ON starts_with(p_type, key)
QUALIFY length(key) = max(length(key)) OVER (PARTITION BY p_type)""")
def match_key_longest(t):
    part = t("part")
    return K.match_keys(_keys(part.sparkSession), part.select("p_type").distinct(), "p_type", longest=True)


@query("""
WITH d AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS id FROM (SELECT DISTINCT split_part(p_type, ' ', 1) AS w FROM part))
SELECT DISTINCT p_type, CAST(length(w) AS BIGINT) AS matched, w AS word, CAST(id AS BIGINT) AS id FROM part JOIN d ON starts_with(p_type, w)""")
def match_dictionary(t):
    part = t("part")
    first = D.dictionary(part.select(F.substring_index("p_type", " ", 1).alias("w")), "w")
    return D.match_prefixes(first, part.select("p_type").distinct(), "p_type")


@query("""
SELECT word, src FROM (SELECT DISTINCT p_brand AS word, 'old' AS src FROM part WHERE p_size < 3) UNION ALL
SELECT DISTINCT p_brand, 'new' FROM part WHERE p_size > 48 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size < 3)""")
def insert_if_absent(t):
    part = t("part")
    own = lambda p, s: part.where(p).select(F.col("p_brand").alias("word"), F.lit(s).alias("src")).distinct()
    return D.insert_if_absent(own("p_size < 3", "old"), own("p_size > 48", "new"))


@query("""
WITH l AS (SELECT user_id AS key, event_id AS seq, value AS val, CASE WHEN event_type = 'error' THEN 'del' WHEN event_id % 3 = 0 THEN 'add' ELSE 'set' END AS op FROM events),
g AS (SELECT l.* FROM l LEFT JOIN (SELECT key, max(seq) AS gone FROM l WHERE op = 'del' GROUP BY key) d USING (key) WHERE op <> 'del' AND (gone IS NULL OR seq > gone)),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE op WHEN 'set' THEN 0 ELSE 1 END, CASE op WHEN 'set' THEN -seq ELSE seq END) AS rn FROM g)
SELECT key, seq, val FROM r WHERE rn = 1""")
def oplog_compact(t):
    op = F.when(F.col("event_type") == "error", "del").when(F.col("event_id") % 3 == 0, "add").otherwise("set")
    return K.compact_log(t("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("value").alias("val"), op.alias("op")))


# --- Patterns

HITS = """
WITH p(pid, pat) AS (VALUES (0, 'th'), (1, 'the'), (2, 'here'))
SELECT doc_id, pid, CAST(i AS BIGINT) AS pos{0} FROM documents, p, generate_series(1, length(text)) g(i) WHERE substr(text, CAST(i AS INT), length(pat)) = pat"""


WORDS = {0: "th", 1: "the", 2: "here"}


@query(HITS.format(""))
def ac_hits(t):
    return P.word_hits(t("documents"), "doc_id", "text", WORDS).select("doc_id", "pid", "pos")


@query(HITS.format(", CAST(strlen(left(text, CAST(i AS INT) - 1)) AS BIGINT) AS byte_pos"))
def ac_hits_bytes(t):
    return P.word_hits(t("documents"), "doc_id", "text", WORDS)


LENGTHS = "list_filter(generate_series(1, length(p_type)), lambda k: regexp_full_match(substr(p_type, 1, CAST(k AS INT)), 'S|STANDARD|[A-Z]+ [A-Z]'))"


@query(f"SELECT DISTINCT p_type AS s, CAST(coalesce(list_max({LENGTHS}), 0) AS BIGINT) AS len FROM part")
def regex_longest(t):
    return D.word_set(t("part"), "p_type").select(F.col("word").alias("s"), P.longest_match(F.col("word"), F.lit("S|STANDARD|[A-Z]+ [A-Z]")).alias("len"))


@query(f"SELECT DISTINCT p_type AS s, CAST(coalesce(list_min({LENGTHS}), 0) AS BIGINT) AS len FROM part")
def regex_shortest(t):
    return D.word_set(t("part"), "p_type").select(F.col("word").alias("s"), P.shortest_match(F.col("word"), F.lit("S|STANDARD|[A-Z]+ [A-Z]")).alias("len"))


@query("""
WITH p(pid, re) AS (VALUES (0, 'S[A-Z]*'), (1, '[A-Z]+ [A-Z]+'), (2, 'ECONOMY'))
SELECT s, pid, CAST(len AS BIGINT) AS len FROM (SELECT DISTINCT p_type AS s, pid,
list_max(list_filter(generate_series(1, length(p_type)), lambda k: regexp_full_match(substr(p_type, 1, CAST(k AS INT)), re))) AS len FROM part, p) WHERE len > 0""")
def regex_match_all(t):
    part = t("part")
    patterns = part.sparkSession.createDataFrame([(0, "S[A-Z]*"), (1, "[A-Z]+ [A-Z]+"), (2, "ECONOMY")], "pid int, pattern string")
    return P.match_set(D.word_set(part, "p_type").withColumnRenamed("word", "s"), "s", patterns)


@query("""
SELECT s, CAST(i AS BIGINT) AS pos, CAST(len AS BIGINT) AS len FROM (SELECT s, i, list_max(list_filter(generate_series(1, length(s) - i + 1), lambda k: regexp_full_match(substr(s, CAST(i AS INT), CAST(k AS INT)), '[AEIOU][A-Z]'))) AS len
FROM (SELECT DISTINCT p_type AS s FROM part), generate_series(1, length(s)) g(i)) WHERE len > 0""")
def regex_find_all(t):
    return P.find_all(D.word_set(t("part"), "p_type").withColumnRenamed("word", "s"), "s", "[AEIOU][A-Z]")


@query("""
SELECT s, CAST(coalesce(min(i), length(s) + 1) AS BIGINT) AS pos, CAST(CASE WHEN min(i) IS NULL THEN 0 ELSE 2 END AS BIGINT) AS len FROM (SELECT DISTINCT p_type AS s FROM part)
LEFT JOIN (SELECT DISTINCT p_type AS z, i FROM part, generate_series(1, length(p_type)) g(i) WHERE regexp_full_match(substr(p_type, CAST(i AS INT), 2), 'B[A-Z]')) ON s = z GROUP BY s""")
def regex_find_first(t):
    return P.find_first(D.word_set(t("part"), "p_type").withColumnRenamed("word", "s"), "s", "B[A-Z]")


@query("SELECT DISTINCT p_name AS s FROM part WHERE regexp_full_match(p_name, '[a-z]+ [a-z]+') AND NOT regexp_full_match(p_name, 'c.*')")
def regex_algebra(t):
    test = P.without(P.full("[a-z]+ [a-z]+"), P.full("c.*"))
    return D.word_set(t("part"), "p_name").where(test(F.col("word"))).withColumnRenamed("word", "s")


@query("SELECT c_custkey, regexp_extract(c_name, '([A-Za-z]+)#([0-9]+)', 1) AS g1, regexp_extract(c_name, '([A-Za-z]+)#([0-9]+)', 2) AS g2 FROM customer")
def regex_submatch(t):
    return t("customer").select("c_custkey", *(F.regexp_extract("c_name", "([A-Za-z]+)#([0-9]+)", i).alias(f"g{i}") for i in (1, 2)))


@query("""
WITH RECURSIVE l AS (SELECT substr('abcdefghijklmnopqrstuvwxyz ', CAST(i AS INT), 1) AS ch FROM generate_series(1, 27) g(i)),
r AS (SELECT ch, ch AS reading FROM l UNION ALL SELECT 'a', 'ah' UNION ALL SELECT 'i', 'ee' UNION ALL SELECT 'i', 'y' UNION ALL SELECT 'c', 'k'),
s AS (SELECT DISTINCT lower(p_name) AS w, 0 AS n, '' AS done FROM part
      UNION ALL SELECT w, n + 1, done || reading FROM s JOIN r ON ch = substr(w, n + 1, 1) WHERE n < length(w))
SELECT DISTINCT w AS word, done AS spelling FROM s WHERE n = length(w)""")
def reading_spellings(t):
    part = t("part")
    own = [(c, c) for c in string.ascii_lowercase + " "] + [("a", "ah"), ("i", "ee"), ("i", "y"), ("c", "k")]
    readings = part.sparkSession.createDataFrame(own, "ch string, reading string")
    return P.spellings(part.select(F.lower("p_name").alias("word")).distinct(), readings)


# --- Log and document search

TERMS = "(SELECT DISTINCT doc_id, unnest(['lang:' || lang, 'source:' || source]) AS term FROM documents)"


@query(f"SELECT term, CAST(doc_id // 100000 AS BIGINT) AS part, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS docs, CAST(count(*) AS BIGINT) AS df FROM {TERMS} t GROUP BY 1, 2")
def invidx_postings(t):
    return E.posting_lists(E.metadata_terms(t("documents"), "doc_id", ["lang", "source"]), "doc_id")


@query(f"SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM {TERMS} t GROUP BY term")
def posting_df(t):
    return E.metadata_terms(t("documents"), "doc_id", ["lang", "source"]).groupBy("term").agg(F.count("*").alias("df"))


@query(f"SELECT DISTINCT doc_id FROM {TERMS} t WHERE regexp_matches(term, '^(?:lang:[a-e])')")
def invidx_regex_search(t):
    terms = E.metadata_terms(t("documents"), "doc_id", ["lang", "source"])
    return terms.where(P.anchored("term", "lang:[a-e]")).select("doc_id").distinct()


@query(f"SELECT d.doc_id, n_chars FROM documents d WHERE doc_id IN (SELECT doc_id FROM {TERMS} t WHERE regexp_matches(term, '^(?:source:src1)'))")
def term_documents(t):
    docs = t("documents")
    terms = E.metadata_terms(docs, "doc_id", ["lang", "source"])
    return docs.join(terms.where(P.anchored("term", "source:src1")), "doc_id", "left_semi").select("doc_id", "n_chars")


@query("""
SELECT conv_id, term, CAST(count(*) AS BIGINT) AS freq FROM (SELECT conv_id, unnest(string_split_regex(lower(text), '[^\\pL\\pN]+')) AS term FROM conversations) WHERE term <> '' GROUP BY 1, 2""")
def doc_term_freq(t):
    return E.document_terms(t("conversations"), "conv_id", ["text"]).select("conv_id", "term", "freq")


@query()
def log_parse(t):
    line = F.concat_ws(" ", F.col("ts").cast("string"), F.lit("user:"), F.concat(F.lit("id="), F.col("user_id").cast("string")), "event_type", "props")
    return E.parse_log(t("events").select("event_id", line.alias("line")), "event_id", "line")


@query("SELECT 'type:' || event_type || chr(9) || props || chr(9) || 'u' || user_id AS line FROM events")
def log_convert(t):
    events = t("events")
    terms = events.select("event_id", F.lit("type").alias("field"), F.col("event_type").alias("term"))
    return E.log_lines(terms, events, "event_id", "props", F.concat(F.lit("u"), F.col("user_id").cast("string")))


@query("""
SELECT field || ':' || val AS term, CAST(count(*) AS BIGINT) AS people FROM (SELECT unnest(['nation', 'segment']) AS field, unnest([CAST(c_nationkey AS VARCHAR), c_mktsegment]) AS val FROM customer) GROUP BY 1""")
def people_index(t):
    rows = t("customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return E.metadata_terms(rows, "c_custkey", ["nation", "segment"]).groupBy("term").agg(F.count("*").alias("people"))


@query("SELECT conv_id, CAST(least(count(*), 255) AS BIGINT) AS freq FROM (SELECT conv_id, unnest(string_split(text, ' ')) AS w FROM conversations) WHERE w <> '' GROUP BY conv_id")
def capped_frequency(t):
    found = t("conversations").select("conv_id", F.explode(F.split("text", " ")).alias("w")).where("w <> ''")
    return found.groupBy("conv_id").agg(F.least(F.count("*"), F.lit(255)).cast("long").alias("freq"))


# --- Scalar functions

@query("SELECT p_partkey, translate(p_name, ' ', '-') AS r1, replace(p_name, 'wi', 'WI') AS r2, hex(p_name) AS h FROM part")
def replace_funcs(t):
    return t("part").select("p_partkey", F.translate("p_name", " ", "-").alias("r1"), F.replace("p_name", F.lit("wi"), F.lit("WI")).alias("r2"), F.hex("p_name").alias("h"))


@query("SELECT p_partkey, substr(p_name, 2, 3) AS mid, left(p_name, 3) AS head, right(p_name, 3) AS tail, trim(p_type) AS trimmed, CAST(strlen(p_name) AS BIGINT) AS size FROM part")
def substring_funcs(t):
    return t("part").select(
        "p_partkey", F.substring("p_name", 2, 3).alias("mid"), F.expr("left(p_name, 3)").alias("head"), F.expr("right(p_name, 3)").alias("tail"), F.trim("p_type").alias("trimmed"), F.octet_length("p_name").cast("long").alias("size")
    )


@query("""
SELECT s_suppkey, CAST((SELECT coalesce(max(i), 0) FROM generate_series(1, 18) g(i) WHERE substr(s_name, 1, CAST(i AS INT)) = substr('Supplier#000000004', 1, CAST(i AS INT)) AND i <= length(s_name)) AS BIGINT) AS cpl FROM supplier""")
def common_prefix_len(t):
    return t("supplier").select("s_suppkey", S.common_prefix_length(F.col("s_name"), F.lit("Supplier#000000004")).alias("cpl"))


@query("SELECT p_partkey, split_part(p_type, ' ', 2) AS second, array_to_string(string_split(p_type, ' '), '|') AS joined, CAST(len(string_split(p_type, ' ')) AS BIGINT) AS n FROM part")
def split_join(t):
    parts = S.split_fields(F.col("p_type"), " ")
    return t("part").select("p_partkey", S.field(F.col("p_type"), " ", 1).alias("second"), F.array_join(parts, "|").alias("joined"), F.size(parts).cast("long").alias("n"))


@query("SELECT c_custkey, base64(encode(c_name)) AS b64, CAST(from_base64(base64(encode(c_name))) AS VARCHAR) = c_name AS same FROM customer")
def base64_codec(t):
    return t("customer").select("c_custkey", F.base64(F.col("c_name").cast("binary")).alias("b64"), (F.unbase64(F.base64(F.col("c_name").cast("binary"))).cast("string") == F.col("c_name")).alias("same"))


@query("SELECT item_id, replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n') AS escaped FROM benchmark")
def c_escape(t):
    return t("benchmark").select("item_id", S.c_escape(F.col("text")).alias("escaped"))


@query("SELECT page_id, split_part(regexp_extract(url, '[?](.*)$', 1), '=', 1) AS k FROM pages")
def url_query_args(t):
    return t("pages").select("page_id", F.coalesce(F.get(S.query_args(F.col("url")), F.lit(0))["key"], F.lit("")).alias("k"))


@query("SELECT p_partkey, replace(p_name, ' ', '%20') || '/x' AS encoded, p_name || '/x' AS decoded FROM part")
def url_codec(t):
    path = F.concat("p_name", F.lit("/x"))
    return t("part").select("p_partkey", S.url_encode(path).alias("encoded"), S.url_decode(S.url_encode(path)).alias("decoded"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(strlen(text) AS BIGINT) AS bytes, CAST(length(regexp_replace(text, '[\\x00-\\x7F]+', 'a', 'g')) AS BIGINT) AS units FROM documents")
def utf8_lengths(t):
    return t("documents").select("doc_id", F.char_length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), S.hanzi_count(F.col("text")).alias("units"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, coalesce(TRY_CAST(event_type AS INT), -1) AS none, CAST(user_id AS VARCHAR) AS user_text FROM events")
def casts(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.expr("coalesce(try_cast(event_type as int), -1)").alias("none"), F.col("user_id").cast("string").alias("user_text"))


@query()
def hashes(t):
    n = F.col("c_name")
    return t("customer").select("c_custkey", F.crc32(n.cast("binary")).alias("crc"), F.xxhash64(n).alias("xx"))


@query("SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS seconds, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS shown, CAST(year(o_orderdate) AS INT) AS year FROM orders")
def dates(t):
    at = F.col("o_orderdate").cast("timestamp")
    return t("orders").select("o_orderkey", F.unix_timestamp(at).alias("seconds"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("shown"), F.year("o_orderdate").alias("year"))


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS BIGINT) AS place FROM customer")
def byte_ordered_sort(t):
    code = t("customer").select("c_custkey", S.byte_ordered(F.col("c_acctbal")).alias("code"))
    return O.with_ordinal(code, "code", "c_custkey", name="place").select("c_custkey", "place")


# --- Windows over event time, an extension

@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(t):
    from skarn.streaming.realtime import tumbling

    out = tumbling(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "user_id", "1 hour")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))
