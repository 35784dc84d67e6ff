"""Queries on patterns and inverted indexes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.operators import dictionary as D
from skarn.operators import etl as E
from skarn.operators import patterns as P
from skarn.operators import setops as A
from skarn.plans.registry import query

WORDS = {0: "th", 1: "the", 2: "here", 3: "he", 4: "he"}

HITS = """
WITH p(pid, pat) AS (VALUES (0, 'th'), (1, 'the'), (2, 'here'), (3, 'he'), (4, 'he')),
h AS (SELECT doc_id, pid, pat, CAST(i AS BIGINT) AS pos FROM documents, p, generate_series(1, length(text)) g(i) WHERE substr(text, CAST(i AS INT), length(pat)) = pat)
"""


@query(HITS + "SELECT doc_id, pid, pos, CAST(row_number() OVER (PARTITION BY doc_id, pos ORDER BY length(pat) DESC, pid) AS INT) AS nth FROM h")
def ac_reverse_hits(t):
    hits = P.word_hits(t("documents"), "doc_id", "text", WORDS).select("doc_id", "pid", "pos")
    return P.reverse_hits(hits, "doc_id", WORDS)


@query(HITS + "SELECT pid, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs FROM h GROUP BY pid")
def ac_hit_counts(t):
    hits = P.word_hits(t("documents"), "doc_id", "text", WORDS)
    by_doc = hits.groupBy("pid", "doc_id").agg(F.count("*").alias("n"))
    return by_doc.groupBy("pid").agg(F.sum("n").alias("hits"), F.count("*").alias("docs"))


NAMED = {"address": "[a-z0-9.]+@[a-z0-9]+[.][a-z]+", "number": "[0-9]{3,}", "umlaut": "[äöüß]", "shout": "[A-Z]{6,}"}


@query("""
SELECT doc_id, array_to_string(list_filter(['address', 'number', 'umlaut', 'shout'], lambda n: CASE n WHEN 'address' THEN regexp_matches(text, '[a-z0-9.]+@[a-z0-9]+[.][a-z]+')
 WHEN 'number' THEN regexp_matches(text, '[0-9]{3,}') WHEN 'umlaut' THEN regexp_matches(text, '[äöüß]') ELSE regexp_matches(text, '[A-Z]{6,}') END), ',') AS names FROM documents WHERE text IS NOT NULL""")
def regex_set_hits(t):
    docs = t("documents").where("text is not null")
    return docs.select("doc_id", F.array_join(P.has_hit(F.col("text"), NAMED), ",").alias("names"))


SHORT = "(SELECT DISTINCT w AS s FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE w <> '')"
PREFIXES = "list_max(list_filter(generate_series(1, length(s)), lambda k: regexp_full_match(substr(s, 1, CAST(k AS INT)), re)))"
MATCHES = f"""
WITH p(pid, re) AS (VALUES (0, '[a-z]*th'), (1, '[a-z]+e'), (2, 'the|there'), (3, '[A-Z][a-z]*')),
m AS (SELECT s, pid, CAST({PREFIXES} AS BIGINT) AS len FROM {SHORT}, p)
"""


def _matches(t):
    words = t("benchmark").select(F.explode(F.split("text", " ")).alias("s")).where("s <> ''").distinct()
    patterns = [(0, "[a-z]*th"), (1, "[a-z]+e"), (2, "the|there"), (3, "[A-Z][a-z]*")]
    return P.match_set(words, "s", words.sparkSession.createDataFrame(patterns, "pid int, pattern string"))


@query(MATCHES + "SELECT s, pid, len FROM m WHERE len > 0")
def regex_match_all_lengths(t):
    return _matches(t)


@query(MATCHES + "SELECT s, len, string_agg(CAST(pid AS VARCHAR), ',' ORDER BY pid) AS pids FROM m WHERE len > 0 GROUP BY s, len QUALIFY len = max(len) OVER (PARTITION BY s)")
def regex_longest_ids(t):
    found = P.longest_ids(_matches(t), "s")
    return found.select("s", "len", F.array_join(F.transform("pids", lambda x: x.cast("string")), ",").alias("pids"))


@query(f"""
SELECT s, CAST(i AS BIGINT) AS pos, CAST(length(s) - i + 1 AS BIGINT) AS rest FROM {SHORT}, generate_series(1, length(s)) g(i) WHERE regexp_matches(substr(s, CAST(i AS INT)), '^(?:[aeiou][a-z])')""")
def regex_find_all_rest(t):
    words = t("benchmark").select(F.explode(F.split("text", " ")).alias("s")).where("s <> ''").distinct()
    return P.find_all(words, "s", "[aeiou][a-z]").select("s", "pos", (F.char_length("s") - F.col("pos") + 1).cast("long").alias("rest"))


@query("""
WITH w AS (SELECT DISTINCT p_name AS w FROM part), q AS (SELECT DISTINCT lower(p_type) AS s FROM part UNION SELECT DISTINCT lower(c_mktsegment) FROM customer),
o AS (SELECT cut, count(*) AS freq FROM (SELECT substr(w, CAST(i AS INT), CAST(k AS INT)) AS cut FROM w, generate_series(1, length(w)) g(i), generate_series(2, length(w) - i + 1) h(k)) GROUP BY cut HAVING count(*) >= 2),
m AS (SELECT s, i, k, freq FROM q, generate_series(1, length(s)) g(i), generate_series(2, length(s) - i + 1) h(k), o WHERE cut = substr(s, CAST(i AS INT), CAST(k AS INT)))
SELECT s, CAST(i AS BIGINT) AS pos, CAST(max(k) AS BIGINT) AS len, CAST(max_by(freq, k) AS BIGINT) AS freq FROM m GROUP BY s, i""")
def suffix_longest_match(t):
    texts = t("part").select(F.lower("p_type").alias("s")).unionByName(t("customer").select(F.lower("c_mktsegment").alias("s")))
    return P.longest_frequent(texts, "s", D.word_set(t("part"), "p_name"), 2, 2)


# --- Inverted indexes

@query("""
SELECT doc_id FROM documents WHERE (lang = 'en' AND source <> 'src1') <> (source = 'src2' AND lang IN ('de', 'fr'))
UNION SELECT doc_id FROM documents WHERE source = 'src3' AND lang = 'es'""")
def boolean_precedence(t):
    terms = E.metadata_terms(t("documents"), "doc_id", ["lang", "source"])
    lang, source = (lambda x: A.has(f"lang:{x}")), (lambda x: A.has(f"source:{x}"))
    return A.matching(terms, lang("en") - source("src1") ^ source("src2") & (lang("de") | lang("fr")) | source("src3") & lang("es"))


WORD_ROWS = "(SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\pL\\pN]+')) AS term FROM documents)"


@query(f"""
SELECT term, CAST(doc_id // 100000 AS BIGINT) AS part, CAST(count(DISTINCT doc_id) AS BIGINT) AS df, min(doc_id) AS first_doc, max(doc_id) AS last_doc, CAST(count(*) AS BIGINT) AS hits
FROM {WORD_ROWS} WHERE term <> '' GROUP BY 1, 2""")
def text_postings(t):
    return E.document_postings(t("documents"), "doc_id", "text")


@query(f"""
SELECT d.doc_id, d.source, CAST(strlen(d.text) AS BIGINT) AS stored FROM documents d WHERE doc_id IN (SELECT doc_id FROM {WORD_ROWS} WHERE term = 'the')
AND doc_id IN (SELECT doc_id FROM {WORD_ROWS} WHERE term = 'of')""")
def text_search(t):
    docs = t("documents")
    terms = E.document_terms(docs, "doc_id", ["text"]).select("doc_id", "term")
    found = A.matching(terms, A.has("the") & A.has("of"))
    return docs.join(found, "doc_id", "left_semi").select("doc_id", "source", F.octet_length("text").cast("long").alias("stored"))


@query("""
SELECT conv_id, term, CAST(least(sum(n), 255) AS BIGINT) AS freq FROM (SELECT conv_id, term, count(*) AS n FROM
(SELECT conv_id, unnest(string_split_regex(lower(text), '[^\\pL\\pN]+')) AS term FROM conversations) WHERE term <> '' GROUP BY 1, 2) GROUP BY 1, 2""")
def term_byte_freq(t):
    terms = E.document_terms(t("conversations"), "conv_id", ["text"])
    return terms.select("conv_id", "term", F.least("freq", F.lit(255)).alias("freq"))


@query()
def log_postings(t):
    # An index over parsed log lines; the scanner of lines has no SQL.
    line = F.concat_ws(" ", F.col("ts").cast("string"), F.concat(F.lit("id="), F.col("user_id").cast("string")), "event_type", "props")
    terms = E.parse_log(t("events").select("event_id", line.alias("line")), "event_id", "line")
    return E.posting_ranges(terms.withColumn("term", F.concat_ws(":", "field", "term")), "event_id", 1000)


@query("""
SELECT to_json({'doc_id': doc_id, 'source': source, 'terms': [lang, source]}) AS line FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""")
def result_json(t):
    docs = t("documents").where("lang is not null and source is not null")
    return docs.select(F.to_json(F.struct("doc_id", "source", F.array("lang", "source").alias("terms"))).alias("line"))
