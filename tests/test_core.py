"""Operators of the core on small inputs: fixtures, edge cases, models in plain Python."""

import os
import random
import subprocess
import sys
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skarn.functions import scalar as S
from skarn.operators import dictionary as D
from skarn.operators import etl as E
from skarn.operators import kv as K
from skarn.operators import ordered as O
from skarn.operators import patterns as P
from skarn.operators import setops as A
from skarn.operators import stats as T


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def words(spark, own):
    return spark.createDataFrame([(w,) for w in own], "word string")


OWN_WORDS = ["river", "riverbank", "rivers", "", "riv", "rowan", "river", "rowans", "zebra"]


def test_dictionary_ordinals(spark):
    d = D.dictionary(words(spark, OWN_WORDS), "word")
    assert rows(d) == sorted((w, i) for i, w in enumerate(sorted(set(OWN_WORDS))))
    back = D.nth_words(d, F.col("id") == 3).collect()
    assert back[0].word == sorted(set(OWN_WORDS))[3]


def test_empty_dictionary(spark):
    d = D.dictionary(words(spark, []), "word")
    probes = spark.createDataFrame([("",), ("1",), ("9",)], "probe string")
    assert rows(D.rank(d, probes)) == [("", -1), ("1", -1), ("9", -1)]
    assert rows(D.lower_bound(d, probes)) == [("", 0), ("1", 0), ("9", 0)]


def test_lower_bound_model(spark):
    r = random.Random(3)
    own = sorted({"".join(r.choices("abc", k=r.randint(0, 4))) for _ in range(60)})
    probes = sorted({"".join(r.choices("abcd", k=r.randint(0, 4))) for _ in range(40)})
    got = dict(rows(D.lower_bound(words(spark, own), spark.createDataFrame([(p,) for p in probes], "probe string"))))
    assert got == {p: sum(w < p for w in own) for p in probes}


def test_prefix_lookups(spark):
    d = D.dictionary(words(spark, ["a", "ab", "b"]), "word")
    texts = spark.createDataFrame([("abc",), ("x",), ("",)], "t string")
    assert rows(D.match_prefixes(d, texts, "t")) == [("abc", 1, "a", 0), ("abc", 2, "ab", 1)]
    assert rows(D.longest_prefix(d.select("word"), texts, "t")) == [("abc", 2)]
    counts = rows(D.path_suffix_counts(d.select("word"), spark.createDataFrame([("ab",)], "probe string")))
    assert counts == [("ab", 0, 3), ("ab", 1, 2), ("ab", 2, 1)]


def test_running_sums_over_ranges(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("v"))
    got = {r.id: r.s for r in O.running_sums(df, ["id"], {"s": F.col("v")}).collect()}
    total = 0
    for i in range(1000):
        total += i % 7
        assert got[i] == total


def test_sorted_runs(spark):
    for values in ([], [5, 5, 5], [5, 4, 3, 2], [1, 2, 2, 1, 7, 3]):
        df = spark.createDataFrame(list(enumerate(values)), "pos long, v long")
        got = [r.run for r in E.sorted_runs(df, ["pos"], "v").orderBy("pos").collect()]
        run, want = 0, []
        for k, v in enumerate(values):
            run += k > 0 and values[k - 1] > v
            want.append(run)
        assert got == want


def test_previous_across_ranges(spark):
    got = {r.id: r.previous for r in O.with_previous(spark.range(50).withColumn("v", F.col("id") * 2), ["id"], "v").collect()}
    assert got == {0: None} | {i: 2 * (i - 1) for i in range(1, 50)}


def test_oplog(spark):
    log = [(1, "add", "a", 1), (2, "add", "a", 2), (3, "add", "b", 3), (4, "set", "b", 4), (5, "del", "b", None), (6, "add", "b", 6), (7, "set", "c", 7), (8, "del", "d", None)]
    got = rows(K.compact_log(spark.createDataFrame(log, "seq long, op string, key string, val long")))
    assert got == [("a", 1, 1), ("b", 6, 6), ("c", 7, 7)]
    r = random.Random(4)
    many, want = [(i, r.choice(["add", "set", "del"]), f"k{r.randrange(12)}", i) for i in range(90)], {}
    for seq, op, key, val in many:
        if op == "del":
            want.pop(key, None)
        elif op == "set" or key not in want:
            want[key] = (seq, val)
    got = rows(K.compact_log(spark.createDataFrame(many, "seq long, op string, key string, val long")))
    last = {k: max((s for s, o, x, _ in many if x == k and o == "del"), default=-1) for k in want}
    first = {k: min([s for s, o, x, _ in many if x == k and o == "set" and s > last[k]][-1:] or [s for s, o, x, _ in many if x == k and o == "add" and s > last[k]]) for k in want}
    assert got == sorted((k, s, s) for k, s in first.items())


def test_unique_value_is_strict(spark):
    kv = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "key string, value string")
    keys = spark.createDataFrame([("a",), ("b",), ("z",)], "key string")
    assert {r.key: r.value for r in K.unique_values(kv, keys).collect()} == {"a": None, "b": "3", "z": None}
    with pytest.raises(Exception, match="several values"):
        K.unique_values(kv, keys, strict=True).collect()


def test_set_algebra(spark):
    ways = [spark.createDataFrame([(x,) for x in w], "k long") for w in ([1, 1, 2, 3], [2, 3, 3, 4], [3, 5])]
    assert rows(A.intersection(ways)) == [(3,)]
    assert rows(A.union(ways)) == [(1,), (2,), (3,), (4,), (5,)]
    assert rows(A.equal_counts(ways, 2)) == [(1, 2), (2, 2), (3, 4)]
    assert rows(A.in_at_least(ways, 2)) == [(2,), (3,)]
    assert rows(A.sizes(ways)) == [(5, 1)]
    assert rows(A.multiset_intersection(ways[0].toDF("key"), ways[1].toDF("key"), "key")) == [(2,), (3,)]


def test_boolean_queries(spark):
    postings = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "b"), (3, "c"), (4, "f:x y")], "doc_id long, term string")
    a, b, c = (A.has(x) for x in "abc")
    cases = [(a & b, {1}), (a | c, {1, 2, 3}), (a - b, {2}), (a ^ b, {2, 3}), ((a | b) - c, {1, 2}), (A.at_least(2, "a", "b", "c"), {1, 3})]
    cases += [(A.has("f:x y"), {4}), (a | b - c, {1, 2}), (a & b ^ c, {1, 3}), (A.at_least(0), set())]
    for q, want in cases:
        assert {r.doc_id for r in A.matching(postings, q).collect()} == want


def test_regex_longest_is_not_first(spark):
    df = spark.createDataFrame([("xyz", "x|xyz"), ("aaab", "a{1,3}|ab"), ("q", "x"), ("", "x")], "s string, p string")
    got = [tuple(r) for r in df.select("s", P.longest_match(F.col("s"), F.col("p")), P.shortest_match(F.col("s"), F.col("p"))).collect()]
    assert got == [("xyz", 3, 1), ("aaab", 3, 1), ("q", 0, 0), ("", 0, 0)]
    r = random.Random(2)
    import re

    cases = [("".join(r.choices("ab\nc", k=r.randint(0, 9))), r.choice(["a|ab|abab", "(ab|a)*c?", "[ab]{2,5}", "b*", "a[\\s\\S]c", "c+|cab"])) for _ in range(120)]
    got = spark.createDataFrame(cases, "s string, p string").select("s", "p", P.longest_match(F.col("s"), F.col("p")), P.shortest_match(F.col("s"), F.col("p"))).collect()
    for text, p, long, short in got:
        lengths = [k for k in range(1, len(text) + 1) if re.fullmatch(p, text[:k])]
        assert (long, short) == (max(lengths, default=0), min(lengths, default=0)), (text, p)


def test_overlapping_hits(spark):
    texts = spark.createDataFrame([(1, "ababa"), (2, ""), (3, None)], "k long, t string")
    own = {0: "aba", 1: "b", 2: "zzzzzzzz", 3: "b", 4: ""}
    hits = P.word_hits(texts, "k", "t", own)
    assert rows(hits.select("k", "pid", "pos")) == [(1, 0, 1), (1, 0, 3), (1, 1, 2), (1, 1, 4), (1, 3, 2), (1, 3, 4)]
    assert rows(P.reverse_hits(hits, "k", own).where("pos = 2").select("pid", "nth")) == [(1, 1), (3, 2)]
    assert rows(P.word_hits(texts, "k", "t", {})) == []
    odd = spark.createDataFrame([(1, "éaéa")], "k long, t string")
    assert rows(P.word_hits(odd, "k", "t", {0: "a"}).select("pos", "byte_pos")) == [(2, 2), (4, 5)]


def test_pattern_sets(spark, tmp_path):
    (tmp_path / "set.txt").write_text("a.c\tfirst\n\nx+\n")
    path = str(tmp_path / "set.txt")
    assert rows(P.read_patterns(spark, path)) == [("3", "x+"), ("first", "a.c")]
    word = P.read_patterns(spark, path, ignore_case=True, literal=True).where("name = 'first'")
    test = spark.createDataFrame([("zA.Cz",), ("abc",)], "t string").join(F.broadcast(word), F.expr("t rlike pattern"))
    assert [r.t for r in test.collect()] == ["zA.Cz"]
    texts = spark.createDataFrame([("abc xx",), ("none",)], "t string")
    assert [r[0] for r in texts.select(P.has_hit(F.col("t"), {"x": "x+", "a": "a.c", "q": "q"})).collect()] == [["x", "a"], []]


def test_pattern_sets_in_a_fresh_session(tmp_path):
    # Columns have small numbers only in a new process; the numbers are those of the query on part.
    code = """
from pyspark.sql import SparkSession
from skarn.operators import dictionary as D, patterns as P
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
part = spark.read.schema("a long, b string, c string, t string, d long, e double").csv("part.csv")
patterns = spark.createDataFrame([(0, "S[A-Z]*"), (1, "[A-Z]+ [A-Z]+"), (2, "LA|L"), (3, "Q*")], "pid int, pattern string")
found = P.match_set(D.word_set(part, "t").withColumnRenamed("word", "s"), "s", patterns)
print("found", sorted(map(tuple, found.collect())), sorted(map(tuple, found.where("len > 2").collect())))
"""
    (tmp_path / "part.csv").write_text("0,n,b,SMALL,1,1.0\n1,n,b,,1,1.0\n2,n,b,LARGE S,1,1.0\n")
    env = os.environ | {"PYTHONPATH": str(Path(P.__file__).resolve().parents[2])}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120).stdout
    assert f"found {[('LARGE S', 1, 7), ('LARGE S', 2, 2), ('SMALL', 0, 5)]} {[('LARGE S', 1, 7), ('SMALL', 0, 5)]}" in said


def test_swaps(spark):
    own = ["abcd", "abdc", "bacd", "abcde", "ab", "ba", "zz", "aabb", "abab"]
    want = [("abcd", "abdc"), ("abcd", "bacd"), ("abcd", "abcde"), ("ab", "ba"), ("aabb", "abab")]
    assert rows(P.fuzzy_join_swaps(words(spark, own))) == sorted(want)


def test_dictionary_cursors(spark):
    d = D.dictionary(words(spark, ["a/b", "a/c", "a/c/d", "b"]), "word")
    probes = spark.createDataFrame([("a/c",), ("a/d",), ("z",)], "probe string")
    assert rows(D.seek(d, probes)) == [("a/c", 1, "a/c", 3, True), ("a/d", 3, "b", 0, False), ("z", 4, None, 0, False)]
    assert rows(D.longest_shared_prefix(d.select("word"), probes)) == [("a/c", 3), ("a/d", 2), ("z", 0)]
    assert rows(D.step_counts(d.select("word"), probes, "/")) == [("a/c", 1, 3), ("a/c", 2, 2), ("a/d", 1, 3), ("a/d", 2, 0), ("z", 1, 0)]
    assert rows(D.first_difference_counts(d.select("word"))) == [(0, 1), (2, 1), (3, 1)]
    near = {("a/b", None, "a/c"), ("a/c", "a/b", "a/c/d"), ("a/c/d", "a/c", "b"), ("b", "a/c/d", None)}
    assert {(r.word, r.before, r.after) for r in D.neighbours(d).collect()} == near
    assert D.word_stats(d.select("word")).first().prefixes == 8


def test_bits_and_ranges(spark):
    bits = [1, 1, 0, 1, 0, 0, 1, 1, 1]
    df = spark.createDataFrame(list(enumerate(bits)), "at long, b int")
    one = F.col("b") == 1
    assert rows(O.runs_of_ones(df, "at", one).select("start", "len")) == [(0, 2), (3, 1), (6, 3)]
    assert [r.at for r in O.select_bits(df, ["at"], one).orderBy("k").collect()] == [i for i, b in enumerate(bits) if b]
    assert [r.rank0 for r in O.bit_ranks(df, ["at"], one).orderBy("at").collect()] == [0, 0, 1, 1, 2, 3, 3, 3, 3]
    assert rows(O.split_ranges(df, ["at"], F.lit(10), 3).select("part", "offset", "length")) == [(0, 0, 30), (1, 30, 30), (2, 60, 30)]


def test_checksums_and_codes(spark):
    from skarn.functions import checksums

    df = spark.createDataFrame([("123456789",), ("",), (None,), ("a",)], "t string")
    both = df.select("t", checksums.crc32c(F.col("t")).alias("c"), checksums.crc16(F.col("t")).alias("d"))
    got = {r.t: (r.c, r.d) for r in both.collect()}
    assert got["123456789"] == (0xE3069283, 0x906E) and got[""] == (0, 0) and got[None] == (None, None)
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    for text in ('a\\n"b"\t\\\\r\n', "\\", ""):
        assert get(S.c_unescape(S.c_escape(F.lit(text)))) == text
    assert get(S.whole_word_count(F.lit("an an. ban an_ éan (an)"), "an")) == 3
    assert get(S.utf16_hex(F.lit("aé😀"))) == "aé😀".encode("utf-16-be").hex().upper()
    assert get(S.hex_decode(F.lit("C3A9"))) == "é"


def test_byte_counts(spark):
    texts = ["abab", "é", None, "", "b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    for order in (0, 1, 2):
        want = {}
        for t in texts:
            b = (t or "").encode()
            for i in range(len(b) - order):
                k = (b[i : i + order].hex().upper(), b[i + order : i + order + 1].hex().upper())
                want[k] = want.get(k, 0) + 1
        assert {(r.prev if order else "", r.cur): r.cnt for r in T.byte_counts(df, "t", order).collect()} == want


class Caught(Exception):
    """Carries the function that a step gives to ``mapInArrow``."""


class Frame:
    """In place of a table, to have that function."""

    schema = StructType().add("k", "long")

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        raise Caught(function)


def peak_bytes(step, batch):
    """Most bytes that Python and NumPy hold at once while a step takes one batch, and the rows of what it yields."""
    with pytest.raises(Caught) as caught:
        step(Frame())
    tracemalloc.start()
    try:
        sizes = [b.num_rows for b in caught.value.args[0](iter([batch]))]
        return tracemalloc.get_traced_memory()[1], sizes
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("order", [0, 1, 2, 4])
def test_byte_counts_in_slices(spark, monkeypatch, order):
    texts = pa.RecordBatch.from_arrays([pa.array(["ab" * 2000, None, "", "xyz"] * 4000)], ["t"])  # 16 MB in one batch
    peak, _ = peak_bytes(lambda df: T.byte_counts(df, "t", order), texts)
    assert peak < 48 << 20
    own = ["abab", "é", None, "", "b", "abcabcabd", "a", "bc"] * 3
    df = spark.createDataFrame([(t,) for t in own], "t string").coalesce(1)
    want = rows(T.byte_counts(df, "t", order))
    total = sum(max(len((t or "").encode()) - order, 0) for t in own)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(T, "SLICE", size)
        got = rows(T.byte_counts(df, "t", order))
        assert got == want and sum(r[-1] for r in got) == total
        if order:
            sizes = [rows(T.entropy_bytes(c, ["prev"])) for c in (T.byte_counts(df, "t", order), spark.createDataFrame(want, "prev string, cur string, cnt long"))]
            assert sizes[0] == sizes[1]


def test_hits_in_bounded_batches(spark, monkeypatch):
    texts = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(["ab" * 500] * 499 + ["ab" * 200_000])], ["k", "t"])
    peak, sizes = peak_bytes(lambda df: P.word_hits(df, "k", "t", {0: "ab", 1: "b"}), texts)
    assert sum(sizes) == 2 * (499 * 500 + 200_000) and max(sizes) <= 1 << 16 and peak < 24 << 20
    df = spark.createDataFrame([(1, "ababa"), (2, "éaéa"), (3, None), (4, "aaaa")], "k long, t string").coalesce(1)
    want = rows(P.word_hits(df, "k", "t", {0: "a", 1: "ba", 2: "a"}))
    for most in (1, 2, 5):
        monkeypatch.setattr(P, "HITS", most)
        hits = P.word_hits(df, "k", "t", {0: "a", 1: "ba", 2: "a"})
        assert rows(hits) == want
        by_doc = hits.groupBy("pid", "k").agg(F.count("*").alias("n"))  # a document's hits come in several batches
        assert rows(by_doc.groupBy("pid").agg(F.sum("n"), F.count("*"))) == [(0, 9, 3), (1, 2, 1), (2, 9, 3)]


def test_postings_of_texts(spark):
    texts = [(1, "A a b"), (1, "a c"), (2, None), (2, "b b"), (None, "a"), (None, "a z"), (7, ""), (100_001, "a-a"), (5, "é É x1"), (8, "b")]
    df = spark.createDataFrame(texts, "k long, t string").repartition(3)
    columns = ["term", "part", "df", "first_doc", "last_doc", "hits"]
    want = E.posting_ranges(E.document_terms(df, "k", ["t"]), "k").select(columns).collect()
    got = E.document_postings(df, "k", "t").select(columns).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and ("b", 0, 3, 1, 8, 4) in map(tuple, got)


def test_postings_shuffle_less_than_a_row_a_term(spark, tmp_path):
    from skarn.plans import registry

    docs = [(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(80))) for i in range(400)]  # 32,000 terms of documents, 90 different ones
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.queries()["text_postings"](spark, str(tmp_path))
    assert found.count() == 90
    found.collect()
    seen, todo = [], [found._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange":
            seen.append(node.metrics().apply("shuffleRecordsWritten").value())
    assert seen and sum(seen) < 5_000


def test_lookup_of_repeated_keys_is_an_error(spark):
    left, side = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(Exception, match="several answers"):
        E.lookup_join(left, side, {"k": "k"}, {"v": "v"}).collect()
    assert E.lookup_join(left, side, {"k": "k"}, {"v": "v"}, check=False).count() == 3


def test_fuzzy_join_model(spark):
    r = random.Random(5)
    own = sorted({"".join(r.choices("abc", k=r.randint(0, 6))) for _ in range(60)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = sorted((a, b, distance(a, b)) for a in own for b in own if a < b and distance(a, b) <= 2)
    assert rows(P.fuzzy_join(words(spark, own), 2)) == want


def test_spellings(spark):
    readings = spark.createDataFrame([("x", "xi"), ("x", "she"), ("y", "yu")], "ch string, reading string")
    own = words(spark, ["xy", "x", "xz"])
    assert rows(P.spellings(own, readings)) == [("x", "she"), ("x", "xi"), ("xy", "sheyu"), ("xy", "xiyu")]
    short = {s for w, s in rows(P.spellings(own, readings, initials_from=2)) if w == "xy"}
    assert short == {a + b for a in ("xi", "x", "she", "s") for b in ("yu", "y")}
    assert ("x", "s") not in rows(P.spellings(own, readings, initials_from=2))


def test_literal_prefix():
    assert P.literal_prefix("lang:[a-e]") == "lang:"
    assert P.literal_prefix("ab*c") == "a"
    assert P.literal_prefix("ab|c") == ""
    assert P.literal_prefix("(a|b)") == ""
    assert P.literal_prefix("ab|(cd)") == ""


def test_log_scanner(spark):
    lines = spark.createDataFrame([(1, "2024-01-02 03:04:05 GET 10.0.0.1 user=Bob user=bob"), (2, None), (3, "")], "d long, l string")
    got = rows(E.parse_log(lines, "d", "l"))
    assert got == [(1, "datetime", "2024-01-02 03:04:05", 1), (1, "ip", "10.0.0.1", 1), (1, "user", "bob", 2)]


def test_replacements(spark):
    cases = [("x--y---z", "--", "+", "x+y+-z"), ("oooo", "oo", "o", "oo"), ("tide", "q", "r", "tide"), ("", "a", "b", "")]
    df = spark.createDataFrame(cases, "t string, a string, b string, want string")
    assert all(r[0] == r[1] for r in df.select(F.replace("t", F.col("a"), F.col("b")), "want").collect())
    assert spark.range(1).select(F.translate(F.lit("k/l:m/"), "/:", "_=")).first()[0] == "k_l=m_"


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(S.split_fields(F.lit("  aa bb  cc "), " ")) == ["aa", "bb", "cc"]
    assert get(S.split_fields(F.lit("a,,b,"), ",")) == ["a", "", "b", ""]
    assert get(S.url_decode(S.url_encode(F.lit("a b+c/é")))) == "a b+c/é"
    assert [(a.key, a.value) for a in get(S.query_args(F.lit("http://x/?a=1&a=%20&b")))] == [("a", "1"), ("a", " "), ("b", "")]
    assert get(S.common_prefix_length(F.lit("abc"), F.lit("abd"))) == 2
    assert get(S.zero_free(F.lit(b"\x00\x01\x02"))) == "010001010200"


def test_byte_order_of_doubles(spark):
    own = [-float("inf"), -1.7976931348623157e308, -1e300, -2.5, -0.11, -0.1, -1e-300, -1e-310, -5e-324, 0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 1e-300, 0.1, 0.11, 2.5, 1e300, 1.7976931348623157e308, float("inf"), float("nan")]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in own], "x double").select(S.byte_ordered(F.col("x"))).collect()]
    assert got == sorted(got) and len(set(got)) == len(got)


def test_histogram_ties(spark):
    h = spark.createDataFrame([(1, 2), (3, 2), (5, 1), (7, 1)], "len long, cnt long")
    r = T.histogram_summary(h).first()
    assert (r.min_cnt_key, r.max_cnt_key, r.cnt_sum, r.total_key_len) == (5, 1, 6, 20)


def test_weighted_counts(spark):
    df = spark.createDataFrame([("a", None), ("a", 3), ("a", -2), ("", 9), (None, 1)], "w string, n long")
    assert rows(T.word_counts(df, F.col("w"), F.col("n"))) == [("a", 5)]


def test_records_round_trip(spark, tmp_path):
    from skarn.sources import io

    (tmp_path / "kv").mkdir()
    kv = spark.createDataFrame([("k1", "v"), ("", "x"), ("k2", "")], "key string, value string")
    data = b"".join(bytes(r.record) for r in io.kv_records(kv).collect())
    (tmp_path / "kv" / "a.bin").write_bytes(data)
    got = sorted((bytes(r.key).decode(), bytes(r.value).decode()) for r in io.read_kv(spark, str(tmp_path / "kv")).collect())
    assert got == [("", "x"), ("k1", "v"), ("k2", "")]
    (tmp_path / "fixed.bin").write_bytes(b"abcdefg")
    assert [bytes(r.record) for r in io.read_fixed(spark, str(tmp_path / "fixed.bin"), 3).orderBy("at").collect()] == [b"abc", b"def", b"g"]
    (tmp_path / "spec.txt").write_text("h\ts\tl\n")
    assert rows(io.read_input_spec(spark, str(tmp_path / "spec.txt"))) == [("h", "s", "l")]


def test_tuples_and_outputs(spark, tmp_path):
    from skarn.sources import io

    df = spark.createDataFrame([("a", "bc"), ("", None)], "x string, y string")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.bin").write_bytes(b"".join(bytes(r.record) for r in io.tuple_records(df, ["x", "y"]).collect()))
    got = sorted([bytes(f) for f in r.fields] for r in io.read_tuples(spark, str(tmp_path / "t"), 2).collect())
    assert got == [[b"", b""], [b"a", b"bc"]]
    (tmp_path / "t" / "a.bin").write_bytes(b"\1\0\0\0\3\0\0\0xy")
    with pytest.raises(Exception, match="fit"):
        io.read_tuples(spark, str(tmp_path / "t"), 2).collect()
    io.write_outputs(df, {str(tmp_path / "text"): ("text", ["x"]), str(tmp_path / "pq"): ("parquet", ["x", "y"])})
    assert spark.read.text(str(tmp_path / "text")).count() == 2 and rows(spark.read.parquet(str(tmp_path / "pq")).select("x")) == [("",), ("a",)]
    io.write_xml(df.where("x = 'a'"), str(tmp_path / "xml"))
    assert spark.read.format("xml").option("rowTag", "doc").load(str(tmp_path / "xml")).first().y == "bc"
    (tmp_path / "kv.bin").write_bytes(b"\1\0\0\0\2\0\0\0ab")
    with pytest.raises(Exception, match="fit"):
        io.read_kv(spark, str(tmp_path / "kv.bin")).collect()


def test_lines_of_addresses_and_programs(spark, tmp_path):
    import functools
    import http.server
    import threading

    from skarn.sources.external import read_lines_of, read_settings

    (tmp_path / "a.txt").write_text("one\ntwo é\n")
    serve = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path))
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), serve) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{server.server_port}/a.txt"
        got = rows(read_lines_of(spark, [url], ["printf 'x\\ny\\n'"]))
        server.shutdown()
    assert got == [(url, "one"), (url, "two é"), ("printf 'x\\ny\\n'", "x"), ("printf 'x\\ny\\n'", "y")]
    assert read_lines_of(spark).count() == 0
    with pytest.raises(Exception, match="ended with"):
        read_lines_of(spark, commands=["false"]).collect()
    (tmp_path / "b.ini").write_text("a = 1\n[db]\n; no\nhost=h=1\na=2\na=3\n[x]\n")
    assert rows(read_settings(spark, str(tmp_path / "b.ini"))) == [("", "a", "1"), ("db", "a", "3"), ("db", "host", "h=1")]


def test_external_lookup(spark):
    df = spark.createDataFrame([("a",), ("bc",), (None,)], "k string").repartition(2)
    assert rows(E.external_lookup(df.fillna(""), "k", ["tr", "a-z", "A-Z"])) == [("", ""), ("a", "A"), ("bc", "BC")]
    with pytest.raises(Exception, match="answers to"):
        E.external_lookup(df, "k", ["true"]).collect()


def test_parsers_are_table_functions(spark):
    from skarn.functions.parsers import parsed, register_parser

    register_parser(spark, "key_values", lambda text: [tuple(p.split("=")) for p in text.split() if p.count("=") == 1])
    docs = spark.createDataFrame([(1, "a=1 b=2 a=1"), (2, None), (3, "none")], "d long, t string")
    assert rows(parsed(docs, "d", "t", "key_values")) == [(1, "a", "1", 2), (1, "b", "2", 1)]


def test_lookup_beside_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v string").parquet(str(tmp_path / "in"))
    side = spark.createDataFrame([(1, "one")], "id long, name string")
    out = E.lookup_join(stream, side, {"k": "id"}, {"name": "name"})
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [(1, "x", "one"), (2, "y", "")]


def test_sessions_over_a_gap(spark):
    from skarn.streaming import realtime

    df = spark.sql("select timestamp_seconds(s) as at, u from values (0, 'a'), (60, 'a'), (200, 'a'), (0, 'b') as t(s, u)")
    assert sorted((r.u, r.n) for r in realtime.sessions(df, "at", "u", "100 seconds").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_realtime_index_equals_batch(spark, tmp_path):
    from skarn.streaming import realtime

    docs = spark.createDataFrame([(1, "en", "s1"), (2, "fr", None), (3, "en", "s2")], "doc_id long, lang string, source string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    realtime.start_index(stream, "doc_id", ["lang", "source"], str(tmp_path / "index"), str(tmp_path / "ck")).awaitTermination()
    index = spark.read.parquet(str(tmp_path / "index"))
    assert rows(index) == rows(realtime.batch_index(docs, "doc_id", ["lang", "source"]))
    assert rows(realtime.search(index, "doc_id", "lang:e")) == [(1,), (3,)]


def test_range_lookup(spark):
    points = spark.createDataFrame([(0,), (9,), (10,), (99,)], "p long")
    ranges = spark.createDataFrame([(0, 10, "a"), (10, 60, "b")], "lo long, hi long, f string")
    assert rows(E.range_lookup(points, "p", ranges, "lo", "hi", 20, ["f"])) == [(0, 0, "a"), (9, 0, "a"), (10, 10, "b")]
    wide = spark.createDataFrame([(0, 5, "a"), (5, 10**9, "b"), (10**9, 10**9 + 65, "c"), (2 * 10**9, 2 * 10**9, "none")], "lo long, hi long, f string")
    many = spark.createDataFrame([(0,), (4,), (5,), (999_999_999,), (10**9,), (10**9 + 64,), (10**9 + 65,)], "p long")
    assert [r[2] for r in rows(E.range_lookup(many, "p", wide, "lo", "hi", 1, ["f"]))] == ["a", "a", "b", "b", "c", "c"]
    assert E.range_lookup(many, "p", wide.limit(0), "lo", "hi", 1, ["f"]).count() == 0


def test_queries_have_sql():
    from skarn.plans import registry

    assert set(registry.queries()) - set(registry.oracle_sql()) == {"log_parse", "log_postings", "hashes", "crc_codes"}
