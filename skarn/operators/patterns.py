"""Pattern matching: many words in texts, sets of regular expressions, edit distance, readings.

Positions are characters from 1 where results say ``pos``; use :func:`byte_offset` for bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Hits that :func:`word_hits` holds at once.
HITS = 1 << 16


def word_hits(texts: DataFrame, key: str, column: str, patterns: dict[int, str]) -> DataFrame:
    """``key``, ``pid``, ``pos``, ``byte_pos``: every place of every pattern, overlapping ones included.

    Texts without any pattern are told by one scan; the others are searched for each of
    their patterns, behind one hit after the other. Hits are handed on :data:`HITS` at a
    time, however many a text has. Patterns may repeat under several ids; empty ones and
    null texts have no hits.
    """
    words = {i: p for i, p in patterns.items() if p}
    kind = texts.schema[key].dataType.simpleString()
    anywhere = re.compile("|".join(re.escape(p) for p in sorted(set(words.values()), key=len)) or "(?!)")

    def taken(keys: pa.Array, hits: tuple[list, ...]) -> pa.RecordBatch:
        row, *rest = (pa.array(x, t) for x, t in zip(hits, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True))
        for x in hits:
            x.clear()
        return pa.RecordBatch.from_arrays([keys.take(row), *rest], [key, "pid", "pos", "byte_pos"])

    def found(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            hits = row, pid, pos, byte = [], [], [], []
            for k, cell in enumerate(b.column(1)):
                text = cell.as_py()
                if not text or not anywhere.search(text):
                    continue
                plain = text.isascii()
                for i, p in words.items():
                    at, last, size = text.find(p), 0, 0
                    while at >= 0:
                        if not plain:
                            size += len(text[last:at].encode())
                            last = at
                        row.append(k)
                        pid.append(i)
                        pos.append(at + 1)
                        byte.append(at if plain else size)
                        if len(row) == HITS:
                            yield taken(b.column(0), hits)
                        at = text.find(p, at + 1)
            yield taken(b.column(0), hits)

    return texts.select(key, column).mapInArrow(found, f"`{key}` {kind}, pid int, pos long, byte_pos long")


def reverse_hits(hits: DataFrame, key: str, patterns: dict[int, str]) -> DataFrame:
    """:func:`word_hits` as a scan from the end gives them: ``nth`` numbers the patterns that begin at one place, longest first."""
    size = F.create_map(*(F.lit(x) for i, p in patterns.items() for x in (i, len(p)))) if patterns else F.lit(None)
    within = Window.partitionBy(key, "pos").orderBy(F.desc("_size"), "pid")  # at most as many as there are patterns
    return hits.withColumn("_size", size[F.col("pid")]).withColumn("nth", F.row_number().over(within)).drop("_size")


def matching_words(words: DataFrame, column: str, patterns: dict[int, str]) -> DataFrame:
    """``qid``, ``column``: patterns that match a prefix of each word; all patterns in one scan."""
    tests = [F.when(anchored(column, p), F.lit(i)) for i, p in patterns.items()]
    return words.select(F.explode(F.array_compact(F.array(*tests))).alias("qid"), column)


def has_hit(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that match anywhere in a text, in the order given."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(name)) for name, p in patterns.items())))


def read_patterns(spark: SparkSession, path: str, ignore_case: bool = False, literal: bool = False) -> DataFrame:
    """``name``, ``pattern`` of a file of lines ``pattern <tab> name``; a line without a name has its number as name.

    ``ignore_case``: for all patterns. ``literal``: lines are words, not expressions. Empty
    lines are left out but counted.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).where("line <> ''")
    pattern = F.substring_index("line", "\t", 1)
    if literal:
        pattern = F.concat(F.lit("\\Q"), F.replace(pattern, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    if ignore_case:
        pattern = F.concat(F.lit("(?iu)"), pattern)
    name = F.when(F.instr("line", "\t") > 0, F.regexp_extract("line", "\t(.*)$", 1)).otherwise((F.col("at") + 1).cast("string"))
    return lines.select(name.alias("name"), pattern.alias("pattern"))


def longest_ids(matches: DataFrame, column: str) -> DataFrame:
    """``column``, ``len``, ``pids``: of :func:`match_set`, the ids that reach the longest match of each text."""
    by_length = matches.groupBy(column, "len").agg(F.sort_array(F.collect_set("pid")).alias("pids"))
    return by_length.groupBy(column).agg(F.max("len").alias("len"), F.max_by("pids", "len").alias("pids"))


def byte_offset(column: str, pos: str) -> Column:
    """0-based byte offset of a 1-based character position."""
    return F.octet_length(F.expr(f"left({column}, {pos} - 1)")).cast("long")


def _halved(text: Column, holds: Callable[[Column], Column]) -> Column:
    """The largest length up to the text's that ``holds``, which must hold for all smaller ones; found by halving, so in a few tests."""
    n = F.char_length(text)
    steps = F.when(n > 0, F.transform(F.sequence(F.floor(F.log2(n)), F.lit(0)), lambda k: F.pow(F.lit(2.0), k).cast("int")))
    grown = lambda best, step: F.when((best + step <= n) & holds(best + step), best + step).otherwise(best)
    return F.coalesce(F.aggregate(steps, F.lit(0), grown), F.lit(0)).cast("long")


def _reaches(text: Column, pattern: Column, rest: Column) -> Column:
    """Whether some match from the start, of one character or more, leaves as much of the text as ``rest`` (a quantifier) says."""
    return F.rlike(text, F.concat(F.lit("^(?:"), pattern, F.lit(r")(?<=[\s\S])(?=[\s\S]{"), rest, F.lit(r"}\z)")))


def longest_match(text: Column, pattern: Column) -> Column:
    """Length of the longest prefix that matches, 0 if none: longest over all alternatives, which a search is not.

    That some match has at least so many characters holds for all smaller numbers too.
    """
    n = F.char_length(text)
    return _halved(text, lambda k: _reaches(text, pattern, F.concat(F.lit("0,"), (n - k).cast("string"))))


def shortest_match(text: Column, pattern: Column) -> Column:
    """Length of the shortest prefix that matches, 0 if none: one more than the most characters that no match stays within."""
    n = F.char_length(text)
    within = lambda k: _reaches(text, pattern, F.concat((n - k).cast("string"), F.lit(",")))
    return F.when((n > 0) & within(n), _halved(text, lambda k: ~within(k)) + 1).otherwise(F.lit(0)).cast("long")


def match_set(texts: DataFrame, column: str, patterns: DataFrame) -> DataFrame:
    """``column``, ``pid``, ``len``: every pattern of ``pid, pattern`` that matches some prefix, with the longest it matches.

    Patterns are as many as a caller lists, and meet each text in one pass. One plain test
    tells which match; lengths are looked for behind the join, where no filter moves them
    into it: in a fresh session Spark loses a column of a join condition with lambdas.
    """
    text, pattern = F.col(column), F.col("pattern")
    pairs = texts.join(F.broadcast(patterns), _reaches(text, pattern, F.lit("0,")))
    return pairs.select(column, "pid", F.stack(F.lit(1), longest_match(text, pattern)).alias("len"))


def find_all(texts: DataFrame, column: str, pattern: str) -> DataFrame:
    """``column``, ``pos``, ``len``: the longest match at every start, so matches overlap."""
    n = F.char_length(column)
    starts = texts.select(column, F.explode(F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))).alias("pos"))
    rest = F.expr(f"substring({column}, pos)")
    return starts.select(column, F.col("pos").cast("long"), longest_match(rest, F.lit(pattern)).alias("len")).where("len > 0")


def find_first(texts: DataFrame, column: str, pattern: str) -> DataFrame:
    """``column``, ``pos``, ``len`` of the first start with a match; length 0 past the end without one."""
    hits = find_all(texts, column, pattern).groupBy(column).agg(F.min(F.struct("pos", "len")).alias("hit"))
    return texts.select(column).distinct().join(hits, column, "left").select(
        column, F.coalesce("hit.pos", F.char_length(column) + 1).cast("long").alias("pos"), F.coalesce("hit.len", F.lit(0)).cast("long").alias("len")
    )


def full(pattern: str):
    """A predicate: the whole text matches."""
    return lambda c: c.rlike(rf"^(?:{pattern})\z")


def both(a, b):
    return lambda c: a(c) & b(c)


def either(a, b):
    return lambda c: a(c) | b(c)


def without(a, b):
    return lambda c: a(c) & ~b(c)


def literal_prefix(pattern: str) -> str:
    """The characters that every match of an anchored pattern starts with; none where the pattern has an alternative."""
    if "|" in pattern:
        return ""
    out = []
    for i, c in enumerate(pattern):
        if c in r"\.[](){}*+?|^$":
            if c in "*?{" and out:
                out.pop()
            break
        out.append(c)
    return "".join(out)


def anchored(column: str, pattern: str) -> Column:
    """Whether a prefix of the column matches; the pattern's literal start also becomes a prefix test, which scans push down."""
    start = literal_prefix(pattern)
    test = F.col(column).rlike(f"^(?:{pattern})")
    return F.col(column).startswith(start) & test if start else test


def deletions(word: Column, k: int) -> Column:
    """All strings that come from a word by dropping up to ``k`` characters."""
    out = F.array(word)
    for _ in range(k):
        drop = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.char_length(w))))
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, drop))))
    return out


def fuzzy_join(words: DataFrame, k: int) -> DataFrame:
    """``a``, ``b``, ``d``: pairs of distinct words with an edit distance of at most ``k``, each once.

    Words within ``k`` edits share a string that both become by dropping up to ``k``
    characters; sharing one is an equi-join, and the distance is checked after.
    """
    cut = words.select("word", F.explode(deletions(F.col("word"), k)).alias("cut"))
    left, right = cut.withColumnRenamed("word", "a"), cut.withColumnRenamed("word", "b")
    pairs = left.join(right, "cut").where("a < b").select("a", "b").distinct()
    return pairs.withColumn("d", F.levenshtein("a", "b", k)).where("d >= 0")


def swapped(a: Column, b: Column) -> Column:
    """Whether two texts of one length differ by one swap of neighbouring characters."""
    n = F.char_length(a)
    one = F.lit(1)
    swap = lambda i: F.concat(F.substring(a, one, i - 1), F.substring(a, i + 1, one), F.substring(a, i, one), F.substring(a, i + 2, n))
    return (n == F.char_length(b)) & (n > 1) & (a != b) & F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: swap(i) == b)


def fuzzy_join_swaps(words: DataFrame) -> DataFrame:
    """``a``, ``b``: pairs of distinct words one edit apart, a swap of neighbours counting as one.

    Words that differ by a swap share what either becomes without one character.
    """
    cut = words.select("word", F.explode(deletions(F.col("word"), 1)).alias("cut"))
    left, right = cut.withColumnRenamed("word", "a"), cut.withColumnRenamed("word", "b")
    pairs = left.join(right, "cut").where("a < b").select("a", "b").distinct()
    return pairs.where((F.levenshtein("a", "b", 1) >= 0) | swapped(F.col("a"), F.col("b")))


def longest_frequent(texts: DataFrame, column: str, words: DataFrame, least_length: int, least_count: int) -> DataFrame:
    """``column``, ``pos``, ``len``, ``freq``: at each place of a text, the longest string of ``least_length`` characters or more that stands ``least_count`` times or more in ``words``.

    Strings of both sides meet by an equi-join; those of ``words`` are counted before it.
    For texts and words of bounded length.
    """

    def strings(df: DataFrame, c: str) -> DataFrame:
        n = F.char_length(c)
        rows = df.where(n >= least_length).select(c, F.explode(F.sequence(F.lit(1), n - least_length + 1)).alias("pos"))
        long = rows.select(c, "pos", F.explode(F.sequence(F.lit(least_length), F.char_length(c) - F.col("pos") + 1)).alias("len"))
        return long.withColumn("cut", F.substring(F.col(c), F.col("pos"), F.col("len")))

    often = strings(words, "word").groupBy("cut").agg(F.count("*").alias("freq")).where(F.col("freq") >= least_count)
    met = strings(texts.select(column).distinct(), column).join(often, "cut")
    best = met.groupBy(column, "pos").agg(F.max(F.struct("len", "freq")).alias("best"))
    return best.select(column, F.col("pos").cast("long").alias("pos"), F.col("best.len").cast("long").alias("len"), "best.freq")


def spellings(words: DataFrame, readings: DataFrame, initials_from: int | None = None) -> DataFrame:
    """``word``, ``spelling``: every way to read a word whose characters have several readings (``ch``, ``reading``).

    ``initials_from``: in words of so many characters or more, the first letter of a reading
    also stands for it. Spellings are as many as the readings' product, so words are to be short.
    """
    table = readings.groupBy("ch").agg(F.sort_array(F.collect_set("reading")).alias("own"))
    chars = words.select("word", F.posexplode(F.split("word", "")).alias("place", "ch"))
    by_word = chars.join(table, "ch").groupBy("word").agg(F.sort_array(F.collect_list(F.struct("place", "own"))).alias("each"))
    whole = by_word.where(F.size("each") == F.char_length("word"))
    if initials_from is not None:
        short = F.transform("each", lambda e: F.struct(e["place"], F.array_union(e["own"], F.transform(e["own"], lambda r: F.left(r, F.lit(1)))).alias("own")))
        whole = whole.withColumn("each", F.when(F.char_length("word") >= initials_from, short).otherwise(F.col("each")))
    grown = F.aggregate(
        F.transform("each", lambda e: e["own"]), F.array(F.lit("")), lambda done, own: F.flatten(F.transform(done, lambda d: F.transform(own, lambda r: F.concat(d, r))))
    )
    return whole.select("word", F.explode(F.array_distinct(grown)).alias("spelling"))
