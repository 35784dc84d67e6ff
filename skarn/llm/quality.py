"""Quality rules (op 6): a threshold table compiled into one projection of built-in functions.

Each row of :data:`RULES` names a metric and the range that passes. :func:`compile_rules`
turns the table into a single boolean column; no user function runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.shared import fresh

#: Frequent short words of English, German, French, Spanish, Italian, Portuguese, Dutch, Polish and Russian (fixed values).
STOP_WORDS = (
    "a", "an", "and", "are", "as", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "im", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "dans", "de", "du", "elle", "en", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "al", "con", "del", "el", "los", "las", "no", "para", "por", "se", "su", "una", "y",
    "che", "di", "e", "gli", "i", "il", "lo", "non", "per", "si",
    "ao", "com", "da", "do", "dos", "em", "mais", "na", "o", "os", "um", "uma",
    "dat", "een", "het", "met", "niet", "op", "te", "van", "voor", "zijn",
    "jest", "nie", "od", "po", "przez", "to", "za",
    "в", "для", "и", "из", "как", "к", "на", "не", "о", "от", "по", "с", "что", "это",
)

#: (name, metric, lowest value that passes, highest value that passes); None: no bound.
RULES = (
    ("length: words", "n_words", 50, None),
    ("length: mean word", "mean_word_chars", 2.0, 15.0),
    ("symbols to words", "symbol_ratio", None, 0.1),
    ("stop words to words", "stop_ratio", 0.02, None),
    ("repeated lines to lines", "dup_line_ratio", None, 0.3),
)

BLANK, NOT_BLANK = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def compile_rules(rules=RULES) -> Column:
    """True where every metric lies in its range; a metric that is null passes."""
    tests = [F.coalesce(test, F.lit(True)) for _, metric, low, high in rules for bound, test in ((low, F.col(metric) >= F.lit(low)), (high, F.col(metric) <= F.lit(high))) if bound is not None]
    return reduce(Column.__and__, tests, F.lit(True))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs``, then the metrics that rules can name; columns with the metrics' names are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words_, lines_, coded_, near_, places_, n_lines_, n_stop_ = fresh(docs, "words", "lines", "coded", "near", "places", "n_lines", "n_stop")
    words, n = F.col(words_), F.size(words_)
    # Windows that another one may equal are found by hash, then compared.
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    coded = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(window(i).alias("h"), i.alias("p"))))
    code = lambda k: F.get(F.col(coded_), k)
    like = lambda x, k: F.coalesce(x["h"] == code(k)["h"], F.lit(False))
    suspects = F.transform(F.filter(F.col(coded_), lambda x, k: like(x, k + 1) | like(x, k - 1)), lambda x: x["p"])
    compared = F.sort_array(F.transform(suspects, lambda p: F.struct(F.get(words, p).alias("a"), F.get(words, p + 1).alias("b"), F.get(words, p + 2).alias("c"), p.alias("p"))))
    near = lambda k: F.get(F.col(near_), k)
    same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    repeated = F.sort_array(F.transform(F.filter(F.col(near_), lambda x, k: same(x, near(k + 1)) | same(x, near(k - 1))), lambda x: x["p"]))
    step = lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col(places_), k + 1) - p, F.lit(3))).cast("long")
    covered = F.aggregate(F.transform(F.col(places_), step), F.lit(0).cast("long"), lambda a, x: a + x)
    symbols = F.when(text.rlike("[#*$%&|<>]"), F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", ""))).otherwise(0)
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_chars", "symbol_ratio", "stop_ratio", "dup_line_ratio")
    kept = [c for c in docs.columns if c.lower() not in made]
    ratio = lambda a, b: F.col(a) / F.when(F.col(b) > 0, F.col(b))
    return (
        docs.select(
            *kept,
            F.array_remove(F.split(text, BLANK), "").alias(words_),
            F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_BLANK)).alias(lines_),
            symbols.cast("long").alias("n_symbols"),
        )
        .withColumn(coded_, F.when(n >= 4, coded))
        .withColumn(near_, F.when(F.size(coded_) >= 2, compared))
        .withColumn(places_, repeated)
        .select(
            *kept,
            n.cast("long").alias("n_words"),
            F.char_length(F.array_join(words_, "")).cast("long").alias("word_chars"),
            "n_symbols",
            F.size(lines_).cast("long").alias(n_lines_),
            (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words_, lambda w: w.isin(*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)))).cast("long").alias(n_stop_),
        )
        .select(
            *kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            ratio("word_chars", "n_words").alias("mean_word_chars"), ratio("n_symbols", "n_words").alias("symbol_ratio"),
            ratio(n_stop_, "n_words").alias("stop_ratio"), ratio("n_dup_lines", n_lines_).alias("dup_line_ratio"),
        )
    )


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """:func:`measured` with ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 50 words, or over half of them in repeated 3-word windows.
    ``kept``: not so, and every rule passes. A null or empty text has no words and fails.
    Repeated rows and ids are judged each alone; an empty table gives an empty one.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    drop = [c for c in docs.columns if c.lower() in ("base_failed", "kept")]
    return measured(docs.drop(*drop), id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~failed & compile_rules(rules))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that :func:`judged` keeps, with their columns.

    The row number holds the filter above the projection: pushed into it, the verdict
    would be worked out again for every use of a metric.
    """
    own, row = fresh(docs, "own", "row")
    found = judged(docs.select(F.struct(*docs.columns).alias(own), F.col(text_col)), id_col, text_col, rules)
    return found.select(own, "kept", F.monotonically_increasing_id().alias(row)).where(F.col("kept") & (F.col(row) >= 0)).select(f"{own}.*")
