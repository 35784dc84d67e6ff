"""Exact deduplication by distributed MSD radix partitioning (op 4).

Documents are split by successive bytes. A round takes the next run of bytes of each
document still in doubt as its digit, groups by (group so far, digit), and a group
that holds one document, or whose documents have ended, is done. The bytes themselves
are compared; no digest decides equality. The length of a text counts as its first
digit. Runs grow eightfold, so a text of n bytes takes about log8(n) rounds.

Groups are counted by partial aggregates and never gathered; members of hot ones meet
their group's row in many parts. From the second round on,
only documents that share length and first bytes with another one are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.shared import join_groups, single_rows, sized_join, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of the first digit, and by how much each digit is longer than the one before.
FIRST_BYTES, GROWTH = 32, 8
#: What tells rows apart in joins, never null: whether there is no id, the id or 0, the text's digest.
KEY = ["no_id", "id", "sha"]


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only; null gives an empty text."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def equal_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(``row_id``, ``n``, ``sha``) of all rows, and (``row_id``, ``sha``, ``keep_id``, ``group_size``, ``copies``) of those with equals.

    ``sha`` tells apart rows that have the same id but different texts; it takes no part in
    finding equals. Rows with the same id and text stand once in the second table and count
    each in ``group_size``; ``copies`` is their number.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), ascii_lower(F.col(text_col)).alias("norm")).select(
        "row_id", "norm", F.octet_length("norm").alias("n"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha")
    )
    digit = F.substring(F.col("norm").cast("binary"), 1, FIRST_BYTES)
    keyed = [F.col("row_id").isNull().alias("no_id"), F.coalesce("row_id", F.lit(0)).alias("id")]
    heads = written(rows.select("row_id", *keyed, "n", "sha", digit.alias("digit")), "radix-heads")
    groups = heads.groupBy("n", "digit").agg(F.count("*").alias("size"), F.min(F.struct(*KEY)).alias("gid")).where("size > 1")
    state = written(join_groups(heads, groups, ["n", "digit"], "id").select(*KEY, "n", "gid"), "radix-0")
    at, width = FIRST_BYTES, FIRST_BYTES * GROWTH
    ended = [state.where(F.col("n") <= at)]
    state = state.where(F.col("n") > at)
    longest = state.agg(F.max("n")).first()[0] or 0
    if longest > at:
        alive = sized_join(rows.select("*", *keyed), state.select(*KEY).distinct(), KEY, "left_semi", rows=500_000)
        texts = written(alive.select(*KEY, F.col("norm").cast("binary").alias("norm")).dropDuplicates(KEY), "radix-texts")
    while longest > at:
        digits = texts.join(state, KEY).select(*KEY, "n", "gid", F.substring("norm", at + 1, width).alias("digit"))
        groups = digits.groupBy("gid", "digit").agg(F.count("*").alias("size"), F.min(F.struct(*KEY)).alias("next")).where("size > 1")
        state = written(join_groups(digits, groups, ["gid", "digit"], "id").select(*KEY, "n", F.col("next").alias("gid")), "radix")
        at, width = at + width, width * GROWTH
        ended.append(state.where(F.col("n") <= at))
        state = state.where(F.col("n") > at)
    equal = reduce(DataFrame.unionByName, ended)
    own = F.when(~F.col("no_id"), F.col("id"))
    sizes = equal.groupBy("gid").agg(F.count("*").alias("group_size"), F.max(own).alias("keep_id"))
    distinct = equal.groupBy("gid", *KEY).agg(F.count("*").alias("copies"))
    members = join_groups(distinct, sizes, ["gid"], "id", "group_size").select(own.alias("row_id"), "sha", "keep_id", "group_size", "copies")
    return heads.select("row_id", "n", "sha"), members


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` of every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z only; a null text is empty. Of
    equal texts the row with the largest id stays; rows that repeat id and text stay
    together. A null id is smaller than any other, and stays only if all its equals have
    none. Other columns are left out, whatever their names; an empty table gives none.
    """
    rows, members = equal_groups(docs, id_col, text_col)
    out = rows.alias("r").join(members.alias("m"), F.expr("r.row_id <=> m.row_id and r.sha = m.sha"), "left")
    keep = F.when(F.col("m.group_size").isNull(), F.col("r.row_id")).otherwise(F.col("m.keep_id"))
    return out.select(
        F.col("r.row_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("m.group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("r.row_id").eqNullSafe(keep).alias("kept"),
        F.col("r.sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see :func:`exact_dedup`. Of rows that repeat id and text one stays."""
    _, members = equal_groups(docs, id_col, text_col)
    repeated = written(members.where(F.col("row_id").eqNullSafe(F.col("keep_id")) & (F.col("copies") > 1)).select(F.col("row_id").alias("_id"), F.col("sha").alias("_mark")), "radix-repeated")
    gone = written(members.where(~F.col("row_id").eqNullSafe(F.col("keep_id"))).select(F.col("row_id").alias("gone_id"), F.col("sha").alias("gone_sha")), "radix-gone")
    small = gone.limit(500_001).count() <= 500_000
    sha = F.sha2(ascii_lower(docs[text_col]).cast("binary"), 256)
    kept = docs.join(F.broadcast(gone) if small else gone, docs[id_col].cast("long").eqNullSafe(gone.gone_id) & (sha == gone.gone_sha), "left_anti")
    return single_rows(kept, repeated, docs[id_col].cast("long"), sha)
