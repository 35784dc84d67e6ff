"""Exact deduplication."""

import hashlib

from helpers import by_id


def test_exact_dedup(spark, docs, texts, nothing):
    from skarn.llm.radix_dedup import drop_duplicates, exact_dedup

    fold = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(fold(t), []).append(i)
    got = by_id(exact_dedup(docs))
    for t, members in groups.items():
        for i in members:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(members), len(members), i == max(members))
            assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert sorted(r.doc_id for r in drop_duplicates(docs).collect()) == sorted(max(m) for m in groups.values())
    assert exact_dedup(nothing).count() == 0
    # Long texts that part late, repeated rows, null ids.
    long = "x" * 5000
    odd = spark.createDataFrame([(1, long + "a"), (2, long + "b"), (3, long + "A"), (3, long + "A"), (None, "q"), (7, "Q")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.keep_id, r.group_size) for r in exact_dedup(odd).collect()) == [("1", 3, 3), ("2", 2, 1), ("3", 3, 3), ("3", 3, 3), ("7", 7, 2), ("None", 7, 2)]


def test_exact_dedup_of_long_texts_without_ids(spark):
    from skarn.llm.radix_dedup import drop_duplicates, exact_dedup

    a, b, c, d = ("x" * 40, "y" * 300, "z" * 50, "w")
    rows = [(None, a), (7, a), (0, b), (None, b), (None, b), (3, c), (3, c), (3, c.upper()), (2, c), (None, d * 60), (None, d * 60), (9, d), (9, d)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.text_sha256[:4], str(r.doc_id), str(r.keep_id), r.group_size) for r in exact_dedup(odd).collect())
    want = {t: max((i for i, u in rows if u.lower() == t and i is not None), default=None) for _, t in rows if t.islower()}
    assert got == sorted((hashlib.sha256(t.lower().encode()).hexdigest()[:4], str(i), str(want[t.lower()]), sum(u.lower() == t.lower() for _, u in rows)) for i, t in rows)
    assert sorted((str(r.doc_id), r.text.lower()) for r in drop_duplicates(odd).collect()) == sorted((str(i), t) for t, i in want.items())
