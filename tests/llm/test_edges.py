"""Null and repeated ids, repeated rows and clashing columns of the operators that other files don't cover."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from helpers import VOCABULARY


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    make = lambda n: " ".join("".join(r.choices("abcdefgh", k=4)) for _ in range(n))
    own = [(None, make(40)), (None, make(30)), (1, make(50)), (1, make(50)), (2, None), (2, ""), (7, make(700))]
    return own + [own[2], own[0]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = "words string, lines int, coded string, near string, places string, n_lines int, n_stop int, own string, row string, kept string, n_words string, terms string, row_id string, text_hash string"
    more = ("w", 1, "c", "n", "p", 2, 3, "o", "r", "k", "nw", "t", "ri", "th")
    return spark.createDataFrame([(i, t, *more) for i, t in rows], f"doc_id long, text string, {clash}").repartition(3)


def test_packing_of_repeated_and_missing_ids(docs, rows, library):
    from skarn.llm.packing import pack

    out = pack(docs, VOCABULARY, capacity=64).collect()
    want = []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(str(i), k, a, zlib.crc32(ids[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    assert sorted((str(x.doc_id), x.piece, x.start, x.ids_crc32) for x in out) == sorted(want)
    places = {}
    for x in out:
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for own in places.values():
        ends = [0, *(a + n for a, n in sorted(own))]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 64


def test_token_files_of_repeated_and_missing_ids(docs, rows, library, spark):
    from skarn.llm.tokenfile import read_documents, write

    got = sorted(read_documents(write(docs, VOCABULARY, row=64)).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    assert [x.start for x in got] == [0, *np.cumsum([x.n_tokens for x in got])[:-1]]
    ids = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    assert sorted((str(x.doc_id), x.ids_crc32) for x in got) == sorted((str(i), zlib.crc32(ids(t).tobytes())) for i, t in rows)
    one = spark.createDataFrame([(5, f"t{k}") for k in range(60)] + [(6, "last")], "doc_id long, text string").repartition(4)
    at = read_documents(write(one, VOCABULARY)).orderBy("start").collect()
    assert [x.doc_id for x in at] == [5] * 60 + [6]


def test_suffixes_of_repeated_and_missing_ids(docs, rows):
    from skarn.llm.suffix import remove_repeats

    def left(i, t):
        """What stays: an id's rows don't take from each other, but lose what either of them loses at its place."""
        key = lambda x: -(2**63) if x is None else x
        before = {b[k : k + 50] for j, u in rows if key(j) < key(i) for b in [(u or "").encode()] for k in range(len(b) - 49)}
        b, gone = (t or "").encode(), set()
        for u in (u for j, u in rows if key(j) == key(i)):
            own = (u or "").encode()
            gone |= {k + d for k in range(len(own) - 49) if own[k : k + 50] in before for d in range(50)}
        return len(b), hashlib.sha256(bytes(c for k, c in enumerate(b) if k not in gone)).hexdigest()

    got = remove_repeats(docs).collect()
    assert sorted((str(x.doc_id), x.n_bytes, x.kept_sha256) for x in got) == sorted((str(i), *left(i, t)) for i, t in rows)


def test_quality_of_clashing_columns_and_many_words(spark, docs, rows):
    from skarn.llm.quality import judged, kept_rows

    got = judged(docs)
    assert got.count() == len(rows) and {"words", "near", "own"} <= set(got.columns)
    assert kept_rows(docs).columns == docs.columns
    words = [f"w{k % 977}x{k // 977 % 3}" for k in range(9000)]
    windows = {}
    for k in range(len(words) - 2):
        windows.setdefault(tuple(words[k : k + 3]), []).append(k)
    want = len({k + d for own in windows.values() if len(own) > 1 for k in own for d in range(3)})
    long = judged(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert (long.n_words, long.n_repeat_words) == (9000, want)


def test_sanitising_of_clashing_columns(docs, rows):
    from skarn.llm.pii import find, sanitise

    assert find(docs).count() == len(rows)
    done = sanitise(docs)
    assert done.columns == docs.columns and sorted(str((x.doc_id, x.text)) for x in done.collect()) == sorted(str(x) for x in rows)


def test_exact_dedup_of_clashing_columns(docs, rows):
    from skarn.llm.jaccard import near_duplicates, one_of_each
    from skarn.llm.radix_dedup import drop_duplicates, exact_dedup

    assert exact_dedup(docs).count() == near_duplicates(docs).count() == len(rows)
    assert drop_duplicates(docs).columns == one_of_each(docs).columns == docs.columns


def test_links_of_documents_are_all_found(spark):
    from skarn.llm.jaccard import near_duplicates

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {x.doc_id: (x.text or "").lower().split() for x in table.collect()}
    sets = {i: set(zip(*[w[k:] for k in range(5)], strict=False)) or ({tuple(w)} if w else set()) for i, w in texts.items()}
    linked = {i: sum(j != i and bool(a) and len(a & b) >= 0.8 * len(a | b) for j, b in sets.items()) for i, a in sets.items()}
    got = {x.doc_id: x.n_links for x in near_duplicates(table).collect()}
    assert sum(linked.values()) > 0 and got == linked  # recall 1 on this table
