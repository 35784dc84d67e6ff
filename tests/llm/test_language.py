"""Language identification against a plain coder, on held-out documents, and at its bounds."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F


def plain_bits(counts, contexts, text):
    """Code length of a text by PPM (method C, exclusions): ``counts`` of one language by context, ``contexts`` known for any."""
    known = set(counts["every"])
    bits, history = 0.0, []
    for b in text:
        excluded, p, coded = set(), 1.0, False
        longest = next((d for d in (3, 2, 1) if len(history) >= d and tuple(history[-d:]) in contexts), 0)
        for d in range(longest, -1, -1):
            own = {s: n for s, n in counts["by"].get(tuple(history[len(history) - d :]), {}).items() if s not in excluded}
            total, distinct = sum(own.values()), len(own)
            if not total:
                continue
            if b in own:
                p *= own[b] / (total + distinct)
                coded = True
                break
            p *= distinct / (total + distinct)
            excluded |= set(own)
        if not coded:
            p /= 256 - len(excluded)
        bits -= math.log2(p)
        history = [*history, b][-3:] if b in known else []
    return bits


def test_code_lengths_equal_a_plain_coder(spark):
    from skarn.llm.langid import LEAST_COUNT, score_bytes, train

    r = random.Random(1)
    letters = {"aa": "abcde é", "bb": "adxyz ß"}
    texts = [(lang, "".join(r.choices(own, k=r.randint(1, 120)))) for lang, own in letters.items() for _ in range(25)]
    texts += texts[:10]  # copies count once
    (model,) = train(spark.createDataFrame(texts, "lang string, text string").repartition(3))
    every, by, total = set(), {"aa": {}, "bb": {}}, Counter()
    for lang, t in set(texts):
        b = t.encode()
        every |= set(b)
        for k in range(len(b)):
            for d in range(min(k, 3) + 1):
                ctx = tuple(b[k - d : k])
                total[ctx] += 1
                by[lang].setdefault(ctx, Counter())[b[k]] += 1
    contexts = {c for c, n in total.items() if n >= LEAST_COUNT}
    for t in ("abcabc", "zyx ad", "éß", "qqq", "a", "dé q xyz", "".join(r.choices("abcdexyz éßq", k=300))):
        got = score_bytes(model, np.frombuffer(b"\0\0\0" + t.encode(), np.uint8), np.array([0]))[0]
        want = [plain_bits({"every": every, "by": by[lang]}, contexts, t.encode()) for lang in model.languages]
        assert model.languages == ["aa", "bb"] and np.allclose(got, want, rtol=1e-4, atol=1e-3), t


def test_held_out_accuracy(spark):
    from skarn.llm.queries import op8_language_id

    path = "/root/testdata/sf0.01"
    got = op8_language_id(spark, path).join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out and lang is not null and lang_pred <> 'und'")
    assert held.count() > 200 and held.where("lang = lang_pred").count() > 0.98 * held.count()
    assert held.agg(F.min("score")).first()[0] < 0.99  # scores don't saturate


def test_many_languages_in_blocks(spark):
    from skarn.llm.langid import predict, train

    r = random.Random(3)
    own = {f"l{k:02d}": "".join(r.sample("abcdefghijklmnopqrstuvwxyz", 5)) for k in range(23)}
    make = lambda lang, n: "".join(r.choices(own[lang], k=n))
    rows = [(lang, make(lang, 400)) for lang in own for _ in range(4)]
    models = train(spark.createDataFrame(rows, "lang string, text string"), block=5)
    assert [len(m.languages) for m in models] == [5, 5, 5, 5, 3]
    tests = spark.createDataFrame([(k, lang, make(lang, 200), "x", 1.0) for k, lang in enumerate(own)], "doc_id long, want string, text string, bits string, score double")
    got = predict(tests, models)
    assert got.columns == ["doc_id", "want", "bits", "lang_pred", "score"]
    assert got.where("want <> lang_pred or not score between 0 and 1").count() == 0


def test_whole_texts_are_learned_and_copies_count_once(spark):
    from skarn.llm.langid import predict, sample, train

    rows = [("aa", "x" * 6000 + " ünü" * 50), ("bb", "x" * 6000 + " dzd" * 50)] + [("aa", "copy")] * 30 + [("aa", f"t{k}") for k in range(8)]
    labelled = spark.createDataFrame(rows, "lang string, text string")
    taken = [x.text for x in sample(labelled.where("lang = 'aa'"), 5).collect()]
    assert len(taken) == len(set(taken)) == 5
    tests = spark.createDataFrame([(1, "ünü ünü"), (2, "dzd dzd")], "doc_id long, text string")
    assert {x.doc_id: x.lang_pred for x in predict(tests, train(labelled)).collect()} == {1: "aa", 2: "bb"}
