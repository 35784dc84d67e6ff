"""Language models."""

import random

import numpy as np

from helpers import by_id


def test_language_model_is_exact():
    from skarn.llm.langid import build, score_bytes

    data = b"abracadabra abracadabra abracadabra " * 20
    raw = np.frombuffer(b"\0" * 3 + data, np.uint8).astype(np.int64)
    code = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    grams, counts = np.unique(code, return_counts=True)
    model = build(["x"] * len(grams), grams, counts)
    mass = np.exp2(-model.bits[:, :, 0].astype(float))
    weight = np.where(np.arange(mass.shape[1]) == 0, 256 - (mass.shape[1] - 1), 1)
    assert np.allclose((mass * weight).sum(1), 1, atol=1e-3)  # code lengths of all 256 bytes fill the code space
    two = np.frombuffer(b"\0\0\0cadab\0\0\0zzq", np.uint8)
    both = score_bytes(model, two, np.array([0, 8]))
    alone = [score_bytes(model, np.frombuffer(b"\0\0\0" + t, np.uint8), np.array([0]))[0] for t in (b"cadab", b"zzq")]
    assert np.allclose(both[:, 0], [a[0] for a in alone])


def test_language_id(spark, nothing):
    from skarn.llm.langid import predict, train

    r = random.Random(4)
    syllables = {"aa": ["ba", "ka", "ma", "ra"], "bb": ["öl", "iz", "enk", "uss"]}
    make = lambda lang, n: " ".join("".join(r.choices(syllables[lang], k=3)) for _ in range(n))
    rows = [(i, make(lang, 40), lang) for i, lang in enumerate(["aa", "bb"] * 30)]
    model = train(spark.createDataFrame([*rows, (90, None, "aa"), (91, "x", None)], "doc_id long, text string, lang string"))
    tests = [(i, make(lang, 5), lang) for i, lang in enumerate(["bb", "aa"] * 20)] + [(100, None, None), (101, "", None), (102, "12 ..", None), (103, "\0\0", None)]
    got = by_id(predict(spark.createDataFrame(tests, "doc_id long, text string, lang_pred string"), model))
    for i, _, lang in tests:
        assert got[i].lang_pred == (lang or "und") and 0 <= got[i].score <= 1
    empty = train(nothing)
    assert by_id(predict(spark.createDataFrame(tests[:1], "doc_id long, text string, z string"), empty))[0].lang_pred == "und"
