"""Encoding and decoding."""

import hashlib

import numpy as np

from helpers import VOCABULARY, by_id


def test_bpe_equals_library(docs, texts, library, nothing):
    from skarn.llm.tokens import encode, encode_decode

    got = by_id(encode_decode(docs, VOCABULARY))
    ids = by_id(encode(docs, VOCABULARY))
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert list(ids[i].ids) == want
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert encode_decode(nothing, VOCABULARY).count() == 0


def test_forced_boundaries_are_certain():
    from skarn.llm.bpe import encoder

    coder = encoder(VOCABULARY)
    for word in ("unbelievably", "zzzqqq", "xqz", "a"):
        parts = coder.fragments(word)
        assert "".join(parts) == word
        assert all((a[-1], b[0]) not in coder.inside for a, b in zip(parts, parts[1:]))


def test_other_operators_drop_the_encoder(spark):
    from skarn.llm.bpe import encoder
    from skarn.llm.jaccard import signatures
    from skarn.llm.pii import scanned

    class Task:
        """Stands for a table: gives the function that a worker would run."""

        def select(self, *_):
            return self

        def mapInArrow(self, f, _):  # noqa: N802
            return f

    for task in (signatures(Task(), "doc_id", "text", 5), scanned(Task(), "doc_id", "text")):
        assert encoder(VOCABULARY).looked_up(["a"])
        assert encoder.cache_info().currsize == 1
        list(task(iter([])))
        assert encoder.cache_info().currsize == 0
