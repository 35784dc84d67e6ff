"""What the tests of the training-data operators share."""

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, kept string, rank string, task string, length string"


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def shingles(text):
    words = (text or "").lower().split()
    return set(zip(*[words[k:] for k in range(5)], strict=False)) or ({tuple(words)} if words else set())
