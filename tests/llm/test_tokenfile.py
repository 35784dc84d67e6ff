"""Token files."""

import zlib

import numpy as np

from helpers import VOCABULARY, by_id


def test_token_files(docs, texts, library, nothing):
    from skarn.llm.tokenfile import read_documents, sequences, write

    files = write(docs, VOCABULARY, row=64)
    got = by_id(read_documents(files))
    at, whole = 0, []
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
        whole += ids.tolist()
    order = {r.name: r.base for r in files.collect()}
    rows = sorted(sequences(files).collect(), key=lambda r: (order[r.name], r.row))
    assert all(len(r.ids) == 64 == len(r.mask) for r in rows)
    assert [x for r in rows for x, m in zip(r.ids, r.mask, strict=True) if m] == whole
    assert read_documents(write(nothing, VOCABULARY)).count() == 0
