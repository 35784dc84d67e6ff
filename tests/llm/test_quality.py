"""Quality rules."""

import re

from helpers import by_id


def test_quality_metrics(docs, texts, nothing):
    from skarn.llm.quality import judged, kept_rows

    got = by_id(judged(docs))
    for i, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        places = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)} if len(windows) < 2000 else None
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        if places is not None:
            assert r.n_repeat_words == len(places)
        assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words))
    assert sorted(r.doc_id for r in kept_rows(docs).collect()) == sorted(i for i, r in got.items() if r.kept)
    assert judged(nothing).count() == 0
