"""The corpus pipeline against all its stages in plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORD, BLANK_LINE = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[\x20\x09-\x0D]*")
PATTERNS = {
    "EMAIL": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "IP": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "CARD": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "PHONE": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def good(text):
    from skarn.llm.quality import STOP_WORDS

    words = WORD.findall(text or "")
    n = len(words)
    windows = Counter(tuple(words[k : k + 3]) for k in range(n - 2))
    repeated = {k + d for k in range(n - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    if n < 50 or 100 * len(repeated) > 50 * n:
        return False
    lines = [x for x in text.split("\n") if not BLANK_LINE.fullmatch(x)]
    stops = sum(w in STOP_WORDS or (w[:1].isupper() and w.lower() in STOP_WORDS and w == w.capitalize()) for w in words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return 2 <= sum(map(len, words)) / n <= 15 and symbols / n <= 0.1 and stops / n >= 0.02 and (len(lines) - len(set(lines))) / len(lines) <= 0.3


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in p.finditer(text):
            d = re.sub(r"\D", "", m[0])
            if kind == "IP" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "CARD" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "PHONE" and not 8 <= len(d) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return out


def near(texts):
    """Of rows (id, text), those that stay: the first of each class."""
    sets = [set(zip(*[t.lower().split()[k:] for k in range(5)], strict=False)) for _, t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if len(a & b) >= 0.8 * len(a | b):
                    root[i] = min(root[i], root[j], key=lambda k: texts[k])
    return [row for k, row in enumerate(texts) if root[k] == k]


def cleaned(texts):
    """Texts without personal data and the words that disclose it."""
    spans = [base(t) for _, t in texts]
    inside = lambda m, own: any(m.start() < b and a < m.end() for a, b, _ in own)
    words = [[m for m in re.finditer(r"[^\W_]+", t) if len(m[0]) >= 3] for _, t in texts]
    n_t = Counter(w for own in words for w in {m[0].lower() for m in own})
    values = [{(k, t[a:b].lower() if k == "EMAIL" else re.sub(r"[^0-9.]" if k == "IP" else r"\D", "", t[a:b])) for a, b, k in own} for (_, t), own in zip(texts, spans, strict=True)]
    outside = [{m[0].lower() for m in own if not inside(m, x)} for own, x in zip(words, spans, strict=True)]
    n, n_c, n_ct = len(texts), Counter(), Counter()
    for v, o in zip(values, outside, strict=True):
        n_c.update(v)
        n_ct.update((c, w) for c in v for w in o)
    out = []
    for (i, t), v, own, x in zip(texts, values, words, spans, strict=True):
        told = {w for c in v for w in {m[0].lower() for m in own} if n_ct[c, w] and math.log2(n_ct[c, w] * n / (n_c[c] * n_t[w])) >= math.log2(n / n_c[c]) / 1.25 - 1e-9}
        gone = [(a, -b, f"[{k}]") for a, b, k in x] + [(m.start(), -m.end(), "[NAME]" if m[0][0].isupper() else "") for m in own if m[0].lower() in told and not inside(m, x)]
        new, at = "", 0
        for a, b, by in sorted(gone):
            if a >= at:
                new += t[at:a] + by
            at = max(at, -b)
        out.append((i, new + t[at:]))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    words = ["the", "of", "and", "in", *("".join(r.choices("abcdefghij", k=5)) for _ in range(300))]
    make = lambda n: " ".join(r.choices(words, k=n)) + " the of and"
    texts = [make(90) for _ in range(30)]
    texts += [texts[0], texts[1].upper(), texts[2].replace("the", "a", 1), texts[2] + " end", "short", None, "", make(2500), "same line here\n" * 40 + make(60), "### " * 40 + make(60)]
    for k in range(6):
        texts.append(f"{make(40)} Quendrith wrote jo{k % 2}@ex-ample.org from 10.0.0.{k} or +1 (555) 010-99{k}0, card 4111 1111 1111 1111. {make(30)}")
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [(3, texts[4] + " other"), (3, texts[3]), (60, texts[5])]


def test_pipeline_equals_plain_python(spark, tmp_path, rows):
    from tokenizers import Tokenizer

    import corpus_pipeline

    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [(i, t) for i, t in rows if good(t)]
    last = {}
    for i, t in kept:
        key = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        last[key] = max(last.get(key, (-1, "")), (i, t), key=lambda x: x[0])
    texts = cleaned(near(sorted(last.values())))
    assert 20 < len(texts) < len(kept) < len(rows)
    assert any("[EMAIL]" in t and "[CARD]" in t and "Quendrith" not in t for _, t in texts)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in texts:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in out) == sorted(want)
    places = {}
    for x in out:
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for own in places.values():
        ends = [0, *(a + n for a, n in sorted(own))]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048


def test_stages_of_odd_tables(spark):
    import corpus_pipeline

    long = " ".join(f"w{k} the" for k in range(60))
    own = [(None, long, "en", None, 1), (None, long, "en", None, 1), (1, long + " z", None, "s", None), (1, long + " z", None, "s", None), (2, None, None, None, None), (3, "", "de", "s", 0)]
    docs = spark.createDataFrame(own, COLUMNS).repartition(2)
    sizes = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        docs.write.mode("overwrite").format("noop").save()
        sizes.append(docs.count())
    assert sizes == [4, 2, 1, 1, 1]
    empty = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, empty, "")
        assert done.count() == 0
        if name != "best-fit packing":
            assert done.columns == empty.columns
            empty = spark.createDataFrame([], done.schema)
