"""Personal data."""

import hashlib
import math
import random
import re

import pytest

from helpers import by_id


def test_base_spans_equal_patterns():
    from skarn.llm.pii import base_spans, emails, luhn

    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    r = random.Random(9)
    for _ in range(3000):
        t = "".join(r.choices("a.@-+ b1", k=r.randint(0, 24)))
        assert emails(t) == [m.span() for m in pattern.finditer(t)]
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    text = "x 256.1.1.1 010.2.3.4 1.2.3.4.5 +1 (555) 010-9999 +12 4111-1111 1111 1111 5"
    assert [(k, text[a:b]) for k, a, b in base_spans(text)] == [("ip", "010.2.3.4"), ("ip", "1.2.3.4"), ("phone", "+1 (555) 010-9999")]
    assert base_spans("1" * 200_000) == []


def test_sanitise(docs, texts, nothing):
    from skarn.llm.pii import base_spans, find, sanitise, shown

    got = by_id(find(docs))
    for i, t in enumerate(texts):
        base = shown(base_spans(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert got[i].spans.startswith(base)
    named = [i for i, t in enumerate(texts) if "Zorbax" in (t or "")]
    assert named and all("term" in got[i].spans for i in named)  # a rare word near one address in different surroundings, and nowhere else
    assert all(got[i].spans == "" for i, t in enumerate(texts) if not base_spans(t or ""))
    clean = by_id(sanitise(docs))
    assert set(clean) == set(range(len(texts))) and clean[4].text is None
    assert all("Zorbax" not in clean[i].text and "[CARD]" in clean[i].text and "4111" not in clean[i].text for i in named)
    assert all(clean[i].text == t for i, t in enumerate(texts) if not base_spans(t or ""))
    assert find(nothing).count() == 0 and sanitise(nothing).count() == 0


@pytest.mark.parametrize("most", [0, 64_000_000])
def test_terms_of_whole_documents(spark, monkeypatch, most):
    from skarn.llm import pii
    from skarn.llm.pii import base_spans, find, sanitise

    monkeypatch.setattr(pii, "MOST_BROADCAST", most)  # 0: joins are shuffled

    r = random.Random(3)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(30)]
    make = lambda n: " ".join(r.sample(words, n))
    texts = [make(25) for _ in range(60)]
    far = f"Quuxley {make(20)} mail a.b@x.org {make(20)} Quuxley"  # far from its only mention, and two copies
    late = f"Vantongeren {'1' * 400} + 10.1.2.3 {make(8)}"  # behind 400 characters
    texts += [far, far, late, make(20), None]
    docs = spark.createDataFrame([(i if i < 64 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    n = len(texts)
    own, held, seen = [], {}, {}
    for t in texts:
        t = t or ""
        spans = base_spans(t)
        own.append({t[a:b].lower() for _, a, b in spans})
        rest = {m[0].lower() for m in re.finditer(r"[^\W_]{3,}", t) if not any(m.start() < b and a < m.end() for _, a, b in spans)}
        for w in {m[0].lower() for m in re.finditer(r"[^\W_]{3,}", t)}:
            seen[w] = seen.get(w, 0) + 1
        for c in own[-1]:
            held.setdefault(c, []).append(rest)
    clean, got = by_id(sanitise(docs)), by_id(find(docs))
    for i, t in enumerate(texts[:64]):
        told = set()
        for c in own[i]:
            for w in set().union(*held[c]):
                both = sum(w in x for x in held[c])
                if math.log2(both * n / (len(held[c]) * seen[w])) >= math.log2(n / len(held[c])) / 1.25 - 1e-9:
                    told.add(w)
        base = base_spans(t)
        want = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W_]+", t) if m[0].lower() in told and not any(m.start() < b and a < m.end() for _, a, b in base)]
        assert [x for x in got[i].spans.split(",") if x.startswith("term")] == want
    assert "Vantongeren" not in clean[62].text and all("Quuxley" not in clean[i].text for i in (60, 61))
    assert clean[63].text == texts[63]
