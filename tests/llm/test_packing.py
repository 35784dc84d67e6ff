"""Packing."""

import math
import random
import zlib

import numpy as np
import pytest

from helpers import VOCABULARY


def test_packing(docs, texts, library, nothing):
    from skarn.llm.packing import pack

    own = pack(docs, VOCABULARY, capacity=128).collect()
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in own if r.doc_id == i)
        assert mine == [(k, a, len(ids[a : a + 128]), zlib.crc32(ids[a : a + 128].tobytes())) for k, a in enumerate(range(0, len(ids), 128))]
    by_sequence = {}
    for r in own:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert pack(nothing, VOCABULARY).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_whole_and_tight(seed):
    from collections import Counter

    from skarn.llm.packing import Plan

    r = random.Random(seed)
    lengths = [r.choice([r.randint(1, 2048), r.randint(1, 300), 2048, 700]) for _ in range(r.choice([1, 30, 3000]))]
    plan = Plan(dict(Counter(lengths)), 2048)
    fill, given = Counter(), Counter()
    for length, first, n, sequence, per in plan.rows:
        assert first == given[length]
        given[length] += n
        for k in range(n):
            fill[sequence + k // per] += length
    assert given == Counter(lengths)
    assert max(fill.values()) <= 2048 and len(fill) <= plan.sequences
    rooms = []  # plain best fit decreasing
    for x in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= x]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= x
        else:
            rooms.append(2048 - x)
    assert len(fill) <= math.ceil(1.01 * len(rooms)) + 1


def test_configurations_place_most_large_pieces():
    from collections import Counter

    from skarn.llm.packing import Plan

    r = random.Random(7)
    counts = dict(Counter(min(2048, max(1, int(r.lognormvariate(6, 0.9)))) for _ in range(60_000)))
    plan = Plan(dict(counts), 2048)
    plain = Plan({}, 2048)
    plain.taken = dict.fromkeys(counts, 0)
    for s in sorted(counts, reverse=True):
        plain.best_fit(s, counts[s], 2048)
    large = sum(n for s, n in counts.items() if 2048 / 6 < s < 2048)
    assert plan.sequences <= 1.001 * plain.sequences and plan.configured > 0.9 * large
    assert max(len({x[3] for x in plan.rows if x[0] == s}) for s in counts if s > 400) > 1
