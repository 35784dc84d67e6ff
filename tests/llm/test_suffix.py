"""Suffix deduplication."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from helpers import by_id


@pytest.mark.parametrize("most", [2, 20_000])
def test_suffix_dedup(docs, texts, nothing, most):
    from skarn.llm.suffix import remove_repeats

    got = by_id(remove_repeats(docs, most_rows=most))
    seen = {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        own = {b[k : k + 50] for k in range(len(b) - 49)}
        for k in range(len(b) - 49):
            if seen.get(b[k : k + 50], i) < i:
                cover[k : k + 50] = 1
        for w in own:
            seen.setdefault(w, i)
        kept = bytes(c for c, m in zip(b, cover, strict=False) if not m)
        want = (len(b), len(b) - len(kept), int((np.diff(np.concatenate([[0], cover])) == 1).sum()), hashlib.sha256(kept).hexdigest())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want, i
    if most > 2:
        assert remove_repeats(nothing).count() == 0


def test_seed_buckets_and_filter(spark):
    from skarn.llm import suffix

    r = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz    "
    rows = [(i, "".join(r.choices(letters, k=4000))) for i in range(120)]
    rows += [(200 + i, r.choice(rows)[1][100:900]) for i in range(30)]
    own = spark.createDataFrame(rows, "doc long, text string").repartition(3)
    assert suffix.bucket_bits(own) == 8 and suffix.filter_size(10**7) == 1 << 27 and suffix.filter_size(10**12) == 1 << 29
    for bits in (8, 11):
        sizes = {}
        for x in suffix.packed_seeds(own, bits).collect():
            sizes[x.bucket] = sizes.get(x.bucket, 0) + len(x.seeds) // 5
        assert len(sizes) > 0.97 * 2**bits and max(sizes.values()) < 20 + 2 * sum(sizes.values()) / 2**bits
    owners = {}
    for d, t in rows:
        for _, _, runs in suffix.runs_of(pa.array([t])):
            for s in suffix.short_seeds(runs.seed).tolist():
                owners.setdefault(s, set()).add(d)
    want = sorted(s for s, d in owners.items() if len(d) > 1)
    for bits in (8, 11):
        got = suffix.shared_seeds(own, bits).collect()
        assert want and sorted(np.concatenate([np.frombuffer(x.seeds, np.uint64) for x in got]).tolist()) == want


def test_hot_suffixes_are_aggregated(spark):
    from skarn.llm.suffix import repeated_suffixes

    rows = [(i % 700, 50 * i, b"h" * 50) for i in range(3000)] + [(5, 7, b"u" * 50), (8, 1, b"v" * 50), (9, 2, b"v" * 50)]
    got = sorted(tuple(x) for x in repeated_suffixes(spark.createDataFrame(rows, "doc long, start long, text binary")).collect())
    assert got == sorted([(d, s, s + 50) for d, s, t in rows if t[:1] == b"h" and d > 0] + [(9, 2, 52)])


def test_deep_shallow_sort():
    from skarn.llm.suffix import LENGTH, sorted_suffixes

    r = np.random.default_rng(1)
    data = r.integers(97, 99, (600, LENGTH)).astype(np.uint8)
    data[:, :40] = 97  # long common prefixes
    data[300:] = data[:300]
    segment = np.arange(600) % 3
    order, leaf = sorted_suffixes(data, segment)
    keys = [(segment[k], data[k].tobytes()) for k in order]
    assert keys == sorted(keys)
    assert all((leaf[i] == leaf[i - 1]) == (keys[i] == keys[i - 1]) for i in range(1, 600))
