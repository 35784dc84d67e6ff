"""Removal of repeated byte strings by deep-shallow suffix sorting (op 9).

A byte is removed when a string of :data:`LENGTH` bytes that covers it also starts in a
document with a smaller id. Suffixes are compared on their first ``LENGTH`` bytes.

Only suffixes that may have an equal one are sorted. The smallest hash among the
``LENGTH - SEED + 1`` strings of ``SEED`` bytes within a suffix's first ``LENGTH`` bytes
names it (its seed): equal suffixes have equal seeds at equal offsets.

1. Seeds that stand in two documents are found from sorted, packed seed lists, a few
   bytes a seed, dealt to buckets of even size whose number follows the input. They go
   into a Bloom filter that grows with them up to a bound.
2. The texts are read again. Suffixes that follow each other with one seed travel as one
   row, their bytes once, to where their seed is sorted. Rows equal to one of a smaller
   document of the same batch need not travel.
3. Suffixes of the same seed and offset are sorted: multikey quicksort on words of eight
   bytes to a shallow depth, then blind tries, which branch on the first byte that
   differs from a leader, order the groups that still agree. Leaves hold equal suffixes.
4. The removed spans of each document meet its text.

Suffixes of seeds with very many different surroundings are aggregated by their own
bytes before they are shuffled, so that neither a seed nor a suffix is too much for a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.jaccard import bounds_of, by_group, mix
from skarn.llm.shared import discard, join_groups, sized_join, slices, trim, written

#: Bytes of a string that counts, and of a seed within it.
LENGTH, SEED = 50, 24
WINDOW = LENGTH - SEED + 1
#: Most bytes of a run of suffixes with one seed.
MOST = LENGTH + WINDOW - 1
#: Words of eight bytes that multikey quicksort goes through before blind tries take over.
SHALLOW_WORDS = 2
#: Fewest and most bits of the filter of shared seeds (8 and 64 MB), bits for each seed in between, hash functions.
FILTER_BITS, MOST_FILTER_BITS, SEED_BITS, FILTER_HASHES = 1 << 26, 1 << 29, 8, 3
#: Bits of the filter that are collected as one row.
PAGE_BITS = 1 << 15
#: Seeds whose bits go to the pages together.
MARKED = 500_000
#: Fewest buckets that seed lists are dealt to, most bytes of text to a bucket (a fourteenth as many seeds).
BUCKETS, BUCKET_BYTES = 256, 16_000_000
#: Bytes of text worked on at once; bytes of runs within which a task settles equal ones before they travel.
SLICE_BYTES, HELD_BYTES = 1_000_000, 8_000_000

_P = np.uint64(0x9E3779B97F4A7C15)
_LOW48 = np.uint64((1 << 48) - 1)


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``SEED`` bytes from each position on, by doubling."""
    power, step = [_P], 1
    parts = {1: data.astype(np.uint64) + np.uint64(1)}
    while step * 2 <= SEED:
        h = parts[step]
        parts[step * 2] = h[:-step] * power[-1] + h[step:]
        power.append(np.uint64(int(power[-1]) ** 2 % 2**64))
        step *= 2
    out, have, n = None, 0, len(data) - SEED + 1
    for k in sorted(parts, reverse=True):
        if have + k <= SEED:
            part = parts[k][have : have + n]
            out = part if out is None else out * power[k.bit_length() - 1] + part
            have += k
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values."""
    n, step = len(x) - w + 1, 1
    while step * 2 <= w:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[w - step : w - step + n]) if w > step else x[:n]


class Runs:
    """Runs of suffixes with one seed, of documents that follow each other in ``data``."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data = data
        h = seed_hashes(data)
        place = np.arange(len(h), dtype=np.uint64)
        low = np.uint64((1 << 23) - 1)
        at = (sliding_min((h & ~low) | place, WINDOW) & low).astype(np.int64)  # the leftmost smallest seed
        number = np.repeat(np.arange(len(starts)), ends - starts)[: len(at)]
        valid = np.arange(len(at)) + LENGTH <= ends[number]
        suffix = np.flatnonzero(valid)
        at, number = at[suffix], number[suffix]
        new = np.ones(len(suffix), bool)
        new[1:] = (at[1:] != at[:-1]) | (number[1:] != number[:-1])
        first = np.flatnonzero(new)
        self.doc = number[first]
        self.seed = h[at[first]]
        self.begin = suffix[first]  # first suffix
        self.at = self.begin - starts[self.doc]  # its place in its stretch
        self.count = np.diff(np.append(first, len(suffix)))
        self.pre = at[first] - self.begin  # the seed's offset in it


def runs_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, Runs]]:
    """Of slices of texts: first row, row and place within its text of each stretch of ``data``, runs.

    A text longer than a slice is worked on in stretches that overlap by ``LENGTH - 1`` bytes.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    raw = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    stretches: list[tuple[int, int, int, int]] = []
    for r, n in enumerate(sizes.tolist()):
        for at in range(0, max(1, n - LENGTH + 1), SLICE_BYTES):
            stretches.append((r, at, int(offsets[r]) + at, min(int(offsets[r]) + at + SLICE_BYTES + LENGTH - 1, int(offsets[r]) + n)))
    k = 0
    while k < len(stretches):
        row, place, parts, held = [], [], [], 0
        while k < len(stretches) and (not parts or held + stretches[k][3] - stretches[k][2] <= SLICE_BYTES + LENGTH):
            r, at, a, b = stretches[k]
            k += 1
            if b - a >= LENGTH:
                row.append(r)
                place.append(at)
                parts.append(raw[a:b])
                held += b - a
        if parts:
            ends = np.cumsum([len(p) for p in parts])
            data = np.concatenate(parts)
            yield np.array(row), np.array(place), Runs(data, ends - [len(p) for p in parts], ends)


def short_seeds(seed: np.ndarray) -> np.ndarray:
    """48 bits of each seed, spread evenly: a seed is the smallest of ``WINDOW`` hashes, so its own high bits are mostly zero."""
    return ((seed >> np.uint64(16)) * _P) & _LOW48


def bucket_bits(docs: DataFrame) -> int:
    """Binary logarithm of the number of buckets for these texts."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return (max(BUCKETS, -(-size // BUCKET_BYTES)) - 1).bit_length()


def packed_seeds(docs: DataFrame, bits: int) -> DataFrame:
    """``bucket`` (the first ``bits``, at least 8, of its seeds), ``many``, ``seeds``: distinct seeds of each batch, those of several documents apart; 48 bits of each."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, BUCKET_BYTES):
            seeds, owner = [], []
            for row, _, runs in runs_of(b.column(1)):
                seeds.append(short_seeds(runs.seed))
                owner.append(row[runs.doc])
            if not seeds:
                continue
            seed, owner = np.concatenate(seeds), np.concatenate(owner)
            order = np.lexsort((owner, seed))
            seed, owner = seed[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
            last = np.append(first[1:], len(seed)) - 1
            many = owner[first] != owner[last]
            seed = seed[first]
            bucket = (seed >> np.uint64(48 - bits)).astype(np.int64)
            out: list[tuple[int, bool, bytes]] = []
            cut = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket)).tolist()
            for a, z in zip(cut, cut[1:]):
                for flag in (False, True):
                    own = seed[a:z][many[a:z] == flag]
                    if len(own):
                        out.append((int(bucket[a]), flag, ((own >> np.uint64(32)) & np.uint64(255)).astype(np.uint8).tobytes() + own.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out]), pa.array([x[2] for x in out], pa.binary())], ["bucket", "many", "seeds"])
        trim()

    return docs.mapInArrow(batches, "bucket int, many boolean, seeds binary")


def shared_seeds(docs: DataFrame, bits: int) -> DataFrame:
    """``n``, ``seeds``: number and 64-bit integers of the seeds of each bucket that stand in two documents; a task holds one bucket at a time."""

    def merged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_group(it, 1):
            bounds = bounds_of(b, 1)
            for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                once, often = [], []
                for bucket, many, raw in zip(*(c.slice(a, z - a).to_pylist() for c in b.columns), strict=True):
                    n = len(raw) // 5
                    seed = (np.uint64(bucket >> (bits - 8)) << np.uint64(40)) | (np.frombuffer(raw, np.uint8, n).astype(np.uint64) << np.uint64(32)) | np.frombuffer(raw, "<u4", n, n).astype(np.uint64)
                    once.append(seed)
                    if many:
                        often.append(seed)
                seed = np.concatenate(once)
                seed.sort()
                often = np.unique(np.concatenate([*often, seed[1:][seed[1:] == seed[:-1]]]))
                if len(often):
                    yield pa.RecordBatch.from_arrays([pa.array([len(often)], pa.int64()), pa.array([often.tobytes()], pa.binary())], ["n", "seeds"])

    return packed_seeds(docs, bits).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merged, "n long, seeds binary")


def filter_size(seeds: int) -> int:
    """Bits of the filter of so many seeds, a power of two within its bounds."""
    return min(MOST_FILTER_BITS, max(FILTER_BITS, 1 << max(0, seeds * SEED_BITS - 1).bit_length()))


def shared_filter(docs: DataFrame) -> np.ndarray:
    """The filter of seeds that stand in two documents: 32-bit words of it, of bounded number."""
    found = written(shared_seeds(docs, bucket_bits(docs)), "suffix-seeds")
    total = filter_size(found.agg(F.sum("n")).first()[0] or 0)

    def marked(seeds: list[np.ndarray]) -> pa.RecordBatch:
        at = np.unique(filter_bits(np.concatenate(seeds), total))
        page = at // PAGE_BITS
        cut = np.append(np.flatnonzero(np.concatenate([[True], page[1:] != page[:-1]])), len(page))
        places = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((2 * cut).astype(np.int32)), pa.py_buffer((at % PAGE_BITS).astype("<u2"))])
        return pa.RecordBatch.from_arrays([pa.array(page[cut[:-1]], pa.int32()), places], ["page", "places"])

    def placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in slices(it, SLICE_BYTES):
            for raw in b.column(0).to_pylist():
                held.append(np.frombuffer(raw, np.uint64))
                n += len(held[-1])
                if n > MARKED:
                    yield marked(held)
                    held, n = [], 0
        if held:
            yield marked(held)

    def paged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_group(it, 1):
            pages, out = [], []
            bounds = bounds_of(b, 1)
            for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                bits = np.zeros(PAGE_BITS, np.uint8)
                for raw in b.column(1).slice(a, z - a).to_pylist():
                    bits[np.frombuffer(raw, "<u2")] = 1
                pages.append(b.column(0)[a].as_py())
                out.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int32()), pa.array(out, pa.binary())], ["page", "bits"])

    marks = found.select("seeds").mapInArrow(placed, "page int, places binary")
    pages = marks.repartition("page").sortWithinPartitions("page").mapInArrow(paged, "page int, bits binary").toArrow()  # at most MOST_FILTER_BITS
    out = np.zeros(total // 32, "<u4").reshape(-1, PAGE_BITS // 32)
    for page, raw in zip(pages.column("page").to_pylist(), pages.column("bits"), strict=True):
        out[page] = np.frombuffer(raw.as_py(), "<u4")
    discard(found)
    return out.ravel()


def filter_bits(seed: np.ndarray, total: int) -> np.ndarray:
    """Places of 48-bit seeds in a filter of ``total`` bits."""
    shift = np.uint64(64 - (total.bit_length() - 1))
    return np.stack([(mix(seed + np.uint64((k + 1) * int(_P) % 2**64)) >> shift).astype(np.int64) for k in range(FILTER_HASHES)], 1)


def byte_rows(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Strings of at most ``MOST`` bytes as rows of a matrix, filled up with zeros."""
    padded = np.concatenate([data, np.zeros(MOST, np.uint8)])
    out = sliding_window_view(padded, MOST)[begin]
    out[np.arange(MOST) >= size[:, None]] = 0
    return out


def rows_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary array without nulls as a matrix (see :func:`byte_rows`), and the sizes."""
    text = text.cast(pa.large_binary())
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8)[at[0] : at[-1]] if len(text) else np.zeros(0, np.uint8)
    size = np.diff(at)
    return byte_rows(data, at[:-1] - at[0] if len(text) else at[:0], size), size


def binary_of(rows: np.ndarray, size: np.ndarray, none: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary array, null where ``none``."""
    size = np.where(none, 0, size)
    data = rows[np.arange(rows.shape[1]) < size[:, None]]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    valid = pa.py_buffer(np.packbits(~none, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), len(size), [valid, pa.py_buffer(offsets), pa.py_buffer(data)], int(none.sum()))


def led(seed: np.ndarray, pre: np.ndarray, doc: np.ndarray, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each run, a run of the smallest document with the same seed at the same place and the same bytes.

    Runs of a size, seed and place are sorted like suffixes; equal ones share a leaf.
    """
    place = pre * (MOST + 1) + size
    order = np.lexsort((place, seed))
    new = np.ones(len(seed), bool)
    new[1:] = (seed[order][1:] != seed[order][:-1]) | (place[order][1:] != place[order][:-1])
    several = ~(new & np.append(new[1:], True))  # runs that aren't alone
    some, segment = order[several], np.cumsum(new[several])
    moved, leaf = sorted_suffixes(rows[some], segment)
    some = some[moved]
    some = some[np.lexsort((doc[some], leaf))]  # leaves are numbered in their order
    heads = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]])) if len(some) else some
    leader = np.arange(len(seed))
    leader[some] = np.repeat(some[heads], np.diff(np.append(heads, len(some))))
    return leader


def candidate_rows(docs: DataFrame, shared: np.ndarray) -> DataFrame:
    """Runs whose seed the filter has: ``seed``, ``pre``, ``doc``, ``start``, ``text``; a null ``text`` is a span to remove.

    Of runs of equal bytes among ``HELD_BYTES`` only those of the smallest document go on;
    the others are spans to remove, from ``start`` on, ``pre`` bytes long.
    """
    shared_bits = docs.sparkSession.sparkContext.broadcast(shared)  # of bounded size

    def settled(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        seed, pre, doc, start, size, rows = map(np.concatenate, zip(*held, strict=True))
        leader = led(seed, pre, doc, rows, size)
        gone = doc > doc[leader]
        columns = [pa.array(seed), pa.array(np.where(gone, size, pre)), pa.array(doc), pa.array(start), binary_of(rows, size, gone)]
        return pa.RecordBatch.from_arrays(columns, ["seed", "pre", "doc", "start", "text"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, size = shared_bits.value, [], 0
        for b in slices(it, SLICE_BYTES):
            ids = b.column(0).to_numpy()
            for row, place, runs in runs_of(b.column(1)):
                at = filter_bits(short_seeds(runs.seed), len(bits) * 32)
                hit = np.flatnonzero(((bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1).all(1))
                own, long = runs.doc[hit], runs.count[hit] + LENGTH - 1
                rows = byte_rows(runs.data, runs.begin[hit], long)
                held.append((runs.seed[hit].view(np.int64), runs.pre[hit], ids[row[own]], place[own] + runs.at[hit], long, rows))
                size += rows.nbytes
                if size > HELD_BYTES:
                    yield settled(held)
                    held, size = [], 0
        if held:
            yield settled(held)
        held.clear()
        trim()

    return docs.mapInArrow(batches, "seed long, pre long, doc long, start long, text binary")


def multikey_quicksort(words: np.ndarray, segment: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by segment and their first ``depth`` words, and the segments they then fall into.

    All segments are split at once, each around the word of its middle row into smaller,
    equal and larger; the equal part goes on to its next word.
    """
    n = len(segment)
    order = np.argsort(segment, kind="stable")
    group = segment[order]
    word = np.zeros(n, np.int64)  # by place: the word that its segment is at
    while True:
        new = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, n))
        live = np.repeat(sizes > 1, sizes) & (word < depth)
        if not live.any():
            return order, np.cumsum(new) - 1
        middle = np.repeat(order[heads + sizes // 2], sizes)
        at = np.flatnonzero(live)
        own, pivot = words[order[at], word[at]], words[middle[at], word[at]]
        part = np.ones(n, np.int8)
        part[at] = np.where(own < pivot, 0, np.where(own > pivot, 2, 1))
        rank = np.cumsum(new) - 1
        moved = np.lexsort((part, rank))
        order, part, rank = order[moved], part[moved], rank[moved]
        word = word[moved] + ((part == 1) & live[moved])
        group = rank * 3 + part


def blind_tries(data: np.ndarray, order: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of groups that agree on ``depth`` bytes, in order of all bytes, and the leaf of each.

    A group's first row leads it. Others branch off by the first byte where they differ
    from it; those of one branch form a group, whose first row leads in turn. Rows equal
    to their leader share its leaf.
    """
    n, length = len(order), data.shape[1]
    done = np.zeros(n, bool)
    path = [group]
    group = group.copy()
    while True:
        new = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, n))
        live = np.repeat(sizes > 1, sizes) & ~done
        if not live.any():
            break
        lead = np.repeat(order[heads], sizes)
        at = np.flatnonzero(live)
        mine, theirs = data[order[at], depth:], data[lead[at], depth:]
        differs = mine != theirs
        first = np.where(differs.any(1), differs.argmax(1), length - depth)
        same = first == length - depth
        byte = np.where(same, 0, mine[np.arange(len(at)), np.minimum(first, length - depth - 1)]).astype(np.int64)
        larger = byte > np.where(same, 0, theirs[np.arange(len(at)), np.minimum(first, length - depth - 1)])
        # Smaller branches come before the leader, those that part from it first outermost; larger ones after, the other way round.
        key = np.zeros(n, np.int64)
        key[at] = np.where(same, 0, np.where(larger, 1, -1) * ((length - depth - first) * 256) + byte)
        rank = np.cumsum(new) - 1
        moved = np.lexsort((key, rank))
        order, rank, key, done, live = order[moved], rank[moved], key[moved], done[moved], live[moved]
        done |= live & (key == 0)
        group = np.cumsum(np.concatenate([[True], (rank[1:] != rank[:-1]) | (key[1:] != key[:-1])])) - 1
    return order, group


def sorted_suffixes(data: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Deep-shallow sort: order of rows of ``LENGTH`` bytes within segments, and leaves of equal rows (by place)."""
    padded = np.zeros((len(data), SHALLOW_WORDS * 8), np.uint8)
    padded[:] = data[:, : SHALLOW_WORDS * 8]
    words = padded.view(">u8").astype(np.uint64).reshape(len(data), SHALLOW_WORDS)
    order, group = multikey_quicksort(words, segment, SHALLOW_WORDS)
    return blind_tries(data, order, group, SHALLOW_WORDS * 8)


def smallest_of_equals(data: np.ndarray, segment: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of each row, the smallest document of the rows equal to it in its segment."""
    order, leaf = sorted_suffixes(data, segment)
    heads = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
    out = np.empty(len(doc), doc.dtype)
    out[order] = np.repeat(np.minimum.reduceat(doc[order], heads), np.diff(np.append(heads, len(order))))
    return out


def removed_spans(runs: DataFrame) -> DataFrame:
    """``doc``, ``start``, ``end`` of what smaller documents have too, from runs sorted by seed."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_group(it, 1):
            seed, pre, doc, start = (b.column(k).to_numpy() for k in range(4))
            rows, size = rows_of(b.column(4))
            leader = led(seed, pre, doc, rows, size)
            gone = doc > doc[leader]
            out = [(doc[gone], start[gone], start[gone] + size[gone])]
            # Of the rest, seeds with different runs are compared suffix by suffix, each different run once.
            heads = np.unique(leader)
            bounds = bounds_of(b, 1)
            number = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            several = np.bincount(number[heads], minlength=len(bounds) - 1) > 1
            heads = heads[several[number[heads]]]
            for part in chunks(heads, number[heads], size[heads] - LENGTH + 1):
                count = size[part] - LENGTH + 1
                owner = np.repeat(np.arange(len(part)), count)
                step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                data = sliding_window_view(rows[part], LENGTH, axis=1)[owner, step]
                segment = number[part][owner] * WINDOW + (pre[part][owner] - step)
                hit = smallest_of_equals(data, segment, doc[part][owner]) < doc[part][owner]
                # Hits that follow each other within a run are one span.
                first = hit & (np.concatenate([[True], ~hit[:-1]]) | (step == 0))
                last = hit & (np.concatenate([~hit[1:], [True]]) | (step == count[owner] - 1))
                who, lo, hi = part[owner[first]], step[first], step[last] + LENGTH
                # Runs of the same document and bytes elsewhere lose the same.
                member = np.flatnonzero(~gone)
                member = member[np.argsort(leader[member], kind="stable")]
                a, z = np.searchsorted(leader[member], who), np.searchsorted(leader[member], who, "right")
                times = z - a
                each = member[np.repeat(a, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
                out.append((doc[each], start[each] + np.repeat(lo, times), start[each] + np.repeat(hi, times)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["doc", "start", "end"])

    return runs.mapInArrow(batches, "doc long, start long, end long")


def chunks(rows: np.ndarray, group: np.ndarray, weight: np.ndarray, most: int = 200_000) -> Iterator[np.ndarray]:
    """Rows in parts of about ``most`` weight; a group stays in one part."""
    if not len(rows):
        return
    order = np.argsort(group, kind="stable")
    rows, group, weight = rows[order], group[order], weight[order]
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    total = np.add.reduceat(weight, heads)
    part = np.cumsum(total) // most
    for a, z in zip(cuts := np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), [*cuts[1:], len(heads)], strict=True):
        yield rows[heads[a] : heads[z] if z < len(heads) else len(rows)]


def single_suffixes(rows: DataFrame) -> DataFrame:
    """Runs taken apart: ``doc``, ``start``, ``text`` of ``LENGTH`` bytes of each suffix."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, SLICE_BYTES):
            rows, size = rows_of(b.column(2))
            count = size - LENGTH + 1
            owner = np.repeat(np.arange(len(count)), count)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            data = sliding_window_view(rows, LENGTH, axis=1)[owner, step]
            text = binary_of(data, np.full(len(owner), LENGTH), np.zeros(len(owner), bool))
            doc, start = (b.column(k).to_numpy()[owner] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start + step), text], ["doc", "start", "text"])

    return rows.select("doc", "start", "text").mapInArrow(batches, "doc long, start long, text binary")


def repeated_suffixes(suffixes: DataFrame) -> DataFrame:
    """``doc``, ``start``, ``end`` of single suffixes that smaller documents have too.

    Equal suffixes are aggregated before the shuffle; those of a hot one are dealt to many
    parts when they meet its smallest document.
    """
    first = suffixes.groupBy("text").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("size")).where("least < most").drop("most")
    return join_groups(suffixes, first, ["text"], "start").where("doc > least").select("doc", "start", (F.col("start") + LENGTH).alias("end"))


def merged_spans(spans: DataFrame) -> DataFrame:
    """``doc``, ``spans``: the union of each document's spans, pairs of 64-bit integers."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_group(it, 1):
            doc, start, end = (b.column(k).to_numpy() for k in range(3))
            bounds = bounds_of(b, 1)
            out = []
            for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                lo, hi = start[a:z], np.maximum.accumulate(end[a:z])
                new = np.concatenate([[True], lo[1:] > hi[:-1]])
                heads = np.flatnonzero(new)
                out.append(np.stack([lo[heads], hi[np.append(heads[1:], z - a) - 1]], 1).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(doc[bounds[:-1]]), pa.array(out, pa.binary())], ["doc", "spans"])

    return spans.repartition("doc").sortWithinPartitions("doc", "start").mapInArrow(batches, "doc long, spans binary")


#: Rows of one seed that one task sorts; suffixes of seeds with more are aggregated. Bytes of spans that may be broadcast.
MOST_ROWS, MOST_BROADCAST = 20_000, 32_000_000


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    A text is its UTF-8 bytes, a null one empty; strings never cross documents, and are
    judged on the input. A null id counts as smaller than all others. Rows that repeat an
    id are one document for the others, don't take from each other, and each lose what
    either loses at its place. Other columns are left out, whatever their names; an empty
    table gives none.
    """
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = written(candidate_rows(own, shared_filter(own)), "suffix-rows", "zstd")
    live = rows.where("text is not null")
    hot = written(live.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > most_rows).select("seed"), "suffix-hot-seeds")
    calm = sized_join(live, hot, ["seed"], "left_anti")
    apart = single_suffixes(sized_join(live, hot, ["seed"], "left_semi"))
    found = [rows.where("text is null").select("doc", "start", (F.col("start") + F.col("pre")).alias("end"))]
    found += [removed_spans(calm.select("seed", "pre", "doc", "start", "text").repartition("seed").sortWithinPartitions("seed")), repeated_suffixes(apart)]
    spans = written(merged_spans(found[0].unionByName(found[1]).unionByName(found[2])), "suffix-spans")
    discard(rows)
    discard(hot)
    size = spans.agg(F.coalesce(F.sum(F.octet_length("spans") + 16), F.lit(0))).first()[0]  # checked before it is broadcast
    both = own.join(F.broadcast(spans) if size <= MOST_BROADCAST else spans, "doc", "left").select("doc", "text", "spans")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, SLICE_BYTES):
            n, gone, count, kept = [], [], [], []
            for text, raw in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                at, parts, pairs = 0, [], np.frombuffer(raw or b"", "<i8").reshape(-1, 2).tolist()
                for lo, hi in pairs:
                    parts.append(text[at:lo])
                    at = hi
                rest = b"".join([*parts, text[at:]])
                n.append(len(text))
                gone.append(len(text) - len(rest))
                count.append(len(pairs))
                kept.append(hashlib.sha256(rest).hexdigest())
            counts = [pa.array(x, pa.int64()) for x in (n, gone, count)]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(kept, pa.string())], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = both.mapInArrow(batches, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.when(F.col("doc") > -(2**63), F.col("doc")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")
