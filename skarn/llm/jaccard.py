"""N-gram Jaccard self-join with Bayesian candidate pruning (op 5).

1. Each text gives its set of word 5-gram hashes (64 bits) and MinHash values of it. Texts
   of equal sets are one class with one representative; what follows is about those.
2. Representatives that agree in a whole band of MinHash values meet. Within such a
   bucket MinHash values are compared step by step; a pair is dropped as soon as the
   posterior probability that its similarity reaches the threshold (uniform prior, so a
   Beta posterior) falls below a tolerance.
3. What survives only says which texts belong together: a bucket returns a spanning
   forest of its surviving pairs, of which connected components are made.
4. Within a component every pair is verified exactly, by products of the incidence
   matrix of texts and shared n-grams; a text's links are counted where they are found.

No pairs are written anywhere: buckets and components over :data:`BLOCK` members are
split into blocks, and pairs of blocks return one row a member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.shared import drop_kept, join_groups, single_rows, sized_join, slices, trim, written

WORDS, THRESHOLD = 5, 0.8
#: MinHash values are BANDS * ROWS; a pair at the threshold meets in no band with probability (1 - 0.8 ** 5) ** 32 < 3e-6.
BANDS, ROWS = 32, 5
#: MinHash values compared at a time; a pair less likely than this to reach the threshold is dropped.
STEP, TOLERANCE = 32, 1e-6
#: Most members of a bucket or component that meet in one task.
BLOCK = 256
SLICE_BYTES = 4_000_000

_HASHES = BANDS * ROWS
_RNG = np.random.default_rng(20_240_501)
_FLIP = _RNG.integers(0, 2**32, _HASHES, dtype=np.uint64).astype(np.uint32)
_FACTOR = (_RNG.integers(0, 2**32, _HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, n: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's word ``n``-grams.

    Words are lower-case and parted by white space. A text of fewer words has one n-gram,
    all of them; one without words has none.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        after = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLICE_BYTES, "right")))
        lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.slice(first, after - first)))
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        words = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), object), categorize=False) if len(coded.dictionary) else np.zeros(0, np.uint64)
        index = coded.indices.to_numpy(zero_copy_only=False)
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # blanks at the ends give empty words
        word = words[index]
        bounds = lists.offsets.to_numpy()
        bounds = bounds - bounds[0]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a < b and not full[a]:
                a += 1
            if a < b and not full[b - 1]:
                b -= 1
            own = word[a:b]
            if len(own) < n:
                own = own[None] if len(own) else np.zeros((0, 1), np.uint64)
                own = [own[:, k] for k in range(own.shape[1])]
            else:
                own = [own[k : len(own) - n + 1 + k] for k in range(n)]
            h = np.zeros(len(own[0]) if own else 0, np.uint64)
            for w in own:
                h = h * np.uint64(0x9E3779B97F4A7C15) + w
            yield np.unique(mix(h))
        first = after


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """Low 16 bits of the MinHash values of a set."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(_HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 512):
        z = low[at : at + 512, None] ^ _FLIP
        z *= _FACTOR
        np.minimum(best, z.min(0), out=best)
    return best.astype(np.uint16)


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """``doc``, ``mark`` (hash of the text), ``set_a``, ``set_b`` (128 bits that name the set; null: no words), ``hashes``."""
    import hashlib

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for part in slices(it):
            names, hashes = [], []
            for s in shingle_sets(part.column(2), n):
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                names.append(np.frombuffer(digest, "<i8").tolist() if len(s) else (None, None))
                hashes.append(min_hashes(s).tobytes() if len(s) else None)
            sets = [pa.array([x[k] for x in names], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], *sets, pa.array(hashes, pa.binary())], ["doc", "mark", "set_a", "set_b", "hashes"])
        trim()

    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), mark.alias("mark"), text_col)
    return rows.mapInArrow(batches, "doc long, mark long, set_a long, set_b long, hashes binary")


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of values compared, the fewest matches of a pair that isn't dropped.

    With a uniform prior, P(similarity >= t | m of n match) is the Beta(m + 1, n - m + 1)
    tail, that is P(Binomial(n + 1, t) <= m).
    """
    out = {}
    for n in range(STEP, _HASHES + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                out[n] = m
                break
    return out


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lowest index of each of ``n`` nodes' component under edges ``i, j``."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        old = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, old[i], low)
        np.minimum.at(label, old[j], low)
        label = label[label]
        if (label == old).all():
            break
    return label


def by_group(it: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups from rows sorted by their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for b in it:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        fresh = bool(held) and any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in range(keys))
        if fresh:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if len(new):
            held.append(b.slice(0, int(new[-1])))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = [b.slice(int(new[-1]))]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def bounds_of(b: pa.RecordBatch, keys: int) -> np.ndarray:
    cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
    return np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1, [b.num_rows]])


def blocked(members: DataFrame, key: str, size: str, node: str, block: int) -> DataFrame:
    """``key, bi, bj, blk`` and the rest: members of groups over ``block`` once for each pair of blocks that theirs is in."""
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    out = members.withColumn("blk", F.pmod(F.xxhash64(node), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rest = [c for c in members.columns if c not in (key, size)]
    return out.select(key, F.least("blk", "_other").alias("bi"), F.greatest("blk", "_other").alias("bj"), "blk", *rest)


def surviving(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """``u``, ``v``: a spanning forest of each bucket's pairs that pruning leaves; rows of ``members``: key, bi, bj, blk, doc, hashes."""
    least = least_matches(threshold, tolerance)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_group(it, 3):
            bounds = bounds_of(b, 3)
            n = b.num_rows
            end = np.repeat(bounds[1:], np.diff(bounds))
            blk, doc = b.column(3).to_numpy(), b.column(4).to_numpy()
            cross = (b.column(1).to_numpy() != b.column(2).to_numpy()) if n else np.zeros(0, bool)
            values = np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint16).reshape(n, _HASHES)
            left, right = [], []
            rows = np.arange(n)
            for d in range(1, int(np.diff(bounds).max())):
                rows = rows[rows + d < end[rows]]
                i, j = rows, rows + d
                own = ~cross[i] | (blk[i] != blk[j])
                i, j = i[own], j[own]
                same = np.zeros(len(i), np.int32)
                for at in range(0, _HASHES, STEP):
                    same += (values[i, at : at + STEP] == values[j, at : at + STEP]).sum(1)
                    stays = same >= least[at + STEP]
                    i, j, same = i[stays], j[stays], same[stays]
                left.append(i)
                right.append(j)
            if left:
                order = np.argsort(doc, kind="stable")  # the lowest document of a component is its root
                rank = np.empty(n, np.int64)
                rank[order] = np.arange(n)
                label = order[forest(n, rank[np.concatenate(left)], rank[np.concatenate(right)])[rank]]
                moved = doc != doc[label]
                yield pa.RecordBatch.from_arrays([pa.array(doc[moved]), pa.array(doc[label][moved])], ["u", "v"])

    return members.mapInArrow(batches, "u long, v long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node``, ``root``: the lowest node of each connected component of the nodes of ``edges`` (``u``, ``v``).

    Alternating large and small stars; each round is written to the shared folder, and
    rounds go on until one changes nothing. A node that many others are linked to is a hot
    key: its edges are dealt to many parts when they meet its lowest neighbour.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, name)
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("size"))
        large = join_groups(both, low, ["u"], "v").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), name)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
        small = join_groups(large, low, ["u"], "v").select(F.explode(ends).alias("e")).select("e.*")
        edges = written(small.where("u <> v").distinct(), name)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """``doc``, ``root``, ``split``, ``texts``, ``docs``: exact links of every member within its pair of blocks.

    Rows of ``members``: comp, bi, bj, blk, doc, weight, split, shingles. ``root``: lowest
    member linked to, directly or not, within the pair of blocks.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_group(it, 3):
            bounds = bounds_of(b, 3)
            cross = b.column(1).to_numpy() != b.column(2).to_numpy()
            blk, doc, weight = (b.column(k).to_numpy() for k in (3, 4, 5))
            raw = b.column(7)
            root, texts, docs = doc.copy(), np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
            for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if z - a < 2:
                    continue
                sets = [np.frombuffer(raw[k].as_py(), np.uint64) for k in range(a, z)]
                linked = links(sets, threshold)
                if cross[a]:
                    linked &= blk[a:z, None] != blk[None, a:z]
                texts[a:z] = linked.sum(1)
                docs[a:z] = linked @ weight[a:z]
                i, j = np.nonzero(np.triu(linked))
                order = np.argsort(doc[a:z], kind="stable")
                rank = np.empty(z - a, np.int64)
                rank[order] = np.arange(z - a)
                root[a:z] = doc[a:z][order[forest(z - a, rank[i], rank[j])[rank]]]
            yield pa.RecordBatch.from_arrays([b.column(4), pa.array(root), b.column(6), pa.array(texts), pa.array(docs)], ["doc", "root", "split", "texts", "docs"])

    return members.mapInArrow(batches, "doc long, root long, split boolean, texts long, docs long")


def links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets reach the Jaccard threshold."""
    g = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    if g == 2:
        common = np.zeros((2, 2))
        common[0, 1] = common[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        value, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(g), size.astype(np.int64))
        often = np.bincount(column, minlength=len(value)) > 1
        number = np.cumsum(often) - 1
        row, column = row[often[column]], number[column[often[column]]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((g, g))
        for at in range(0, int(often.sum()), 4096):
            lo, hi = np.searchsorted(column, [at, at + 4096])
            x = np.zeros((g, 4096), np.float32)
            x[row[lo:hi], column[lo:hi] - at] = 1
            common += x @ x.T
    out = common * (1 + threshold) >= threshold * (size[:, None] + size[None]) - 1e-9
    np.fill_diagonal(out, False)
    return out


def _known_id(doc: Column) -> Column:
    return F.coalesce(doc, F.lit(2**63 - 1))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, threshold: float = THRESHOLD, block: int = BLOCK, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: id, ``class_id``, ``n_links``, ``n_text_links``.

    ``class_id``: lowest id among the documents reached over links (pairs of documents
    whose sets of word ``n``-grams have a Jaccard similarity of ``threshold`` or more).
    ``n_links``: other documents linked to; ``n_text_links``: other sets linked to.
    A null text, or one without words, has no links and is its own class. Rows that
    repeat an id are documents of their own with that id; their texts' sets tell them apart. Other columns are left out, whatever
    their names; an empty table gives none. A null id names a class only if all ids of
    the class are null.
    """
    found = classified(docs, id_col, text_col, n, threshold, block, tolerance)
    return found.select(id_col, "class_id", "n_links", "n_text_links")


def classified(docs: DataFrame, id_col: str, text_col: str, n: int = WORDS, threshold: float = THRESHOLD, block: int = BLOCK, tolerance: float = TOLERANCE) -> DataFrame:
    """:func:`near_duplicates` with ``mark``, a hash of the row's text, and ``class_no``, which tells classes apart (null: no words)."""
    marked = written(signatures(docs, id_col, text_col, n), "signatures")
    some = marked.where("set_a is not null")
    # A row that has the set's text; ids may be null or stand for several texts, so sets are numbered (once, as they are written).
    source = F.min(F.struct(_known_id(F.col("doc")).alias("id"), "mark")).alias("source")
    sets = some.groupBy("set_a", "set_b").agg(F.min("doc").alias("low"), source, F.count("*").alias("weight"), F.first("hashes").alias("hashes"))
    sets = written(sets.withColumn("rep", F.monotonically_increasing_id()), "sets")

    def keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                values = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), values.shape[:2])
                for k in range(ROWS):
                    key = mix(key + values[:, :, k] * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], ["key", "doc"])

    met = sets.select("rep", "hashes").mapInArrow(keys, "key long, doc long")
    buckets = met.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(join_groups(met, buckets, ["key"], "doc"), "bucket-members")
    own = members.join(sets.select(F.col("rep").alias("doc"), "hashes"), "doc").select("key", "size", "doc", "hashes")
    edges = surviving(blocked(own, "key", "size", "doc", block).repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj"), threshold, tolerance)
    comps = components(edges)

    sizes = comps.groupBy("root").agg(F.count("*").alias("size"))
    sourced = sets.select(F.col("rep").alias("node"), "weight", "source.id", "source.mark")
    placed = join_groups(comps, sizes, ["root"], "node").join(sourced, "node")
    placed = written(placed.select(F.col("root").alias("comp"), "size", F.col("node").alias("doc"), "weight", "id", "mark"), "component-members")
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(_known_id(F.col(id_col).cast("long")).alias("id"), mark.alias("mark"), F.col(text_col).alias("_text"))
    chosen = sized_join(texts, placed, ["id", "mark"]).select("comp", "size", "doc", "weight", "_text")
    if not some.groupBy(_known_id(F.col("doc")), "mark").count().where("count > 1").isEmpty():
        chosen = chosen.dropDuplicates(["doc"])  # rows that repeat id and text

    def shingled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(it):
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([s.tobytes() for s in shingle_sets(part.column(4), n)], pa.binary())], ["comp", "size", "doc", "weight", "shingles"])

    rows = chosen.mapInArrow(shingled, "comp long, size long, doc long, weight long, shingles binary").withColumn("split", F.col("size") > block)
    rows = blocked(rows.select("comp", "size", "doc", "weight", "split", "shingles"), "comp", "size", "doc", block)
    found = written(verified(rows.repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj"), threshold), "verified")

    counts = found.groupBy("doc").agg(F.min("root").alias("root"), F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    far = components(found.where("split and doc <> root").select(F.col("doc").alias("u"), F.col("root").alias("v")), "split-components")
    roots = counts.join(far.select(F.col("node").alias("doc"), F.col("root").alias("far")), "doc", "left")
    roots = roots.select(F.col("doc").alias("rep"), F.coalesce("far", "root").alias("root"), "texts", "docs")
    roots = written(roots.join(sets.select("rep", "low"), "rep"), "roots")
    lowest = roots.groupBy("root").agg(F.min("low").alias("lowest"), F.count("*").alias("size"))
    roots = join_groups(roots, lowest, ["root"], "rep").select("rep", "root", "lowest", "texts", "docs")
    classes = sets.select("set_a", "set_b", "rep", "low", "weight").join(roots, "rep", "left")
    # A set that very many rows share is dealt to many parts; rows without words don't take part.
    known = join_groups(some.select("doc", "mark", "set_a", "set_b"), classes, ["set_a", "set_b"], F.monotonically_increasing_id(), "weight").select(
        "doc", "mark",
        F.coalesce("root", "rep").alias("class_no"),
        F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("lowest")).alias("class_id"),
        (F.col("weight") - 1 + F.coalesce("docs", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"),
    )
    none = marked.where("set_a is null").select(
        "doc", "mark", F.lit(None).cast("long").alias("class_no"), F.col("doc").alias("class_id"),
        F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_text_links"),
    )
    return known.unionByName(none).withColumnRenamed("doc", id_col)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, that whose id names it; see :func:`near_duplicates`.

    Of rows with that id the one whose text has the lowest hash, and of rows that repeat
    both any one. Texts without words all stay.
    """
    found = written(classified(docs, id_col, text_col, **options).where("class_no is not null").select(F.col(id_col).alias("_id"), F.col("mark").alias("_mark"), "class_no"), "near-classes")
    order = F.struct(F.col("_id").isNull(), "_id", "_mark")
    # Most classes are of one row; the rest's lowest rows are found by partial aggregates.
    first = found.groupBy("class_no").agg(F.min(order).alias("first"), F.count("*").alias("size")).where("size > 1")
    several = written(join_groups(found, first, ["class_no"], "_mark").select("_id", "_mark", (order == F.col("first")).alias("stays")), "near-rows")
    gone = written(several.where("not stays").select("_id", "_mark").distinct(), "near-duplicates")
    repeated = written(several.where("stays").groupBy("_id", "_mark").count().where("count > 1").select("_id", "_mark"), "near-repeated")
    small = gone.limit(1_000_001).count() <= 1_000_000
    own, mark = docs[id_col].cast("long"), F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    kept = docs.join(F.broadcast(gone) if small else gone, own.eqNullSafe(F.col("_id")) & (mark == F.col("_mark")), "left_anti")
    return single_rows(kept, repeated, own, mark)
