"""Language identification by prediction by partial matching (op 8).

Each language has a tree of byte contexts up to :data:`DEPTH` bytes deep with counts of
the bytes that followed. A byte costs the code length that PPM gives it: in the longest
context known, or after an escape (as many counts as the context has different bytes,
bytes of longer contexts excluded) in the next shorter one, down to a uniform order.
Counts are frozen after training, so the code length of each byte in each context is
worked out once, into one table for all languages; scoring a text is looking up its
bytes' contexts in it. The language whose statistics code the text shortest wins.

Trees are fitted on a bounded sample, the one exception: at most ``per_language``
different texts of each language, chosen by a hash of the text and read whole. All
languages are learned, in blocks of :data:`BLOCK`, each a model of bounded size; the
texts are scored block by block, and scoring reads whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skarn.llm.shared import fresh, sized_join, slices, trim, written

#: Longest context in bytes; bound of the sample: different texts of each language; languages of a model.
DEPTH, PER_LANGUAGE, BLOCK = 3, 600, 16
#: A context is kept in the tree when this many bytes followed it in the sample; twice as many, and so on, where a model's table would be larger than so many bytes.
LEAST_COUNT, MODEL_BYTES = 8, 64_000_000
#: Bytes of text whose strings are counted at once.
COUNTED_BYTES = 1_000_000
#: Bytes of evidence that a score stands for, whatever the length of the text.
SCORE_BYTES = 4

_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    """``symbol``: byte to symbol (0: not learned); ``two``: symbols of two bytes to a state; ``three``: state and symbol to a state; ``bits[state, symbol, language]``."""

    languages: list[str]
    symbol: np.ndarray
    two: np.ndarray
    three: np.ndarray
    bits: np.ndarray


def sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` different texts of each ``lang``, those of the smallest hashes; others drop out before the sort."""
    hashed = labelled.withColumn("_h", F.xxhash64("text"))
    sizes = written(hashed.groupBy("lang").agg(F.approx_count_distinct("_h").alias("_n")), "language-sizes")
    # Three times the share of hashes that the bound needs: enough texts remain, and the window sees few.
    share = F.pmod("_h", F.lit(1 << 30)) * F.col("_n") < F.lit(3.0 * per_language) * F.lit(1 << 30)
    kept = sized_join(hashed, sizes, ["lang"]).where(share).groupBy("lang", "_h").agg(F.min("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("_h", F.lit(1 << 30)), "_h"))
    return kept.withColumn("_k", first).where(F.col("_k") <= per_language).select("lang", "text")


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", per_language: int = PER_LANGUAGE, block: int = BLOCK) -> list[Model]:
    """Context trees of every language of ``labelled``, a model for each ``block`` of them; rows without a language or text are left out.

    No such rows: no model, which predicts ``und``.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def grams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            counts: dict[str, dict[int, int]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = counts.setdefault(lang, {})
                raw = np.frombuffer(b"\0" * DEPTH + text.encode(), np.uint8)
                for at in range(0, len(raw) - DEPTH, COUNTED_BYTES):
                    part = raw[at : at + COUNTED_BYTES + DEPTH].astype(np.int64)
                    code = (part[:-3] << 24) | (part[1:-2] << 16) | (part[2:-1] << 8) | part[3:]
                    for g, n in zip(*(x.tolist() for x in np.unique(code, return_counts=True)), strict=True):
                        own[g] = own.get(g, 0) + n
            for lang, own in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(own.keys(), pa.int64()), pa.array(own.values(), pa.int64())], ["lang", "gram", "n"])

    chosen = sample(rows, per_language)
    found = written(chosen.mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-counts")
    languages = sorted(r.lang for r in found.select("lang").distinct().collect())
    models = []
    for at in range(0, len(languages), block):
        own = found.where(F.col("lang").isin(languages[at : at + block])).toArrow()  # bounded by the sample
        models.append(build(own.column("lang").to_pylist(), own.column("gram").to_numpy(), own.column("n").to_numpy()))
    return models


def build(langs: list[str], grams: np.ndarray, counts: np.ndarray) -> Model:
    """The model of counted strings of four bytes, the last of which is the byte predicted."""
    languages = sorted(set(langs))
    index = {x: i for i, x in enumerate(languages)}
    lang = np.array([index[x] for x in langs], np.int64)
    raw = np.stack([(grams >> s) & 255 for s in (24, 16, 8, 0)], 1) if len(grams) else np.zeros((0, 4), np.int64)
    symbol = np.zeros(256, np.int64)
    known = np.unique(raw[:, 3])
    known = known[known > 0]
    symbol[known] = np.arange(1, len(known) + 1)
    a = len(known) + 1
    sym = symbol[raw]
    # Contexts: strings of up to three symbols, none of them 0, coded in base a; each depth is kept where seen often.
    followed = sym[:, 3] > 0
    found = []
    for d in range(1, DEPTH + 1):
        part = sym[:, DEPTH - d : DEPTH]
        ok = followed & (part > 0).all(1)
        codes = part[ok] @ (a ** np.arange(d - 1, -1, -1))
        value, where = np.unique(codes, return_inverse=True)
        found.append((value, np.bincount(where, counts[ok], len(value))))
    least = LEAST_COUNT
    while sum((seen >= least).sum() for _, seen in found) * a * max(1, len(languages)) * 4 > MODEL_BYTES:
        least *= 2
    contexts = [np.zeros(1, np.int64), *(value[seen >= least] for value, seen in found)]
    first = np.cumsum([0, *(len(c) for c in contexts)])
    states = int(first[-1])

    def state(d: int, codes: np.ndarray) -> np.ndarray:
        """State of the longest suffix, at most ``d`` symbols, that is a context."""
        if d == 0:
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(contexts[d], codes), max(0, len(contexts[d]) - 1))
        hit = contexts[d][at] == codes if len(contexts[d]) else np.zeros(len(codes), bool)
        return np.where(hit, first[d] + at, state(d - 1, codes % a ** (d - 1)))

    parent = np.zeros(states, np.int64)
    for d in range(1, DEPTH + 1):
        parent[first[d] : first[d + 1]] = state(d - 1, contexts[d] % a ** (d - 1))
    bits = np.zeros((states, a, max(1, len(languages))), np.float32)
    for k in range(len(languages)):
        table = np.zeros((states, a))
        for d in range(DEPTH + 1):
            part = sym[:, DEPTH - d : DEPTH]
            ok = followed & (lang == k) & (part > 0).all(1)
            codes = part[ok] @ (a ** np.arange(d - 1, -1, -1)) if d else np.zeros(int(ok.sum()), np.int64)
            at = np.minimum(np.searchsorted(contexts[d], codes), max(0, len(contexts[d]) - 1))
            hit = contexts[d][at] == codes if len(contexts[d]) else np.zeros(len(codes), bool)
            np.add.at(table, (first[d] + at[hit], sym[ok, 3][hit]), counts[ok][hit])
        bits[:, :, k] = code_lengths(table, parent)
    two = np.zeros(a * a, np.int64)
    pairs = np.arange(a * a)
    old, new = pairs // a, pairs % a
    two[:] = np.where(new == 0, 0, np.where(old == 0, state(1, new), state(2, pairs)))
    # After a state of at most two symbols, one more symbol: its own string of symbols, cut to known ones.
    text = np.zeros(first[3], np.int64)
    for d in range(1, DEPTH):
        text[first[d] : first[d + 1]] = contexts[d]
    depth = np.repeat(np.arange(DEPTH), [len(contexts[d]) for d in range(DEPTH)])
    three = np.zeros((first[3], a), np.int32)
    for d in range(DEPTH):
        own = np.flatnonzero(depth == d)
        if len(own):
            codes = (text[own][:, None] * a + np.arange(a)[None]).ravel()
            three[own] = np.where(np.tile(np.arange(a), len(own)) == 0, 0, state(d + 1, codes)).reshape(len(own), a)
    return Model(languages, symbol, two.astype(np.int32), three.ravel(), bits)


def code_lengths(counts: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Bits of every symbol in every state, with escapes and exclusions; symbol 0, never learned, shares the uniform order."""
    states, a = counts.shape
    out = np.zeros((states, a), np.float32)
    unknown = 256 - (a - 1)  # bytes that symbol 0 stands for
    for lo in range(0, states, 4096):
        at = np.arange(lo, min(states, lo + 4096))
        p, mass, done = np.zeros((len(at), a)), np.ones(len(at)), np.zeros((len(at), a), bool)
        here = at
        for _ in range(DEPTH + 1):
            c = np.where(done, 0, counts[here])
            total, distinct = c.sum(1), (c > 0).sum(1)
            some = total > 0
            scale = np.where(some, mass / np.maximum(total + distinct, 1), 0)
            new = (c > 0) & ~done
            p = np.where(new, c * scale[:, None], p)
            mass = np.where(some, mass * distinct / np.maximum(total + distinct, 1), mass)
            done |= new
            root = here == 0
            here = parent[here]
            if root.all():
                break
            # States at the root have nothing shorter; what they count again is excluded already.
        weight = np.where(np.arange(a) == 0, unknown, 1)[None] * ~done
        share = mass / np.maximum(weight.sum(1), 1)
        p = np.where(done, p, share[:, None])
        out[at] = -np.log2(np.maximum(p, 1e-30))
    return out


def score_bytes(model: Model, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Code length of each text under each language; texts follow each other in ``data``, each after ``DEPTH`` zero bytes that cost nothing."""
    sym = model.symbol[data]
    a = model.bits.shape[1]
    state = model.three[model.two[sym[:-3] * a + sym[1:-2]] * np.int64(a) + sym[2:-1]]
    bits = model.bits.reshape(-1, model.bits.shape[2])[state * np.int64(a) + sym[3:]]
    for k in range(1, DEPTH + 1):
        bits[starts[1:] - k] = 0
    return np.add.reduceat(bits, starts, axis=0, dtype=np.float64)


def predict(docs: DataFrame, models: list[Model], text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``lang_pred`` and ``score``.

    ``lang_pred``: the language that codes the whole text shortest (of equals the first by
    name); ``und`` with score 0 for a null text, one without a letter, or no language
    learned. ``score``: the share of that language when code lengths per byte, taken for
    :data:`SCORE_BYTES` bytes, are turned into probabilities. Every row is judged on its
    own; other columns stay, but for those with the names of the results; an empty table
    gives none.
    """
    rest = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    lang, bits, mass = fresh(docs, "lang_pred", "bits", "mass")
    rows = docs.select(*rest, F.lit("und").alias(lang), F.lit(None).cast("double").alias(bits), F.lit(0.0).alias(mass), F.col(text_col))
    for k, model in enumerate(models):
        rows = scored(rows if k == 0 else written(rows, "languages"), model, k == len(models) - 1)
    score = F.when(F.col(mass) > 0, F.least(F.lit(1.0), 1 / F.col(mass))).otherwise(0.0)
    return rows.select(*rest, F.col(lang).alias("lang_pred"), score.alias("score"))


def scored(rows: DataFrame, model: Model, last: bool) -> DataFrame:
    """``rows`` after one more model: their last four columns are the best language so far, its bits a byte, the mass of all languages by its own, and the text (not after the ``last``)."""
    schema = StructType(rows.schema.fields[:-1]) if last else rows.schema
    held = rows.sparkSession.sparkContext.broadcast(model)  # bounded by MODEL_BYTES

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        gap = b"\0" * DEPTH
        for b in slices(it):
            n = b.num_columns
            pred, before, mass = (b.column(n - 4 + k).to_pylist() for k in range(3))
            own = [(k, t) for k, t in enumerate(b.column(n - 1).to_pylist()) if t and _LETTER.search(t)]
            if own:
                raw = [t.encode() for _, t in own]
                data = np.frombuffer(gap + gap.join(raw), np.uint8)
                starts = np.cumsum([0, *(len(r) + DEPTH for r in raw[:-1])])
                total = score_bytes(m, data, starts) / np.array([len(r) for r in raw])[:, None]
                best = total.argmin(1)
                least = total.min(1)
                share = np.exp2((least[:, None] - total) * SCORE_BYTES).sum(1)
                for (k, _), i, x, s in zip(own, best.tolist(), least.tolist(), share.tolist(), strict=True):
                    old = before[k]
                    if old is None or x < old:
                        pred[k], before[k], mass[k] = m.languages[i], x, s + (0 if old is None else mass[k] * 2 ** max(-1000.0, (x - old) * SCORE_BYTES))
                    else:
                        mass[k] += s * 2 ** max(-1000.0, (old - x) * SCORE_BYTES)
            found = [pa.array(pred, pa.string()), pa.array(before, pa.float64()), pa.array(mass, pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-4], *found, *b.columns[n - 1 :][: not last]], schema.names)
        trim()

    return rows.mapInArrow(batches, schema)
