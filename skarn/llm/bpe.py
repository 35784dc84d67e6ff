"""BPE encoding by forced boundaries, and decoding.

A byte pair that lies inside no vocabulary token can't be merged over, so a cut
between its two bytes is certain: the fragments on both sides are encoded
independently and their ids concatenated. Cuts hold inside the words that the
tokenizer's own normaliser and splitter give.

Work is per distinct word: Arrow splits a batch into words and finds the distinct ones,
each of which is encoded once and kept in a bounded memory; ids of whole texts are
gathered from them.
"""

from __future__ import annotations

import functools
import gc
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from skarn.llm.shared import kept

#: Bytes of text worked on at once, and words remembered per generation (two are kept).
SLICE_BYTES, REMEMBERED = 4_000_000, 300_000

# Texts of these characters only are NFC-stable, lower-case character by character, and
# split alike by Arrow and by the tokenizer; all others take the library's own steps.
_OTHER = "[^\t-\r -~¡-±´-¸º»¿-įı-ž‐-‧]|<\\|"
_LETTER = "a-zªµºß-öø-ž"
#: What the tokenizer's splitter sets apart from runs of letters, beside blanks.
_APART = f"('(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\t-\\r {_LETTER}0-9]+)"


@functools.cache
def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder and decoder of a byte-level BPE with word ends, from its tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.path, self.end = path, spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        #: Byte pairs inside tokens; between any other two bytes a cut is certain.
        self.inside = {pair for w in vocab for t in [w.removesuffix(self.end)] for pair in zip(t, t[1:])}
        self.joined = re.compile("|".join(re.escape(t) for t in self.special) or "(?!)")
        self.table = {i: c for i, c in enumerate(byte_chars())}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @functools.cached_property
    def final(self):
        """Merges of fragments that end a word: the library's own model, not a copy of it."""
        return self.library.model

    @functools.cached_property
    def inner(self):
        """Merges of fragments inside a word: no symbol has the word's end."""
        from tokenizers.models import BPE

        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return BPE(model["vocab"], [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]])

    def fragments(self, word: str) -> list[str]:
        """A word in byte characters, cut where no token has the pair."""
        cuts = [i for i, pair in enumerate(zip(word, word[1:]), 1) if pair not in self.inside]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def word(self, word: str) -> list[int]:
        """Ids of a word: its fragments' ids, one after the other; only the last has the word's end."""
        if self.inside.issuperset(zip(word, word[1:])):
            return [t.id for t in self.final.tokenize(word)]
        *before, last = self.fragments(word)
        return [t.id for f in before for t in self.inner.tokenize(f)] + [t.id for t in self.final.tokenize(last)]

    def any_text(self, text: str) -> np.ndarray:
        """Ids of any text: special tokens apart, then the library's normaliser and splitter."""
        ids: list[int] = []
        at = 0
        for m in [*self.joined.finditer(text), None]:
            plain = text[at : m.start() if m else len(text)]
            if plain:
                for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(plain)):
                    ids += self.word(w)
            if m:
                ids.append(self.special[m[0]])
                at = m.end()
        return np.array(ids, "<u4")

    def looked_up(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, as little-endian 32-bit integers; what isn't remembered is encoded."""
        parts = [*map(self.new.get, words)]
        for k, got in enumerate(parts):
            if got is None:
                word = words[k]
                if (got := self.old.get(word)) is None:
                    got = array("I", self.word(word if word.isascii() else word.encode().decode("latin-1").translate(self.table))).tobytes() if word else b""
                if len(self.new) >= REMEMBERED:
                    self.old, self.new = self.new, {}
                self.new[word] = parts[k] = got
        return parts

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Of slices of a string array (null: empty): first row, row after the last, ids, offsets of the rows in ids."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(texts):
            used = ends[first - 1] if first else 0
            after = max(first + 1, int(np.searchsorted(ends, used + SLICE_BYTES, "right")))
            collecting = gc.isenabled()
            gc.disable()  # nothing below makes cycles, and full collections walk all that is remembered
            try:
                ids, offsets = self._slice(texts.slice(first, after - first))
            finally:
                if collecting:
                    gc.enable()
            yield first, after, ids, offsets
            first = after
            del ids, offsets
            pa.default_memory_pool().release_unused()

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, _OTHER)
        plain = pc.if_else(odd, "", texts)
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(plain), _APART, r" \1 "))
        coded = lists.flatten().dictionary_encode()
        parts = self.looked_up(coded.dictionary.to_pylist())
        table = np.frombuffer(b"".join(parts), "<u4")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        starts = np.cumsum(sizes) - sizes
        index = coded.indices.to_numpy(zero_copy_only=False)
        size = sizes[index]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(ends[-1])
        at += np.repeat(starts[index] - ends[:-1], size)
        ids = table[at]
        bounds = lists.offsets.to_numpy()
        offsets = ends[bounds - bounds[0]]
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(rows):
            pieces = np.split(ids, offsets[1:-1])
            for r in rows:
                pieces[r] = self.any_text(texts[int(r)].as_py())
            ids = np.concatenate(pieces)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        return ids, offsets

    def decode(self, ids: np.ndarray) -> str:
        """As the library does without a decoder: the tokens' own strings, joined by blanks."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@kept
def encoder(path: str) -> ForcedBoundaryBPE:
    """One encoder per worker process and vocabulary, until the worker turns to another operator."""
    return ForcedBoundaryBPE(path)
