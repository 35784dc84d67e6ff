"""Encoding and decoding of a text column on Spark (op 3)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from skarn.llm.bpe import encoder
from skarn.llm.shared import slices, trim


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids array<int>``: the ids of each whole text.

    A null text counts as empty and has no ids; repeated rows and ids give one row each;
    columns other than the two named are left out, whatever their names.
    """
    schema = docs.select(F.col(id_col)).schema

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for b in slices(it):
            for first, after, ids, offsets in coder.encode(b.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype("i4")))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, after - first), lists], [id_col, "ids"])
        trim()

    return docs.select(id_col, text_col).mapInArrow(batches, schema.add("ids", ArrayType(IntegerType())))


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``: encodes each whole text and decodes its ids.

    Nulls, empty texts and repeated rows as in :func:`encode`; the digests of no ids and of
    an empty text are those of no bytes.
    """
    schema = docs.select(F.col(id_col)).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for b in slices(it):
            n, hashes, decoded = [], [], []
            for first, after, ids, offsets in coder.encode(b.column(1)):
                for k in range(after - first):
                    own = ids[offsets[k] : offsets[k + 1]]
                    n.append(len(own))
                    hashes.append(hashlib.sha256(own.astype("<u4", copy=False).tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(coder.decode(own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], schema.names)
        trim()

    return docs.select(id_col, text_col).mapInArrow(batches, schema)
