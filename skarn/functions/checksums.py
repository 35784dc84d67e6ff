"""Checksums that no built-in function has, on whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _table(polynomial: int) -> np.ndarray:
    """What each byte does to a reflected cyclic redundancy code."""
    code = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        code = np.where(code & 1, (code >> 1) ^ np.uint32(polynomial), code >> 1)
    return code


def crc(data: list[bytes], polynomial: int, ones: int) -> np.ndarray:
    """Reflected codes of byte strings, all rows a byte at a time; ``ones`` is the start and the last mask."""
    table = _table(polynomial)
    size = np.array([len(x) for x in data], np.int64)
    order = np.argsort(-size, kind="stable")
    flat = np.frombuffer(b"".join(data), np.uint8)
    start = (np.cumsum(size) - size)[order]
    code = np.full(len(data), ones, np.uint32)
    live = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")  # rows with more than so many bytes
    for k, n in enumerate(live):
        code[:n] = table[(code[:n] ^ flat[start[:n] + k]) & 255] ^ (code[:n] >> 8)
    out = np.empty(len(data), np.int64)
    out[order] = code ^ np.uint32(ones)
    return out


def _column(data: Column, polynomial: int, ones: int) -> Column:
    @F.pandas_udf("long")
    def coded(part: pd.Series) -> pd.Series:
        return pd.Series(crc([bytes(x or b"") for x in part], polynomial, ones)).where(part.notna().to_numpy()).astype("Int64")

    return coded(data.cast("binary"))


def crc32c(data: Column) -> Column:
    """CRC-32C (Castagnoli) of bytes or of a text's UTF-8; null for null."""
    return _column(data, 0x82F63B78, 0xFFFFFFFF)


def crc16(data: Column) -> Column:
    """CRC-16 (reflected CCITT polynomial, start and last mask of ones) of bytes or of a text's UTF-8; null for null."""
    return _column(data, 0x8408, 0xFFFF)
