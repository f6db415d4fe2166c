"""Hashed n-grams of UTF-8 bytes as numpy arrays, and bounded samples to fit on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

MOST_GROUPS = 300
_A, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_TABLE = ((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)).astype(np.uint32)


#: Bytes whose n-grams are held at a time, and the longest texts in characters that models are fitted on.
PART, FIT_CHARS = 1 << 16, 1 << 20


def grams(raw: np.ndarray, orders: tuple[int, ...], bits: int, starts: int | None = None) -> np.ndarray:
    """Bucket of every n-gram of ``raw``, or of those that begin at its first ``starts`` places: those of the k-th order lie in
    ``[k << bits, k + 1 << bits)``."""
    t = _TABLE[raw]
    out, h = [], t
    for n in range(1, max(orders) + 1):
        if n > 1:
            if len(h) < 2:
                break
            h = h[:-1] * _A + t[n - 1 :]
        if n in orders:
            own = h[:starts]
            x = (own ^ own >> np.uint32(15)) * _C
            out.append((x >> np.uint32(32 - bits)).astype(np.int32) + (orders.index(n) << bits))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def parts(spaced: bytes) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most ``PART`` bytes that end behind a space (byte 32) where they hold one."""
    at = 0
    while at < len(spaced):
        end = len(spaced) if len(spaced) - at <= PART else spaced.rfind(b" ", at, at + PART) + 1 or at + PART
        yield at, end
        at = end


def word_hashes(raw: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of every word between spaces (byte 32)."""
    t = np.where(raw == 32, np.uint32(0), _TABLE[raw]).astype(np.uint64)
    powers = np.cumprod(np.full(len(raw), 0x100000001B3, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(t * powers)])
    inside = np.concatenate([[False], raw != 32, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    # dividing by the power at the start makes equal words equal wherever they stand
    inverse = np.cumprod(np.full(len(raw), pow(0x100000001B3, -1, 1 << 64), np.uint64))
    h = (total[end] - total[start]) * inverse[start]
    return ((h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int32)


def bounded_sample(rows: DataFrame, group: str, most: int, total: int | None = None) -> list:
    """At most ``most`` rows of each value of ``group``, fewer where ``total`` over all values asks for it, chosen by a hash of ``doc_id``, for
    fitting on the driver. More than ``MOST_GROUPS`` values raise ``ValueError``.

    Rows are thinned by a hash threshold from the group's count before they leave the executors, so no group is
    gathered in one task; what arrives is cut to the bound in hash order.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("_n")).limit(MOST_GROUPS + 1).collect()
    if len(counts) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} values of {group}")
    most = min(most, max(1, total // max(1, len(counts)))) if total else most
    known = rows.sparkSession.createDataFrame([(r[group], min(1.0, 1.2 * most / r["_n"])) for r in counts], StructType([rows.schema[group], StructField("_share", DoubleType())]))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # at most MOST_GROUPS rows
    thin = rows.join(F.broadcast(known), group).withColumn("_at", place).where("_at < _share")
    # rows repeated with one doc_id count once, however many there are
    others = [F.min(c).alias(c) for c in rows.columns if c not in ("doc_id", group)]
    thin = thin.groupBy("doc_id", group).agg(*others, F.min("_at").alias("_at")).select(*rows.columns, "_at")
    found: dict = {}
    for row in sorted(thin.collect(), key=lambda r: (r["_at"], *map(str, r))):
        own = found.setdefault(row[group], [])
        if len(own) < most:
            own.append(row)
    return [r for k in sorted(found) for r in found[k]]
