"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered in a total order of their content. A balanced Feistel network permutes the numbers of
the next power of four; cycle walking brings every image that lies outside the table back into it, which
keeps the map a permutation of exactly the row numbers. Position p goes to shard p mod n, slot p div n,
so shard sizes differ by at most one, slots have no gaps, and both directions are plain arithmetic: the
place of a row number, and the row number at a place, are computed without reading the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import position_rows
from .common import column, keeps_other_columns

ROUNDS = 6


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Permutation:
    """A keyed permutation of ``0 .. size - 1`` with its inverse."""

    def __init__(self, size: int, seed: int = 0) -> None:
        self.size = size
        self.half = np.uint64(max(1, (max(1, size - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        start = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.keys = _scramble(start + np.uint64(seed % (1 << 63)))

    def _network(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in keys:
            left, right = right, left ^ (_scramble(right + key) & self.mask)
        return right << self.half | left  # halves swapped, so the reversed keys undo it

    def _walk(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        x = self._network(x.astype(np.uint64), keys)
        while (outside := x >= np.uint64(self.size)).any():
            x[outside] = self._network(x[outside], keys)
        return x.astype(np.int64)

    def forward(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self.keys)

    def backward(self, positions: np.ndarray) -> np.ndarray:
        return self._walk(positions, self.keys[::-1])


def place_of(row_number: int, size: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number."""
    position = int(Permutation(size, seed).forward(np.array([row_number]))[0])
    return position % shards, position // shards


def row_at(shard: int, slot: int, size: int, shards: int, seed: int = 0) -> int:
    """Row number at a shard and slot."""
    return int(Permutation(size, seed).backward(np.array([slot * shards + shard]))[0])


def shard_rows(df: DataFrame, order_by: list[Column | str], shards: int = 16, seed: int = 0) -> DataFrame:
    """``df`` with ``row_number`` (from 0, in ``order_by``), ``shard`` and ``slot``.

    ``order_by`` must tell different rows apart for reruns to agree; rows that tie in all of it may swap
    places. Nulls sort first. An empty table stays empty. Input columns named like the added ones are
    replaced. The sort is dealt by ranges and written to shared storage; numbering adds one small table
    with a row per range.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    numbered = position_rows(df.drop("row_number", "shard", "slot"), order_by, "row_number")
    size = numbered.count()
    permutation = Permutation(max(1, size), seed)

    @F.pandas_udf("long")
    def position(numbers: pd.Series) -> pd.Series:
        return pd.Series(permutation.forward(numbers.to_numpy(dtype=np.int64)))

    spare = next(n for n in ("_position" + "#" * i for i in range(len(df.columns) + 1)) if n not in df.columns)
    placed = numbered.withColumn(spare, position("row_number"))
    return placed.select(
        *[column(placed, c) for c in numbered.columns],
        F.pmod(column(placed, spare), F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"`{spare}` div {shards}").alias("slot"),
    )


@keeps_other_columns
def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """Whole documents with ``row_number``, ``shard`` and ``slot``, in an order that content alone fixes."""
    slim = docs.withColumn("_hash", F.xxhash64("text"))
    others = [column(slim, c) for c in sorted(docs.columns) if c not in ("doc_id", "text")]
    order = [F.col("doc_id"), F.col("_hash"), F.xxhash64(F.lit(1), *others)]
    return shard_rows(slim, order, shards, seed).drop("_hash")


def shard_digest(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """One narrow row per document: id, size, checksum and place. The text itself is not moved.

    A null text has no bytes, so size 1 and the checksum of nothing. The law is ``rows``.
    """
    body = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    slim = docs.select(
        "doc_id",
        (F.length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("_hash"),
    )
    placed = shard_rows(slim, ["doc_id", "_hash", "size", "text_crc32"], shards, seed)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
