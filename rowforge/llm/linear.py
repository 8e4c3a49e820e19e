"""Logistic regression on hashed word and character n-grams, for texts of any length."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import sigmoid

#: Weights of one family of features: words, word pairs, runs of three bytes.
FAMILY = 1 << 16
FAMILIES = 3
_KEPT_WORDS = 400_000
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


class Words(dict):
    """Consecutive numbers for words, with the hash of each; forgets all when it has grown too large."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.zeros(1024, dtype=np.uint32)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        if number >= len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(len(self.hashes), dtype=np.uint32)])
        self.hashes[number] = xxhash.xxh32_intdigest(word, 7)
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Equal numbers mean equal words, within one call."""
        if len(self) > _KEPT_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def features(data: bytes, numbers: np.ndarray, words: Words) -> list[np.ndarray]:
    """Slots of each family, repeats included. A family without items is empty."""
    single = words.hashes[numbers]
    pairs = (single[:-1] * _MULTIPLIERS[0]) ^ (single[1:] * _MULTIPLIERS[1])
    raw = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    runs = (raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]) * _MULTIPLIERS[2]
    found = [single * _MULTIPLIERS[0] >> np.uint32(16), pairs * _MULTIPLIERS[2] >> np.uint32(16), runs >> np.uint32(16)]
    return [f.astype(np.int64) + i * FAMILY for i, f in enumerate(found)]


def shares(slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots with their share in their family."""
    index, value = [], []
    for family in slots:
        if len(family):
            at, n = np.unique(family, return_counts=True)
            index.append(at)
            value.append(n / len(family))
    if not index:
        return np.empty(0, dtype=np.int64), np.empty(0)
    return np.concatenate(index), np.concatenate(value)


@dataclass
class Rows:
    """Sparse rows: slots and values of row i lie between ``start[i]`` and ``start[i + 1]``."""

    slot: np.ndarray
    value: np.ndarray
    start: np.ndarray

    @classmethod
    def of_lists(cls, slots: pa.ChunkedArray, values: pa.ChunkedArray) -> Rows:
        """From two list columns of the same shape."""
        sizes = pc.list_value_length(slots).to_numpy()
        flat = [np.concatenate([np.asarray(c.flatten()) for c in x.chunks] or [np.empty(0)]) for x in (slots, values)]
        start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        return cls(flat[0].astype(np.int32), flat[1].astype(np.float32), start)

    @classmethod
    def empty(cls) -> Rows:
        return cls(np.empty(0, dtype=np.int32), np.empty(0, dtype=np.float32), np.zeros(1, dtype=np.int64))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots, values and the place within ``rows`` that each belongs to."""
        sizes = self.start[rows + 1] - self.start[rows]
        before = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(self.start[rows] - before, sizes)
        return self.slot[at], self.value[at], np.repeat(np.arange(len(rows)), sizes)

    def margins(self, weights: np.ndarray, bias: float) -> np.ndarray:
        owner = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        return bias + np.bincount(owner, weights=weights[self.slot] * self.value, minlength=len(self.start) - 1)


def fit_logistic(
    rows: Rows,
    label: np.ndarray,
    size: int,
    epochs: int = 15,
    rate: float = 2.0,
    decay: float = 1e-4,
    use: np.ndarray | None = None,
    seed: int = 1,
) -> tuple[np.ndarray, float]:
    """Weights and bias by AdaGrad over small batches; classes weigh alike. Deterministic."""
    use = np.arange(len(label)) if use is None else use
    weights, squares = np.zeros(size), np.full(size, 1e-2)
    bias, bias_square = 0.0, 1e-2
    positive = label[use].sum()
    if not len(use) or positive in (0, len(use)):
        return weights, 0.0 if not len(use) else (4.0 if positive else -4.0)
    balance = {1: len(use) / (2 * positive), 0: len(use) / (2 * (len(use) - positive))}
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        shuffled = order.permutation(use)
        for at in range(0, len(shuffled), 64):
            batch = shuffled[at : at + 64]
            slot, value, owner = rows.take(batch)
            margin = bias + np.bincount(owner, weights=weights[slot] * value, minlength=len(batch))
            truth = label[batch]
            error = (sigmoid(margin) - truth) * np.where(truth > 0, balance[1], balance[0]) / len(batch)
            touched, inverse = np.unique(slot, return_inverse=True)
            gradient = np.bincount(inverse, weights=error[owner] * value) + decay * weights[touched]
            squares[touched] += gradient**2
            weights[touched] -= rate * gradient / np.sqrt(squares[touched])
            step = float(error.sum())
            bias_square += step**2
            bias -= 0.1 * step / bias_square**0.5
    return weights, float(bias)


def margin_of(slots: list[np.ndarray], weights: np.ndarray, bias: float) -> float:
    """The margin of one text from its slots, without finding distinct ones first."""
    return bias + float(sum(weights[f].mean() for f in slots if len(f)))
