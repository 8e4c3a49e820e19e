"""Periodic runs in texts by branching tandem repeats of an enhanced suffix array.

The words of a text become numbers; suffix array, inverse and LCP array are made by rank doubling. Every LCP
interval is seen as merges of two neighbouring ranges of the suffix array whose suffixes agree in ``depth``
words. For each suffix ``i`` of the smaller range, ``ISA[i + depth]`` or ``ISA[i - depth]`` in the other range
is a branching square: two equal halves of ``depth`` words that cannot move on to the right. Squares are then
rotated to the left as far as they go, which merges all squares of a run into the one run. No tree is built.

Words that cannot belong to a long run are left out first: each pair of neighbouring words inside a run of
at least four periods stands three times in the text or more. Texts without such a stretch need no suffix array.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import column, map_batches

#: A run has at least so many words and so many periods. The screen below rests on four periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4


def suffix_array(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse, and the LCP of each suffix with the one before it (0 for the first)."""
    n = len(values)
    _, rank = np.unique(values, return_inverse=True)
    rank = rank.astype(np.int64)
    levels = [rank]
    step = 1
    while step < n:
        # Suffixes of equal rank that go past the end differ in length, so 0 stands for the end.
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = levels[-1][step:] + 1
        key = levels[-1] * (n + 1) + second
        _, rank = np.unique(key, return_inverse=True)
        rank = rank.astype(np.int64)
        levels.append(rank)
        step *= 2
        if rank.max(initial=0) == n - 1:
            break
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    lcp = np.zeros(n, dtype=np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    # Ranks of a level are equal if that many words agree: the LCP is put together from the highest level on.
    for level in range(len(levels) - 2, -1, -1):
        ranks = levels[level]
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), dtype=bool)
        same[inside] = ranks[a[inside]] == ranks[b[inside]]
        # A rank may also be equal because both suffixes end; distinct suffixes never do at once.
        lcp[1:][same] += 1 << level
        a[same] += 1 << level
        b[same] += 1 << level
    return order, rank, lcp


def merges(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every LCP value but the first: where its left range starts, its right range ends (exclusive), its depth.

    Position ``k`` merges the ranges ``[left, k)`` and ``[k, right)`` of the suffix array.
    """
    n = len(lcp)
    values = lcp.tolist()
    left, right = [0] * n, [n] * n
    stack: list[int] = []
    for k in range(1, n):
        depth = values[k]
        while stack and values[stack[-1]] > depth:
            right[stack.pop()] = k
        # Equal depths: the later merge takes in the earlier one.
        while stack and values[stack[-1]] == depth:
            right[stack.pop()] = k
        left[k] = stack[-1] if stack else 0
        stack.append(k)
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), lcp


def branching_squares(values: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and half lengths of the branching squares whose halves have at most ``longest`` words."""
    order, inverse, lcp = suffix_array(values)
    n = len(values)
    left, right, depth = merges(lcp)
    at = np.nonzero((depth > 0) & (depth <= longest))[0]
    at = at[at > 0]
    if not len(at):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    left, right, depth = left[at], right[at], depth[at]
    small_left = at - left <= right - at
    first = np.where(small_left, left, at)
    size = np.where(small_left, at - left, right - at)
    other = np.where(small_left, at, left), np.where(small_left, right, at)
    starts, halves = [], []
    # All suffixes of the smaller sides, some merges at a time: their number is n log n at most.
    bounds = np.concatenate([[0], np.cumsum(size)])
    cuts = [0]
    while cuts[-1] < len(at):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(bounds, bounds[cuts[-1]] + 2_000_000, side="right")) - 1))
    for p, q in zip(cuts, cuts[1:], strict=False):
        sizes = size[p:q]
        which = np.repeat(np.arange(p, q), sizes)
        within = np.arange(len(which)) - np.repeat(bounds[p:q] - bounds[p], sizes)
        suffix = order[first[which] + within]
        d = depth[which]
        for move in (d, -d):
            to = suffix + move
            there = (to >= 0) & (to < n)
            place = inverse[np.where(there, to, 0)]
            hit = there & (place >= other[0][which]) & (place < other[1][which])
            starts.append(np.minimum(suffix, to)[hit])
            halves.append(d[hit])
    return np.concatenate(starts), np.concatenate(halves)


def _rotated(values: np.ndarray, start: int, period: int) -> int:
    """How far left a square can move: the first word of the run that holds it."""
    step = 64
    while start > 0:
        low = max(0, start - step)
        apart = np.nonzero(values[low:start] != values[low + period : start + period])[0]
        if len(apart):
            return low + int(apart[-1]) + 1
        start, step = low, step * 4
    return 0


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of one text, by start and period. ``words`` are numbers.

    A run is a stretch with smallest period q and at least ``max(6, 4 q)`` words that no neighbouring word extends.
    """
    n = len(words)
    if n < LEAST_WORDS:
        return []
    pairs = words[:-1] * (int(words.max()) + 1) + words[1:]
    _, which, counts = np.unique(pairs, return_inverse=True, return_counts=True)
    often = np.concatenate([[False], counts[which] >= LEAST_PERIODS - 1, [False]])
    edges = np.nonzero(often[1:] != often[:-1])[0]
    # A stretch of k frequent pairs has k + 1 words.
    stretches = [(int(a), int(b) + 1) for a, b in edges.reshape(-1, 2) if b - a + 1 >= LEAST_WORDS]
    if not stretches:
        return []
    # All stretches in one array, a number of its own between them.
    parts, offsets, length = [], [], 0
    for i, (a, b) in enumerate(stretches):
        parts += [words[a:b], np.array([-1 - i])]
        offsets.append(length)
        length += b - a + 1
    values = np.concatenate(parts)[:-1]
    longest = max(b - a for a, b in stretches) // LEAST_PERIODS
    starts, halves = branching_squares(values, max(longest, 1))
    # A run of four periods holds the square two words before; most squares end here.
    inner = np.nonzero(starts > 0)[0]
    inner = inner[values[starts[inner] - 1] == values[starts[inner] - 1 + halves[inner]]]
    order = inner[np.lexsort((starts[inner], halves[inner]))]
    found: list[tuple[int, int, int]] = []
    ends: dict[int, list[tuple[int, int]]] = {}
    for start, period in zip(starts[order].tolist(), halves[order].tolist(), strict=True):
        end = start + 2 * period
        # Squares of a multiple of a run's period end with the run.
        if any(period % q == 0 and first <= start for first, q in ends.get(end, ())):
            continue
        first = _rotated(values, start, period)
        if end - first >= LEAST_PERIODS * period:
            ends.setdefault(end, []).append((first, period))
            if end - first >= LEAST_WORDS:
                found.append((first, end - first, period))
    offset = np.array(offsets)
    out = []
    for first, size, period in found:
        i = int(np.searchsorted(offset, first, side="right")) - 1
        out.append((first - offsets[i] + stretches[i][0], size, period))
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length by period; ties by smallest start, then period."""

    def order(a: tuple[int, int, int], b: tuple[int, int, int]) -> int:
        return b[1] * a[2] - a[1] * b[2] or a[0] - b[0] or a[2] - b[2]

    return min(runs, key=cmp_to_key(order)) if runs else None


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by single blanks, without those after the first period of a run."""
    if runs:
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        words = [w for w, gone in zip(words, (np.cumsum(edge[:-1]) > 0).tolist(), strict=True) if not gone]
    return b" ".join(words)


RUN = StructType([StructField(n, LongType(), False) for n in ("start", "length", "period")])


def find_runs(
    docs: DataFrame,
    text: str = "text",
    edit: Callable[[list[bytes], object], list[bytes]] | None = None,
    key: str | None = None,
) -> DataFrame:
    """``docs`` without the text, with ``n_words``, ``runs``, ``best_run`` and ``collapsed``.

    Words are runs of characters other than ASCII white space, numbered from 0. ``runs`` holds structs ``start,
    length, period`` by start, then period; ``best_run`` is the one with the greatest length by period (ties:
    smallest start, then period), or null; ``collapsed`` is the text's words joined by single blanks, without
    those that a run holds after its first period.

    Null and empty texts have no words, no run and an empty collapsed text. Repeated rows are kept, each with
    its result; an empty table gives an empty result. A long text is worked on whole, in memory that grows with
    its length. Input columns named like the added ones are replaced. ``edit`` may give other words in place of
    a text's own; it gets them and the row's ``key``.
    """
    added = ("n_words", "runs", "best_run", "collapsed")
    names = [c for c in docs.columns if c not in (text, *added)]
    plain = docs.select(
        *[column(docs, c).alias(f"_c{i}") for i, c in enumerate(names)], column(docs, text).cast("string").alias("_text")
    )
    others = plain.schema.fields[:-1]
    key_at = names.index(key) if key else None
    schema = StructType(
        [
            *others,
            StructField("n_words", LongType(), False),
            StructField("runs", ArrayType(RUN, False), False),
            StructField("best_run", RUN, True),
            StructField("collapsed", StringType(), False),
        ]
    )

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        made: dict[str, list] = {n: [] for n in added}
        for at, value in enumerate(batch.column(batch.num_columns - 1)):
            words = (value.as_py() or "").encode("utf-8", "surrogatepass").split()
            if edit:
                words = edit(words, None if key_at is None else batch.column(key_at)[at].as_py())
            numbers: dict[bytes, int] = {}
            ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
            runs = runs_of(ids)
            best = strongest(runs)
            made["n_words"].append(len(words))
            made["runs"].append([dict(zip(RUN.names, r, strict=True)) for r in runs])
            made["best_run"].append(dict(zip(RUN.names, best, strict=True)) if best else None)
            made["collapsed"].append(collapsed(words, runs).decode("utf-8", "surrogatepass"))
        yield {f.name: batch.column(i) for i, f in enumerate(others)} | made

    found = map_batches(plain, run, schema)
    return found.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], *added)


def planted(words: list[bytes], doc_id: object) -> list[bytes]:
    """The contract's words: one document in ten repeats a stretch of its words from some word on to its end.

    A null id has no decimal form, so its words stay as they are.
    """
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def runs_digest(docs: DataFrame) -> DataFrame:
    """The contract's rows: planted texts, the strongest run, and hashes of all runs and of the collapsed text."""
    found = find_runs(docs.select("doc_id", "text"), edit=planted, key="doc_id")
    runs = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best_run.start",
        "best_run.length",
        "best_run.period",
        F.expr("1000 * best_run.length div best_run.period").alias("exponent_milli"),
        F.sha2(F.array_join(runs, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
