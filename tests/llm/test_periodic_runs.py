"""Periodic runs against brute force over random words, and the query over documents."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowforge.llm.catalogue import QUERIES
from rowforge.llm.periodic_runs import find_runs, runs_of, suffix_array

SMALL = "/root/testdata/sf0.001"


def brute(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - start >= max(6, 4 * q):
                found.append((start, end + q - start, q))
            start = max(end, start) + 1
    smallest = [r for r in found if not any(words[r[0] : r[0] + r[1] - p] == words[r[0] + p : r[0] + r[1]] for p in range(1, r[2]))]
    return sorted(smallest, key=lambda r: (r[0], r[2]))


def random_words(seed):
    pick = random.Random(seed)
    n, kinds = pick.randint(0, 70), pick.choice([1, 2, 2, 3, 6])
    words = [pick.randrange(kinds) for _ in range(n)]
    for _ in range(pick.randint(0, 3)):
        if n > 6:
            a, p = pick.randrange(n), pick.randint(1, 9)
            for i in range(a, pick.randint(a, n - 1) + 1):
                words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_brute_force(seed):
    for i in range(50):
        words = random_words(seed * 1000 + i)
        assert runs_of(np.array(words, dtype=np.int64)) == brute(words)


def test_suffix_and_lcp_arrays():
    for seed in range(60):
        words = random_words(seed)
        order, inverse, lcp = suffix_array(np.array(words, dtype=np.int64))
        assert order.tolist() == sorted(range(len(words)), key=lambda i: words[i:])
        assert all(inverse[order[i]] == i for i in range(len(words)))
        for i in range(1, len(words)):
            a, b = words[order[i - 1] :], words[order[i] :]
            agree = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[i] == agree


def test_long_texts():
    assert runs_of(np.zeros(300_000, dtype=np.int64)) == [(0, 300_000, 1)]
    words = np.random.default_rng(1).integers(0, 500, 120_000)
    words[40_000:] = np.resize(words[40_000:47_001], 80_000)
    start, length, period = runs_of(words)[0]
    assert (start + length, period) == (120_000, 7001) and 39_990 < start <= 40_000


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t\n", "c"), (4, "x x x x x x", "d"), (4, "x x x x x x", "d"), (5, "a b " * 4 + "c", None)]
    rows += [(None, "é é é é é é é", "e"), (6, "x x x x x", "f"), (7, "a b a b a b a b a b a b", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string").withColumns(
        {"_c0": F.lit(7), "runs": F.lit("own"), "collapsed": F.lit("own")}
    )
    found = find_runs(docs)
    assert found.columns == ["doc_id", "_text", "_c0", "n_words", "runs", "best_run", "collapsed"]
    got = sorted(((r.doc_id or 0, r._text or "", r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()), key=str)
    assert got == sorted(
        [
            (1, "a", 0, [], ""),
            (2, "b", 0, [], ""),
            (3, "c", 0, [], ""),
            (4, "d", 6, [(0, 6, 1)], "x"),
            (4, "d", 6, [(0, 6, 1)], "x"),
            (5, "", 9, [(0, 8, 2)], "a b c"),
            (0, "e", 7, [(0, 7, 1)], "é"),
            (6, "f", 5, [], "x x x x x"),
            (7, "g", 6, [(0, 6, 1)], "a b"),
        ],
        key=str,
    )
    assert find_runs(docs.limit(0)).collect() == []


def test_query_equals_brute_force(spark):
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    assert len(got) == len(texts)
    seen = 0
    for doc_id, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if n > 2000:
            continue
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        rest = " ".join(w for i, w in enumerate(words) if i not in gone)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        r = got[doc_id]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(rest.encode()).hexdigest()
        seen += bool(runs)
    assert seen > 5
