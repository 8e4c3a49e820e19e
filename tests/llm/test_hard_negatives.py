"""Hard negatives against brute force, on few rows with ties, repeats and unusable vectors."""

import random

import pytest
from pyspark.sql import functions as F

from rowforge.llm.hard_negatives import inner_products, mine_hard_negatives, pack, stream_windows, unpack

SCHEMA = "vec_id long, embedding array<double>, label int, id string, anchor string, score string, a string"


def brute(rows, anchors, take=5):
    clean = {}
    for vec_id, vector, label in rows:
        if vec_id is None or vector is None or label is None:
            continue
        if any(x is None or x != x or abs(x) == float("inf") for x in vector):
            continue
        clean[vec_id] = min(clean.get(vec_id, (label, vector)), (label, vector))
    whole = {k: (label, [int(256 * x // 1) for x in v]) for k, (label, v) in clean.items()}
    out = set()
    for a in whole:
        if not anchors(a):
            continue
        scores = [(-sum(x * y for x, y in zip(whole[a][1], v)), i) for i, (_, v) in whole.items() if i != a]
        scores.sort()
        same = [(-s, i) for s, i in scores if whole[i][0] == whole[a][0]][:take]
        for p, positive in same:
            fit = [(-s, i) for s, i in scores if whole[i][0] != whole[a][0] and 80 * p <= -100 * s <= 100 * p][:take]
            out |= {(a, positive, n, i, p, s) for n, (s, i) in enumerate(fit, 1)}
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, x, "x", "y", "z", "w") for i, v, x in rows], SCHEMA)


def rows_of(seed, n, width=6, labels=3, steps=4):
    pick = random.Random(seed)
    # Few steps make many equal scores; the vectors point one way, so that windows are not empty.
    return [(i, [pick.randint(1, steps) / 4 for _ in range(width)], pick.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("blocks", [(1, 3), (4, 16), (1024, 4096)])
def test_equals_brute_force(spark, blocks):
    rows = rows_of(1, 90)
    rows += [rows[3], rows[3], (3, [0.25] * 6, 0), (None, [1.0] * 6, 1), (200, None, 1), (210, [1.0] * 6, None)]
    rows += [(220, [float("nan")] + [1.0] * 5, 1), (230, [None] + [1.0] * 5, 1), (240, [float("-inf")] * 6, 1)]
    rows += [(250, [], 1), (260, [1.0, 1.0], 1), (-10, [1.0] * 6, 2), (-7, [-0.3] * 6, 2)]
    found = mine_hard_negatives(
        table(spark, rows), F.col("id") % 10 == 0, anchors_in_block=blocks[0], rows_in_block=blocks[1]
    )
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, lambda i: i % 10 == 0)
    assert len(got) > 100


def test_one_vector_for_all(spark):
    rows = [(i, [0.5, 0.5], i % 2) for i in range(60)]
    found = mine_hard_negatives(table(spark, rows), F.col("id") % 20 == 0, rows_in_block=7)
    assert {tuple(r) for r in found.collect()} == brute(rows, lambda i: i % 20 == 0)


def test_empty_table(spark):
    assert mine_hard_negatives(table(spark, []), F.col("id") % 10 == 0).collect() == []


def test_keys_sort_by_anchor_falling_score_and_id():
    rows = [(a, s, i, p) for a in (-3, 0, 5) for s in (-(1 << 62), -1, 0, 7) for i in (-9, 4) for p in (False, True)]
    assert [unpack(pack(*r)) for r in rows] == rows
    assert sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3])) == [unpack(k) for k in sorted(pack(*r) for r in rows)]


def test_ties_before_their_positive_count():
    keys = sorted([pack(1, 10, 5, True), pack(1, 10, 3, False), pack(1, 10, 8, False), pack(1, 9, 1, False)])
    assert list(stream_windows(keys, 5, 80, 100)) == [(1, 5, 1, 3, 10, 10), (1, 5, 2, 8, 10, 10), (1, 5, 3, 1, 10, 9)]


def test_huge_components_stay_exact():
    import numpy as np

    a = np.array([[2.0**40, 3.0]])
    assert inner_products(a, np.array([[2.0**20, 1.0]])).tolist() == [[2**60 + 3]]
    assert inner_products(a, a * -(2.0**40)).tolist() == [[-(2**63)]]
