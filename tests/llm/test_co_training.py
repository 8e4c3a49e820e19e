"""Co-training against one document after the other, and what its views teach each other."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowforge.llm import co_training
from rowforge.llm.co_training import co_training_digest, learn_quality_views, metadata_slots, roles, sure_bounds
from rowforge.llm.linear import FAMILY, Words, features, margin_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=600, sources=6):
    """Good pages use one half of the words and come from low sources, both with exceptions."""
    pick, out = random.Random(3), []
    for i in range(n):
        good = pick.random() < 0.6
        words = [f"w{pick.randrange(40) + (25 if good else 0)}" for _ in range(pick.randrange(3, 40))]
        source = pick.randrange(3) + (0 if good ^ (pick.random() < 0.02) else 3)
        text = None if i % 97 == 5 else " ".join(words)
        out.append((i, text, None if i % 11 == 0 else "en", f"s{source}" if i % 13 else None, len(text or "")))
    return out, [int(r[3] in ("s0", "s1", "s2")) for r in out]


@pytest.fixture(scope="module")
def tables(spark):
    rows, label = corpus()
    docs = spark.createDataFrame([*rows, rows[7], (None, "w1 w2", "en", "s1", 5)], SCHEMA).repartition(5)
    labels = spark.createDataFrame([(i, label[i]) for i in range(0, 600, 2)] + [(1, None), (4, 0)], "doc_id long, quality int")
    return docs, labels


def plain_sums(rows, sides):
    """Per view and class: mean share of each slot, and documents, added up one row at a time."""
    words = Words()
    shares = [[Counter(), Counter()], [Counter(), Counter()]]
    documents = [[0, 0], [0, 0]]
    for r, (text_side, meta_side) in zip(rows, sides, strict=True):
        data = (r["text"] or "").encode()
        if text_side is not None:
            documents[0][text_side] += 1
            for family in features(data, words.numbers(data.split()), words):
                for slot in family.tolist():
                    shares[0][text_side][slot] += 1 / len(family)
        if meta_side is not None:
            documents[1][meta_side] += 1
            shares[1][meta_side].update(metadata_slots(r["source"], r["lang"], r["n_chars"]))
    return shares, documents


def test_a_round_equals_brute_force(tables):
    """Every document without a label, and no other, is taught by the sure view, over the whole table."""
    docs, labels = tables
    before, after = learn_quality_views(docs, labels, rounds=0), learn_quality_views(docs, labels, rounds=1)
    role = {r["_id"]: r for r in roles(labels).collect()}
    rows = docs.collect()
    seeds = [r for r in rows if r["doc_id"] in role and role[r["doc_id"]]["_seed"]]
    known = plain_sums(seeds, [(role[r["doc_id"]]["_label"],) * 2 for r in seeds])
    words, sides = Words(), []
    pool = [r for r in rows if r["doc_id"] not in role]
    for r in pool:
        data = (r["text"] or "").encode()
        a = margin_of(features(data, words.numbers(data.split()), words), before.text, 0.0)
        b = before.meta[metadata_slots(r["source"], r["lang"], r["n_chars"])].sum()
        says = [1 if m >= high else 0 if m <= low else None for m, (low, high) in zip((a, b), before.bounds, strict=True)]
        text_says, meta_says = says
        apart = None not in (text_says, meta_says) and text_says != meta_says
        sides.append((None, None) if apart else (meta_says, text_says))
    assert {s for _, s in sides} == {0, 1, None} and {s for s, _ in sides} == {0, 1, None}
    taught = plain_sums(pool, sides)
    for view, (weights, smoothing) in enumerate(((after.text, 0.1), (after.meta, 1.0))):
        mean, total = [], 0
        for side in (0, 1):
            own, other = known[1][view][side], taught[1][view][side]
            weight = min(1, own / other) if other else 0
            n = own + weight * other
            total += n
            mean.append({s: (known[0][view][side][s] + weight * taught[0][view][side][s]) / n for s in range(len(weights))})
        least = smoothing / total
        expected = [math.log((mean[1][s] + least) / (mean[0][s] + least)) for s in range(len(weights))]
        assert np.allclose(weights, expected, atol=1e-3)


def test_bounds_equal_counting():
    pick = random.Random(2)
    margin = np.array([pick.randrange(30) / 3 - 5 for _ in range(400)])
    label = np.array([int(m + pick.gauss(0, 2) > 1) for m in margin])
    low, high = sure_bounds(margin, label)
    n = [np.count_nonzero(label == k) for k in (0, 1)]

    def enough(beyond, side):
        right = np.count_nonzero(beyond & (label == side)) / n[side]
        wrong = (np.count_nonzero(beyond & (label != side)) + 1) / (n[1 - side] + 1)
        return right / (right + wrong) >= 0.9

    assert high == min(m for m in margin[label == 1] if enough(margin >= m, 1))
    assert low == max(m for m in margin[label == 0] if enough(margin <= m, 0))
    assert low < high
    assert sure_bounds(np.zeros(50), label[:50]) == (-np.inf, np.inf)


def test_sums_do_not_depend_on_tasks(tables):
    docs, labels = tables
    made = [learn_quality_views(d, labels) for d in (docs.coalesce(1), docs.repartition(7, "source"))]
    assert np.array_equal(made[0].text, made[1].text) and np.array_equal(made[0].meta, made[1].meta)
    assert np.array_equal(made[0].head, made[1].head)


def test_unlabelled_documents_teach_new_sources(spark):
    """A source that no label knows gets its weight from the text view, however many documents it has."""
    pick = random.Random(5)
    rows = []
    for i in range(900):
        good = i % 2
        text = " ".join(f"{'ab'[good]}{pick.randrange(30)}" for _ in range(30))
        rows.append((i, text, "en", f"old{good}" if i < 300 else f"new{good}", 100))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")

    def margin(model, source):
        return model.meta[metadata_slots(source, "en", 100)].sum()

    alone, exchanged = learn_quality_views(docs, labels, rounds=0), learn_quality_views(docs, labels)
    assert abs(margin(alone, "new1") - margin(alone, "new0")) < 1e-9
    assert margin(exchanged, "new1") - margin(exchanged, "new0") > 3


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = labels.filter("quality is not null").withColumn("test", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    scored = co_training_digest(docs, known.filter("not test")).join(known.filter("test"), "doc_id").toPandas()
    good, bad = (scored.loc[scored["quality"] == q, "score"].to_numpy() for q in (1, 0))
    auc = np.mean(good[:, None] > bad[None]) + 0.5 * np.mean(good[:, None] == bad[None])
    assert auc > 0.9


def test_null_is_no_name_of_a_source():
    assert metadata_slots(None, "en", 1) != metadata_slots("None", "en", 1)
    assert metadata_slots("s", None, None) != metadata_slots("s", "None", 0)


def test_roles(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)] + [(None, 1), (2000, None), (4, 1)], "doc_id long, quality int")
    made = {r["_id"]: r for r in roles(labels, 50).collect()}
    assert set(made) == set(range(1000)) and made[4]["_label"] == 1
    assert sum(r["_held"] for r in made.values()) == 50
    assert all(r["_seed"] != r["_held"] for r in made.values())
    one = roles(labels.filter("quality = 1")).collect()
    assert all(r["_seed"] for r in one)


def test_long_text(spark):
    text = " ".join(f"w{i % 1000}" for i in range(1_000_000))
    rows = [(1, text, "en", "a", len(text)), (2, "short", "en", "a", 5), (3, "", "en", "b", 0), (4, None, None, None, None)]
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    scored = {r["doc_id"]: r for r in co_training_digest(spark.createDataFrame(rows, SCHEMA), labels).collect()}
    assert set(scored) == {1, 2, 3, 4} and all(0 <= r["score"] <= 1 for r in scored.values())
    assert co_training.MAX_HELD >= 2
