"""Hard negatives of anchors by a secondary-sort shuffle of packed pair scores.

Anchors meet all rows in blocks of bounded size, each block pair in one task. The pairs that can matter are
packed into keys ``(anchor, descending score, id)``; ``repartitionAndSortWithinPartitions`` brings the pairs
of an anchor together in that order, and a streaming iterator opens a window at each positive and emits the
negatives that fall into it. The iterator holds a few windows and the ties of one score, never an anchor.

Pairs are thinned before the shuffle, without loss: of a block only its best positives of an anchor can be
among the anchor's best, and once those are known, only the first negatives of the block in each window.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import column

#: Most anchors and rows that a block aims at; a task holds one block of each and their scores.
ANCHORS_IN_BLOCK = 1024
ROWS_IN_BLOCK = 4096
#: Components are whole numbers of 1/256.
STEPS = 256
_SIGN = 1 << 63
_KEY = struct.Struct(">QQQ?")
_LONG = np.iinfo(np.int64)


def clean_vectors(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``id, label, vector`` of the rows that take part, one row for each id."""
    plain = rows.select(
        column(rows, key).cast("long").alias("id"),
        column(rows, label).cast("long").alias("label"),
        column(rows, vector).cast("array<double>").alias("vector"),
    )
    plain = plain.dropna()
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    first = Window.partitionBy("id").orderBy("label", "vector")
    return plain.filter(~bad).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def quantised(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of whole numbers as doubles; short vectors are filled up with zeros."""
    lengths = np.asarray(vectors.combine_chunks().value_lengths(), dtype=np.int64)
    flat = np.asarray(vectors.combine_chunks().flatten(), dtype=np.float64)
    with np.errstate(over="ignore"):
        steps = np.nan_to_num(np.floor(flat * STEPS))
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = steps
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; those beyond the range of a long stop at its ends."""
    most = float(np.abs(a).max(initial=0.0)) * float(np.abs(b).max(initial=0.0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = [[[int(x) for x in row] for row in side.tolist()] for side in (a, b)]
    exact = [[sum(x * y for x, y in zip(p, q, strict=True)) for q in whole[1]] for p in whole[0]]
    return np.array([[min(max(s, _LONG.min), _LONG.max) for s in row] for row in exact], dtype=np.int64)


def _blocks(table: pa.Table, anchors: pa.Table) -> tuple[np.ndarray, ...]:
    """Ids and labels of both sides, rows by growing id, and the quantised vectors."""
    table = table.sort_by("id")
    width = max([0, *(x for t in (table, anchors) for x in t.column("vector").combine_chunks().value_lengths().to_pylist())])
    out = []
    for side in (anchors, table):
        out += [side.column("id").to_numpy(), side.column("label").to_numpy(), quantised(side.column("vector"), width)]
    return tuple(out)


def _pairs(anchor: list[int], score: list[int], other: list[int]) -> pa.Table:
    return pa.table({n: pa.array(x, pa.int64()) for n, x in (("anchor", anchor), ("score", score), ("id", other))})


def _best_positives(table: pa.Table, anchors: pa.Table, most: int) -> pa.Table:
    """The best rows of the anchor's label in this block."""
    a_id, a_label, a, b_id, b_label, b = _blocks(table, anchors)
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    for label in np.intersect1d(a_label, b_label):
        mine, theirs = np.nonzero(a_label == label)[0], np.nonzero(b_label == label)[0]
        scores = inner_products(a[mine], b[theirs])
        for at, row in zip(mine, scores, strict=True):
            ids = b_id[theirs]
            other = ids != a_id[at]
            row, ids = row[other], ids[other]
            if len(row) > most:
                least = np.partition(row, len(row) - most)[len(row) - most]
                near = row >= least
                row, ids = row[near], ids[near]
            order = np.lexsort((ids, -row))[:most]
            out[0].extend([int(a_id[at])] * len(order))
            out[1].extend(row[order].tolist())
            out[2].extend(ids[order].tolist())
    return _pairs(*out)


def _window_negatives(table: pa.Table, anchors: pa.Table, take: int, least: int, whole: int) -> pa.Table:
    """The first rows of other labels of this block in the window of each of the anchor's positives."""
    a_id, a_label, a, b_id, b_label, b = _blocks(table, anchors)
    windows = anchors.column("windows").to_pylist()
    scores = inner_products(a, b)
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    for at, row in enumerate(scores):
        tops = sorted(set(windows[at] or []))
        if not tops:
            continue
        # Floor division keeps the bound exact, and 0.8 of a positive score is never above it.
        low = -(-least * tops[0] // whole)
        near = (row <= tops[-1]) & (row >= low) & (b_label != a_label[at])
        row, ids = row[near], b_id[near]
        order = np.lexsort((ids, -row))
        row, ids = row[order], ids[order]
        found: set[int] = set()
        for top in tops:
            start = int(np.searchsorted(-row, -top, side="left"))
            for i in range(start, min(start + take, len(row))):
                if whole * int(row[i]) >= least * top:
                    found.add(i)
        for i in sorted(found):
            out[0].append(int(a_id[at]))
            out[1].append(int(row[i]))
            out[2].append(int(ids[i]))
    return _pairs(*out)


def pack(anchor: int, score: int, other: int, positive: bool) -> bytes:
    """A key whose bytes sort by anchor, then falling score, then growing id."""
    return _KEY.pack(anchor + _SIGN, _SIGN - 1 - score, other + _SIGN, positive)


def unpack(key: bytes) -> tuple[int, int, int, bool]:
    anchor, score, other, positive = _KEY.unpack(key)
    return anchor - _SIGN, _SIGN - 1 - score, other - _SIGN, positive


def stream_windows(
    keys: Iterable[bytes], take: int, least: int, whole: int
) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Rows ``(anchor, positive, rank, negative, positive score, negative score)`` from sorted keys.

    A positive opens a window that closes when it is full or the scores have fallen below it. Negatives
    that tie with a positive may come before it, so the first ones of the present score are remembered.
    """
    now: int | None = None
    tie: int | None = None
    tied: list[int] = []
    windows: list[list[int]] = []  # positive, its score, rows emitted
    for key in keys:
        anchor, score, other, positive = unpack(key)
        if anchor != now:
            now, tie, windows = anchor, None, []
        if score != tie:
            tie, tied = score, []
            windows = [w for w in windows if w[2] < take and whole * score >= least * w[1]]
        if not positive:
            if len(tied) < take:
                tied.append(other)
            fitting, mates = windows, [other]
        else:
            fitting, mates = [[other, score, 0]], tied
            windows += fitting
        for window in fitting:
            for mate in mates:
                if window[2] < take and least * window[1] <= whole * score <= whole * window[1]:
                    window[2] += 1
                    yield anchor, window[0], window[2], mate, window[1], score


def mine_hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    least: int = 80,
    whole: int = 100,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    anchors_in_block: int = ANCHORS_IN_BLOCK,
    rows_in_block: int = ROWS_IN_BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for all anchors.

    ``is_anchor`` is a condition on ``id``, the key as a long. A score is the integer inner product of the
    vectors with their components cut to whole numbers of 1/256. An anchor's positives are its first other
    rows of the same label, higher scores first and ties by smaller id; the negatives of a positive are the
    first rows of other labels with ``least * positive_score <= whole * negative_score <= whole *
    positive_score``, in the same order.

    Rows with a null key, label or vector, or with a null or non-finite component, take no part. Rows that
    repeat a key count once: the smallest label, then the smallest vector in array order, stands. Missing
    components of shorter vectors are zero, so an empty vector scores 0 with every row. Scores beyond the
    range of a long stop at its ends. An anchor without positives or a positive without negatives has no
    row; an empty table gives an empty result. Other columns are not read, whatever their names.
    """
    spark = rows.sparkSession
    clean = materialize(clean_vectors(rows, key, vector, label).withColumn("anchor", is_anchor), "vectors")
    sizes = clean.agg(F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors")).first()
    a_blocks, b_blocks = max(1, -(-sizes["anchors"] // anchors_in_block)), max(1, -(-sizes["rows"] // rows_in_block))

    # Ids are unique here, so hashing them deals even blocks; every block of anchors meets every block of rows.
    def dealt(frame: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        return frame.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    vectors = dealt(clean.drop("anchor"), "b", b_blocks, "a", a_blocks).groupBy("a", "b")
    anchors = clean.filter("anchor").drop("anchor").toDF("id", "label", "vector")
    schema = "anchor long, score long, id long"

    best = vectors.cogroup(dealt(anchors, "a", a_blocks, "b", b_blocks).groupBy("a", "b")).applyInArrow(
        lambda x, y: _best_positives(x, y, positives), schema
    )
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    best = best.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= positives).drop("_n")
    best = materialize(best, "positives")

    opened = best.groupBy(F.col("anchor").alias("id")).agg(F.collect_list("score").alias("windows"))
    opened = dealt(anchors.join(opened, "id").toDF("id", "label", "vector", "windows"), "a", a_blocks, "b", b_blocks).groupBy("a", "b")
    near = vectors.cogroup(opened).applyInArrow(lambda x, y: _window_negatives(x, y, negatives, least, whole), schema)

    pairs = best.withColumn("positive", F.lit(True)).unionByName(near.withColumn("positive", F.lit(False)))
    keyed = pairs.select("anchor", "score", "id", "positive").rdd.map(lambda r: (pack(*r), None))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_keys = keyed.repartitionAndSortWithinPartitions(parts, lambda k: zlib.crc32(k[:8]))
    mined = sorted_keys.mapPartitions(lambda part: stream_windows((k for k, _ in part), negatives, least, whole))
    return spark.createDataFrame(
        mined,
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
        verifySchema=False,
    )


def negatives_digest(embeddings: DataFrame) -> DataFrame:
    """The contract's labels and anchors: one label in seven ids moved on by one, every hundredth id asks."""
    moved = F.when(embeddings["vec_id"] % 7 == 0, (embeddings["label"] + 1) % 10).otherwise(embeddings["label"])
    plain = embeddings.select("vec_id", "embedding", moved.alias("label"))
    return mine_hard_negatives(plain, F.col("id") % 100 == 0)


DIGEST_SQL = """
WITH plain AS (
    SELECT vec_id AS id,
           CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
           list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vector
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
),
clean AS (
    SELECT id, label, list_transform(vector, lambda x: CAST(floor(256 * x) AS BIGINT)) AS v
    FROM plain
    WHERE len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY label, vector) = 1
),
scored AS (
    SELECT a.id AS anchor_id, r.id AS id, a.label = r.label AS same,
           CAST(COALESCE(list_sum(list_transform(list_zip(a.v, r.v),
                lambda z: COALESCE(z[1], 0) * COALESCE(z[2], 0))), 0) AS BIGINT) AS score
    FROM clean a JOIN clean r ON r.id <> a.id
    WHERE a.id % 100 = 0
),
positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score
    FROM scored
    WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
),
ranked AS (
    SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS n
    FROM positives p JOIN scored s
      ON s.anchor_id = p.anchor_id AND NOT s.same
     AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked
WHERE n <= 5
"""
