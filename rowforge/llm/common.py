"""What several operators of this subpackage share: words, folds, bounded label samples, Arrow mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and quotes included."""
    return df["`" + name.replace("`", "``") + "`"]


def keeps_other_columns(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators whose own columns start with ``_``: such columns of the first argument come through unharmed.

    They have other names while the operator works, unless an argument names them.
    """

    @wraps(function)
    def run(docs: DataFrame, *args: object, **options: object) -> DataFrame:
        named = {x for x in (*args, *options.values()) if isinstance(x, str)}
        away = {c: f"#{i}" for i, c in enumerate(docs.columns) if c.startswith("_") and c not in named}
        if not away:
            return function(docs, *args, **options)
        done = function(docs.select(*[column(docs, c).alias(away.get(c, c)) for c in docs.columns]), *args, **options)
        back = {new: c for c, new in away.items()}
        return done.select(*[column(done, c).alias(back.get(c, c)) for c in done.columns])

    return run


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def label_sample(labels: DataFrame, label: str, max_rows: int, keep: Column | None = None) -> DataFrame:
    """At most ``max_rows`` labelled ids, chosen by hash of the id: columns ``_id`` and ``_label``.

    An id with several rows has its largest label. Null ids and null labels teach nothing. The bound is
    what makes it safe to broadcast the sample and to fit a model on it in one task.
    """
    ids = labels.select(labels["doc_id"].alias("_id"), labels[label].cast("int").alias("_label"))
    ids = ids.filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1))
    if keep is not None:
        ids = ids.filter(keep)
    ids = ids.groupBy("_id").agg(F.max("_label").alias("_label"))
    return ids.orderBy(F.xxhash64(F.lit("sample"), F.col("_id")), "_id").limit(max_rows)


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``_id``, ``_text``, ``_label`` of the sampled documents. The sample has a proven bound."""
    plain = docs.select(docs["doc_id"].alias("_id"), docs["text"].alias("_text"))
    return plain.join(F.broadcast(sample), "_id")


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[dict[str, list]] | dict[str, list]], schema: StructType
) -> DataFrame:
    """``mapInArrow`` over a function from a batch to columns (one dict, or several)."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = function(batch)
            for columns in [made] if isinstance(made, dict) else made:
                arrays = [
                    x if isinstance(x, pa.Array) else pa.array(x, type=field.type)
                    for field, x in ((f, columns[f.name]) for f in arrow)
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def platt(margin: np.ndarray, label: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities; Newton steps on smoothed targets."""
    if not len(margin):
        return 1.0, 0.0
    positive, negative = float(label.sum()), float(len(label) - label.sum())
    target = np.where(label > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    slope, offset = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(slope * margin + offset)
        weight = np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([((p - target) * margin).sum() + 1e-3 * (slope - 1), (p - target).sum()])
        hessian = np.array(
            [
                [(weight * margin * margin).sum() + 1e-3, (weight * margin).sum()],
                [(weight * margin).sum(), weight.sum() + 1e-6],
            ]
        )
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(slope), 1e-3), float(offset)
