"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words and the first and last four letters of them, as 64-bit hashes.
Terms whose presence depends on the label (likelihood ratio over the training rows) are the model's
features; each has a weight and a short vector, and the inner products of the vectors of two present terms
add what the pair means beyond its parts. Margins are calibrated on training rows that were held back.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..runtime import materialize
from .common import column, fold_of, keeps_other_columns, label_sample, labelled_texts, platt, sigmoid

#: Labelled rows that teach the model, at most.
MAX_ROWS = 12_000
MAX_FEATURES = 4096
LEAST_ROWS = 3
LEAST_RATIO = 15.0
FACTORS = 6
THRESHOLD = 0.7
_KEPT_WORDS = 300_000
_PART = re.compile(r"[^\W\d_]+")


def _hash(kind: str, part: str) -> int:
    value = xxhash.xxh64_intdigest((kind + part).encode("utf-8", "surrogatepass"), 11)
    return value - (value >> 63 << 64)


def terms_of(word: str) -> list[int]:
    """Hashed terms of a raw word: its letter runs, with their first and last four letters."""
    found = []
    for part in _PART.findall(word.lower()):
        found.append(_hash("=", part))
        if len(part) > 4:
            found.append(_hash("<", part[:4]))
            found.append(_hash(">", part[-4:]))
    return found


class _Terms(dict):
    """Terms of a word, remembered for a bounded number of words; only known ones if a map is given."""

    def __init__(self, known: dict[int, int] | None = None) -> None:
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        terms = terms_of(word)
        if self.known is not None:
            terms = [self.known[t] for t in terms if t in self.known]
        found = self[word] = tuple(terms)
        return found

    def of(self, text: str | None) -> list[int]:
        found: set[int] = set()
        for word in set((text or "").split()):
            if terms := self[word]:
                found.update(terms)
        return sorted(found)


@dataclass
class FactorizationMachine:
    """Binary inputs: ``bias + sum w + sum over pairs <v, v>``, then a calibrated logistic."""

    terms: dict[int, int]
    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, rows: list[list[int]]) -> np.ndarray:
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = np.array([i for r in rows for i in r], dtype=np.int64)
        return self._margins(at, owner, len(rows))

    def _margins(self, at: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(owner, weights=self.weights[at], minlength=n)
        for f in range(self.vectors.shape[1]):
            v = self.vectors[at, f]
            sums = np.bincount(owner, weights=v, minlength=n)
            out += 0.5 * (sums**2 - np.bincount(owner, weights=v * v, minlength=n))
        return out

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        return sigmoid(self.slope * self.margins(rows) + self.offset)


def fit(rows: list[list[int]], label: np.ndarray, terms: dict[int, int], epochs: int = 30) -> FactorizationMachine:
    """AdaGrad on the logistic loss, then calibration on each fifth row, which training leaves out."""
    size = max(1, len(terms))
    random = np.random.default_rng(3)
    machine = FactorizationMachine(terms, 0.0, np.zeros(size), random.normal(0, 0.01, (size, FACTORS)))
    everyone = np.arange(len(rows))
    held = everyone % 5 == 4
    use = everyone[~held] if len(np.unique(label[~held])) == 2 else everyone
    rate = float(np.clip(label.mean(), 1e-3, 1 - 1e-3)) if len(rows) else 0.5
    machine.bias = float(np.log(rate / (1 - rate)))
    squares_w, squares_v, square_b = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    for _ in range(epochs if len(np.unique(label)) == 2 else 0):
        shuffled = random.permutation(use)
        for start in range(0, len(shuffled), 128):
            batch = shuffled[start : start + 128]
            n = len(batch)
            owner = np.repeat(np.arange(n), [len(rows[i]) for i in batch])
            at = np.array([t for i in batch for t in rows[i]], dtype=np.int64)
            error = (sigmoid(machine._margins(at, owner, n)) - label[batch]) / n
            touched, inverse = np.unique(at, return_inverse=True)
            if len(touched):
                gradient = np.bincount(inverse, weights=error[owner]) + 1e-5 * machine.weights[touched]
                squares_w[touched] += gradient**2
                for f in range(FACTORS):
                    v = machine.vectors[at, f]
                    sums = np.bincount(owner, weights=v, minlength=n)
                    slope = np.bincount(inverse, weights=error[owner] * (sums[owner] - v))
                    slope += 1e-4 * machine.vectors[touched, f]
                    squares_v[touched, f] += slope**2
                    machine.vectors[touched, f] -= 0.05 * slope / np.sqrt(squares_v[touched, f])
                machine.weights[touched] -= 0.3 * gradient / np.sqrt(squares_w[touched])
            step = float(error.sum())
            square_b += step**2
            machine.bias -= 0.1 * step / square_b**0.5
    check = everyone[held] if len(use) < len(rows) and len(np.unique(label[held])) == 2 else everyone
    machine.slope, machine.offset = platt(machine.margins([rows[i] for i in check]), label[check])
    return machine


def _ratio(n: Column, positive: Column, rows: int, marked: int) -> Column:
    """Log likelihood ratio of a term's presence against the label; negative where it speaks for label 0."""

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = marked / rows
    negative = n - positive
    out = part(positive, n * share) + part(negative, n * (1 - share))
    absent, absent_marked = F.lit(rows) - n, F.lit(marked) - positive
    out = out + part(absent_marked, absent * share) + part(absent - absent_marked, absent * (1 - share))
    return 2 * out


def learn_toxicity(
    docs: DataFrame, labels: DataFrame, keep: Column | None = None, max_rows: int = MAX_ROWS
) -> FactorizationMachine:
    """Fit on at most ``max_rows`` labelled documents, whole texts. ``keep`` filters label ids (``_id``).

    Without labels of both classes the model has no terms and scores every text alike.
    """
    sample = materialize(label_sample(labels, "toxic", max_rows, keep), "toxic-sample")
    texts = materialize(labelled_texts(docs, sample), "toxic-texts")
    totals = texts.agg(F.count(F.lit(1)).alias("n"), F.sum("_label").alias("p")).first()
    rows, marked = int(totals["n"] or 0), int(totals["p"] or 0)
    if not 0 < marked < rows:
        return fit([], np.empty(0), {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, seen, marked_with = _Terms(), Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = terms.of(text)
                seen.update(found)
                if label:
                    marked_with.update(found)
        arrays = [pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())]
        arrays.append(pa.array([marked_with[t] for t in seen], pa.int64()))
        yield pa.RecordBatch.from_arrays(arrays, names=["term", "n", "p"])

    counts = texts.select("_text", "_label").mapInArrow(count, "term long, n long, p long")
    counts = counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).filter(F.col("n") >= LEAST_ROWS)
    scored = counts.withColumn("ratio", _ratio(F.col("n"), F.col("p"), rows, marked))
    chosen = scored.filter(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "term").limit(MAX_FEATURES)
    terms = {r["term"]: i for i, r in enumerate(chosen.select("term").collect())}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Terms(terms)
        for batch in batches:
            found = pa.array([known.of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found, batch.column(2)], names=["id", "terms", "label"])

    kind = texts.schema["_id"].dataType.simpleString()
    inputs = texts.select("_id", "_text", "_label").mapInArrow(present, f"id {kind}, terms array<int>, label int")

    def train(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        made = fit(table.column("terms").to_pylist(), table.column("label").to_numpy().astype(float), terms)
        head = np.concatenate([[made.bias, made.slope, made.offset], np.zeros(max(0, FACTORS - 2))])
        body = np.column_stack([made.weights, made.vectors])
        return pa.table({"at": pa.array(range(-1, len(body))), "row": [head.tolist(), *body.tolist()]})

    # One group on purpose: at most max_rows rows of at most MAX_FEATURES small numbers.
    model = inputs.groupBy(F.lit(0).alias("all")).applyInArrow(train, "at long, row array<double>")
    values = [r["row"] for r in model.orderBy("at").collect()]
    body = np.array(values[1:])
    return FactorizationMachine(terms, values[0][0], body[:, 0], body[:, 1:], values[0][1], values[0][2])


@keeps_other_columns
def score_toxicity(docs: DataFrame, machine: FactorizationMachine, keep_text: bool = False) -> DataFrame:
    """``docs`` (without the text, unless ``keep_text``) with ``score`` and ``predicted``.

    The score comes from the whole text alone. Null and empty texts have no terms and score as such.
    ``predicted`` is 1 from THRESHOLD on. Repeated rows stay; input columns named like the added ones are
    replaced; an empty table stays empty.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted") and (keep_text or c != "text")]
    extra = [] if keep_text else [column(docs, "text").alias("_text")]
    slim = docs.select(*[column(docs, c) for c in names], *extra)
    at = names.index("text") if keep_text else len(names)
    added = [StructField("score", DoubleType(), False), StructField("predicted", IntegerType(), False)]
    schema = StructType([*slim.schema.fields[: len(names)], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Terms(machine.terms)
        for batch in batches:
            scores = machine.scores([known.of(t.as_py()) for t in batch.column(at)])
            kept = [batch.column(i) for i in range(len(names))]
            flags = pa.array((scores >= THRESHOLD).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores), flags], names=[f.name for f in schema.fields])

    return slim.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic, by a model fit on all labels. Columns stay as they are."""
    machine = learn_toxicity(docs, labels)
    names = ["text" if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)]
    kept = score_toxicity(docs.toDF(*names), machine, keep_text=True).filter("predicted = 0")
    return kept.select(*names).toDF(*docs.columns)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, learned on the other two folds."""
    machine = learn_toxicity(docs, labels, fold_of(F.col("_id"), 3) != 1)
    scored = score_toxicity(docs.select("doc_id", "text"), machine)
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
