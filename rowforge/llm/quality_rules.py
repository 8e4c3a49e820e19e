"""Quality rules with a learned verdict: fixed counts of a text, then calibrated logistic regression.

The classifier reads hashed words, word pairs and runs of three bytes (see ``linear``); it is trained on
labelled rows, calibrated on rows that training left out, and its probability meets a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from ..runtime import materialize
from .common import column, keeps_other_columns, label_sample, labelled_texts, platt, sigmoid
from .linear import FAMILIES, FAMILY, Rows, Words, features, fit_logistic, margin_of, shares

#: Labelled rows that teach the model, at most.
MAX_ROWS = 4000
THRESHOLD = 0.5
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
_SYMBOLS = b"#*$%&|<>"
_PACKED = 1 << 21


def repeated_words(numbers: np.ndarray) -> int:
    """Words inside windows of three words that occur twice or more."""
    if len(numbers) < 4:
        return 0
    if int(numbers.max()) >= _PACKED:
        numbers = np.unique(numbers, return_inverse=True)[1]
    if int(numbers.max()) >= _PACKED:  # over two million different words: number the pairs first
        pairs = np.unique(numbers[:-1] << 32 | numbers[1:], return_inverse=True)[1]
        keys = pairs[:-1].astype(np.int64) << 32 | numbers[2:]
    else:
        keys = numbers[:-2] << 42 | numbers[1:-1] << 21 | numbers[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    inside = np.zeros(len(numbers), dtype=bool)
    windows = np.concatenate([order[1:][same], order[:-1][same]])
    for step in range(3):
        inside[windows + step] = True
    return int(inside.sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, repeats = set(), 0
    for line in data.split(b"\n"):
        if line.strip():
            repeats += line in seen
            seen.add(line)
    return repeats


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, slots: list[np.ndarray]) -> float:
        return float(sigmoid(np.array(self.slope * margin_of(slots, self.weights, self.bias) + self.offset)))


def learn_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> QualityModel:
    """Fit on at most ``max_rows`` labelled documents, whole texts; each fifth row is for calibration.

    With labels of one class only every text gets that class; without labels every text is good.
    """
    sample = materialize(label_sample(labels, "quality", max_rows), "quality-sample")
    texts = labelled_texts(docs, sample)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            slot, value = [], []
            for text in batch.column(1):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                s, v = shares(features(data, words.numbers(data.split()), words))
                slot.append(s.astype(np.int32))
                value.append(v.astype(np.float32))
            slots = pa.array(slot, pa.list_(pa.int32()))
            values = pa.array(value, pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), slots, values, batch.column(2)], names=["id", "slot", "value", "label"])

    kind = texts.schema["_id"].dataType.simpleString()
    encoded = texts.select("_id", "_text", "_label").mapInArrow(
        encode, f"id {kind}, slot array<int>, value array<float>, label int"
    )

    def train(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        label = table.column("label").to_numpy().astype(float)
        rows = Rows.of_lists(table.column("slot"), table.column("value"))
        everyone = np.arange(len(label))
        held = everyone[everyone % 5 == 4]
        use = everyone[everyone % 5 != 4]
        if len(np.unique(label[use])) < 2 or len(np.unique(label[held])) < 2:
            use = held = everyone
        weights, bias = fit_logistic(rows, label, FAMILY * FAMILIES, use=use)
        slope, offset = 1.0, 0.0
        if len(np.unique(label)) == 2:
            slope, offset = platt(rows.margins(weights, bias)[held], label[held])
        at = np.flatnonzero(weights)
        return pa.table(
            {
                "at": pa.array(np.concatenate([[-3, -2, -1], at])),
                "weight": pa.array(np.concatenate([[bias, slope, offset], weights[at]])),
            }
        )

    # One group on purpose: at most max_rows rows of FAMILY * FAMILIES slots.
    model = encoded.groupBy(F.lit(0).alias("all")).applyInArrow(train, "at long, weight double")
    found = model.toPandas()
    weights = np.zeros(FAMILY * FAMILIES)
    head = dict(zip(found["at"][found["at"] < 0], found["weight"][found["at"] < 0], strict=True))
    body = found[found["at"] >= 0]
    weights[body["at"].to_numpy(dtype=np.int64)] = body["weight"].to_numpy()
    return QualityModel(weights, head.get(-3, 4.0), head.get(-2, 1.0), head.get(-1, 0.0))


@keeps_other_columns
def judge_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the text, with the counts, ``base_failed``, ``probability`` and ``kept``.

    A null text counts as empty: no words, base failed, not kept. Repeated rows stay; input columns named
    like the added ones are replaced; an empty table stays empty.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    added = (*counts, "base_failed", "probability", "kept")
    names = [c for c in docs.columns if c != "text" and c not in added]
    slim = docs.select(*[column(docs, c) for c in names], column(docs, "text").alias("_text"))
    kinds = [LongType()] * 5 + [BooleanType(), DoubleType(), BooleanType()]
    schema = StructType([*slim.schema.fields[:-1], *[StructField(n, k, False) for n, k in zip(added, kinds, strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            rows = []
            for text in batch.column(len(names)):
                text = text.as_py() or ""
                data = text.encode("utf-8", "surrogatepass")
                words = data.split()
                numbers = known.numbers(words)
                blanks = sum(map(text.count, " \t\n\v\f\r"))
                repeated = repeated_words(numbers)
                failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * len(words)
                p = model.probability(features(data, numbers, known))
                symbols = len(data) - len(data.translate(None, _SYMBOLS))
                rows.append(
                    (len(words), len(text) - blanks, symbols, duplicate_lines(data), repeated, failed, p, not failed and p >= threshold)
                )
            kept = [batch.column(i) for i in range(len(names))]
            made = [
                pa.array([r[i] for r in rows], t)
                for i, t in enumerate([pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()])
            ]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[f.name for f in schema.fields])

    return slim.mapInArrow(run, schema)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    judged = judge_quality(docs.select("doc_id", "text"), learn_quality(docs, labels))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"
    )
