"""Quality scores by co-training of two views of a document.

The text view sees hashed words, word pairs and runs of three bytes. The metadata view sees only what is known
about the page: source, language, length and their pairs, never the text. Each view is a naive Bayes model, so
all it learns from are sums per class, which any number of tasks can gather:

1. Both views learn from all labelled documents but a held-out part, which calibrates them.
2. In each round every document without a label is scored by both views. A view that is sure of one teaches
   it to the other; views sure of opposite classes teach nothing. The next models come from the sums of
   the labelled documents and of all that were taught, over the whole corpus.
3. A small logistic model of the two calibrated log odds, fitted on held-out rows that calibration did not
   use, scores all documents.

Sums are whole numbers, so they do not depend on how the rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from ..runtime import materialize
from .common import column, keeps_other_columns, platt, sigmoid
from .linear import FAMILIES, FAMILY, Words, features, margin_of

#: Held-out labelled documents that calibrate and combine the views, at most. All other labels are learned from.
MAX_HELD = 4000
ROUNDS = 3
#: Share of a class among held-out rows, with classes taken as equally frequent, from which on a view teaches.
SURE = 0.9
THRESHOLD = 0.5
_META = 1 << 14
_TEXT = FAMILY * FAMILIES
#: What a document adds to its class in each family of the text view, and for each fact.
_UNIT = 1 << 24
#: Sums: text slots of class 0 and 1, facts of class 0 and 1, then documents by view and class.
_SUMS = 2 * _TEXT + 2 * _META + 4
_SMOOTHING = (0.1, 1.0)
#: Bits of the filter that tells documents surely without a label; its table has a row for 64 of them.
FILTER_BITS = 1 << 22


def metadata_slots(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Hashed features of a page: each known fact, and facts in pairs. Nulls are facts of their own."""
    length = None if n_chars is None else max(0, int(n_chars)).bit_length()
    named = zip("sln", (source, lang, length), strict=True)
    facts = [name if value is None else f"{name}={value}" for name, value in named]
    pairs = [f"{a}&{b}" for i, a in enumerate(facts) for b in facts[i + 1 :]]
    return [xxhash.xxh32_intdigest(f.encode("utf-8", "surrogatepass"), 5) & (_META - 1) for f in facts + pairs]


def _combine(logits: np.ndarray, label: np.ndarray, prior: float) -> np.ndarray:
    """Bias and weights of the two views' log odds.

    Without evidence they are those of views that are independent within each class: both count whole, the prior
    once. Each of them is worth ten rows.
    """
    x = np.column_stack([np.ones(len(logits)), logits])
    start = np.array([-prior, 1.0, 1.0])
    w = start.copy()
    for _ in range(200):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - label) + 10.0 * (w - start)
        # A bound of the curvature in place of it: every step lowers the loss.
        step = np.linalg.solve(x.T @ x / 4 + 10.0 * np.eye(3), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return np.array([w[0], max(w[1], 0.0), max(w[2], 0.0)])


def sure_bounds(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Margins up to which, and from which on, a view is sure of class 0 and of class 1.

    Among the held-out rows beyond a bound the class must have a share of SURE, with classes taken as equally
    frequent and one more row of the other class than there is. A view that held-out rows do not bear out is
    sure of nothing.
    """
    found = []
    for sign, side in ((-1, 0), (1, 1)):
        own, other = (np.sort(sign * margin[label == k]) for k in (side, 1 - side))
        at = np.unique(own)
        right = (len(own) - np.searchsorted(own, at)) / max(1, len(own))
        wrong = (len(other) - np.searchsorted(other, at) + 1) / (len(other) + 1)
        enough = at[right >= SURE * (right + wrong)]
        found.append(sign * (enough[0] if len(enough) else np.inf))
    return found[0], found[1]


@dataclass
class CoModel:
    text: np.ndarray
    meta: np.ndarray
    #: Slope and offset of the text view, then of the metadata view; then the combination.
    head: np.ndarray
    #: What each view is sure of, by its margin: class 0 up to the first, class 1 from the second on.
    bounds: tuple[tuple[float, float], ...] = ((-np.inf, np.inf),) * 2

    def logits(self, text_margin: np.ndarray, meta_margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.head
        return h[0] * text_margin + h[1], h[2] * meta_margin + h[3]

    def views(self, text_margin: np.ndarray, meta_margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.logits(text_margin, meta_margin)
        h = self.head
        return sigmoid(a), sigmoid(b), sigmoid(h[4] + h[5] * np.clip(a, -12, 12) + h[6] * np.clip(b, -12, 12))

    def taught(self, text_margin: float, meta_margin: float) -> tuple[int, int]:
        """The class that each view is taught by the other one: 1, 0, or -1 for none."""
        sure = []
        for margin, (low, high) in zip((text_margin, meta_margin), self.bounds, strict=True):
            good, bad = margin >= high, margin <= low
            sure.append(-1 if good == bad else int(good))
        return (-1, -1) if sorted(sure) == [0, 1] else (sure[1], sure[0])


def view_weights(labelled: np.ndarray, taught: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios of the classes' mean shares per slot, for the text view and the metadata view.

    Taught documents weigh as much as labelled ones of their class, and together at most as much as all of these.
    """
    made = []
    for view, (size, start) in enumerate(((_TEXT, 0), (_META, 2 * _TEXT))):
        means, documents = [], 0.0
        for side in (0, 1):
            at, count = slice(start + side * size, start + (side + 1) * size), _SUMS - 4 + 2 * view + side
            own, other = float(labelled[count]), float(taught[count])
            weight = min(1.0, own / other) if other else 0.0
            total = max(own + weight * other, 1.0)
            means.append((labelled[at] + weight * taught[at]) / _UNIT / total)
            documents += total
        least = _SMOOTHING[view] / documents
        made.append(np.log((means[1] + least) / (means[0] + least)))
    return made[0], made[1]


def roles(labels: DataFrame, max_held: int = MAX_HELD) -> DataFrame:
    """``_id, _label, _seed, _held`` of all labelled ids; an id with several labels has the largest one.

    A fifth of the ids by hash, at most ``max_held``, is held out; all others are seeds. If either part lacks a
    class, all ids are seeds and held-out rows come from among them. Null ids and null labels teach nothing.
    """
    ids = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label"))
    ids = ids.filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1)).groupBy("_id").agg(F.max("_label").alias("_label"))
    ids = materialize(ids, "quality-labels")
    fifth = F.pmod(F.xxhash64(F.lit("held"), "_id"), F.lit(5)) == 0

    def sampled(among: DataFrame) -> DataFrame:
        return among.orderBy(F.xxhash64(F.lit("sample"), "_id"), "_id").limit(max_held).select("_id", F.lit(True).alias("_held"))

    # The sample has at most max_held ids: a proven bound.
    marked = ids.join(F.broadcast(sampled(ids.filter(fifth))), "_id", "left")
    marked = marked.select("_id", "_label", F.col("_held").isNull().alias("_seed"), F.col("_held").isNotNull().alias("_held"))
    marked = materialize(marked, "quality-roles")
    if marked.select("_held", "_label").distinct().count() == 4:
        return marked
    marked = ids.join(F.broadcast(sampled(ids)), "_id", "left")
    marked = marked.select("_id", "_label", F.lit(True).alias("_seed"), F.col("_held").isNotNull().alias("_held"))
    return materialize(marked, "quality-roles")


def _split(plain: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their role, stored, and those without a label; only the former are shuffled.

    A bit table of fixed size passes most documents without a label by; the others meet the labels.
    """
    word, bit = "pmod(xxhash64(_id), {0}) div 64", "shiftleft(1L, cast(pmod(xxhash64(_id), 64) as int))"
    word, bit = F.expr(word.format(FILTER_BITS)).alias("_word"), F.expr(bit).alias("_bit")
    # FILTER_BITS / 64 rows at most, whatever the labels: a proven bound for the broadcast.
    table = marked.select(word, bit).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    tested = plain.select("*", word, bit).join(F.broadcast(table), "_word", "left")
    may = F.col("_id").isNotNull() & (F.coalesce("_bits", F.lit(0).cast("long")).bitwiseAND(F.col("_bit")) != 0)
    names = plain.columns
    # Never by broadcast, so that the cost is in proportion to the documents with a label at every size.
    known = tested.filter(may).select(*names).join(marked.hint("merge"), "_id", "left")
    known = materialize(known.select(*names, "_label", "_seed", "_held"), "quality-known")
    rest = tested.filter(~may).select(*names, F.lit(None).cast("int").alias("_label"))
    return known, rest.unionByName(known.filter("_label is null").select(*names, "_label"))


def _margins(batch: pa.RecordBatch, model: CoModel, words: Words) -> Iterator[tuple[list[np.ndarray], list[int], float, float]]:
    """Slots and margin of both views for rows that start with text, source, language and length."""
    facts = zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)
    for t, fact in zip(batch.column(0), facts, strict=True):
        data = (t.as_py() or "").encode("utf-8", "surrogatepass")
        text, meta = features(data, words.numbers(data.split()), words), metadata_slots(*fact)
        yield text, meta, margin_of(text, model.text, 0.0), float(model.meta[meta].sum())


def _gather(rows: DataFrame, model: CoModel) -> np.ndarray:
    """The sums of all rows: by ``_label``, or where it is null by what the views teach each other.

    Every task adds up its rows; at most _SUMS sums reach the driver, whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = Words(), np.zeros(_SUMS, dtype=np.int64)
        for batch in batches:
            for (text, meta, a, b), label in zip(_margins(batch, model, words), batch.column(4).to_pylist(), strict=True):
                sides = model.taught(a, b) if label is None else (label, label)
                if sides[0] >= 0:
                    for family in text:
                        if len(family):
                            slot, n = np.unique(family, return_counts=True)
                            sums[sides[0] * _TEXT + slot] += n * _UNIT // len(family)
                    sums[_SUMS - 4 + sides[0]] += 1
                if sides[1] >= 0:
                    np.add.at(sums, 2 * _TEXT + sides[1] * _META + np.array(meta), _UNIT)
                    sums[_SUMS - 2 + sides[1]] += 1
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["at", "n"])

    found = rows.select("text", "source", "lang", "n_chars", "_label").mapInArrow(run, "at int, n long")
    found = found.groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros(_SUMS, dtype=np.int64)
    sums[found["at"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return sums


def _held_margins(held: DataFrame, model: CoModel) -> pd.DataFrame:
    """``id, label, late, text, meta`` of the held-out rows, of which there are MAX_HELD at most; by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            scored = [(a, b) for _, _, a, b in _margins(batch, model, words)]
            columns = [pa.array([s[i] for s in scored], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(4), batch.column(5), batch.column(6), *columns], names=["id", "label", "late", "text", "meta"]
            )

    kind = held.schema["_id"].dataType.simpleString()
    rows = held.select("text", "source", "lang", "n_chars", "_id", "_label", "_late")
    found = rows.mapInArrow(run, f"id {kind}, label int, late boolean, text double, meta double").toPandas()
    return found.sort_values("id", ignore_index=True)


def _calibrated(text: np.ndarray, meta: np.ndarray, held: DataFrame) -> CoModel:
    """The views with slopes and offsets from one half of the held-out rows, combined on the other half."""
    raw = CoModel(text, meta, np.array([1.0, 0, 1, 0, 0, 0.5, 0.5]))
    rows = _held_margins(held, raw)
    halves = [rows[~rows["late"]], rows[rows["late"]]]
    if any(h["label"].nunique() < 2 for h in halves):
        halves = [rows, rows]
    first, second = halves
    label = first["label"].to_numpy(dtype=float)
    fits = [platt(first[v].to_numpy(dtype=float), label) for v in ("text", "meta")]
    model = CoModel(text, meta, np.array([*fits[0], *fits[1], 0, 1, 1]))
    model.bounds = tuple(sure_bounds(rows[v].to_numpy(dtype=float), rows["label"].to_numpy()) for v in ("text", "meta"))
    prior = float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1)))
    logits = np.column_stack(model.logits(second["text"].to_numpy(dtype=float), second["meta"].to_numpy(dtype=float)))
    model.head[4:] = _combine(np.clip(logits, -12, 12), second["label"].to_numpy(dtype=float), prior)
    return model


def learn_quality_views(docs: DataFrame, labels: DataFrame, max_held: int = MAX_HELD, rounds: int = ROUNDS) -> CoModel:
    """Co-train on all labelled documents and all others, whole texts; only calibration is bounded.

    Labels of one class give that class to every document; no labels give one half. Rows with an id that has a
    label are never taught, rows without an id always may be; repeated rows count each, but a held-out id
    calibrates once. Every round reads the corpus once. Texts with a label are shuffled and stored once.
    """
    marked = roles(labels, max_held)
    plain = docs.select(F.col("doc_id").alias("_id"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    blank = CoModel(np.zeros(_TEXT), np.zeros(_META), np.array([1.0, 0, 1, 0, 0, 0.5, 0.5]))
    known, pool = _split(plain, marked)
    labelled = _gather(known.filter("_seed"), blank)
    by_class = labelled[-4:-2]
    if not by_class.all():
        blank.head[4] = 4.0 * np.sign(by_class[1] - by_class[0])
        return blank
    facts = ("text", "source", "lang", "n_chars")
    held = known.filter("_held").groupBy("_id", "_label").agg(F.min(F.struct(*facts)).alias("row"))
    late = F.pmod(F.xxhash64(F.lit("late"), "_id"), F.lit(2)) == 0
    held = materialize(held.select("_id", "_label", late.alias("_late"), "row.*"), "quality-held")
    taught = np.zeros_like(labelled)
    model = _calibrated(*view_weights(labelled, taught), held)
    for _ in range(rounds):
        before, taught = taught, _gather(pool, model)
        if np.array_equal(before, taught):
            break
        model = _calibrated(*view_weights(labelled, taught), held)
    return model


@keeps_other_columns
def score_quality(docs: DataFrame, model: CoModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the text, with ``p_text``, ``p_meta``, ``score`` (all 0 to 1) and ``kept``.

    Null texts count as empty, null metadata as a value of their own. Repeated rows stay; input columns
    named like the added ones are replaced; an empty table stays empty.
    """
    added = ("p_text", "p_meta", "score", "kept")
    names = [c for c in docs.columns if c != "text" and c not in added]
    facts = [docs["source"].alias("_s"), docs["lang"].alias("_l"), docs["n_chars"].cast("long").alias("_n")]
    slim = docs.select(*[column(docs, c) for c in names], *facts, docs["text"].alias("_text"))
    kinds = (DoubleType(), DoubleType(), DoubleType(), BooleanType())
    own = slim.schema.fields[: len(names)]
    schema = StructType([*own, *[StructField(n, k, False) for n, k in zip(added, kinds, strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, kept_meta = Words(), {}
        for batch in batches:
            columns = [batch.column(len(names) + i) for i in range(4)]
            text_margin, meta_margin = [], []
            for t in columns[3]:
                data = (t.as_py() or "").encode("utf-8", "surrogatepass")
                text_margin.append(margin_of(features(data, words.numbers(data.split()), words), model.text, 0.0))
            for source, lang, n in zip(*(c.to_pylist() for c in columns[:3]), strict=True):
                fact = (source, lang, None if n is None else max(0, n).bit_length())
                if fact not in kept_meta:
                    if len(kept_meta) > 100_000:
                        kept_meta.clear()
                    kept_meta[fact] = float(model.meta[metadata_slots(source, lang, n)].sum())
                meta_margin.append(kept_meta[fact])
            a, b, score = model.views(np.array(text_margin, dtype=float), np.array(meta_margin, dtype=float))
            made = [pa.array(a), pa.array(b), pa.array(score), pa.array(score >= threshold)]
            kept = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[f.name for f in schema.fields])

    return slim.mapInArrow(run, schema)


def co_training_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_quality(docs.select("doc_id", "text", "source", "lang", "n_chars"), learn_quality_views(docs, labels))
    return scored.select("doc_id", "score", "p_text", "p_meta", "kept")
