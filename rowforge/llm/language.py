"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams, most frequent first. A document's own
list is compared with each profile: every n-gram adds the distance between its two places, or the full
length of a profile that lacks it; the language with the smallest sum wins.

N-grams have 1 to 3 letters, lower-cased, with word ends as a mark. They are counted with array
operations for many documents at once: the letters of a batch become small numbers, an n-gram with its
document is one 64-bit key, and sorted keys are counted by their runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import column, keeps_other_columns

PROFILE = 400
#: Most labelled documents of a language from which its profile is made, those with the smallest hashes.
ROWS_PER_LANGUAGE = 3000
UNDETERMINED = "und"

_POINTS = 0x110000
_ABSENT = 0x1FFFFF
_CHUNK = 2_000_000
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(_POINTS)), dtype=bool, count=_POINTS)
    return _letters


def _counted(texts: list[str | None], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, n-gram and count, sorted by group and n-gram; texts of one group are counted together."""
    encoded = [(t or "").lower().encode("utf-32-le", "surrogatepass") for t in texts]
    points = np.frombuffer(b"\0\0\0\0" + b"\0\0\0\0".join(encoded) + b"\0\0\0\0", dtype=np.uint32)
    owner = np.repeat(group, [len(e) // 4 + 1 for e in encoded])
    owner = np.concatenate([owner[:1], owner]) if len(owner) else np.zeros(len(points), dtype=np.int64)
    points = np.where(_is_letter()[points], points, 0)
    present = np.zeros(_POINTS, dtype=bool)
    present[points] = True
    present[0] = True
    number = np.cumsum(present, dtype=np.int64) - 1
    named = np.flatnonzero(present).astype(np.int64)
    bits = max(1, int(len(named) - 1).bit_length())
    x = number[points]
    # Kind 0: one letter, 1: two, 2: three. The mark 0 stands for the end of a word.
    kinds = []
    whole = 3 * bits + 2
    base = owner << whole
    middle = x[1:-1] > 0
    kinds.append((base | x << bits)[x > 0])
    pair = (x[:-1] > 0) | (x[1:] > 0)
    owner_of_pair = np.where(x[:-1] > 0, base[:-1], base[1:])
    kinds.append((owner_of_pair | (1 << 3 * bits) | x[:-1] << bits | x[1:])[pair])
    kinds.append((base[1:-1] | (2 << 3 * bits) | x[:-2] << 2 * bits | x[1:-1] << bits | x[2:])[middle])
    keys = np.concatenate(kinds)
    keys.sort()
    if not len(keys):
        return keys, keys, keys
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.concatenate([starts, [len(keys)]]))
    runs = keys[starts]
    mask = (1 << bits) - 1
    a, b, c = (named[runs >> s & mask] for s in (2 * bits, bits, 0))
    kind = runs >> 3 * bits & 3
    a, b, c = np.where(kind == 2, a, np.where(kind == 1, b, _ABSENT)), np.where(kind == 1, c, b), np.where(kind == 2, c, _ABSENT)
    return runs >> whole, a << 42 | b << 21 | c, counts


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with a bounded number of characters together, and 1,024 texts at most."""
    start = held = 0
    for i, text in enumerate(texts):
        if i > start and (held + len(text or "") > _CHUNK or i - start >= 1024):
            yield start, i
            start, held = i, 0
        held += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def ranked(texts: list[str | None], top: int = PROFILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, n-gram and place of the ``top`` most frequent n-grams of each text."""
    owner, gram, count = _counted(texts, np.arange(len(texts), dtype=np.int64))
    if not len(owner):
        return owner, gram, count
    bits = int(len(owner)).bit_length()
    count_bits = int(count.max()).bit_length()
    packed = (owner << count_bits | ((1 << count_bits) - 1 - count)) << bits | np.arange(len(owner))
    packed.sort()
    at = packed & ((1 << bits) - 1)
    owner, gram = owner[at], gram[at]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    place = np.arange(len(owner)) - np.repeat(first, np.diff(np.concatenate([first, [len(owner)]])))
    keep = place < top
    return owner[keep], gram[keep], place[keep]


class Profiles:
    """Ranked n-grams of each language, as one table of places."""

    def __init__(self, lists: dict[str, list[int]], length: int = PROFILE) -> None:
        self.languages = sorted(lists, key=lambda s: s.encode("utf-8", "surrogatepass"))
        self.length = length
        self.grams = np.unique(np.array([g for v in lists.values() for g in v], dtype=np.int64))
        self.place = np.full((len(self.languages), len(self.grams) + 1), length, dtype=np.int32)
        for i, language in enumerate(self.languages):
            own = np.array(lists[language], dtype=np.int64)
            self.place[i, np.searchsorted(self.grams, own)] = np.arange(len(own))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and mean out-of-place distance of every text.

        The score is the runner-up's share of the two smallest distances, 1 for a perfect match or an only
        language. Equal distances go to the language that comes first by code point.
        """
        names, scores, distances = [], [], []
        for start, end in _chunks(texts):
            n = end - start
            owner, gram, place = ranked(texts[start:end], self.length)
            total = np.zeros((len(self.languages), n))
            held = np.bincount(owner, minlength=n)
            if len(self.languages) and len(owner):
                at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
                at = np.where(self.grams[at] == gram, at, len(self.grams))
                for i in range(len(self.languages)):
                    theirs = self.place[i, at]
                    apart = np.where(theirs < self.length, np.abs(theirs - place), self.length)
                    total[i] = np.bincount(owner, weights=apart, minlength=n)
            for d in range(n):
                if not held[d] or not len(self.languages):
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    distances.append(float(self.length))
                    continue
                order = np.argsort(total[:, d], kind="stable")
                best = float(total[order[0], d])
                second = float(total[order[1], d]) if len(order) > 1 else 0.0
                names.append(self.languages[order[0]])
                scores.append(second / (best + second) if len(order) > 1 and best + second > 0 else 1.0)
                distances.append(best / int(held[d]))
        return names, scores, distances


def learn_profiles(docs: DataFrame, learn_from: Column, rows_per_language: int = ROWS_PER_LANGUAGE) -> Profiles:
    """Profiles of every non-null language among the rows that ``learn_from`` allows.

    At most ``rows_per_language`` documents of a language teach it (more only where hashes of equal ids
    tie): those with the smallest hash of the id.
    """
    allowed = docs.filter(learn_from & F.col("lang").isNotNull())
    draw = F.xxhash64(F.lit("profile"), F.col("doc_id"))
    drawn = allowed.select("lang", draw.alias("draw"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    last = drawn.withColumn("place", place).filter(F.col("place") <= rows_per_language)
    last = last.groupBy(F.col("lang").alias("_lang")).agg(F.max("draw").alias("_last"))
    # One row per language: stored, its size is known, and the texts need not be dealt by language.
    last = materialize(last, "language-limits")
    taught = allowed.join(last, (F.col("lang") == F.col("_lang")) & (draw <= F.col("_last"))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            languages = np.array(batch.column(0).to_pylist(), dtype=object)
            for start, end in _chunks(texts):
                names, group = np.unique(languages[start:end], return_inverse=True)
                owner, gram, count = _counted(texts[start:end], group.astype(np.int64))
                lang = pa.array([names[i] for i in owner], pa.string())
                yield pa.RecordBatch.from_arrays([lang, pa.array(gram), pa.array(count)], names=["lang", "gram", "n"])

    counts = taught.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PROFILE)
    lists: dict[str, list[int]] = {}
    for r in top.select("lang", "gram", "place").orderBy("lang", "place").collect():  # PROFILE rows a language
        lists.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(lists)


@keeps_other_columns
def identify_language(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` without the text, with ``lang_pred``, ``score`` (0 to 1) and ``distance``.

    Only the text is looked at, whole. A null text, or one without a letter, gives ``und`` with score 0; so
    does every text if no language was learned. Repeated rows stay. Input columns named like the added
    ones are replaced. An empty table stays empty.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    added = ("lang_pred", "score", "distance")
    names = [c for c in docs.columns if c != "text" and c not in added]
    slim = docs.select(*[column(docs, c) for c in names], column(docs, "text").alias("_text"))
    kinds = (StringType(), DoubleType(), DoubleType())
    schema = StructType([*slim.schema.fields[:-1], *[StructField(n, k) for n, k in zip(added, kinds, strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = profiles.predict(batch.column(len(names)).to_pylist())
            kept = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, made)], names=[f.name for f in schema.fields])

    return slim.mapInArrow(run, schema)
