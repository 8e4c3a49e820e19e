"""Benchmark decontamination with a distributed positional inverted index.

1. Benchmark texts give their terms. A bitmap of fixed size over term hashes (TABLE slots, whatever the
   benchmark's size) is all that tasks over the corpus need to know of them.
2. One pass over all documents counts how often each slot's terms occur; sums are made map-side.
3. Of every window of a benchmark item the rarest terms are its anchors.
4. A second pass stores the postings ``(term, document, position)`` of the anchor terms: the index.
5. Postings meet anchors on the term. Subtracting the anchor's offset brings all hits of one occurrence to
   one diagonal, so lists are intersected by counting the distinct anchors on a diagonal.
6. Diagonals that could hold a window are compared word by word with the document itself.
7. For proximity, hits need not lie on one diagonal: those of one near occurrence lie within a band of
   diagonals, so bands that hold enough anchors are searched for a stretch with all words of a window.

Hash collisions only add candidates; the comparison decides, so phrase and proximity matches are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import column

WINDOW = 10
#: Slots of the term table; a task's counters take 8 bytes a slot.
TABLE = 1 << 20
#: Anchors of a window: a candidate diagonal must hold so many of them.
ANCHORS = 2
#: Words that may stand between those of a proximity match, in all.
SLACK = 5
#: Hits of one near occurrence span fewer diagonals than half a band; bands overlap by half.
BAND = 2 * (2 * WINDOW + SLACK - 1)
_KEPT_WORDS = 500_000

#: Bytes 00-2F, 3A-60 and 7B-7F part words; A-Z are lower-cased first.
_BLANKED = bytes(
    32 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in bytes(range(256)).lower()
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, lower-cased in A-Z."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BLANKED).split()


def _term(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


class _Slots(dict):
    """Word to slot, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        slot = self[word] = _term(word) & (TABLE - 1)
        return slot


def _bitmap(slots: list[int]) -> bytes:
    bits = np.zeros(TABLE, dtype=bool)
    bits[slots] = True
    return np.packbits(bits).tobytes()


def _bits(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, dtype=np.uint8)).astype(bool)


def _item_slots(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {_term(w) & (TABLE - 1) for t in batch.column(0).to_pylist() for w in words_of(t)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int32())], names=["slot"])

    return items.select("text").mapInArrow(run, "slot int").distinct()


def _slot_counts(docs: DataFrame, wanted: bytes) -> DataFrame:
    """Occurrences per wanted slot over all documents, one partial row per task and slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, counts = _Slots(), np.zeros(TABLE, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                if words := words_of(text.as_py()):
                    found = np.fromiter(map(slots.__getitem__, words), np.int64, len(words))
                    np.add.at(counts, found, 1)
        at = np.nonzero(counts * _bits(wanted))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["slot", "n"])

    return docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))


def _anchors(items: DataFrame, counts: np.ndarray) -> DataFrame:
    """``(item, term, at)``: in every window of an item its ANCHORS rarest words, ties to the left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = [_term(w) for w in words_of(text)]
                rare = [(int(counts[t & (TABLE - 1)]), i) for i, t in enumerate(terms)]
                chosen: set[int] = set()
                for start in range(max(1, len(terms) - WINDOW + 1) if terms else 0):
                    chosen.update(i for _, i in sorted(rare[start : start + WINDOW])[:ANCHORS])
                for i in sorted(chosen):
                    for values, value in zip(out, (item, terms[i] - (terms[i] >> 63 << 64), i), strict=True):
                        values.append(value)
            types = (pa.int64(), pa.int64(), pa.int32())
            arrays = [pa.array(v, t) for v, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["item", "term", "at"])

    return items.select("item", "text").mapInArrow(run, "item long, term long, at int")


def _index(docs: DataFrame, wanted: bytes) -> DataFrame:
    """The positional index of the wanted slots, and one row per document with its number of words.

    Columns ``doc_id, hash, term, at``; in a document's own row the term is null and ``at`` its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, keep = _Slots(), _bits(wanted)
        for batch in batches:
            row, term, at = [], [], []
            for r, text in enumerate(batch.column(2)):
                words = words_of(text.as_py())
                row.append(r)
                term.append(None)
                at.append(len(words))
                if words:
                    hit = np.nonzero(keep[np.fromiter(map(slots.__getitem__, words), np.int64, len(words))])[0]
                    row.extend([r] * len(hit))
                    term.extend(t - (t >> 63 << 64) for t in (_term(words[i]) for i in hit))
                    at.extend(hit.tolist())
            rows = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(term, pa.int64()), pa.array(at, pa.int32())],
                names=["doc_id", "hash", "term", "at"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "hash", "text").mapInArrow(run, f"doc_id {kind}, hash long, term long, at int")


def _verify(candidates: DataFrame, id_type: str) -> DataFrame:
    """Compare whole items with documents along the candidate diagonals.

    Input rows have ``doc_id, hash, text`` and ``found``: structs of item number, name, text and diagonal.
    """
    schema = f"doc_id {id_type}, hash long, n_hit long, n_items long, items_sha256 string, spans string, items array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, found in zip(batch.column(2), batch.column(3), strict=True):
                words = words_of(text.as_py())
                hit, names, cut = np.zeros(len(words) + 1, dtype=np.int64), set(), {}
                for f in found.as_py():
                    if f["item"] not in cut:
                        cut[f["item"]] = words_of(f["item_text"])
                    item, shift = cut[f["item"]], f["diagonal"]
                    need, first, last = min(WINDOW, len(item)), max(0, -shift), min(len(item), len(words) - shift)
                    run_length = 0
                    for i in range(first, last + 1):
                        if i < last and item[i] == words[i + shift]:
                            run_length += 1
                            continue
                        if run_length >= need:
                            hit[i + shift - run_length] += 1
                            hit[i + shift] -= 1
                            names.add(f["name"])
                        run_length = 0
                inside = np.cumsum(hit)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
                ordered = sorted(names)
                for values, value in zip(
                    out,
                    (
                        int(inside.sum()),
                        len(ordered),
                        hashlib.sha256(",".join(ordered).encode()).hexdigest(),
                        ",".join(f"{a}:{b}" for a, b in edge.reshape(-1, 2).tolist()),
                        ordered,
                    ),
                    strict=True,
                ):
                    values.append(value)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()))
            arrays = [pa.array(v, t) for v, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *arrays],
                names=["doc_id", "hash", "n_hit", "n_items", "items_sha256", "spans", "items"],
            )

    return candidates.select("doc_id", "hash", "text", "found").mapInArrow(run, schema)


def _near_bands(met: DataFrame, needed: DataFrame) -> DataFrame:
    """``(doc_id, hash, item, spots)``: bands with enough anchors, as their lowest diagonal and the anchors.

    A band holds at most BAND diagonals times the anchors of one item, however long the document.
    """
    lows = [F.col("diagonal") - F.pmod(F.col("diagonal") + F.lit(s), F.lit(BAND)) for s in (0, BAND // 2)]
    banded = met.withColumn("low", F.explode(F.array(*lows)))
    bands = banded.groupBy("doc_id", "hash", "item", "low").agg(F.collect_set("offset").alias("offsets"))
    bands = bands.join(needed, "item").filter(F.size("offsets") >= F.col("needed"))
    return bands.groupBy("doc_id", "hash", "item").agg(F.collect_list(F.struct("low", "offsets")).alias("spots"))


def _is_near(item: list[bytes], words: list[bytes], low: int, offsets: list[int]) -> bool:
    """Whether all words of a window of the item stand close together within the band."""
    n = min(WINDOW, len(item))
    for start in range(len(item) - n + 1):
        if sum(start <= o < start + n for o in offsets) < min(ANCHORS, n):
            continue
        wanted, last = set(item[start : start + n]), {}
        for at in range(max(0, low + start), min(len(words), low + BAND + start + n - 1)):
            if words[at] in wanted:
                last[words[at]] = at
                if len(last) == len(wanted) and at - min(last.values()) < n + SLACK:
                    return True
    return False


def _verify_near(candidates: DataFrame, id_type: str) -> DataFrame:
    """Names of the items near a document. Input rows have ``doc_id, hash, text`` and ``found``: structs of
    item name, text and spots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for text, found in zip(batch.column(2), batch.column(3), strict=True):
                words, names = words_of(text.as_py()), set()
                for f in found.as_py():
                    item = words_of(f["item_text"])
                    if any(_is_near(item, words, s["low"], s["offsets"]) for s in f["spots"]):
                        names.add(f["name"])
                near.append(sorted(names))
            made = pa.array(near, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], names=["doc_id", "hash", "near"])

    schema = f"doc_id {id_type}, hash long, near array<string>"
    return candidates.select("doc_id", "hash", "text", "found").mapInArrow(run, schema)


def _with_texts(docs: DataFrame, found: DataFrame, purpose: str) -> DataFrame:
    """Documents that have candidates, with their texts and ``found``."""
    found = materialize(found.withColumnRenamed("doc_id", "_id").withColumnRenamed("hash", "_hash"), purpose)
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (docs["hash"] == found["_hash"]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, proximity: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, also
    ``spans`` (word ranges that are hit, ``start:end`` comma-joined), ``items`` (their ids) and ``hash``
    (of the text). With ``proximity`` also ``near_items``: ids of the items of which all words of a window
    stand, in any order, within a stretch of SLACK more words than the window has; every item with an
    occurring window is among them.

    A window is WINDOW consecutive words of an item; a shorter item that has words is one window. Null
    texts and null items have no words and match nothing. A null item id with words counts as an item
    with an empty name. Repeated items are one item; equal texts under two ids are two items. Rows with
    equal id and text give equal results and stay separate rows. Empty tables give no hits. Extra
    columns of either table are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    named = benchmark.select(F.coalesce(column(benchmark, "item_id").cast("string"), F.lit("")).alias("name"), "text")
    named = named.filter("text is not null").distinct()
    items = materialize(named.select(F.xxhash64("name", "text").alias("item"), "name", "text"), "items")
    used = [r[0] for r in _item_slots(items).collect()]  # at most TABLE small numbers
    counts = np.zeros(TABLE, dtype=np.int64)
    for r in _slot_counts(docs, _bitmap(used)).collect():
        counts[r["slot"]] = r["n"]
    anchors = materialize(_anchors(items, counts), "anchors")
    slots = anchors.select(F.expr(f"cast(term & {TABLE - 1} as int)").alias("slot")).distinct()
    index = materialize(_index(docs, _bitmap([r[0] for r in slots.collect()])), "index")

    needed = anchors.groupBy("item").agg(F.least(F.count(F.lit(1)), F.lit(ANCHORS)).alias("needed"))
    postings = index.filter("term is not null")
    met = postings.join(anchors.withColumnRenamed("at", "offset"), "term")
    met = met.select("doc_id", "hash", "item", (F.col("at") - F.col("offset")).alias("diagonal"), "offset").distinct()
    if proximity:
        met = materialize(met, "met")
    lined = met.groupBy("doc_id", "hash", "item", "diagonal").agg(F.count(F.lit(1)).alias("n"))
    lined = lined.join(needed, "item").filter("n >= needed")
    texts = items.select("item", "name", F.col("text").alias("item_text"))
    lined = lined.join(texts, "item")
    found = lined.groupBy("doc_id", "hash").agg(
        F.collect_list(F.struct("item", "name", "item_text", "diagonal")).alias("found")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    verified = _verify(_with_texts(docs, found, "found"), kind).filter("n_items > 0")
    # Repeated rows of a document were compared each; one result is enough.
    verified = materialize(verified.dropDuplicates(["doc_id", "hash"]), "verified")
    verified = verified.withColumnRenamed("doc_id", "_id").withColumnRenamed("hash", "_hash")
    own = index.filter("term is null")
    none = hashlib.sha256(b"").hexdigest()
    joined = own.join(verified, own["doc_id"].eqNullSafe(verified["_id"]) & (own["hash"] == verified["_hash"]), "left")
    near = []
    if proximity:
        spots = _near_bands(met, needed).join(texts, "item")
        spots = spots.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("name", "item_text", "spots")).alias("found"))
        close = _verify_near(_with_texts(docs, spots, "near-found"), kind).filter(F.size("near") > 0)
        close = materialize(close.dropDuplicates(["doc_id", "hash"]), "near-verified")
        close = close.select(F.col("doc_id").alias("_near_id"), F.col("hash").alias("_near_hash"), "near")
        same = own["doc_id"].eqNullSafe(close["_near_id"]) & (own["hash"] == close["_near_hash"])
        joined = joined.join(close, same, "left")
        near = [F.coalesce("near", F.array().cast("array<string>")).alias("near_items")]
    return joined.select(
        "doc_id",
        F.col("at").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "hash",
        *near,
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark. Columns stay as they are."""
    found = find_contamination(docs, benchmark).filter("contaminated")
    hit = found.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hit")).distinct()
    same = docs["doc_id"].eqNullSafe(hit["_id"]) & (F.xxhash64(docs["text"]) == hit["_hit"])
    return docs.join(hit, same, "left_anti")


_WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The counts in SQL.
DIGEST_SQL = rf"""
WITH item_words AS MATERIALIZED (
    SELECT DISTINCT item_id::VARCHAR AS item, regexp_extract_all({_LOWER_SQL}, '{_WORD_SQL}') AS w FROM benchmark
), windows AS MATERIALIZED (
    SELECT DISTINCT item, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS body, least(10, len(w)) AS n
    FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item_words WHERE len(w) > 0)
), bodies AS MATERIALIZED (SELECT DISTINCT body, n FROM windows),
doc_words AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all({_LOWER_SQL}, '{_WORD_SQL}') AS w FROM documents
), hits AS MATERIALIZED (
    SELECT doc_id, i, d.n, d.body FROM (
        SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS body FROM (
            SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
            FROM doc_words, (SELECT DISTINCT n FROM bodies))
    ) d JOIN bodies b ON b.body = d.body AND b.n = d.n
), hit_words AS (
    SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM hits) GROUP BY doc_id
), hit_items AS (
    SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (
        SELECT DISTINCT doc_id, item FROM hits h JOIN windows w ON w.body = h.body AND w.n = h.n)
    GROUP BY doc_id
), near_windows AS MATERIALIZED (
    SELECT DISTINCT item, n, list_sort(list_distinct(w[i:i + n - 1])) AS words FROM (
        SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i
        FROM item_words WHERE len(w) > 0)
), spots AS MATERIALIZED (
    SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc_words)
    WHERE w[i] IN (SELECT unnest(words) FROM near_windows)
), rarest AS (
    SELECT item, n, words, arg_min(word, coalesce(f, 0)) AS word
    FROM (SELECT *, unnest(words) AS word FROM near_windows)
    LEFT JOIN (SELECT word, count(*) AS f FROM spots GROUP BY word) USING (word) GROUP BY item, n, words
), stretches AS (
    SELECT doc_id, item, n, words, w, unnest(range(greatest(1, i - n - 4), i + 1)) AS s
    FROM rarest JOIN spots USING (word) JOIN doc_words USING (doc_id)
), near_items AS (
    SELECT doc_id, count(DISTINCT item) AS n_near_items FROM stretches
    WHERE list_has_all(w[s:s + n + 4], words) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0)::BIGINT AS n_near_items
FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
LEFT JOIN near_items USING (doc_id)
"""
