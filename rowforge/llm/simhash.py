"""Near-duplicate documents by SimHash fingerprints and vantage-point trees.

Fingerprints within ``max_distance`` bits of each other are linked. A link of k bits puts at most k // 2
differing bits into one of the two 32-bit halves, so one tree per half finds every link with the small
radius k // 2, at which triangle bounds prune well; each candidate is then checked on all 64 bits.

A tree's upper part is grown on the driver from a bounded sample of half values. Its leaves are the
shards: every distinct fingerprint lives in one leaf and also visits the leaves that its ball overlaps.
Inside a shard the tree goes on down to small blocks. Shards that hold too many residents are dealt in
parts that visit each other, so no shard is one task's burden. A shard reports a spanning forest of the
links found, never all pairs, and connected components join the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, NumericType, StructField, StructType

from ..runtime import materialize
from .common import column, keeps_other_columns
from .components import components

#: Distinct fingerprints aimed at in a shard, and the most half values from which a tree is grown.
SHARD = 4096
MOST_PIVOTS = 65_536
_BLOCK = 192


def shingle_hashes(text: str | None, words_in_shingle: int) -> np.ndarray:
    """Hashes of the word shingles of a text, lower-cased in A-Z, as big-endian longs; a short text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=">u8")
    if len(words) < words_in_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_in_shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, 42) for s in shingles], dtype=">u8")


def fingerprint(text: str | None, words_in_shingle: int = 3) -> int:
    """SimHash of the word shingles of a text, lower-cased in A-Z; 0 without words."""
    hashes = shingle_hashes(text, words_in_shingle)
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text", words_in_shingle: int = 3) -> DataFrame:
    """Every column of ``docs`` but the text, and ``_fp``: the fingerprint as a signed long."""
    others = [column(docs, c) for c in docs.columns if c != text]
    narrow = docs.select(*others, column(docs, text).alias("_text"))
    schema = StructType([*narrow.schema.fields[:-1], StructField("_fp", LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            made = [fingerprint(t.as_py(), words_in_shingle) for t in batch.column(batch.num_columns - 1)]
            signed = pa.array(np.array(made, dtype=np.uint64).view(np.int64))
            names = [f.name for f in schema.fields]
            yield pa.RecordBatch.from_arrays([*kept, signed], names=names)

    return narrow.mapInArrow(run, schema)


def _half(values: np.ndarray, half: int) -> np.ndarray:
    """One 32-bit half of signed 64-bit fingerprints."""
    return (values.view(np.uint64) >> np.uint64(32 * half)).astype(np.uint32)


class Tree:
    """Upper part of a vantage-point tree over 32-bit values; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.nodes: list[tuple[int, int, int, int]] = []  # point, bound, child inside, child outside
        self.leaves = 0
        self.root = self._grow(np.unique(sample), max(1, leaves))

    def _grow(self, values: np.ndarray, leaves: int) -> int:
        """Index of a node, or -1 - leaf."""
        if leaves > 1 and len(values) > 1:
            point = values[len(values) // 2]
            apart = np.bitwise_count(values ^ point)
            bound = int(np.median(apart))
            if bound == apart.max():
                bound -= 1
            inside = apart <= bound
            if inside.any() and not inside.all():
                at = len(self.nodes)
                self.nodes.append((int(point), bound, 0, 0))
                near = self._grow(values[inside], leaves // 2)
                far = self._grow(values[~inside], leaves - leaves // 2)
                self.nodes[at] = (int(point), bound, near, far)
                return at
        self.leaves += 1
        return -self.leaves

    def route(self, values: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each leaf: positions of the values that live there, and of those that visit it.

        A pair within the radius meets in the home leaf of at least one of the two: a value that lives
        inside a bound visits the outside if its ball reaches there, and a visitor goes wherever its ball
        reaches.
        """
        stack = [(self.root, np.arange(len(values)), np.empty(0, dtype=np.int64))]
        while stack:
            at, live, visit = stack.pop()
            if not len(live) and not len(visit):
                continue
            if at < 0:
                yield -1 - at, live, visit
                continue
            point, bound, near, far = self.nodes[at]
            d_live = np.bitwise_count(values[live] ^ np.uint32(point)).astype(np.int64)
            d_visit = np.bitwise_count(values[visit] ^ np.uint32(point)).astype(np.int64)
            inside = d_live <= bound
            crossing = live[inside & (d_live + radius > bound)]
            stack.append((near, live[inside], visit[d_visit - radius <= bound]))
            stack.append((far, live[~inside], np.concatenate([visit[d_visit + radius > bound], crossing])))


def _forest(live: np.ndarray, visit: np.ndarray, half: int, max_distance: int) -> list[tuple[int, int]]:
    """Links between positions of one shard, thinned to a spanning forest.

    ``live`` and ``visit`` are fingerprints; positions count on from live to visit. The search goes down
    a vantage-point tree on the half; where all values of the half are equal it goes on with the whole
    fingerprint, and blocks that cannot be split are compared in rows of bounded size.
    """
    values = np.concatenate([live, visit]).view(np.uint64)
    halves = _half(values.view(np.int64), half).astype(np.uint64)
    parent = np.arange(len(values))
    links: list[tuple[int, int]] = []

    def join(a: np.ndarray, b: np.ndarray) -> None:
        """Hook the larger root of each pair below the smaller one, all pairs at once, until none is left."""
        while True:
            p, q = parent[a], parent[b]
            apart = p != q
            if not apart.any():
                return
            a, b, p, q = a[apart], b[apart], p[apart], q[apart]
            high, at = np.unique(np.maximum(p, q), return_index=True)
            parent[high] = np.minimum(p, q)[at]
            links.extend(zip(a[at].tolist(), b[at].tolist(), strict=True))
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent[:] = up

    def compare(residents: np.ndarray, others: np.ndarray, own: bool) -> None:
        step = max(1, 2_000_000 // max(1, len(others)))
        for at in range(0, len(residents), step):
            rows = residents[at : at + step]
            x, y = np.nonzero(np.bitwise_count(values[rows][:, None] ^ values[others][None, :]) <= max_distance)
            a, b = rows[x], others[y]
            keep = a < b if own else a != b
            join(a[keep], b[keep])

    stack = [(np.arange(len(live)), np.arange(len(live), len(values)), False)]
    while stack:
        residents, visitors, whole = stack.pop()
        if not len(residents):
            continue
        metric, radius = (values, max_distance) if whole else (halves, max_distance // 2)
        if len(residents) > _BLOCK:
            point = metric[residents[len(residents) // 2]]
            d_live = np.bitwise_count(metric[residents] ^ point).astype(np.int64)
            bound = int(np.median(d_live))
            if bound == d_live.max():
                bound -= 1
            inside = d_live <= bound
            if inside.any() and not inside.all():
                d_visit = np.bitwise_count(metric[visitors] ^ point).astype(np.int64)
                crossing = residents[inside & (d_live + radius > bound)]
                stack.append((residents[inside], visitors[d_visit - radius <= bound], whole))
                far = np.concatenate([visitors[d_visit + radius > bound], crossing])
                stack.append((residents[~inside], far, whole))
                continue
            if not whole:
                stack.append((residents, visitors, True))
                continue
        compare(residents, residents, True)
        compare(residents, visitors, False)
    return links


def _placed(prints: DataFrame, trees: list[Tree], parts: dict[tuple[int, int], int], radius: int) -> DataFrame:
    """``(tree, leaf, part, id, fp, lives)``: every fingerprint in its home and where it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for t, tree in enumerate(trees):
                out: list[list[np.ndarray]] = [[], [], [], []]
                for leaf, live, visit in tree.route(_half(values, t), radius):
                    n = parts.get((t, leaf), 1)
                    # Any even deal will do; it must rest on the fingerprint alone.
                    home = (values[live].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(n)
                    home = home.astype(np.int64)
                    rows = [(live, home, 1)]
                    for p in range(n):
                        rows.append((live[home > p], np.full(int((home > p).sum()), p), 0))
                        rows.append((visit, np.full(len(visit), p), 0))
                    for who, part, lives in rows:
                        if len(who):
                            out[0].append(np.full(len(who), leaf))
                            out[1].append(part)
                            out[2].append(who)
                            out[3].append(np.full(len(who), lives))
                if out[0]:
                    leaf, part, who, lives = map(np.concatenate, out)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(who), t, dtype=np.int32)),
                            pa.array(leaf.astype(np.int32)),
                            pa.array(part.astype(np.int32)),
                            pa.array(ids[who]),
                            pa.array(values[who]),
                            pa.array(lives.astype(np.int32)),
                        ],
                        names=["tree", "leaf", "part", "id", "fp", "lives"],
                    )

    return prints.select("id", "fp").mapInArrow(run, "tree int, leaf int, part int, id long, fp long, lives int")


def link_fingerprints(prints: DataFrame, max_distance: int = 3, shard: int = SHARD) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs within ``max_distance`` bits.

    ``prints`` has one row ``(id, fp)`` per distinct fingerprint and is read several times.
    """
    total = prints.count()
    leaves = max(1, min(MOST_PIVOTS, -(-total // shard)))
    # The k smallest hashes: the same sample in every run; at most MOST_PIVOTS values reach the driver.
    few = prints.orderBy(F.xxhash64("fp"), "fp").limit(min(MOST_PIVOTS, max(64, 16 * leaves)))
    sample = np.array([r[0] for r in few.select("fp").collect()], dtype=np.int64)
    trees = [Tree(_half(sample, half), leaves) for half in (0, 1)]
    radius = max_distance // 2
    held = _placed(prints, trees, {}, radius).filter("lives = 1").groupBy("tree", "leaf").count()
    full = held.filter(F.col("count") > 4 * shard).collect()  # at most one row per leaf
    parts = {(r["tree"], r["leaf"]): -(-r["count"] // (2 * shard)) for r in full}

    def search(key: tuple, table: pa.Table) -> pa.Table:
        lives = table.column("lives").to_numpy() == 1
        ids, values = table.column("id").to_numpy(), table.column("fp").to_numpy()
        order = np.concatenate([np.nonzero(lives)[0], np.nonzero(~lives)[0]])
        links = _forest(values[lives], values[~lives], int(key[0].as_py()), max_distance)
        a = ids[order[[i for i, _ in links]]] if links else np.empty(0, dtype=np.int64)
        b = ids[order[[j for _, j in links]]] if links else np.empty(0, dtype=np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    placed = _placed(prints, trees, parts, radius)
    return placed.groupBy("tree", "leaf", "part").applyInArrow(search, "a long, b long")


def _grouped(docs: DataFrame, max_distance: int, words_in_shingle: int, text: str, key: str) -> DataFrame:
    """Rows without the text, with ``_fp``, ``_root`` (one fingerprint per component) and the smallest key."""
    prints = materialize(with_fingerprints(docs, text, words_in_shingle), "fingerprints")
    distinct = prints.groupBy(F.col("_fp").alias("id")).agg(F.min(column(prints, key)).alias("first"))
    distinct = materialize(distinct.withColumn("fp", F.col("id")), "distinct")
    found = components(link_fingerprints(distinct.select("id", "fp"), max_distance))
    labels = distinct.join(found.withColumnRenamed("node", "id"), "id", "left")
    labels = materialize(labels.select("id", "first", F.coalesce("component", "id").alias("_root")), "roots")
    smallest = labels.groupBy("_root").agg(F.min("first").alias("_smallest"))
    members = labels.join(smallest, "_root").select(F.col("id").alias("_fp"), "_root", "_smallest")
    return prints.join(materialize(members, "members"), "_fp")


@keeps_other_columns
def near_duplicates(
    docs: DataFrame, max_distance: int = 3, words_in_shingle: int = 3, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``docs`` without the text, with ``fingerprint`` (16 hex digits) and ``component_id``.

    The component is the smallest non-null key that links of at most ``max_distance`` bits reach, the own
    one included. Null and blank texts have fingerprint zero and are linked like any other. A row with a
    null key takes part with its text; if no row reached has a key, the component is null. Repeated rows
    are kept. An empty table gives an empty result. Input columns named like the two added ones are
    replaced.
    """
    names = [c for c in docs.columns if c not in (text, "fingerprint", "component_id")]
    slim = docs.select(*[column(docs, c) for c in names], column(docs, text))
    found = _grouped(slim, max_distance, words_in_shingle, text, key)
    return found.select(
        *[column(found, c) for c in names],
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("_smallest").alias("component_id"),
    )


def document_keys(docs: DataFrame) -> list[Column]:
    """What tells documents apart: the key, whether it is null, and the hash of the text. Keys that are no numbers are texts."""
    kind = docs.schema["doc_id"].dataType
    key = docs["doc_id"] if isinstance(kind, NumericType) else docs["doc_id"].cast("string")
    none = F.lit(0).cast(kind) if isinstance(kind, NumericType) else F.lit("")
    return [
        F.coalesce(key, none).alias("_key"),
        docs["doc_id"].isNull().alias("_none"),
        F.coalesce(F.xxhash64(docs["text"]), F.lit(0)).alias("_hash"),
    ]


def first_of_groups(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``_root`` of ``found``, which has the document keys."""
    best = F.min(F.struct("_none", "_key", "_hash")).alias("best")
    kept = materialize(found.groupBy("_root").agg(best).select("best.*"), "kept")
    same = docs.select("*", *document_keys(docs)).join(kept, ["_none", "_key", "_hash"], "left_semi")
    # The join leaves the rows dealt and sorted by these keys, so the window needs no exchange.
    place = F.row_number().over(Window.partitionBy("_none", "_key", "_hash").orderBy(F.lit(0)))
    first = same.withColumn("_place", place).filter("_place = 1")
    return first.select(*[column(first, c) for c in docs.columns])


@keeps_other_columns
def drop_near_duplicates(docs: DataFrame, max_distance: int = 3, words_in_shingle: int = 3) -> DataFrame:
    """One document of each group of near duplicates: the smallest key, then the smallest text hash.

    Null keys come last. Rows with the same key and text are one document and leave one row. Columns are
    those of ``docs``.
    """
    found = _grouped(docs.select(*document_keys(docs), docs["text"]), max_distance, words_in_shingle, "text", "_key")
    return first_of_groups(docs, found)
