"""Mixing sources to target weights by a time-varying curriculum. DataFrame functions only.

Every source has a token target. Its weight over training time t in [0, 1] runs along a straight ramp, so
its cumulative demand D(t) is a quadratic whose value at 1 is the target. A source's documents are laid
end to end, in hash order, on its token line; a second copy follows the first pass. A copy that starts at
token x is trained at t = D^-1(x), words beyond the target are not taken, and the mix is the copies of all
sources range-sorted by t. Running sums are made per (source, range), so a source that holds a third of
all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import position_rows, running, with_row_id
from ..runtime import materialize
from .common import WORD, column, keeps_other_columns

WEIGHTS = (5, 2, 1)
#: Weight at the start and at the end of training, in the order of WEIGHTS.
RAMPS = ((2.0, 1.0), (1.0, 1.0), (1.0, 3.0))
SHARE = 1.5
MOST_COPIES = 2


def _by_turn(place: Column, values: tuple) -> Column:
    turn = F.pmod(place, F.lit(len(values)))
    pick = F.when(turn == 0, F.lit(values[0]))
    for i, value in enumerate(values[1:], 1):
        pick = pick.when(turn == i, F.lit(value))
    return pick


def source_targets(sizes: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS) -> DataFrame:
    """``(source, source_size, weight, target, place)`` of ``(source, size)`` rows.

    Sources in code-point order, null last, weigh ``weights`` in turn. Together they want ``share`` times
    all sizes; no target exceeds MOST_COPIES times its source, and what is cut off is shared out anew by
    weight. The fixed point is found by one sort: sources fill up in the order of size by weight.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = position_rows(totals, [F.col("source").isNull(), F.col("source")], "place")
    wanted = placed.withColumns(
        {
            "weight": _by_turn(F.col("place"), weights).cast("long"),
            "full": F.col("source_size") * MOST_COPIES,
        }
    )
    sums = wanted.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    demand, weight = share * float(sums["n"] or 0), int(sums["w"] or 0)
    ordered = with_row_id(wanted, [F.col("full") / F.col("weight"), F.col("place")], "_row")
    filling = running(running(ordered, F.col("full"), "_full", (), "_row"), F.col("weight"), "_weight", (), "_row")
    level = (F.lit(demand) - (F.col("_full") - F.col("full"))) / (F.lit(weight) - (F.col("_weight") - F.col("weight")))
    filling = materialize(filling.withColumn("_level", level), "filling")
    open_ = filling.filter(F.col("full") / F.col("weight") > F.col("_level"))
    first = open_.agg(F.min_by("_level", "_row")).first()[0]
    target = F.col("full").cast("double")
    if first is not None:
        target = F.least(target, F.col("weight") * F.lit(first))
    return filling.select("source", "source_size", "weight", target.alias("target"), "place")


def _moment(x: Column, begin: Column, end: Column) -> Column:
    """Inverse of the share of a ramp's area that lies before a moment."""
    root = F.sqrt(begin * begin + (end * end - begin * begin) * x)
    return F.when(begin == end, x).otherwise((root - begin) / (end - begin))


def _planned(docs: DataFrame, share: float, weights: tuple, ramps: tuple) -> DataFrame:
    """The rows of :func:`plan_mix` with ``_row``, the place where each is laid out."""
    slim = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_hash"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_mix"),
    )
    laid = with_row_id(slim, [F.col("source"), F.col("_mix"), F.col("doc_id"), F.col("size"), F.col("_hash")], "_row")
    targets = materialize(source_targets(laid.select("source", "size"), share, weights), "targets")
    ends = running(laid, F.col("size"), "_end", ("source",), "_row")
    own = targets.select(F.col("source").alias("_source"), "source_size", "target", "place")
    rows = ends.join(own, F.col("source").eqNullSafe(F.col("_source")))
    begin, end = (_by_turn(F.col("place"), tuple(float(r[i]) for r in ramps)) for i in (0, 1))
    words = F.floor("target").cast("long")
    columns = {}
    for copy in range(MOST_COPIES):
        start = F.col("_end") - F.col("size") + F.col("source_size") * copy
        taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), words - start))
        columns[f"taken_{copy}"] = taken
        columns[f"position_{copy}"] = F.when(taken > 0, _moment(start / F.col("target"), begin, end))
    planned = rows.withColumns(columns)
    total = sum((F.col(f"taken_{i}") for i in range(1, MOST_COPIES)), F.col("taken_0"))
    return planned.select("_row", "doc_id", "source", "_hash", "size", "source_size", "target", total.alias("taken"), *columns)


def plan_mix(docs: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS, ramps: tuple = RAMPS) -> DataFrame:
    """Per row: ``doc_id, source, _hash, size, source_size, target, taken``, and for each of its copies
    ``taken_i`` (words) and ``position_i`` (training time, null if nothing is taken).

    A null text has size 0. Rows are laid out by md5 of the id, then id, size and text hash; rows equal in
    all of these are interchangeable. Nulls are ids and sources like any other. A source without words
    has target 0. An empty table gives an empty plan.
    """
    return _planned(docs, share, weights, ramps).drop("_row")


def _copies() -> Column:
    """The copies of a planned row of which words are taken: their words ``n`` and training time ``t``."""
    both = [F.struct(F.col(f"taken_{i}").alias("n"), F.col(f"position_{i}").alias("t")) for i in range(MOST_COPIES)]
    return F.filter(F.array(*both), lambda copy: copy["n"] > 0)


def mix_sequence(plan: DataFrame, *columns: str) -> DataFrame:
    """The mix as a sequence: copies range-sorted by training time, as ``columns, n, t`` and ``_place``, which grows
    in the order of the mix. Copies of one time follow in the order of their id and text hash. A row that is not
    in the mix stands behind it once, with null for ``n`` and ``t``.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key")
    copies = plan.select(*columns, key, "_hash", F.explode_outer(_copies()).alias("_copy"))
    copies = materialize(copies.select(*columns, "_key", "_hash", "_copy.n", "_copy.t"), "copies")
    return with_row_id(copies, [F.col("t").asc_nulls_last(), "_key", "_hash"], "_place").drop("_key", "_hash")


@keeps_other_columns
def mix_documents(docs: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS, ramps: tuple = RAMPS) -> DataFrame:
    """The training mix: rows of ``docs``, once per copy taken, range-sorted by training position.

    Texts are taken whole: of a source's last copy, which the plan may cut, all is taken if the plan takes half
    of its words or more, and nothing otherwise. So a source's words are off its target by half a document at
    most. Rows without words are left out. Columns are those of ``docs``.
    """
    keys = {
        "_key": F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
        "_none": F.col("doc_id").isNull(),
        "_origin": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")),
    }
    plan = plan_mix(docs, share, weights, ramps).withColumns(keys)
    copies = plan.select(*keys, "_hash", F.col("size").alias("_size"), F.explode(_copies()).alias("_copy"))
    plan = materialize(copies.filter("2 * _copy.n >= _size"), "copies")
    keyed = docs.withColumns(keys | {"_hash": F.coalesce(F.xxhash64("text"), F.lit(0))})
    names = [*keys, "_hash"]
    # Equal rows are one document here: the plan has their copies. The join finds rows dealt by these keys.
    place = F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0)))
    once = keyed.withColumn("_place", place).filter("_place = 1")
    mixed = once.join(plan, names)
    ordered = mixed.orderBy(F.col("_copy.t"), "_key", "_hash")
    return ordered.select(*[column(ordered, c) for c in docs.columns])


def mix_digest(docs: DataFrame) -> DataFrame:
    """What the range-sorted mix holds of each document: words of all its copies, and the time of the first one."""
    row = ["_row", "doc_id", "size", "source_size", "target"]
    held = mix_sequence(_planned(docs, SHARE, WEIGHTS, RAMPS), *row).groupBy(*row).agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("taken"), F.min_by("t", "_place").alias("first_position")
    )
    return held.drop("_row")


#: The same figures in SQL.
DIGEST_SQL = rf"""
WITH sized AS (
    SELECT doc_id, source, text,
        coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size
    FROM documents
), totals AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT *, [5, 2, 1][1 + place % 3]::BIGINT AS weight, source_size * 2 AS full_size FROM (
        SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM totals)
), filling AS (
    SELECT *,
        (CAST(1.5 AS DOUBLE) * sum(source_size) OVER ()
            - (sum(full_size) OVER (ORDER BY full_size / weight, place) - full_size))::DOUBLE
        / (sum(weight) OVER () - (sum(weight) OVER (ORDER BY full_size / weight, place) - weight))::DOUBLE AS level
    FROM weighed
), chosen AS (
    SELECT min_by(level, full_size / weight) AS level FROM filling WHERE full_size / weight > level
), targets AS (
    SELECT source, source_size, place,
        CASE WHEN chosen.level IS NULL THEN full_size::DOUBLE
            ELSE least(full_size::DOUBLE, weight * chosen.level) END AS target
    FROM filling, chosen
), laid AS (
    SELECT s.*, t.source_size, t.target, t.place,
        (sum(size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size
            ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), taken AS (
    SELECT *,
        greatest(0, least(size, floor(target)::BIGINT - start)) AS first_taken,
        greatest(0, least(size, floor(target)::BIGINT - start - source_size)) AS second_taken,
        [2.0, 1.0, 1.0][1 + place % 3]::DOUBLE AS b, [1.0, 1.0, 3.0][1 + place % 3]::DOUBLE AS e
    FROM laid
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (first_taken + second_taken)::BIGINT AS taken,
    CASE WHEN first_taken > 0 THEN
        CASE WHEN b = e THEN start / target ELSE (sqrt(b * b + (e * e - b * b) * (start / target)) - b) / (e - b) END
    END AS first_position
FROM taken
"""
