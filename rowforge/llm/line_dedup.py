"""Near-duplicate lines by an exact set-similarity join. DataFrame functions only.

A line is the set of its lower-cased words. Lines match if the Jaccard similarity of their sets is 0.8 or
more; a line is removed if an earlier line of the corpus matches it.

1. Word frequencies are counted over the whole corpus into a table of fixed size (SLOTS counters). The
   frequency class of a word's slot, then its hash, orders all words from rare to common. The two are one
   long, which stands for the word from there on, so sorting a line is sorting longs.
2. Equal lines become one set, with their earliest place. A set keeps its prefix: its rarest words, of which
   two matching sets must share one.
3. Crowds are found: many sets that share rare words. The pairs inside a crowd grow with its square, so they
   never become rows: its sets meet in blocks, and each set counts its matches among those of a block.
4. All other pairs: prefixes meet on the word and the class of the size, so that sets far from each other's
   size never meet. Length, positional and bitmap filters run inside that join: sizes within 0.8 of each other,
   enough words left behind the shared one, and no more differing parity bits than the similarity allows (of
   128 for long lines). Pairs must then share as many words of the prefixes as their sizes ask for. All are
   bounds, so no match is lost.
5. The words of the few sets that are left are fetched once more, and the similarity is computed.
6. Each line looks up the earliest place among its matches; later occurrences are removed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import WORD, column, keeps_other_columns

#: Words from which a set has a bitmap of 128 bits.
WIDE = 80
#: Counters of the frequency table, which every task holds.
SLOTS = 1 << 16
#: Bits of the filter that picks rows by a hash; the table has a row for 64 of them.
FILTER_BITS = 1 << 22
#: Sets from which three words of prefixes make a crowd, and sets of a crowd that meet in one row.
CROWD, BLOCK = 256, 256
_SPACE = r"[\x20\x09-\x0D]+"
#: What _SPACE has besides blanks and line ends.
_OTHER_SPACE = "\t\v\f\r"


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def _longs(values: list[int]) -> Column:
    """Folds into one literal array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _lines(docs: DataFrame) -> DataFrame:
    """``_id, _doc, _no, _line``; null texts have no lines."""
    # Hashed below the lines, or each line would hash the whole text again.
    docs = docs.select(docs["doc_id"].alias("_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_doc"), "text")
    return docs.select("_id", "_doc", F.posexplode(F.split("text", "\n")).alias("_no", "_line"))


def _with_words(lines: DataFrame) -> DataFrame:
    """The lines that have a word, in lower case."""
    # A test on the words would be pushed below them and compute them twice.
    lines = lines.filter(F.col("_line").rlike(WORD))
    return lines.withColumn("_line", F.lower("_line"))


def _words() -> Column:
    """The words of ``_line``, empty texts among them."""
    # A split at one given character needs no regular expression.
    odd = F.lit(False)
    for c in _OTHER_SPACE:
        odd = odd | F.col("_line").contains(c)
    return F.when(odd, F.split("_line", _SPACE)).otherwise(F.split("_line", " "))


def _place() -> Column:
    """Order of lines in the corpus: id (null last), text hash, number of the line."""
    return F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_doc").alias("doc"), F.col("_no").alias("no"))


def _frequency_classes(lines: DataFrame) -> list[int]:
    """A class from 0 to 127 for every slot, eight to a doubling, over all words of the corpus."""
    words = _with_words(lines).select(F.explode(_words()).alias("word"))
    slots = words.select(F.expr(f"cast(xxhash64(word) & {SLOTS - 1} as int)").alias("slot"))
    found = slots.groupBy("slot").count()
    # A slot and its class in one number, 256 slots to a row: the driver gets lists of numbers, not a row a slot.
    one = F.col("slot") * 128 + F.least(F.lit(127), F.floor(4 * F.log2(1 + F.col("count")))).cast("int")
    rows = found.groupBy(F.shiftright("slot", 8)).agg(F.collect_list(one).alias("slots"))
    classes = [0] * SLOTS
    for r in rows.collect():  # at most SLOTS numbers
        for x in r["slots"]:
            classes[x >> 7] = x & 127
    return classes


def _with_tokens(lines: DataFrame, classes: list[int]) -> DataFrame:
    """The lines that have a word, with ``tokens``: their distinct words as sorted longs, rare ones first."""
    # Its values are shifted already to the place of the class.
    table = _longs([c << 56 for c in classes])
    hashes = F.transform(F.array_remove(_words(), ""), lambda w: F.xxhash64(w))
    # Longs that cannot be null are sorted as plain numbers.
    packed = F.transform(
        F.array_distinct(hashes),
        lambda h: F.coalesce(
            table[h.bitwiseAND(F.lit(SLOTS - 1))].bitwiseOR(F.shiftrightunsigned(h, 8)), F.lit(0).cast("long")
        ),
    )
    return _with_words(lines).withColumn("tokens", F.sort_array(packed))


def _line_rows(docs: DataFrame, classes: list[int]) -> DataFrame:
    """One row per line: its place, and its set's key, size, bitmaps and prefix.

    A prefix only brings lines together, so its words are kept as 32-bit hashes: words that collide add
    candidates, nothing else. ``bitmap`` has the parity of the words at each of 64 bits; ``high``, of sets of
    more than WIDE words, that of the words of the upper half of 128 bits.
    """
    lines = _with_tokens(_lines(docs), classes)
    size = F.size("tokens")
    zero = F.lit(0).cast("long")
    # Looked up, a bit takes fewer steps than a shift.
    bits = [-(1 << 63) if i == 63 else 1 << i for i in range(64)]
    parity = lambda values: F.aggregate(
        "tokens", zero, lambda seen, t: seen.bitwiseXOR(_longs(values)[t.bitwiseAND(F.lit(len(values) - 1))])
    )
    bitmap = parity(bits)
    high = F.when(size > WIDE, parity([0] * 64 + bits)).otherwise(zero)
    prefix = F.slice("tokens", F.lit(1), size - F.ceil(size * 4 / F.lit(5)).cast("int") + 1)
    return lines.select(
        "_id",
        "_doc",
        "_no",
        F.xxhash64("tokens").alias("key"),
        size.alias("size"),
        bitmap.alias("bitmap"),
        high.alias("high"),
        F.transform(prefix, lambda t: F.hash(t)).alias("prefix"),
    )


def _bit_word(h: Column) -> Column:
    return F.shiftright(F.pmod(h, F.lit(FILTER_BITS)), 6)


def _with_bits(rows: DataFrame, by: Column, wanted: DataFrame, how: str) -> DataFrame:
    """``rows`` with ``_hit``: whether their hash ``by`` may be among ``wanted`` (``_h``), by a bit table of fixed size."""
    bit = lambda h: _bit(F.pmod(h, F.lit(64)))
    # FILTER_BITS / 64 rows at most, whatever the corpus: a proven bound for the broadcast.
    table = wanted.groupBy(_bit_word(F.col("_h")).alias("_word")).agg(F.bit_or(bit(F.col("_h"))).alias("_bits"))
    met = rows.join(F.broadcast(table), _bit_word(by) == F.col("_word"), how)
    hit = F.coalesce(F.col("_bits").bitwiseAND(bit(by)) != 0, F.lit(False))
    return met.select(*rows.columns, hit.alias("_hit"))


def _picked(rows: DataFrame, by: Column, wanted: DataFrame) -> DataFrame:
    """The rows that may be among ``wanted``; a few others come along."""
    return _with_bits(rows, by, wanted, "inner").filter("_hit").drop("_hit")


def _crowd_cores(sets: DataFrame) -> DataFrame | None:
    """``key, crowd`` of sets that share three words of their prefixes with CROWD or more; None if there are none.

    Only the four words of a prefix with the smallest hashes are looked at. A mark (three such words) goes
    with the most frequent mark that has half of the sets of one of the two in common with it.
    """
    # Numbers that cannot be null are sorted as plain numbers.
    least = F.sort_array(F.transform("prefix", lambda t: F.coalesce(t, F.lit(0))))
    four = sets.filter(F.size("prefix") > 3).select("key", least.alias("p"))
    three = [F.hash(*[F.get("p", F.lit(i)) for i in range(4) if i != gone]) for gone in range(4)]
    marks = four.select("key", F.explode(F.array(*three)).alias("mark"))
    many = materialize(marks.groupBy("mark").count().filter(F.col("count") >= CROWD), "line-marks")
    if many.isEmpty():
        return None
    held = _picked(marks, F.col("mark"), many.select(F.col("mark").alias("_h"))).join(many, "mark")
    held = materialize(held.withColumn("mark", F.col("mark").cast("long")).distinct(), "line-marked")
    other = held.select("key", F.col("mark").alias("b"), F.col("count").alias("m"))
    both = held.join(other, "key").groupBy(F.col("mark").alias("a"), "b")
    both = both.agg(F.count(F.lit(1)).alias("n"), F.first("count").alias("count"), F.first("m").alias("m"))
    best = F.max(F.struct("m", "b"))
    crowd = both.filter("2 * n >= least(count, m)").groupBy("a").agg(best["b"].alias("crowd"))
    return held.join(crowd, F.col("mark") == F.col("a")).groupBy("key").agg(F.min("crowd").alias("crowd"))


def _crowds(sets: DataFrame) -> DataFrame:
    """``key, crowd``: sets that share words with a crowd, one row each.

    A crowd's words are those in the prefixes of half of its core. A set belongs to the crowd with which it
    shares most words, three at least. Sets that are missed are compared as all others are.
    """
    core = _crowd_cores(sets)
    if core is None:
        return sets.select("key", F.col("key").alias("crowd")).limit(0)
    core = materialize(core, "line-cores")
    total = core.groupBy("crowd").agg(F.count(F.lit(1)).alias("n"))
    of_core = _picked(sets.select("key", "prefix"), F.col("key"), core.select(F.col("key").alias("_h"))).join(core, "key")
    words = of_core.select("crowd", F.explode(F.array_distinct("prefix")).alias("word")).groupBy("crowd", "word").count()
    words = materialize(words.join(total, "crowd").filter("2 * count >= n").select("crowd", "word"), "line-core-words")
    # Two words of a prefix that collide count twice, which only matters to which sets are taken into a crowd.
    at = sets.select("key", F.explode("prefix").alias("word"))
    met = _picked(at, F.col("word"), words.select(F.col("word").alias("_h"))).join(words, "word").groupBy("key", "crowd").count()
    best = F.max(F.struct("count", "crowd"))
    return materialize(met.filter("count >= 3").groupBy("key").agg(best["crowd"].alias("crowd")), "line-crowds")


#: Of a set, what the join of the prefixes reads.
_KEPT = ("key", "size", "bitmap", "high", "crowd")
#: Of the sizes of two neighbouring classes: a little more than that of the sizes of a match.
_RATIO = 1.2500001


def _size_class(size: Column) -> Column:
    """Sizes that match are of one class or of two neighbouring ones."""
    return F.floor(F.log(size) / math.log(_RATIO)).cast("int")


def _candidates(sets: DataFrame, crowds: DataFrame) -> DataFrame:
    """Pairs of keys ``(a, b)`` that are not of one crowd and pass the filters of the join."""
    # Smaller sets match equal ones only.
    own = sets.filter("size > 3").select("key", "size", "bitmap", "high", "prefix")
    own = _with_bits(own, F.col("key"), crowds.select(F.col("key").alias("_h")), "left")
    held = own.filter("_hit").join(crowds, "key", "left")
    own = own.filter("not _hit").withColumn("crowd", F.lit(None).cast("long")).unionByName(held)
    # A set stands in the class of its size with all of its prefix. Once more it stands, as the smaller set of a
    # pair, in the next class, with the words that it can share first with a set of that class. Both sides of the
    # join read these rows, so they are shuffled once.
    least = F.floor(F.pow(F.lit(_RATIO), F.col("class") + 1) * (1 - 1e-9))
    reach = F.when(_size_class(F.expr("size + size div 4")) > F.col("class"), F.col("size") - F.floor((4 * (F.col("size") + least) + 8) / 9))
    own = own.withColumn("class", _size_class(F.col("size")))
    own = own.select(*_KEPT, "class", F.coalesce(reach, F.lit(-1)).alias("reach"), F.posexplode("prefix").alias("at", "token"))
    stands = F.when(F.col("at") <= F.col("reach"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = own.select(*_KEPT, "class", "at", "token", F.explode(stands).alias("next"))
    rows = rows.select(*_KEPT, (2 * F.col("at") + F.col("next")).alias("at"), F.hash("token", F.col("class") + F.col("next")).alias("word"))
    left, right = (rows.select(*[F.col(c).alias(f"{c}_{x}") for c in rows.columns]) for x in "ab")
    # Two sets of n and m words are 0.8 similar if they share 4/9 of n + m.
    need = F.expr("(4 * (size_a + size_b) + 8) div 9")
    ordered = F.expr("size_a < size_b or (size_a = size_b and key_a < key_b)")
    length = F.expr("4 * size_b <= 5 * size_a")
    # The larger set is met in its own class only. This test stays in the join as it is one of both sides.
    at_b = F.expr("if(at_b % 2 = 1, size_b, at_b div 2)")
    position = F.least(F.col("size_a") - F.expr("at_a div 2"), F.col("size_b") - at_b) >= need
    bits, high = (F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")) for c in ("bitmap", "high"))
    most = F.col("size_a") + F.col("size_b") - 2 * need
    # The lower half of the 128 bits is what the upper half leaves of the 64.
    apart = F.when(F.col("size_a") > WIDE, F.bit_count(bits.bitwiseXOR(high)) + F.bit_count(high)).otherwise(F.bit_count(bits))
    other = F.coalesce(F.col("crowd_a") != F.col("crowd_b"), F.lit(True))
    met = left.join(right, (F.col("word_a") == F.col("word_b")) & ordered & length & position & (apart <= most) & other)
    return met.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct()


def _prefixes_agree(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` that share as many words of their prefixes as their sizes ask for.

    Of two matching sets of n and m words at most n - need and m - need are not shared, so the k-th word they
    share has at most k + n - need words of its set up to it: those with k up to the bound are in both prefixes.
    Words are told apart by 15 bits here; words that collide only add to the count.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("_h"))
    small = F.transform("prefix", lambda t: t.bitwiseAND(F.lit(32767)).cast("short"))
    short = _picked(sets, F.col("key"), asked).select("key", "size", small.alias("p"))
    left, right = (short.select(*[F.col(c).alias(c + x) for c in short.columns]) for x in ("_a", "_b"))
    met = pairs.join(left, F.col("a") == F.col("key_a")).join(right, F.col("b") == F.col("key_b"))
    need = F.expr("(4 * (size_a + size_b) + 8) div 9")
    bound = F.least(F.size("p_a") - F.col("size_a"), F.size("p_b") - F.col("size_b")) + need
    return met.filter(F.size("p_a") - F.size(F.array_except("p_a", "p_b")) >= bound).select("a", "b")


def _similar(ta: Column, tb: Column) -> Column:
    shared = F.size(F.array_intersect(ta, tb))
    return 9 * shared >= 4 * (F.size(ta) + F.size(tb))


def _crowd_matches(crowds: DataFrame, words: DataFrame) -> DataFrame:
    """``key, near, n_links`` of the sets of crowds among their crowd, a row for each block that a set meets."""
    blocks = crowds.groupBy("crowd").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    own = crowds.join(blocks, "crowd").select("key", "crowd", "blocks", F.expr("pmod(key, blocks)").cast("int").alias("block"))
    own = own.join(words, "key")
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    one = F.struct("key", "block", "first", "bitmap", "tokens")
    met = met.groupBy("crowd", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    met = met.agg(F.collect_list(one).alias("sets"))

    # Sets of a crowd have most words in common, so what each lacks of one of them, and has besides it, is compared.
    base = F.col("sets")[0]["tokens"]
    unlike = lambda s: F.struct(
        *[s[c].alias(c) for c in ("key", "block", "first", "bitmap")],
        F.size(s["tokens"]).alias("size"),
        F.array_except(F.col("base"), s["tokens"]).alias("lacks"),
        F.array_except(s["tokens"], F.col("base")).alias("more"),
    )
    met = met.select("lo", "hi", "sets", base.alias("base"))
    met = met.select("lo", "hi", F.size("base").alias("n"), F.transform("sets", unlike).alias("sets"))

    def alike(x: Column, y: Column) -> Column:
        length = (4 * x["size"] <= 5 * y["size"]) & (4 * y["size"] <= 5 * x["size"])
        apart = 9 * F.bit_count(x["bitmap"].bitwiseXOR(y["bitmap"])) <= x["size"] + y["size"]
        here = (F.col("lo") == F.col("hi")) | (x["block"] != y["block"])
        both_lack = F.size(F.array_intersect(x["lacks"], y["lacks"]))
        shared = F.col("n") - F.size(x["lacks"]) - F.size(y["lacks"]) + both_lack + F.size(F.array_intersect(x["more"], y["more"]))
        return here & (x["key"] != y["key"]) & length & apart & (9 * shared >= 4 * (x["size"] + y["size"]))

    firsts = lambda x: F.transform(F.filter("sets", lambda y: alike(x, y)), lambda y: y["first"])
    each = met.select(F.explode(F.transform("sets", lambda x: F.struct(x["key"].alias("key"), firsts(x).alias("f")))).alias("x"))
    counted = each.select("x.key", F.array_min("x.f").alias("near"), F.size("x.f").cast("long").alias("n_links"))
    return counted.filter("n_links > 0")


def _line_sets(lines: DataFrame) -> DataFrame:
    """One row per different set: ``key, size, bitmap, high, prefix`` and its ``first`` place."""
    # The first of each task's lines are found before the shuffle, so many equal lines don't meet in one task.
    earliest = Window.partitionBy("key").orderBy(F.col("_id").isNull(), "_id", "_doc", "_no")
    kept = lines.withColumn("_rank", F.row_number().over(earliest)).filter("_rank = 1")
    return materialize(kept.select("key", "size", "bitmap", "high", "prefix", _place().alias("first")), "line-sets")


def _near(docs: DataFrame, sets: DataFrame, classes: list[int]) -> DataFrame:
    """``key, near, n_links`` of each set that matches others: the earliest place and the number of those."""
    crowds = _crowds(sets)
    pairs = materialize(_candidates(sets, crowds), "line-pairs")
    pairs = materialize(_prefixes_agree(pairs, sets), "line-pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("_h")).union(crowds.select("key"))
    asked = materialize(_picked(sets, F.col("key"), asked).select("key", "first", "bitmap"), "lines-asked")
    # The line at a set's first place is fetched; of others that come along, most have keys that nothing asked for.
    place = lambda *at: F.xxhash64(*[F.coalesce(c, F.lit(0)) for c in at])
    wanted = asked.select(place(F.col("first.id"), F.col("first.doc"), F.col("first.no")).alias("_h"))
    fetched = _picked(_lines(docs), place(F.col("_id"), F.col("_doc"), F.col("_no")), wanted)
    tokens = _with_tokens(fetched, classes)
    tokens = tokens.select(F.xxhash64("tokens").alias("key"), "tokens")
    tokens = _picked(tokens, F.col("key"), asked.select(F.col("key").alias("_h")))
    tokens = tokens.groupBy("key").agg(F.first("tokens").alias("tokens"))
    told = materialize(asked.join(tokens, "key"), "line-tokens")
    left = told.select(F.col("key").alias("a"), F.col("tokens").alias("ta"), F.col("first").alias("fa"))
    right = told.select(F.col("key").alias("b"), F.col("tokens").alias("tb"), F.col("first").alias("fb"))
    links = pairs.join(left, "a").join(right, "b").filter(_similar(F.col("ta"), F.col("tb")))
    two = F.array(*[F.struct(F.col(k).alias("key"), F.col(f).alias("near")) for k, f in (("a", "fb"), ("b", "fa"))])
    both = links.select(F.explode(two).alias("x")).select("x.key", "x.near", F.lit(1).cast("long").alias("n_links"))
    both = both.union(_crowd_matches(crowds, told))
    return materialize(both.groupBy("key").agg(F.min("near").alias("near"), F.sum("n_links").alias("n_links")), "near")


def judge_lines(docs: DataFrame) -> DataFrame:
    """One row per line that has a word: ``_id, _doc, _no, removed, n_links``.

    ``n_links`` counts the different word sets, among all lines of the corpus, that match the line's own
    and are not equal to it. ``removed`` is true if an earlier line matches. Lines are ordered by document
    id (null last), text hash and line number. Rows equal in id and text are one document: they get equal
    verdicts and do not remove each other's lines.
    """
    docs = docs.select("doc_id", "text")
    classes = _frequency_classes(_lines(docs))
    lines = materialize(_line_rows(docs, classes), "lines")
    sets = _line_sets(lines)
    verdict = sets.select("key", "first").join(_near(docs, sets, classes), "key", "left")
    verdict = verdict.select("key", F.least("first", "near").alias("earliest"), "n_links")
    own = lines.select("_id", "_doc", "_no", "key").join(verdict, "key")
    return own.select(
        "_id",
        "_doc",
        "_no",
        (_place() > F.col("earliest")).alias("removed"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def line_digest(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_lines`` (with a word), ``n_removed, n_links, removed`` (numbers of the
    removed lines from 0, comma-joined).

    Null, empty and blank texts have no lines. An empty table gives no rows; repeated rows stay; other
    columns are ignored.
    """
    judged = judge_lines(docs)
    # Equal rows and lines of a document meet in one shuffle. 64 lines make one number: sums of numbers are
    # cheaper than lists.
    judged = judged.repartition("_id", "_doc").dropDuplicates(["_id", "_doc", "_no"])
    part = judged.groupBy("_id", "_doc", F.shiftright("_no", 6).alias("part")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if("removed").alias("n_removed"),
        F.sum("n_links").alias("n_links"),
        F.bit_or(F.when(F.col("removed"), _bit(F.col("_no").bitwiseAND(63)))).alias("bits"),
    )
    gone = F.collect_list(F.when(F.col("n_removed") > 0, F.struct("part", "bits")))
    found = part.groupBy("_id", "_doc").agg(
        *[F.sum(c).alias(c) for c in ("n_lines", "n_removed", "n_links")], F.sort_array(gone).alias("gone")
    )
    numbers = F.expr(
        "flatten(transform(gone, g -> transform(filter(sequence(0, 63), i -> getbit(g.bits, i) = 1), i -> 64 * g.part + i)))"
    )
    found = found.withColumn("removed", F.array_join(numbers, ",")).drop("gone")
    found = materialize(found, "documents-judged")
    own = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_own"))
    joined = own.join(found, own["doc_id"].eqNullSafe(found["_id"]) & (own["_own"] == found["_doc"]), "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id",
        *[F.coalesce(c, zero).alias(c) for c in ("n_lines", "n_removed", "n_links")],
        F.coalesce("removed", F.lit("")).alias("removed"),
    )


@keeps_other_columns
def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed lines taken out of the text. Lines without a word stay. Columns and rows
    stay as they are; a null text stays null."""
    judged = judge_lines(docs).filter("removed")
    gone = judged.groupBy("_id", "_doc").agg(F.collect_set("_no").alias("_gone"))
    gone = materialize(gone, "lines-removed")
    keyed = docs.withColumn("_own", F.coalesce(F.xxhash64("text"), F.lit(0)))
    joined = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["_id"]) & (keyed["_own"] == gone["_doc"]), "left")
    split = F.split("text", "\n")
    left = F.filter(split, lambda line, i: ~F.array_contains("_gone", i))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.withColumn("text", text).select(*[column(joined, c) if c != "text" else F.col("text") for c in docs.columns])


#: The digest in SQL: the same join on exact document frequencies.
DIGEST_SQL = rf"""
WITH lines AS MATERIALIZED (
    SELECT doc_id, u.no - 1 AS no, list_distinct(list_filter(regexp_split_to_array(lower(u.line), '{_SPACE}'),
        lambda x: x <> '')) AS words
    FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, no)
), full_lines AS MATERIALIZED (
    SELECT doc_id, no, list_sort(words) AS words FROM lines WHERE len(words) > 0
), sets AS MATERIALIZED (
    SELECT row_number() OVER () AS id, words, len(words) AS n, first FROM (
        SELECT words, min((doc_id, no)) AS first FROM full_lines GROUP BY words)
), tokens AS (
    SELECT id, n, unnest(words) AS word FROM sets
), ranked AS (
    SELECT id, n, word, row_number() OVER (PARTITION BY id ORDER BY f, word) AS place
    FROM tokens JOIN (SELECT word, count(*) AS f FROM tokens GROUP BY word) USING (word)
), prefixes AS MATERIALIZED (
    SELECT id, n, word FROM ranked WHERE place <= n - ceil(n * 4 / 5.0) + 1
), pairs AS MATERIALIZED (
    SELECT DISTINCT x.id AS a, y.id AS b FROM prefixes x JOIN prefixes y
    ON x.word = y.word AND x.id <> y.id AND 4 * x.n <= 5 * y.n AND 4 * y.n <= 5 * x.n
), links AS MATERIALIZED (
    SELECT a, b FROM (
        SELECT a, b, s.n AS n, t.n AS m, len(list_intersect(s.words, t.words)) AS c
        FROM pairs JOIN sets s ON s.id = a JOIN sets t ON t.id = b)
    WHERE 5 * c >= 4 * (n + m - c)
), verdict AS (
    SELECT s.words, min(least(s.first, coalesce(t.first, s.first))) AS earliest, count(b) AS n_links
    FROM sets s LEFT JOIN links ON a = s.id LEFT JOIN sets t ON t.id = b GROUP BY s.id, s.words
), judged AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE (doc_id, no) > earliest) AS n_removed,
        sum(n_links)::BIGINT AS n_links,
        string_agg(no::VARCHAR, ',' ORDER BY no) FILTER (WHERE (doc_id, no) > earliest) AS removed
    FROM full_lines JOIN verdict USING (words) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
    coalesce(n_links, 0) AS n_links, coalesce(removed, '') AS removed
FROM documents LEFT JOIN judged USING (doc_id)
"""
