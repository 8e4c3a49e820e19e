"""The training-data operators against brute force, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from rowforge.llm import curriculum, decontaminate, language, line_dedup, pii, quality_rules, sharding, simhash, toxicity
from rowforge.llm.catalogue import ORACLES, QUERIES
from rowforge.llm.co_training import co_training_digest
from rowforge.llm.common import fold_of
from rowforge.llm.components import components

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, slot string, hash string"
WORDS = [a + b for a in "ba ke li mo nu pa re si to vu".split() for b in "ran tel min dor fas".split()]


def prose(seed, n=60):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) for _ in range(n))


def near(text, seed):
    words = text.split()
    words[seed % len(words)] = "changed"
    return " ".join(words)


ITEM = prose(900, 14)


def rows():
    base = [prose(i) for i in range(6)]
    texts = [
        *base,
        base[0],
        near(base[1], 30),
        near(base[1], 7),
        None,
        "",
        " \t\n",
        "one",
        "two words",
        base[2].upper(),
        f"{prose(50, 20)} {ITEM.upper()}, {prose(51, 20)}",
        "\n".join([base[3], "same line here again", "same line here again", base[4]]),
        " ".join(prose(i, 500) for i in range(100, 140)),
        "éàü ŝ 漢字 😀 mail a.b@c.example.org or +1 (555) 010-2030, 10.0.0.255 and 4111 1111 1111 1111.",
        "idiot " + prose(60),
    ]
    out = [(i, t, "en" if i % 3 else "de", f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    out += [out[0], out[0], (None, base[5], None, None, None), (None, None, None, None, None)]
    return [(*r, "x", "y", "z", "w") for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    marked = [(i, int(i not in (10, 11, 12)), int(i == 19)) for i in range(20)]
    return spark.createDataFrame([*marked, (None, 1, 1), (3, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(1, ITEM), (2, "two words"), (3, None), (4, ""), (None, "Changed"), (1, ITEM), (5, prose(999, 30))]
    return spark.createDataFrame(items, "item_id long, text string")


def shingle_print(text, size):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(n, linked):
    parent = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    return parent


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark):
    made = QUERIES[name](spark, SMALL)
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    expected = con.execute(ORACLES[name])
    columns = sorted(c[0] for c in expected.description)
    assert sorted(made.columns) == columns
    order = [[c[0] for c in expected.description].index(c) for c in columns]
    wanted = sorted(str([r[i] for i in order]).replace("-0.0", "0.0") for r in expected.fetchall())
    assert sorted(str([r[c] for c in columns]).replace("-0.0", "0.0") for r in made.collect()) == wanted


def test_components(spark):
    pick = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(pick.randrange(50, 90), pick.randrange(50, 90)) for _ in range(25)]
    edges += [(100, x) for x in range(101, 160)] + [(7, 7)]
    nodes = sorted({x for e in edges for x in e})
    linked = {frozenset(e) for e in edges}
    parent = groups_of(len(nodes), lambda i, j: frozenset((nodes[i], nodes[j])) in linked)
    made = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert made == {n: nodes[p] for n, p in zip(nodes, parent, strict=True)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("shard", [8, 4096])
def test_links_equal_all_pairs(spark, shard):
    pick = random.Random(shard)
    prints = {pick.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:40]:
        for _ in range(6):
            p ^= 1 << pick.randrange(64)
            prints.add(p)
    dense = pick.getrandbits(64)
    prints |= {dense ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    values = sorted(p - (p >> 63 << 64) for p in prints)
    frame = spark.createDataFrame([(v, v) for v in values], "id long, fp long").repartition(3)
    found = components(simhash.link_fingerprints(frame, 3, shard)).collect()
    bits = np.array(values, dtype=np.int64).view(np.uint64)
    close = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3
    parent = groups_of(len(values), lambda i, j: close[i, j])
    expected = {values[i]: values[p] for i, p in enumerate(parent) if parent.count(p) > 1}
    assert {r["node"]: r["component"] for r in found} == expected


def test_near_duplicates(docs, empty):
    made = simhash.near_duplicates(docs.select("doc_id", "text", "size"))
    texts = [(r[0], r[1]) for r in rows()]
    prints = [shingle_print(t, 3) for _, t in texts]
    parent = groups_of(len(texts), lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 3)
    expected = []
    for i, (doc_id, _) in enumerate(texts):
        ids = [texts[j][0] for j in range(len(texts)) if parent[j] == parent[i] and texts[j][0] is not None]
        expected.append((doc_id, f"{prints[i]:016x}", min(ids) if ids else None))
    assert sorted(map(str, expected)) == sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in made.collect())
    assert made.columns == ["doc_id", "size", "fingerprint", "component_id"]
    assert simhash.near_duplicates(empty).count() == 0


def test_drop_near_duplicates(docs, empty):
    made = simhash.drop_near_duplicates(docs)
    texts = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows()}, key=str)
    prints = [shingle_print(t, 3) for _, _, t in texts]
    parent = groups_of(len(texts), lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 3)
    best = [min((t for t, p in zip(texts, parent, strict=True) if p == g), key=lambda t: t[:2]) for g in set(parent)]
    assert made.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in made.collect()) == sorted("None" if b[0] else str(b[1]) for b in best)
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_pipeline_keeps_one_document_of_each_group(spark, docs, empty):
    """The pipeline's stage against all pairs of fingerprints: copies with a few edited words, a large group, text ids."""
    pick = random.Random(5)
    made = [(None if r[0] is None else f"d{r[0]:05}", *r[1:5]) for r in rows()]
    for base in range(30):
        text = prose(2000 + base, pick.choice((60, 150, 400, 2000)))
        made.append((f"d{1000 + 10 * base}", text, "en", "s", len(text)))
        for copy in range(1, 4):
            text = near(text, pick.randrange(10_000))
            made.append((f"d{1000 + 10 * base + copy}", text, "en", "s", len(text)))
    center = prose(3000, 2000)
    made += [(f"d{50000 + i}", near(center, 3 * i), "en", "s", 0) for i in range(60)]
    frame = spark.createDataFrame(made, "doc_id string, text string, lang string, source string, n_chars long")
    texts = sorted({(r[0] is None, r[0] or "", r[1]) for r in made}, key=str)
    prints = [shingle_print(t, 3) for _, _, t in texts]
    parent = groups_of(len(texts), lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 3)
    assert len(set(parent)) < len(texts) - 20
    best = [min((t for t, p in zip(texts, parent, strict=True) if p == g), key=lambda t: t[:2]) for g in set(parent)]
    kept = corpus_pipeline.near_dedup(spark, frame.repartition(3), "")
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted("None" if b[0] else b[1] for b in best)
    assert corpus_pipeline.near_dedup(spark, empty, "").count() == 0


def contamination(text, items):
    words = [w.decode() for w in decontaminate.words_of(text)]
    hit, names = set(), set()
    for name, body in items:
        item = [w.decode() for w in decontaminate.words_of(body)]
        n = min(10, len(item))
        for i in range(len(item) - n + 1 if n else 0):
            for s in range(len(words) - n + 1):
                if words[s : s + n] == item[i : i + n]:
                    hit.update(range(s, s + n))
                    names.add(name)
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_contamination(docs, empty, benchmark):
    items = [("" if r[0] is None else str(r[0]), r[1]) for r in benchmark.collect()]
    expected = sorted(str((r[0], *contamination(r[1], items))) for r in rows())
    found = decontaminate.find_contamination(docs, benchmark)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(str(tuple(r[c] for c in columns)) for r in found.collect()) == expected
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(
        str(r[0]) for r in rows() if not contamination(r[1], items)[4]
    )
    assert decontaminate.find_contamination(empty, benchmark).count() == 0
    none = decontaminate.find_contamination(docs, benchmark.limit(0))
    assert none.filter("contaminated").count() == 0 and none.count() == len(rows())


def near_names(text, items):
    words, names = decontaminate.words_of(text), set()
    for name, body in items:
        item = decontaminate.words_of(body)
        n = min(10, len(item))
        for i in range(len(item) - n + 1 if n else 0):
            wanted = set(item[i : i + n])
            if any(wanted <= set(words[s : s + n + decontaminate.SLACK]) for s in range(len(words))):
                names.add(name)
    return sorted(names)


def test_proximity(spark, docs, empty, benchmark):
    rare = [f"w{i}" for i in range(30)]
    items = [("long", " ".join(rare)), ("short", "w3 w9 w9"), ("one", "solo"), ("same", "x x x x x x x x x x x"), (None, None)]
    spread = [rare[i : i + 10] for i in range(0, 20, 5)]
    texts = [
        " ".join(reversed(rare[5:16])),
        "a b " + " pad ".join([" ".join(spread[1][:4]), *spread[1][4:8], " ".join(spread[1][8:])]) + " end",
        " pad pad ".join(spread[2]),
        "filler " * 47 + " ".join(sorted(spread[3])) + " filler" * 30,
        "w9 w3",
        "w9 a b c d e f g w3 solo",
        " ".join(rare[:9]),
        "x",
        "",
        None,
    ]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = decontaminate.find_contamination(made, spark.createDataFrame(items, "item_id string, text string"), True)
    got = {r["doc_id"]: r["near_items"] for r in found.collect()}
    assert got == {i: near_names(t, [x for x in items if x[1]]) for i, t in enumerate(texts)}
    assert got[0] == got[1] == got[3] == ["long"] and got[2] == [] and got[4] == ["short"]
    known = [("" if r[0] is None else str(r[0]), r[1]) for r in benchmark.collect()]
    whole = decontaminate.find_contamination(docs, benchmark, True)
    expected = sorted(str((r[0], near_names(r[1], known))) for r in rows())
    assert sorted(str((r["doc_id"], r["near_items"])) for r in whole.collect()) == expected
    assert all(set(r["items"]) <= set(r["near_items"]) for r in whole.collect())
    assert decontaminate.find_contamination(empty, benchmark, True).count() == 0


def test_contamination_words():
    assert decontaminate.words_of("A-B_c\x7fÉ9\x00z") == [b"a", b"b", b"c", "É9".encode(), b"z"]


def sets_of(text):
    return [frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w) for line in text.split("\n")]


def test_lines(docs, empty):
    seen = {(r[0], r[1]) for r in rows() if r[1] is not None}
    order = {(r["doc_id"], r["text"]): r["h"] for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    lines = []
    for key in seen:
        for no, words in enumerate(sets_of(key[1])):
            if words:
                lines.append(((key[0] is None, key[0] or 0, order[key], no), key, words))
    similar = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    expected = {}
    for place, key, words in lines:
        gone = any(p < place and similar(words, w) for p, _, w in lines)
        links = len({w for _, _, w in lines if w != words and similar(words, w)})
        expected.setdefault(key, []).append((place[3], gone, links))
    wanted = []
    for r in rows():
        own = expected.get((r[0], r[1]), [])
        removed = sorted(no for no, gone, _ in own if gone)
        wanted.append(str((r[0], len(own), len(removed), sum(x[2] for x in own), ",".join(map(str, removed)))))
    made = line_dedup.line_digest(docs)
    assert sorted(str(tuple(r)) for r in made.collect()) == sorted(wanted)
    assert line_dedup.line_digest(empty).count() == 0
    cleaned = line_dedup.dedup_lines(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows())
    text = next(r["text"] for r in cleaned.collect() if r["doc_id"] == 16)
    assert text.split("\n") == ["same line here again"]


def test_no_python_on_native_paths(docs):
    for frame in (line_dedup.line_digest(docs), curriculum.mix_digest(docs), curriculum.mix_documents(docs)):
        assert not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().executedPlan().toString())


def test_language(spark, docs, empty):
    texts = {"aa": "lamo rito sumi ", "bb": "kret stolb gvint ", "cc": "éaùx öéü ñàç "}
    pick = random.Random(1)
    made = [(i, "".join(pick.choice(texts[k].split()) + " " for _ in range(40)), k) for i, k in enumerate(list(texts) * 20)]
    made += [(None, "lamo rito", "aa"), (500, None, "bb"), (501, "12 34 !!", "bb"), (502, "kret stolb", None), (7, made[7][1], made[7][2])]
    frame = spark.createDataFrame(made, "doc_id long, text string, lang string")
    profiles = language.learn_profiles(frame, fold_of(frame["doc_id"], 5) != 0)
    found = language.identify_language(frame, profiles).collect()
    for r in found:
        text = next(t for i, t, _ in made if i == r["doc_id"])
        blank = not any(c.isalpha() for c in text or "")
        assert (r["lang_pred"] == "und") == blank and 0 <= r["score"] <= 1
        if not blank:
            assert r["lang_pred"] == next(k for k, v in texts.items() if text.split()[0] in v.split())
    assert len(found) == len(made)
    assert language.identify_language(empty, profiles).count() == 0
    untaught = language.learn_profiles(frame, F.lit(False))
    assert {r["lang_pred"] for r in language.identify_language(frame, untaught).collect()} == {"und"}
    assert language.identify_language(docs, profiles).count() == len(rows())


def test_language_ranks_equal_counting():
    text = "Ab ba, abba Ünlü 漢"
    words = re.findall(r"[^\W\d_]+", text.lower())
    seen = {}
    for w in words:
        marked = f"\0{w}\0"
        for n in (1, 2, 3):
            for i in range(len(marked) - n + 1):
                gram = marked[i : i + n]
                if gram.strip("\0") and not (n == 1 and gram == "\0"):
                    seen[gram] = seen.get(gram, 0) + 1
    owner, gram, place = language.ranked([None, text, "..."])
    assert set(owner) == {1} and len(gram) == len(seen) and list(place) == list(range(len(seen)))

    def name(code):
        points = [code >> s & 0x1FFFFF for s in (42, 21, 0)]
        return "".join(chr(p) for p in points if p != 0x1FFFFF)

    counts = [seen[name(int(g))] for g in gram]
    assert counts == sorted(seen.values(), reverse=True)


def test_mix(docs, empty):
    plan = curriculum.plan_mix(docs).collect()
    assert len(plan) == len(rows())
    sizes, weights = {}, (5, 2, 1)
    for r in rows():
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    left, targets, open_ = 1.5 * sum(sizes.values()), {}, list(order)
    while True:
        unit = left / max(1, sum(weights[order.index(s) % 3] for s in open_))
        full = [s for s in open_ if unit * weights[order.index(s) % 3] >= 2 * sizes[s]]
        if not full:
            break
        for s in full:
            targets[s] = 2.0 * sizes[s]
            left -= targets[s]
            open_.remove(s)
    targets |= {s: unit * weights[order.index(s) % 3] for s in open_}
    taken = {}
    for r in plan:
        assert r["target"] == pytest.approx(targets[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - targets[s]) < 1 + 1e-6 for s in order)
    again = curriculum.plan_mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, plan))
    mixed = curriculum.mix_documents(docs)
    words = {}
    for r in mixed.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    longest = max(r["size"] for r in plan)
    assert mixed.columns == docs.columns
    assert all(abs(words.get(s, 0) - n) * 2 <= longest for s, n in taken.items())
    whole = {r[1] for r in rows()}
    assert all(r["text"] in whole for r in mixed.collect())
    assert curriculum.plan_mix(empty).count() == 0 and curriculum.mix_documents(empty).count() == 0


def test_mix_digest_reads_the_sorted_mix(docs, empty, monkeypatch):
    seen = []

    def sequence(plan, *columns, _sort=curriculum.mix_sequence):
        seen.append(_sort(plan, *columns))
        return seen[-1]

    monkeypatch.setattr(curriculum, "mix_sequence", sequence)
    digest = curriculum.mix_digest(docs).collect()
    copies = sorted(seen[0].collect(), key=lambda r: r["_place"])
    copies = [r for r in copies if r["t"] is not None]
    assert all(r["_place"] > copies[-1]["_place"] for r in seen[0].filter("n IS NULL").collect())
    times = [r["t"] for r in copies]
    assert times == sorted(times) and len({r["_place"] for r in copies}) == len(copies) > 0
    first, words = {}, {}
    for r in copies:
        first.setdefault(r["_row"], r["t"])
        words[r["_row"]] = words.get(r["_row"], 0) + r["n"]
    assert len(digest) == len(rows())
    assert sorted(r["taken"] for r in digest if r["taken"]) == sorted(words.values())
    assert sorted(r["first_position"] for r in digest if r["taken"]) == sorted(first.values())
    assert all(r["first_position"] is None for r in digest if not r["taken"])
    plan = curriculum.plan_mix(docs).selectExpr("doc_id", "size", "source_size", "target", "taken", "position_0")
    assert sorted(map(tuple, digest), key=str) == sorted(map(tuple, plan.collect()), key=str)
    assert curriculum.mix_digest(empty).count() == 0


def test_moments_invert_demand(spark):
    frame = spark.range(0, 101).select((F.col("id") / 100).alias("x"))
    for begin, end in curriculum.RAMPS:
        moment = curriculum._moment(F.col("x"), F.lit(begin), F.lit(end))
        for r in frame.withColumn("t", moment).collect():
            area = (begin * r["t"] + (end - begin) * r["t"] ** 2 / 2) / ((begin + end) / 2)
            assert area == pytest.approx(r["x"], abs=1e-9)


def test_permutation_round_trip():
    for size in (1, 2, 3, 17, 1000, 4097):
        keyed = sharding.Permutation(size, 5)
        images = keyed.forward(np.arange(size))
        assert sorted(images) == list(range(size)) and list(keyed.backward(images)) == list(range(size))
    shard, slot = sharding.place_of(37, 1000, 16, 3)
    assert sharding.row_at(shard, slot, 1000, 16, 3) == 37


def test_sharding(docs, empty):
    made = sharding.shard_digest(docs).collect()
    assert len(made) == len(rows())
    by_shard = {}
    for r in made:
        assert (r["shard"], r["slot"]) == sharding.place_of(r["row_number"], len(made), 16)
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    counts = [len(by_shard.get(s, [])) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    expected = sorted(str((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()))) for r in rows())
    assert sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in made) == expected
    again = sharding.shard_digest(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, made))
    whole = sharding.shard_documents(docs)
    assert whole.count() == len(rows()) and set(docs.columns) - {"slot"} <= set(whole.columns)
    assert sharding.shard_digest(empty).count() == 0


def test_toxicity(spark, docs, empty, labels):
    pick = random.Random(2)
    made = []
    for i in range(600):
        a, b = pick.random() < 0.3, pick.random() < 0.3
        words = prose(i, 30).split() + ["insultword"] * a + ["groupword"] * b
        made.append((i, " ".join(words), int(a and b)))
    frame = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string")
    marked = spark.createDataFrame([(m[0], m[2]) for m in made], "doc_id long, toxic int")
    found = toxicity.toxicity_digest(frame, marked).collect()
    truth = {m[0]: m[2] for m in made}
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    # Neither word alone is toxic: only the pair is.
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    odd = toxicity.score_toxicity(docs, toxicity.learn_toxicity(frame, marked)).collect()
    assert len(odd) == len(rows()) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.toxicity_digest(docs, labels.limit(0)).count() == len(rows())
    assert toxicity.toxicity_digest(empty, labels).count() == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns


def test_toxicity_digest_ignores_held_out_labels(spark):
    frame = spark.createDataFrame([(i, prose(i, 20) + " bad" * (i % 2)) for i in range(120)], "doc_id long, text string")
    marked = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    flipped = marked.withColumn("toxic", F.when(fold_of(F.col("doc_id"), 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = (sorted(map(tuple, toxicity.toxicity_digest(frame, x).collect())) for x in (marked, flipped))
    assert first == second


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    inside = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, dup, len(inside), len(words) < 50 or 100 * len(inside) > 50 * len(words)


def test_quality_rules(docs, empty, labels):
    made = quality_rules.quality_digest(docs, labels)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    found = made.collect()
    assert sorted(str(tuple(r[c] for c in columns)) for r in found) == sorted(str((r[0], *counted(r[1]))) for r in rows())
    assert not any(r["kept"] and r["base_failed"] for r in found)
    assert quality_rules.quality_digest(empty, labels).count() == 0
    assert quality_rules.quality_digest(docs, labels.limit(0)).count() == len(rows())


def test_repeated_words():
    for text in ("a b c a b c", "a a a a", "a b c d", "x a b c y a b c z", "a b a b a"):
        seen = {}
        numbers = np.array([seen.setdefault(w, len(seen)) for w in text.split()])
        assert quality_rules.repeated_words(numbers) == counted(text)[4]
        assert quality_rules.repeated_words(numbers + (1 << 22)) == counted(text)[4]


def test_learned_quality(spark):
    good = [(i, prose(i, 80), "en", f"s{i % 3}", 400) for i in range(200)]
    bad = [(1000 + i, " ".join(w + "%%%" for w in prose(i, 80).split()), "en", "s9", 700) for i in range(100)]
    frame = spark.createDataFrame([*good, *bad], "doc_id long, text string, lang string, source string, n_chars long")
    marked = spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in [*good, *bad] if r[0] % 2], "doc_id long, quality int")
    kept = quality_rules.judge_quality(frame, quality_rules.learn_quality(frame, marked)).collect()
    assert sum((r["probability"] >= 0.5) == (r["doc_id"] < 1000) for r in kept) >= 297
    scored = co_training_digest(frame, marked).collect()
    assert sum(r["kept"] == (r["doc_id"] < 1000) for r in scored) >= 297
    assert all(0 <= r[c] <= 1 for r in scored for c in ("score", "p_text", "p_meta"))


def test_co_training_edges(docs, empty, labels):
    assert co_training_digest(docs, labels).count() == len(rows())
    assert co_training_digest(docs, labels.limit(0)).count() == len(rows())
    assert co_training_digest(empty, labels).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_equal_plain_patterns():
    pick = random.Random(6)
    alphabet = ["1", "4", "25", "256", ".", ".", "-", " ", "+", "@", "@", "a", "b.c", "(", ")", "4111111111111111", "é", "_", "%", "\n"]
    for _ in range(4000):
        text = "".join(pick.choice(alphabet) for _ in range(pick.randrange(1, 40)))
        made = [(pii.KINDS[k], s, e) for k, spans in enumerate(pii.base_spans(text)) for s, e in spans]
        assert made == plain_spans(text), text


def test_long_texts_take_linear_time():
    for piece in ("a" * 300_000, "1" * 300_000, "a@" * 150_000, "+1" * 150_000, "1.1." * 75_000, "(" * 300_000):
        base = pii.base_spans(piece)
        pii.candidates(piece, base)


def test_personal_data(spark, docs, empty):
    made = pii.pii_digest(docs).collect()
    assert len(made) == len(rows())
    for r in made:
        text = next(t for i, t, *_ in rows() if i == r["doc_id"]) if r["doc_id"] is not None else None
        if r["doc_id"] is not None:
            spans = plain_spans(text or "")
            listed = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
            assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
            assert [r[f"n_{k}"] for k in PATTERNS] == [sum(x[0] == k for x in spans) for k in PATTERNS]
            assert set(listed.split(",")) <= set(r["spans"].split(",")) or not listed
    assert pii.pii_digest(empty).count() == 0
    texts = [f"{prose(i, 8)} mail joe{i}@site{i}.org or call +1 (555) 010-{1000 + i} now" for i in range(60)]
    texts += [f"{prose(i, 8)} version 12-345-67{i:02d} section {i}.{i}" for i in range(60)]
    texts += ["write to joe (at) site (dot) org today", "phone (555) 010-2030 please"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.pii_digest(frame).collect()}
    assert found[120].startswith("email:") and found[121].startswith("phone:")
    assert all(not found[i] for i in range(60, 120))


def test_pipeline_stages_keep_columns(spark, docs, labels, benchmark, tmp_path):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, folder)
        assert frame.columns == docs.columns, name
        frame.write.parquet(f"{folder}/{name}")
        frame = spark.read.parquet(f"{folder}/{name}")
    assert {"shard", "slot"} <= set(corpus_pipeline.STAGES[-1][1](spark, frame, folder).columns)


def test_pipeline(spark):
    made = corpus_pipeline.run(spark, SMALL)
    assert made.count() > 0 and {"doc_id", "text", "shard", "slot"} <= set(made.columns)


def test_crowds_of_lines(spark, monkeypatch):
    """Near copies of one line by the hundred: no row for each of their pairs, and every link counted."""
    pick = random.Random(5)
    base, other = ([f"{a}{i}" for i in range(60)] for a in "ab")
    texts = [" ".join(["both"] + [w if pick.random() > 0.04 else f"n{pick.random()}" for w in line]) for line in (base, other) for _ in range(140)]
    texts += [" ".join(["both"] + [f"o{pick.randrange(300)}" for _ in range(40)]) for _ in range(60)]
    stored = {}
    keep = line_dedup.materialize

    def count(df, purpose):
        made = keep(df, purpose)
        stored[purpose] = max(stored.get(purpose, 0), made.count())
        return made

    monkeypatch.setattr(line_dedup, "materialize", count)
    monkeypatch.setattr(line_dedup, "CROWD", 20, raising=False)
    monkeypatch.setattr(line_dedup, "BLOCK", 50, raising=False)
    made = line_dedup.line_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sets = [sets_of(t)[0] for t in texts]
    similar = [[j for j, b in enumerate(sets) if 5 * len(a & b) >= 4 * len(a | b)] for a in sets]
    wanted = {(i, 1, int(min(j) < i), len({sets[x] for x in j} - {sets[i]}), "0" if min(j) < i else "") for i, j in enumerate(similar)}
    assert sum(r[3] for r in wanted) > 20_000
    assert {tuple(r) for r in made.collect()} == wanted
    assert stored["line-pairs"] < 4_000
