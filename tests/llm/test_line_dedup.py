"""Lines that match at the very bounds of the sizes, odd white space, long documents, and what the join passes on."""

import random

from rowforge.llm import line_dedup

SCHEMA = "doc_id long, text string"


def digest(spark, texts):
    made = line_dedup.line_digest(spark.createDataFrame(list(enumerate(texts)), SCHEMA))
    return {r["doc_id"]: (r["n_lines"], r["n_removed"], r["n_links"], r["removed"]) for r in made.collect()}


def test_sizes_at_the_bound_match(spark):
    sizes = [*range(4, 90), 99, 100, 101, 127, 128, 160, 256, 500]
    texts = []
    for n in sizes:
        most = 5 * n // 4
        own, more, other = ([f"{x}{n}_{i}" for i in range(k)] for x, k in (("w", n), ("m", most - n), ("o", most + 1 - n)))
        texts.append("\n".join(" ".join(x) for x in (own, own[::-1] + more, other + own)))
    found = digest(spark, texts)
    # A size of n matches n words among 5 n / 4, and misses them among one more.
    for i, n in enumerate(sizes):
        assert found[i] == ((3, 1, 2, "1") if 5 * n // 4 > n else (3, 1, 0, "1")), n


def test_words_are_split_at_all_white_space(spark):
    same = ["Alpha beta gamma", "gamma\tALPHA  beta ", "beta\x0bgamma\x0calpha\r", " alpha beta\t \tgamma gamma"]
    assert digest(spark, ["\n".join(same), "\t\n\x0b \r\n\nalpha beta gamma"]) == {0: (4, 3, 0, "1,2,3"), 1: (1, 0, 0, "")}


def test_many_lines_of_a_document_are_listed(spark):
    pick = random.Random(3)
    lines = [f"line number {pick.randrange(150)}" for _ in range(400)]
    gone = [i for i, line in enumerate(lines) if line in lines[:i]]
    assert digest(spark, ["\n".join(lines)]) == {0: (400, len(gone), 0, ",".join(map(str, gone)))}


def test_long_unlike_lines_make_no_pairs(spark, monkeypatch):
    """A bitmap of 64 bits says nothing about lines of 150 words: most pairs of them that share a word passed it."""
    pick = random.Random(5)
    words = [f"word{i}" for i in range(600)]
    texts = [" ".join([f"rare{k // 2}", *pick.sample(words, 149)]) for k in range(60)]
    stored, keep = [], line_dedup.materialize

    def count(df, purpose="stage", *more):
        made = keep(df, purpose, *more)
        stored.extend([made.count()] if purpose == "line-pairs" else [])
        return made

    monkeypatch.setattr(line_dedup, "materialize", count)
    assert all(x == (1, 0, 0, "") for x in digest(spark, texts).values())
    assert stored and sum(stored) == 0
