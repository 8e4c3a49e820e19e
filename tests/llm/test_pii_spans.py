"""Spans beyond the base: planted ones found, look-alikes left alone, and features that no labeler reads."""

import random
import string

from rowforge.llm import pii


def prose(pick, n=8):
    return " ".join("".join(pick.choices("aeiounrstl", k=pick.randint(2, 8))) for _ in range(n))


def spans_of(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = pii.find_personal_data(frame, pii.learn_spans(frame)).collect()
    return {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["found"]] for r in found}


def planted(pick):
    """Texts with the span they hold, or None for look-alikes."""
    mixed = "".join(pick.choices(string.ascii_letters + string.digits, k=36)) + "aZ7"
    code = "".join(pick.choices("0123456789abcdef", k=40))
    number = str(pick.randint(10**9, 10**10 - 1))[:9] + "7"
    street = f"{pick.randint(1, 999)} {pick.choice(('Maple', 'Old Mill', 'Harbour'))} {pick.choice(('Street', 'Road', 'Avenue'))}"
    place = f"{pick.choice(('Garten', 'Linden', 'Haupt'))}straße {pick.randint(1, 99)}"
    return [
        (f"api key: {mixed} here", ("secret", mixed)),
        (f'token = "{code}" then', ("secret", code)),
        (f"with ghp_{mixed} inside", ("secret", f"ghp_{mixed}")),
        (f"ship to {street}, Springfield 12345 now", ("address", street)),
        (f"wohnt in der {place}, 10115 Berlin", ("address", place)),
        (f"account {number} at bank", ("account", number)),
        (f"commit {code} merged", None),
        ("see the-long-name-of-a-page-about-2024-things", None),
        (f"on {pick.randint(1990, 2024)}0{pick.randint(1, 9)}15 it was", None),
        (f"order {number} shipped", None),
    ]


def test_planted_spans_and_look_alikes(spark):
    pick = random.Random(8)
    cases = [case for _ in range(40) for case in planted(pick)]
    texts = [f"{prose(pick)} {text} {prose(pick)}" for text, _ in cases]
    found = spans_of(spark, texts)
    wanted = {(i, span) for i, (_, span) in enumerate(cases) if span}
    made = {(i, span) for i, spans in found.items() for span in spans}
    assert len(wanted & made) >= 0.95 * len(wanted)
    assert len(wanted & made) >= 0.95 * len(made)


def test_features_decide_where_labelers_say_the_same(spark):
    pick = random.Random(9)
    people = [f"{prose(pick)} patient Dr. {pick.choice(('Maria', 'Peter', 'Laura'))} admitted {prose(pick)}" for _ in range(120)]
    others = [f"{prose(pick)} figure poster Dr. Snarl screened {prose(pick)}" for _ in range(120)]
    held = [f"{prose(pick, 12)} patient Dr. Alan Turing admitted", f"{prose(pick, 12)} poster Dr. Evil Laugh screened"]
    texts = people + others + held
    vote = [pii.votes(t, *next(c for c in pii.candidates(t, pii.base_spans(t))), False) for t in held]
    assert vote[0] == vote[1]
    found = spans_of(spark, texts)
    assert found[240] == [("name", "Dr. Alan Turing")] and found[241] == []


def test_spans_of_long_tokens_take_linear_time():
    for piece in ("a1" * 200_000, "1 A" * 100_000, "Astraße " * 50_000, "12345678 " * 40_000, "1 Aa Bb Cc " * 40_000):
        for kind, start, end in pii.candidates(piece, pii.base_spans(piece))[:50]:
            pii.features(piece, kind, start, end)
