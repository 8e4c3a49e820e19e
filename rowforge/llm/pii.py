"""Personal data by weak supervision.

Base patterns (email, ip, card, phone) always give spans. Looser patterns propose further candidates. Four
labelers vote on every candidate, base ones included: the pattern itself (with its check sums), a
gazetteer, the words around it, and its edges. Votes are counted by pattern over all documents, map-side
first; expectation-maximisation on these counts estimates how far each labeler can be trusted and how
likely each vote pattern is personal data. On these soft labels a span classifier is trained, which decides about
the candidates beyond the base: a logistic part on kind, votes and length, plus evidence of features that no labeler
reads (the shape of the span, the words on both sides of it that are in no list, the characters it touches). Its
counts by kind, vote pattern and hashed feature come from the same pass over all documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import column, keeps_other_columns, sigmoid

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "name", "secret", "address", "account")
BASE_KINDS = 4
THRESHOLD = 0.8
_LABELERS = 4
_LENGTHS = 4
#: Hashed features of a kind, rows of background that smooth their shares, and the most they may say together.
FEATURE_SLOTS = 512
_SMOOTH = 10.0
_MOST_EVIDENCE = 4.0

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins, so looking back changes nothing but the time taken.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Looser candidates.
_AT = re.compile(r"\s?[\[({<]\s?(?:at|AT|At)\s?[\])}>]\s?")
_BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}$")
_AFTER_AT = re.compile(
    r"[A-Za-z0-9-]{1,63}(?:(?:\.|\s?[\[({<]\s?(?:dot|DOT|Dot)\s?[\])}>]\s?)[A-Za-z0-9-]{1,63}){1,6}"
)
_NATIONAL = re.compile(r"(?<![\w+.,-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])")
_IP6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")
_SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NAME = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20})?(?!\w)")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=.-])[A-Za-z0-9_+/-]{20,512}+={0,2}(?![A-Za-z0-9_+/=-])")
_STREET_FIRST = re.compile(
    r"(?<![\w.-])[A-ZÄÖÜ][a-zäöüß]{1,25}(?:stra(?:ß|ss)e|weg|platz|gasse|allee) [0-9]{1,4}[a-z]?(?!\w)"
    r"|(?<!\w)(?:Calle|Avenida|Plaza|Paseo) (?:(?:de|del|la|los|las) ){0,2}[A-ZÁÉÍÓÚÑ]\w{1,25},? [0-9]{1,4}(?!\w)"
)
_NUMBER_FIRST = re.compile(
    r"(?<![\w.,-])[0-9]{1,5}[A-Za-z]?,? (?:(?:[A-Z][\w'-]{0,20} ){1,3}"
    r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square|Way)(?!\w)"
    r"|(?:rue|avenue|boulevard|place|chemin|quai) (?:(?:de|du|des|la|le|les) ){0,2}[A-ZÀÂÉÈ][\w'-]{1,25})"
)
_ACCOUNT = re.compile(r"(?<![\w.,+-])[0-9]{8,17}(?![\w-])")
_POSTCODE = re.compile(r"(?<!\w)(?:[0-9]{4,5}|[A-Z]{1,2}[0-9][0-9A-Z]? [0-9][A-Z]{2})(?!\w)")
_DAY = re.compile(r"(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])")
_HEX = re.compile(r"[0-9a-f-]+|[0-9A-F-]+")

# Gazetteers.
_DOMAINS = frozenset("com org net edu gov io info biz de fr es uk it nl eu us ca ch at be ru jp cn in au br".split())
_CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47",
            "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84",
            "86", "90", "91", "92", "98")
_ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "22", "23", "24", "25", "26", "27", "35", "36")
_BANKS = frozenset("AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT SE".split())
_NAMES = frozenset(
    "James John Robert Michael William David Mary Anna Maria Linda Susan Peter Paul Thomas Hans Karl Pierre Jean "
    "Marie Juan Jose Carlos Carmen Sarah Laura".split()
)
_TOKENS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "github_pat_", "glpat-", "sk_live_", "rk_live_", "sk-", "xoxb-", "xoxp-", "AIza", "npm_", "eyJ")
_BANKING = ("bank", "routing", "iban", "swift", "bic", "sort", "blz", "transfer")
_NEAR = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "mastercard", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "dial", "cell"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "account", "bank", "konto"),
    "name": ("name", "contact", "dear", "signed"),
    "secret": ("token", "key", "secret", "password", "passwd", "bearer", "credential", "api", "auth"),
    "address": ("address", "adresse", "dirección", "live", "residen", "ship", "deliver", "home", "wohn"),
    "account": ("account", "acct", "konto", "compte", "cuenta", "bank", "routing"),
}
_NO_SECRET = ("commit", "sha", "hash", "checksum", "digest", "revision", "uuid", "build")
_AGAINST = ("version", "isbn", "issn", "order", "page", "figure", "table", "section", "serial", "model", "doi", "ticket")
_WORDS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each base kind, in code points, in time linear in the text."""
    found: list[list[tuple[int, int]]] = [[], [], [], []]
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            found[0].append((start, end))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_small, m[0].split("."))):
                found[1].append(m.span())
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found[2].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    found[3].append(m.span())
    return found


def candidates(text: str, base: list[list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` beyond the base; none overlaps a base span or an earlier candidate."""
    loose: list[tuple[int, int, int]] = []
    for m in _AT.finditer(text):
        left = _BEFORE_AT.search(text, max(0, m.start() - 64), m.start())
        right = _AFTER_AT.match(text, m.end())
        if left and right:
            loose.append((0, left.start(), right.end()))
    if _DIGIT.search(text):
        loose.extend((1, *m.span()) for m in _IP6.finditer(text))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(_digits(m[0])) <= 19:
                loose.append((2, *m.span()))
        loose.extend((3, *m.span()) for m in _NATIONAL.finditer(text) if 9 <= len(_digits(m[0])) <= 11)
        loose.extend((4, *m.span()) for m in _SSN.finditer(text))
        loose.extend((5, *m.span()) for m in _IBAN.finditer(text))
        for m in _SECRET.finditer(text):
            if _DIGIT.search(m[0]):
                loose.append((7, *m.span()))
        loose.extend((8, *m.span()) for m in _STREET_FIRST.finditer(text))
        loose.extend((8, *m.span()) for m in _NUMBER_FIRST.finditer(text))
        loose.extend((9, *m.span()) for m in _ACCOUNT.finditer(text))
    loose.extend((6, *m.span()) for m in _NAME.finditer(text))
    taken = sorted(s for spans in base for s in spans)
    kept, last, at, reach = [], 0, 0, 0
    for kind, start, end in sorted(loose, key=lambda x: (x[1], x[0])):
        while at < len(taken) and taken[at][0] < end:
            reach = max(reach, taken[at][1])
            at += 1
        if start >= max(last, reach):
            kept.append((kind, start, end))
            last = end
    return kept


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _entropy(s: str) -> float:
    shares = np.array(list(Counter(s).values())) / len(s)
    return float(-(shares * np.log2(shares)).sum())


def _token_vote(text: str, start: int, body: str) -> int:
    """Random characters speak for a secret; a hexadecimal one might be a hash unless something is set to it."""
    if _HEX.fullmatch(body):
        return 1 if any(c in text[max(0, start - 3) : start] for c in "=:\"'") else -1
    classes = sum(any(test(c) for c in body) for test in (str.islower, str.isupper, str.isdigit))
    return 1 if classes == 3 and _entropy(body) >= 3.5 else -1


def votes(text: str, kind: int, start: int, end: int, base: bool) -> tuple[int, int, int, int]:
    """Votes of pattern, gazetteer, context and edges: 1 for, -1 against, 0 none."""
    name, body = KINDS[kind], text[start:end]
    digits = _digits(body)
    if base or name == "email":
        pattern = 1
    elif name == "card":
        pattern = 1 if luhn(digits) else -1
    elif name == "iban":
        pattern = 1 if _mod97(body) else -1
    elif name == "ssn":
        pattern = 1 if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" else -1
    elif name == "secret":
        pattern = _token_vote(text, start, body)
    elif name == "address":
        pattern = 1
    elif name == "account":
        pattern = -1 if _DAY.fullmatch(body) or body.endswith("000") or len(set(body)) < 3 else 0
    elif name == "phone":
        pattern = 1 if body[0] == "(" or (len(digits) == 10 and digits[0] not in "01") else 0
    else:
        pattern = 0
    if name == "email":
        gazetteer = 1 if re.split(r"[^A-Za-z]+", body.lower().rstrip(")]}>"))[-1] in _DOMAINS else 0
    elif name == "card":
        gazetteer = 1 if digits.startswith(_ISSUERS) else -1
    elif name == "phone":
        gazetteer = int(body[0] == "+" and digits.startswith(_CALLING))
    elif name == "iban":
        gazetteer = 1 if body[:2] in _BANKS else -1
    elif name == "name":
        gazetteer = int(not _NAMES.isdisjoint(body.split()))
    elif name == "secret":
        gazetteer = int(body.startswith(_TOKENS))
    elif name == "address":
        gazetteer = int(bool(_POSTCODE.search(text, end, end + 40)))
    elif name == "account":
        after = [w.lower() for w in _WORDS.findall(text, end, end + 40)]
        gazetteer = 1 if any(w.startswith(_BANKING) for w in after) else -1
    else:
        gazetteer = 0
    around = [w.lower() for w in _WORDS.findall(text, max(0, start - 40), start)]
    against = _AGAINST + _NO_SECRET if name == "secret" else _AGAINST
    context = 1 if any(w.startswith(_NEAR[name]) for w in around) else -int(any(w.startswith(against) for w in around))
    glued = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    return pattern, gazetteer, context, -1 if glued else 1


def features(text: str, kind: int, start: int, end: int) -> list[int]:
    """Hashed features of a span, each once, that no labeler reads."""
    listed = _NEAR[KINDS[kind]] + _AGAINST + _NO_SECRET + _BANKING
    before = [w.lower() for w in _WORDS.findall(text, max(0, start - 40), start)][-2:]
    after = [w.lower() for w in _WORDS.findall(text, end, end + 40)][:2]
    shape = _DIGIT.sub("9", text[start : min(end, start + 64)])
    shape = re.sub(r"[^\W\d_]", "a", re.sub(r"[A-Z]", "A", shape))
    found = ["s" + re.sub(r"(.)\1+", r"\1+", shape)[:16]]
    found += [f"{side}{w}" for side, words in (("<", before), (">", after)) for w in words if not w.startswith(listed)]
    found += ["[" + text[max(0, start - 1) : start], "]" + text[end : end + 1]]
    return list({zlib.crc32(x.encode("utf-8", "replace")) % FEATURE_SLOTS for x in found})


def _length_class(start: int, end: int) -> int:
    return min(_LENGTHS - 1, (end - start) // 8)


def _inputs(kind: int, vote: tuple[int, ...], length: int) -> list[int]:
    """Active inputs of the span classifier: kind, each vote, each vote with the kind, length class."""
    at = [kind]
    offset = len(KINDS)
    for i, v in enumerate(vote):
        at.append(offset + 3 * i + v + 1)
    offset += 3 * _LABELERS
    for i, v in enumerate(vote):
        at.append(offset + (kind * _LABELERS + i) * 3 + v + 1)
    offset += len(KINDS) * _LABELERS * 3
    at.append(offset + kind * _LENGTHS + length)
    return at


_SIZE = len(KINDS) + 3 * _LABELERS + len(KINDS) * _LABELERS * 3 + len(KINDS) * _LENGTHS


@dataclass
class SpanModel:
    """Classifier weights and bias; for each labeler, by class, how often it votes -1, 0 and 1."""

    weights: np.ndarray
    bias: float
    reliability: np.ndarray = field(default_factory=lambda: np.full((2, _LABELERS, 3), 1 / 3))
    evidence: np.ndarray = field(default_factory=lambda: np.zeros((len(KINDS), FEATURE_SLOTS)))

    def probability(self, kind: int, vote: tuple[int, ...], length: int, slots: Sequence[int] = ()) -> float:
        shown = float(np.clip(self.evidence[kind, list(slots)].sum(), -_MOST_EVIDENCE, _MOST_EVIDENCE))
        return float(sigmoid(np.array(self.weights[_inputs(kind, vote, length)].sum() + self.bias + shown)))


def _evidence(soft: dict[tuple[int, tuple[int, ...]], float], all_: dict, seen: dict) -> np.ndarray:
    """Log odds of each feature by kind: its share among likely spans against that among unlikely ones.

    ``all_`` counts spans by (kind, votes), ``seen`` by (kind, votes, slot). Both shares are drawn towards the
    feature's share among all spans of the kind, so what one class alone has little of says little. Features of
    a span depend on each other, so each counts half.
    """
    total, has = np.zeros((2, len(KINDS), 1)), np.zeros((2, len(KINDS), FEATURE_SLOTS))
    for (kind, vote), n in all_.items():
        p = soft[kind, vote]
        total[:, kind, 0] += n * (1 - p), n * p
    for (kind, vote, slot), n in seen.items():
        p = soft[kind, vote]
        has[:, kind, slot] += n * (1 - p), n * p
    background = (has.sum(axis=0) + 0.5) / (total.sum(axis=0) + 1.0)
    share = (has + _SMOOTH * background) / (total + _SMOOTH)
    return 0.5 * np.log(share[1] / share[0])


def fit_spans(
    counts: dict[tuple[int, tuple[int, ...], int], int],
    slots: dict[tuple[int, tuple[int, ...], int], int] | None = None,
    rounds: int = 100,
) -> SpanModel:
    """Expectation-maximisation over vote patterns, then the span classifier on the soft labels.

    ``counts`` is by kind, votes and length class, ``slots`` by kind, votes and feature slot.
    """
    if not counts:
        return SpanModel(np.zeros(_SIZE), -4.0)
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], dtype=float)
    kind = np.array([k[0] for k in keys])
    vote = np.array([k[1] for k in keys]) + 1
    # At first the sum of votes decides, a tie against the span.
    soft = sigmoid(2.0 * ((vote - 1).sum(axis=1) - 0.5))
    trust = np.full((2, _LABELERS, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([n * (1 - soft), n * soft])
        for c in (0, 1):
            for i in range(_LABELERS):
                seen = np.bincount(vote[:, i], weights=weight[c], minlength=3) + 1.0
                # A labeler may be useless but is not taken to mean the opposite of what it says.
                trust[c, i] = seen / seen.sum()
        for i in range(_LABELERS):
            for v, better in ((2, 1), (0, 0)):
                if trust[better, i, v] < trust[1 - better, i, v]:
                    trust[:, i, v] = trust[:, i, v].mean()
            trust[:, i] /= trust[:, i].sum(axis=1, keepdims=True)
        positive = np.bincount(kind, weights=n * soft, minlength=len(KINDS)) + 1.0
        prior = positive / (np.bincount(kind, weights=n, minlength=len(KINDS)) + 2.0)
        odds = np.log(prior[kind] / (1 - prior[kind]))
        for i in range(_LABELERS):
            odds = odds + np.log(trust[1, i, vote[:, i]] / trust[0, i, vote[:, i]])
        new = sigmoid(odds)
        done = np.abs(new - soft).max() < 1e-7
        soft = new
        if done:
            break
    x = np.zeros((len(keys), _SIZE))
    for row, (k, v, length) in enumerate(keys):
        x[row, _inputs(k, v, length)] = 1.0
    weights, bias = np.zeros(_SIZE), 0.0
    share = np.log1p(n)  # frequent patterns must not drown rare ones
    for _ in range(60):
        p = sigmoid(x @ weights + bias)
        w = share * np.maximum(p * (1 - p), 1e-6)
        design = np.column_stack([x, np.ones(len(keys))])
        gradient = design.T @ (share * (p - soft)) + 0.05 * np.append(weights, bias)
        hessian = (design * w[:, None]).T @ design + 0.05 * np.eye(_SIZE + 1)
        step = np.linalg.solve(hessian, gradient)
        weights, bias = weights - step[:-1], bias - float(step[-1])
        if np.abs(step).max() < 1e-8:
            break
    label: dict[tuple[int, tuple[int, ...]], float] = {}
    spans: Counter = Counter()
    for (k, v, _), p in zip(keys, soft, strict=True):
        label[k, v] = float(p)  # the same for every length
    for (k, v, _), c in counts.items():
        spans[k, v] += c
    return SpanModel(weights, bias, trust, _evidence(label, spans, slots or {}))


def learn_spans(docs: DataFrame, text: str = "text") -> SpanModel:
    """Count votes and features over all documents and fit.

    The counts have at most kinds x vote patterns x (length classes + feature slots) distinct rows, however
    large the corpus: 10 x 81 x (4 + 512).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def add(body: str, kind: int, s: int, e: int, base: bool) -> None:
            vote = votes(body, kind, s, e, base)
            seen[kind, vote, _length_class(s, e), -1] += 1
            for slot in features(body, kind, s, e):
                seen[kind, vote, -1, slot] += 1

        for batch in batches:
            for value in batch.column(0):
                if body := value.as_py():
                    base = base_spans(body)
                    for kind, spans in enumerate(base):
                        for s, e in spans:
                            add(body, kind, s, e, True)
                    for kind, s, e in candidates(body, base):
                        add(body, kind, s, e, False)
        rows = list(seen.items())
        arrays = [
            pa.array([k[0] for k, _ in rows], pa.int32()),
            pa.array([list(k[1]) for k, _ in rows], pa.list_(pa.int32())),
            pa.array([k[2] for k, _ in rows], pa.int32()),
            pa.array([k[3] for k, _ in rows], pa.int32()),
            pa.array([n for _, n in rows], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=["kind", "vote", "length", "slot", "n"])

    schema = "kind int, vote array<int>, length int, slot int, n long"
    counted = docs.select(column(docs, text)).mapInArrow(count, schema)
    sums = counted.groupBy("kind", "vote", "length", "slot").agg(F.sum("n").alias("n")).collect()
    lengths = {(r["kind"], tuple(r["vote"]), r["length"]): r["n"] for r in sums if r["slot"] < 0}
    slots = {(r["kind"], tuple(r["vote"]), r["slot"]): r["n"] for r in sums if r["slot"] >= 0}
    return fit_spans(lengths, slots)


@keeps_other_columns
def find_personal_data(docs: DataFrame, model: SpanModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the text, with ``found``: structs of kind, start, end and whether it is a base span.

    Offsets count code points, the end excluded. Spans come by kind in the order of KINDS, then by start. A
    null text counts as empty. Repeated rows stay; an empty table stays empty; a column named ``found`` is
    replaced.
    """
    names = [c for c in docs.columns if c not in ("text", "found")]
    slim = docs.select(*[column(docs, c) for c in names], column(docs, "text").alias("_text"))
    item = "kind string, start int, end int, base boolean"
    added = StructField("found", ArrayType(StructType.fromDDL(item), False), False)
    schema = StructType([*slim.schema.fields[:-1], added])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(len(names)):
                body = value.as_py() or ""
                base = base_spans(body)
                spans = [(kind, s, e, True) for kind, own in enumerate(base) for s, e in own]
                for kind, s, e in candidates(body, base):
                    vote, slots = votes(body, kind, s, e, False), features(body, kind, s, e)
                    if model.probability(kind, vote, _length_class(s, e), slots) >= threshold:
                        spans.append((kind, s, e, False))
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in sorted(spans)])
            kept = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, arrow)], names=[f.name for f in schema.fields])

    return slim.mapInArrow(run, schema)


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts of base spans, the hash of their list, and the list of all spans, for every document."""
    found = find_personal_data(docs.select("doc_id", "text"), learn_spans(docs))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast(LongType())

    base = F.filter("found", lambda s: s["base"])
    counts = {f"n_{kind}": of_kind(kind) for kind in KINDS[:BASE_KINDS]}
    return found.select(
        "doc_id",
        *[c.alias(n) for n, c in counts.items()],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).cast(StringType()).alias("spans"),
    )
