"""URL rules against row-wise Python: parsing, given rules, mined rules and their matches."""

import re
from itertools import combinations
from math import ceil

from pyspark.sql import functions as F

from rowforge.llm.url_rules import ALLOW, BLOCK, CONTRACT_RULES, judge_urls

URLS = [
    None,
    "",
    "no scheme/at all",
    "http://",
    "://x.net/a",
    "HTTP://Blog.Example.NET/EN/a",
    "http://example.net/en/a",
    "http://example.net/en",
    "http://example.net",
    "http://notexample.net/en/x",
    "http://a.b.example.com/de/1?x=://y.org/fr/",
    "http://example.com?de/",
    "http://example.org/fr/#top",
    "http://org/fr/",
    "http://ÀB.example.org/fr/a",
    "https://u@h.example.com:80/de/",
    "https://b.example.com/de/" + "very-long/" * 3000,
] + [f"https://{h}.example.{t}/{p}/{i}?k={i}&&=v" for i, (h, t, p) in enumerate(
    (h, t, p) for h in ("a", "spam", "m") for t in ("com", "net", "org") for p in ("en", "de", "fr", "x")
)]


def parse(url):
    if url is None or "://" not in url:
        return "", "", []
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host = host.translate(lower)
    query = re.match("[^?#]*[?]([^#]*)", rest)
    tokens = ["s:" + url.split("://")[0], *("h:" + x for x in host.split(".") if x)]
    tokens += ["p:" + x for x in re.findall("[a-z0-9]+", path.translate(lower))]
    tokens += ["q:" + x.split("=")[0] for x in (query[1] if query else "").split("&") if x.split("=")[0]]
    tokens += ["f:"] if "#" in rest else []
    return host, path, sorted(set(tokens))


def given(host, path, rules=CONTRACT_RULES):
    fits = []
    for verdict, rule in rules:
        domain, _, start = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def brute(urls, support, confidence):
    parsed = [parse(u) for u in urls]
    ruled = [given(h, p) for h, p, _ in parsed]
    labelled = [(t, v) for (_, _, t), (_, v) in zip(parsed, ruled) if v]
    least = ceil(support * len(labelled))
    single = {}
    for t, _ in labelled:
        for x in t:
            single[x] = single.get(x, 0) + 1
    counts = {}
    for t, v in labelled:
        often = [x for x in t if single[x] >= least]
        for k in range(1, len(often) + 1):
            for part in combinations(often, k):
                c = counts.setdefault(part, {BLOCK: 0, ALLOW: 0})
                c[v] += 1
    rules = []
    for part, c in counts.items():
        for v, n in c.items():
            if n >= least and n / sum(c.values()) >= confidence:
                rules.append((n / sum(c.values()), n, v == ALLOW, set(part)))
    out = []
    for (h, p, t), (rule, v) in zip(parsed, ruled):
        hits = [r[:3] for r in rules if r[3] <= set(t)]
        mined = BLOCK if hits and not max(hits)[2] else ALLOW
        out.append((h, p, rule, v or mined))
    return out


def judged(spark, urls, **options):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rows = rows.withColumns({"tokens": F.lit("t"), "_c0": F.lit(1), "given": F.lit("g"), "host": F.lit("own"), "mined": F.lit("m")})
    found = judge_urls(rows, CONTRACT_RULES, **options)
    assert found.columns == ["page_id", "url", "tokens", "_c0", "given", "mined", "host", "path", "rule", "verdict"]
    return [(r.host, r.path, r.rule, r.verdict) for r in sorted(found.collect(), key=lambda r: r.page_id)]


def test_equals_brute_force(spark):
    urls = URLS + URLS[20:25] * 3
    assert judged(spark, urls, least_support=0.1, least_confidence=0.7) == brute(urls, 0.1, 0.7)
    assert judged(spark, urls, least_support=0.2, least_confidence=0.6) == brute(urls, 0.2, 0.6)


def test_labels_teach_a_combination(spark):
    """Neither token blocks alone, both together do."""
    rows = [("http://a.x/buy/1", ALLOW), ("http://b.x/buy/2", ALLOW), ("http://a.x/pills/1", ALLOW), ("http://c.x/pills/1", ALLOW)]
    rows += [("http://a.x/buy/pills", BLOCK), ("http://b.x/pills/buy", BLOCK), (None, BLOCK), ("http://q.x/", None)]
    labels = spark.createDataFrame(rows * 3, "url string, verdict string")
    pages = spark.createDataFrame([("http://new.y/buy/now/pills",), ("http://new.y/buy",), ("http://new.y/pills",), (None,)], "url string")
    found = judge_urls(pages, (), labels=labels, least_support=0.1, least_confidence=0.9)
    assert {r.url: r.verdict for r in found.collect()} == {
        "http://new.y/buy/now/pills": BLOCK, "http://new.y/buy": ALLOW, "http://new.y/pills": ALLOW, None: ALLOW
    }


def test_empty_table_and_no_labels(spark):
    assert judged(spark, []) == []
    assert judged(spark, ["http://x.com/a", None]) == [("x.com", "/a", None, ALLOW), ("", "", None, ALLOW)]
