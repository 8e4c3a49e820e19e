"""URL filtering by given host and path rules, and by association rules mined from the URLs they decide.

A given rule decides a URL if its host is the rule's or below it and its path starts with the rule's; the
longest rule wins. URLs that some rule decides are the labelled ones: each is a transaction of its tokens and
its verdict, and Spark's FP-growth mines the token combinations that come with a verdict. Combinations below
the least support or confidence are dropped, and so are those that a part of them says as surely.

The rules kept go into an inverted index under their rarest token. A URL looks up its own tokens, and the
rules found there whose other tokens it has too are its matches. The surest match decides, then the one with
more support; on a tie the URL is allowed, as it is without a match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .common import column

BLOCK, ALLOW = "block", "allow"
#: Least share of the labelled URLs that hold a rule's tokens with its verdict, and least confidence.
LEAST_SUPPORT = 0.01
LEAST_CONFIDENCE = 0.8
#: Verdicts among the items; no token starts like this.
_MARK = "="
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the contract.
CONTRACT_RULES = (
    (BLOCK, "net/"),
    (ALLOW, "example.net/en/"),
    (BLOCK, "example.com/de/"),
    (ALLOW, "org/fr/"),
)


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """The host, lower-cased in A-Z, a port or user included; empty for null or without ``://``."""
    return _ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What stands between the host and the first ``?`` or ``#``."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels, words of the path, keys of the query, whether there is a fragment."""
    rest = _rest(url)
    query = F.regexp_extract(rest, "^[^?#]*[?]([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))

    def named(kind: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))

    found = F.concat(
        F.array(F.concat(F.lit("s:"), F.substring_index(url, "://", 1))),
        named("h:", F.split(host, "[.]")),
        named("p:", F.regexp_extract_all(_ascii_lower(path), F.lit("[a-z0-9]+"), F.lit(0))),
        named("q:", keys),
        F.when(rest.contains("#"), F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>")),
    )
    none = F.array().cast("array<string>")
    return F.when(F.instr(url, "://") > 0, F.array_distinct(found)).otherwise(none)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest given rule that fits, and its verdict; both null without one.

    Rules of equal length cannot both be the longest unless they are equal; then the one given first stands.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i in sorted(range(len(rules)), key=lambda i: (len(rules[i][1]), -i)):
        kind, text = rules[i]
        domain, slash, start = text.partition("/")
        domain = domain.translate(str.maketrans(_UPPER, _LOWER))
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def mine_rules(labelled: DataFrame, least_support: float, least_confidence: float) -> DataFrame:
    """``antecedent, verdict, confidence, support, rarest`` from ``tokens`` and ``verdict`` of labelled URLs.

    The frequent items, of which there are at most (tokens in a URL) / ``least_support``, reach the driver
    inside FP-growth; trees are merged before the shuffle. A combination costs as many itemsets as its
    frequent tokens have subsets, so ``least_support`` should leave a URL some twenty frequent tokens at most.
    """
    items = labelled.select(F.array_append("tokens", F.concat(F.lit(_MARK), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least_support, minConfidence=least_confidence).fit(items)
    target = F.get("consequent", F.lit(0))
    found = model.associationRules.filter(target.startswith(_MARK))
    found = found.filter(~F.exists("antecedent", lambda x: x.startswith(_MARK)))
    found = found.select(
        F.sort_array("antecedent").alias("antecedent"), F.substr(target, F.lit(2)).alias("verdict"), "confidence", "support"
    )
    found = materialize(found, "rules")
    # A rule that a part of it says as surely never decides: the part has more support.
    parts = found.withColumn("_x", F.explode("antecedent")).select(
        "antecedent", "verdict", "confidence", F.array_remove("antecedent", F.col("_x")).alias("part")
    )
    shorter = found.select(F.col("antecedent").alias("part"), "verdict", F.col("confidence").alias("sure"))
    idle = parts.join(shorter, ["part", "verdict"]).filter("sure >= confidence").select("antecedent", "verdict")
    kept = found.join(idle.distinct(), ["antecedent", "verdict"], "left_anti")
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("_t"), "freq")
    tokens = kept.select("antecedent", "verdict", F.explode("antecedent").alias("_t")).join(single, "_t")
    rarest = tokens.groupBy("antecedent", "verdict").agg(F.min(F.struct("freq", "_t")).alias("_r"))
    indexed = kept.join(rarest, ["antecedent", "verdict"]).withColumn("rarest", F.col("_r._t")).drop("_r")
    return materialize(indexed, "index")


def match_rules(urls: DataFrame, index: DataFrame) -> DataFrame:
    """``url`` and ``mined``, the verdict of the best matching rule, for the URLs with a match.

    ``urls`` has one row ``url, tokens`` for each URL.
    """
    index = index.select("rarest", "antecedent", "verdict", "confidence", "support")
    looked_up = urls.select("url", "tokens", F.explode("tokens").alias("rarest")).join(index, "rarest")
    hits = looked_up.filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", (F.col("verdict") == ALLOW).alias("allow"))).alias("best")
    return hits.groupBy("url").agg(best).select("url", F.when(F.col("best.allow"), ALLOW).otherwise(BLOCK).alias("mined"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    url: str = "url",
    labels: DataFrame | None = None,
    least_support: float = LEAST_SUPPORT,
    least_confidence: float = LEAST_CONFIDENCE,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the given rule, or null) and ``verdict``.

    ``rules`` are pairs of ``allow`` or ``block`` and a host with a path. ``labels`` (``url``, ``verdict``) are
    the URLs to mine; without them, they are the pages that a given rule decides, repeated rows counted.

    A null URL, or one without ``://``, has an empty host and path and no token; no rule decides it and it is
    allowed. So is every undecided URL if nothing is labelled. Repeated rows are kept and judged alike. An empty
    table gives an empty result. Input columns named like the added ones are replaced; others may have any name.
    """
    added = ("host", "path", "rule", "verdict")
    names = [c for c in pages.columns if c not in added]
    plain = pages.select(*[column(pages, c).alias(f"_c{i}") for i, c in enumerate(names)], column(pages, url).alias("url"))
    parsed = plain.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, given = rule_for(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "given": given})
    tokens = tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens")
    if labels is None:
        labelled = parsed.filter("given IS NOT NULL").select(tokens, F.col("given").alias("verdict"))
    else:
        named = labels.select("url", "verdict").filter(F.col("verdict").isin(BLOCK, ALLOW) & F.col("url").isNotNull())
        labelled = named.select(tokens_of(F.col("url"), host_of(F.col("url")), path_of(F.col("url"))).alias("tokens"), "verdict")
    labelled = materialize(labelled, "labelled")
    if not labelled.isEmpty():
        index = mine_rules(labelled, least_support, least_confidence)
        open_urls = parsed.filter("given IS NULL AND url IS NOT NULL").select("url", "host", "path").distinct()
        mined = match_rules(open_urls.select("url", tokens), index)
        parsed = parsed.join(mined, "url", "left")
    else:
        parsed = parsed.withColumn("mined", F.lit(None).cast("string"))
    return parsed.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)],
        F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        "rule",
        F.coalesce("given", "mined", F.lit(ALLOW)).alias("verdict"),
    )


def url_digest(pages: DataFrame) -> DataFrame:
    """The contract's rows: its four rules, and association rules mined from the pages that they decide."""
    judged = judge_urls(pages.select("page_id", "url"), CONTRACT_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


_LOWERED = f"translate(%s, '{_UPPER}', '{_LOWER}')"

DIGEST_SQL = f"""
WITH rests AS (
    SELECT page_id, url, instr(url, '://') AS mark, CASE WHEN instr(url, '://') > 0 THEN url[instr(url, '://') + 3:] ELSE '' END AS rest
    FROM pages
),
parsed AS (
    SELECT *, {_LOWERED % "regexp_extract(rest, '^[^/?#]*')"} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rests
),
ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
        END AS rule
    FROM parsed
),
judged AS (
    SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS given,
           CASE WHEN mark > 0 THEN list_sort(list_distinct(list_concat(
               ['s:' || url[:mark - 1]],
               list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
               list_transform(regexp_extract_all({_LOWERED % "path"}, '[a-z0-9]+'), lambda x: 'p:' || x),
               list_transform(list_filter(list_transform(
                   string_split(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '&'), lambda x: split_part(x, '=', 1)),
                   lambda x: x <> ''), lambda x: 'q:' || x),
               CASE WHEN contains(rest, '#') THEN ['f:'] ELSE [] END))) ELSE [] END AS tokens
    FROM ruled
),
few AS (SELECT ceil({LEAST_SUPPORT} * count(*)) AS n FROM judged WHERE given IS NOT NULL),
frequent AS (
    SELECT list(token) AS known FROM (
        SELECT token FROM (SELECT unnest(tokens) AS token FROM judged WHERE given IS NOT NULL)
        GROUP BY token HAVING count(*) >= (SELECT n FROM few)
    )
),
held AS (
    SELECT url, given, count(*) AS n, any_value(list_intersect(tokens, coalesce(known, []))) AS kept
    FROM judged, frequent WHERE url IS NOT NULL GROUP BY url, given
),
subsets AS (
    SELECT url, given, n, list_sort(list_filter(kept, lambda t, i: (m >> (i - 1)) & 1 = 1)) AS part
    FROM held, unnest(generate_series(1, (1 << len(kept)) - 1)) AS u(m)
),
rules AS (
    SELECT part, count_block, count_allow, total
    FROM (
        SELECT part, sum(n) AS total, coalesce(sum(n) FILTER (given = 'block'), 0) AS count_block,
               coalesce(sum(n) FILTER (given = 'allow'), 0) AS count_allow
        FROM subsets WHERE given IS NOT NULL GROUP BY part
    )
),
sure AS (
    SELECT part, 0 AS allow, CAST(count_block AS DOUBLE) / total AS confidence, count_block AS support FROM rules
    UNION ALL
    SELECT part, 1, CAST(count_allow AS DOUBLE) / total, count_allow FROM rules
),
best AS (
    SELECT url, s.allow
    FROM subsets t JOIN sure s USING (part)
    WHERE t.given IS NULL AND s.support >= (SELECT n FROM few) AND s.confidence >= {LEAST_CONFIDENCE}
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY s.confidence DESC, s.support DESC, s.allow DESC) = 1
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(given, CASE WHEN b.allow = 0 THEN 'block' END, 'allow') AS verdict
FROM judged LEFT JOIN best b USING (url)
"""
