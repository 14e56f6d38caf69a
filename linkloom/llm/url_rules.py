"""URL filters: listed host/path rules, and association rules for the URLs they leave.

URLs that a listed rule judges are the labelled examples. Each URL becomes the set of its
structural tokens; FP-growth mines the token combinations that go with a label, and rules
below the support or confidence limits are dropped. The kept rules are an inverted index
(token -> rules): a rule fires for a token set that holds all its tokens. Token sets are
first cut to the tokens that some rule has, so that only distinct sets are matched.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path): a rule fits its host and all subdomains under its path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DEFAULT = "allow"
#: Share of the judged URLs that a combination and its label must occur in, the share of a
#: combination's URLs that must have the label, and the least URLs with both.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_COUNT = 0.005, 0.8, 5
LABEL = "verdict="


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest fitting rule as a struct ``rule, verdict`` (null if none fits)."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of the whole URL: the host's top level, name and other labels, each
    folder with its depth, the last part, its extension, and each query key. Spaces in a
    token read ``%20``."""
    labels, parts = F.filter(F.split(host, r"\."), lambda x: x != ""), F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(labels)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"(?s)^([^=]*)", 1)), lambda x: x != "")
    named = lambda name, values: F.transform(values, lambda x: F.concat(F.lit(name + "="), x))
    one = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(name + "="), value))
    file = F.get(parts, F.size(parts) - 1)
    return F.transform(
        F.array_distinct(F.array_compact(F.concat(
            F.array(one("top", F.get(labels, n - 1)), one("name", F.get(labels, n - 2)), one("file", file), one("ext", F.regexp_extract(F.coalesce(file, F.lit("")), r"\.([A-Za-z0-9]{1,8})$", 1))),
            named("sub", F.slice(labels, 1, F.greatest(n - 2, F.lit(0)))),
            F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p, i: F.concat(F.lit("dir"), (i + 1).cast("string"), F.lit("="), p)),
            named("key", keys),
        ))),
        lambda t: F.replace(t, F.lit(" "), F.lit("%20")),
    )


def mine(judged: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """``rule_id, items, verdict, confidence, support`` mined from ``tokens, verdict``.

    A combination counts from ``min_support`` of the rows and ``min_count`` of them on.
    Frequent tokens that the same rows hold are mined as one item (no row can tell them
    apart, and every subset of them would be a combination), so a rule lists them all. The
    rules are few at any input size: only frequent items enter. No judged URL gives no rules.
    """
    spark = judged.sparkSession
    n = judged.count()
    least = max(math.ceil(min_support * n), min_count)
    rows = materialise(judged.select(F.monotonically_increasing_id().alias("row"), "tokens", "verdict"), "url-examples")
    held = rows.select("row", F.explode("tokens").alias("token"))
    # A count and two mixed hashes of the rows: equal for equal sets of rows.
    extent = held.groupBy("token").agg(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64(F.lit(k), "row")).alias(f"h{k}") for k in (1, 2))).where(F.col("n") >= least)
    alike = extent.groupBy("n", "h1", "h2").agg(F.array_sort(F.collect_list("token")).alias("members")) if n else None
    if not n or alike.isEmpty():
        return spark.createDataFrame([], "rule_id string, items array<string>, verdict string, confidence double, support double")
    # At most (tokens a URL) / min_support rows, as each member is frequent.
    items = materialise(alike.select(F.get("members", 0).alias("token"), "members"), "url-items")
    kept = F.array(*(F.lit(r.token) for r in items.select("token").orderBy("token").collect()))
    baskets = rows.select(F.concat(F.array_intersect("tokens", kept), F.array(F.concat(F.lit(LABEL), "verdict"))).alias("items"))
    found = FPGrowth(minSupport=(least - 0.5) / n, minConfidence=min_confidence).fit(baskets).associationRules
    verdict = F.get("consequent", 0)
    found = found.where(verdict.startswith(LABEL) & ~F.exists("antecedent", lambda x: x.startswith(LABEL)))
    found = found.select(F.monotonically_increasing_id().alias("k"), "antecedent", F.substring(verdict, len(LABEL) + 1, 100).alias("verdict"), "confidence", "support")
    found = materialise(found, "url-found")
    whole = found.select("k", "verdict", "confidence", "support", F.explode("antecedent").alias("token")).join(items, "token")
    rules = whole.groupBy("k", "verdict", "confidence", "support").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("items"))
    return materialise(rules.select(F.array_join("items", " ").alias("rule_id"), "items", "verdict", "confidence", "support"), "url-rules")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``tokens, rule_id, verdict, confidence``: the best rule of each token set that has one.

    A token set meets only the rules that the index lists under its tokens. The order is
    confidence, support, number of items, then the rule's name.
    """
    index = rules.select(F.explode("items").alias("item"), "rule_id", F.size("items").alias("n_items"), "verdict", "confidence", "support")
    hits = sets.select("tokens", F.explode("tokens").alias("item")).join(index, "item")
    fired = hits.groupBy("tokens", "rule_id", "n_items", "verdict", "confidence", "support").count().where("count = n_items")
    best = F.min_by(F.struct("rule_id", "verdict", "confidence"), F.struct(-F.col("confidence"), -F.col("support"), -F.col("n_items"), "rule_id", "verdict"))
    return fired.groupBy("tokens").agg(best.alias("b")).select("tokens", "b.rule_id", "b.verdict", "b.confidence")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, default: str = DEFAULT, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined_rule, confidence`` for each row of ``pages``.

    A listed rule decides where one fits; else the best mined rule; else ``default``. A
    null url, or one without ``://``, has an empty host and path, fits no listed rule and
    gets ``default`` unless its query keys alone are a mined rule. A host alone, an empty
    path and very long URLs are judged like any other. Repeated rows and null ids are kept
    as they are, other columns are ignored, an empty table gives no rows.
    """
    url = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    base = materialise(
        url.withColumn("base", listed_rule(F.col("host"), F.col("path"), rules)).select(
            "page_id", "host", "path", F.col("base.rule").alias("rule"), F.col("base.verdict").alias("listed"), url_tokens(F.col("host"), F.col("path"), F.col("url")).alias("all_tokens")
        ),
        "urls",
    )
    mined = mine(base.where("listed IS NOT NULL").select(F.col("all_tokens").alias("tokens"), F.col("listed").alias("verdict")), min_support, min_confidence, min_count)
    # Each of them is in min_support of the judged URLs.
    items = [r.item for r in mined.select(F.explode("items").alias("item")).distinct().collect()]
    known = F.array(*map(F.lit, sorted(items))) if items else F.array().cast("array<string>")
    cut = base.withColumn("tokens", F.when(F.col("listed").isNull(), F.array_sort(F.array_intersect("all_tokens", known))))
    verdicts = materialise(match(cut.where("size(tokens) > 0").select("tokens").distinct(), mined), "url-verdicts")
    return cut.join(verdicts, "tokens", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("listed", "verdict", F.lit(default)).alias("verdict"), F.col("rule_id").alias("mined_rule"), "confidence"
    )
