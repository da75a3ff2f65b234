"""URL filtering by listed rules and by mined association rules.

Spark's FP-growth mines the token combinations of labelled URLs, each basket holding a mark if its page is labelled bad. Rules
that conclude the mark are kept if their support and confidence suffice and no shorter rule is as sure. Rules are found
for a URL by an inverted index on each rule's rarest token, then checked against all tokens of the URL, so a URL meets
few rules and a common token no more than a rare one.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

BAD = "=bad"
#: Listed rules: host, path, verdict.
LISTED = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path`` and ``rest`` (what follows the path); all are empty without ``://`` or a url."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    host = F.regexp_extract("rest", r"^[^/?#]*", 0)
    out = pages.withColumn("rest", rest).withColumn("host", host).withColumn("rest", F.expr("substring(rest, length(host) + 1)"))
    out = out.withColumn("path", F.regexp_extract("rest", r"^[^?#]*", 0)).withColumn("rest", F.expr("substring(rest, length(path) + 1)"))
    return out.withColumn("host", F.translate("host", _UPPER, _LOWER))


def url_tokens() -> F.Column:
    """Distinct tokens of a URL's parts: the host's suffixes, words of the path, and names and values of the query. Numbers are one token."""
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    last = F.size(labels)
    suffix = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat(F.lit("s:"), F.array_join(F.slice(labels, i, F.greatest(last, F.lit(1))), ".")))
    word = lambda prefix, text, by: F.transform(F.filter(F.split(F.lower(text), by), lambda x: x != ""), lambda x: F.concat(F.lit(prefix), F.when(x.rlike(r"^[0-9]+$"), F.lit("0")).otherwise(x)))
    return F.array_distinct(F.concat(F.when(last > 0, suffix).otherwise(F.array().cast("array<string>")), word("p:", F.col("path"), r"[/._-]+"), word("q:", F.col("rest"), r"[?&;#]+")))


def listed_rule(rules=None) -> F.Column:
    """The longest listed rule that fits ``host`` and ``path``, as a struct of its text and verdict, or null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for host, path, verdict in sorted(rules or LISTED, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def mine(labelled: DataFrame, support: float = 0.002, lift: float = 2.0, confidence: float = 0.0, z: float = 2.33) -> DataFrame:
    """Association rules from ``tokens`` (array) and ``bad`` (boolean): ``rule_id``, ``tokens``, ``confidence``, ``support``, ``lift``.

    A rule's tokens and the mark occur together in at least the share ``support`` of the baskets, and in five. Its
    confidence, the share of the baskets with the tokens that have the mark, is at least ``lift`` times that of all
    baskets and at least ``confidence``, and higher than that of all also at the lower end of its confidence interval (Wilson's, ``z`` deviations). A rule goes if some of its
    tokens alone are as sure. Baskets with null tokens or marks are left aside; without bad baskets there are no rules.
    """
    spark = labelled.sparkSession
    baskets = labelled.filter("tokens is not null and bad is not null").select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"), "bad")
    baskets = materialize(baskets.filter(F.size("items") > 0), "baskets")
    n, bad = baskets.agg(F.count(F.lit(1)), F.sum(F.col("bad").cast("long"))).first()
    if not bad:
        return spark.createDataFrame([], "rule_id long, tokens array<string>, confidence double, support double, lift double")
    base = bad / n
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, 5 / n)), minConfidence=min(1.0, max(confidence, lift * base))).fit(baskets.select("items"))
    c, m = F.col("confidence"), F.round(F.col("support") * n) / F.col("confidence")
    lower = (c + z * z / (2 * m) - z * F.sqrt(c * (1 - c) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    found = model.associationRules.filter(F.element_at("consequent", 1) == BAD).filter(lower > base)
    found = materialize(found.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support", "lift"), "rules")
    # A rule's proper parts that are rules: by their own tokens among the rule's.
    part = found.select(F.col("tokens").alias("part"), F.col("confidence").alias("sure"), F.element_at("tokens", 1).alias("t"))
    weaker = found.select("tokens", "confidence", F.explode("tokens").alias("t")).join(part, "t")
    weaker = weaker.filter((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0) & (F.col("sure") >= F.col("confidence"))).select("tokens").distinct()
    return found.join(weaker, "tokens", "left_anti").select(F.xxhash64("tokens").alias("rule_id"), "tokens", "confidence", "support", "lift")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``key``, ``confidence`` and ``tokens`` of the surest mined rule that fits each of ``urls`` (``key``, ``tokens``)."""
    frequency = rules.select(F.explode("tokens").alias("t")).groupBy("t").count()
    ranked = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("t")).join(frequency, "t")
    index = ranked.groupBy("rule_id").agg(F.min(F.struct("count", "t")).alias("m"), F.first("tokens").alias("rule_tokens"), F.first("confidence").alias("confidence")).select(F.col("m.t").alias("t"), "rule_tokens", "confidence")
    index = materialize(index, "index")
    if index.isEmpty():
        return urls.sparkSession.createDataFrame([], "key long, confidence double, pattern array<string>")
    hits = urls.select("key", "tokens", F.explode("tokens").alias("t")).join(index, "t").filter(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    best = hits.groupBy("key").agg(F.max(F.struct("confidence", F.col("rule_tokens").alias("pattern"))).alias("m"))
    return best.select("key", "m.confidence", "m.pattern")


def judge(pages: DataFrame, labels: DataFrame, rules=None, **mining) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``confidence`` and ``pattern`` of every page.

    A listed rule decides if one fits; else a page is blocked if a mined rule fits its url. Labels belong to the page whose
    page_id is their doc_id, as a reviewer's verdict on what is found at its url; a page is bad if its quality is 0. Null urls have empty parts and no tokens, and are allowed.
    Equal urls are judged alike; pages may repeat.
    """
    parts = with_parts(pages.select("page_id", "url"))
    marks = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    tokens = parts.select("page_id", "host", "path", "url", url_tokens().alias("tokens"))
    labelled = tokens.join(marks, F.col("page_id") == F.col("doc_id")).select("tokens", (F.col("quality") == 0).alias("bad"))
    mined = mine(labelled, **mining)
    distinct = tokens.filter(F.size("tokens") > 0).select(F.xxhash64("url").alias("key"), "tokens")
    best = matched(distinct.groupBy("key").agg(F.first("tokens").alias("tokens")), mined)
    out = parts.select("page_id", "host", "path", listed_rule(rules).alias("listed"), F.xxhash64("url").alias("key")).join(best, "key", "left")
    verdict = F.coalesce(F.col("listed.verdict"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"), "confidence", "pattern")


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return out.withColumn("pattern", F.array_join("pattern", " "))
