"""URL verdicts: fixed host/path rules first, then learned association rules.

FP-growth mines combinations of URL tokens that go with a low-quality or a
good label over all labelled pages.  A rule must rest on enough pages, and its
confidence must lie above its label's own share of all pages by more than
chance explains, given how many rules were tried.  The rules form an inverted
index on their rarest token: a page meets only the rules that hold one of its
tokens as that key, and a rule fires if all of its tokens are the page's.  The
rule that lifts its label's share furthest on the way to 1 decides.
Spark and Spark ML built-ins only.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stored

# Fixed rules: (verdict, host, path); a rule's text is host + path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT = 0.01      # share of labelled pages; bounds the number of rules
MIN_PAGES = 20          # labelled pages a rule must rest on at least
MAX_CHANCE = 0.05       # that any rule at all is learned from labels that do not depend on the URL
BAD, GOOD = "label=0", "label=1"


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = url.substr(at + 3, F.length(url))
    return F.when(at > 0, ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = url.substr(at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: scheme, all host labels and the last endings, all
    path segments with their place (numbers as #), all query keys."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    ends = [F.when(n >= k, F.concat(F.lit("end:"), F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), F.lit(k)), ".")))
            for k in (1, 2)]
    segments = F.filter(F.split(ascii_lower(path), "/"), lambda x: x != "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda kv: F.regexp_extract(kv, r"^([^=]*)", 1)), lambda x: x != "")
    parts = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.regexp_extract(ascii_lower(url), r"^([a-z]+)://", 1)), *ends),
        F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
        F.transform(segments, lambda x, i: F.concat(
            F.lit("path"), i.cast("string"), F.lit(":"), F.regexp_replace(x, "[0-9]+", "#"))),
        F.transform(keys, lambda x: F.concat(F.lit("query:"), x)))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x.isNotNull())))


def least_pages(total: int, min_support: float = MIN_SUPPORT) -> int:
    """Labelled pages, of ``total``, that a token or rule must rest on."""
    return max(MIN_PAGES, math.ceil(min_support * total))


def same_pages(labelled: DataFrame, pages: int) -> dict[str, str]:
    """Token -> the first token that is on exactly the same pages, for tokens on
    ``pages`` pages or more.

    Long URLs have many tokens that always come together; mined one by one,
    every subset of them would be a combination of its own with equal figures.
    The tokens are few: with n a page, less than n / ``MIN_SUPPORT``.
    """
    each = labelled.select(F.explode("tokens").alias("token"), "row")
    marks = [F.bit_xor(F.xxhash64("row", F.lit(n))).alias(f"mark{n}") for n in (1, 2)]
    found = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *marks).where(F.col("n") >= pages)
    groups = found.groupBy("n", "mark1", "mark2").agg(F.array_sort(F.collect_list("token")).alias("tokens")).collect()
    return {token: g["tokens"][0] for g in groups for token in g["tokens"]}


def as_first(tokens: Column, first: dict[str, str]) -> Column:
    """Tokens that have an entry in ``first``, as that entry."""
    other = {t: f for t, f in first.items() if t != f}
    out = F.array_intersect(tokens, F.array(*map(F.lit, first)).cast("array<string>"))
    if other:
        names = F.create_map(*[F.lit(x) for pair in other.items() for x in pair])
        out = F.transform(out, lambda t: F.coalesce(F.try_element_at(names, t), t))
    return F.array_sort(F.array_distinct(out))


def learn_rules(spark: SparkSession, urls: DataFrame, min_support: float = MIN_SUPPORT,
                max_chance: float = MAX_CHANCE) -> DataFrame:
    """``urls(tokens, label)`` -> ``rule_tokens, key, verdict, strength, confidence, lift, support``.

    ``support`` is the share of pages that hold the rule's tokens, ``strength``
    (confidence - share) / (1 - share) of its label.  The chance of n pages
    showing such a confidence is at most exp(-n * KL(confidence, share)).
    """
    columns = ("rule_tokens array<string>, key string, verdict string, strength double, confidence double, "
               "lift double, support double")
    total, good = urls.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if total <= MIN_PAGES or good in (0, total):
        return spark.createDataFrame([], columns)
    pages = least_pages(total, min_support)
    share = {BAD: 1 - good / total, GOOD: good / total}
    # a rule above its label's share rests on so many pages of that label
    joint = pages * min(share.values()) / total
    baskets = urls.select(F.concat("tokens", F.array(F.concat(F.lit("label="), F.col("label").cast("string")))).alias("items"))
    sets = stored(spark, FPGrowth(itemsCol="items", minSupport=joint).fit(baskets).freqItemsets, "url-itemsets")
    marks = F.array(F.lit(BAD), F.lit(GOOD))
    plain = (sets.where(~F.arrays_overlap("items", marks) & (F.col("freq") >= pages))
             .select(F.array_sort("items").alias("rule_tokens"), F.col("freq").alias("n")))
    marked = (sets.where(F.arrays_overlap("items", marks) & (F.size("items") > 1))
              .select(F.array_sort(F.array_except("items", marks)).alias("rule_tokens"), "freq",
                      F.when(F.array_contains("items", BAD), share[BAD]).otherwise(share[GOOD]).alias("share"),
                      F.when(F.array_contains("items", BAD), "block").otherwise("allow").alias("verdict")))
    tried = 2 * plain.count()
    if not tried:
        return spark.createDataFrame([], columns)
    p, q = F.col("confidence"), F.col("share")
    distance = p * F.log(p / q) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - q))).otherwise(0.0)
    rules = (marked.join(plain, "rule_tokens").withColumn("confidence", F.col("freq") / F.col("n"))
             .where((p > q) & (F.col("n") * distance >= math.log(tried / max_chance)))
             .select("rule_tokens", "verdict", ((p - q) / (1 - q)).alias("strength"), "confidence",
                     (p / q).alias("lift"), (F.col("n") / total).alias("support")))
    single = plain.where(F.size("rule_tokens") == 1).select(F.col("rule_tokens")[0].alias("token"), F.col("n").alias("freq"))
    key = (rules.select("rule_tokens", F.explode("rule_tokens").alias("token")).distinct().join(single, "token")
           .groupBy("rule_tokens").agg(F.min(F.struct("freq", "token"))["token"].alias("key")))
    return stored(spark, rules.join(key, "rule_tokens").select(
        "rule_tokens", "key", "verdict", "strength", "confidence", "lift", "support"), "url-rules")


def judge_urls(spark: SparkSession, pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, learned_rule`` per row of ``pages``.

    ``labels`` gives the quality (0 or 1) of the page with the same id.  A
    null URL, or one without ``://``, has an empty host and path; it is judged
    by its other tokens, if any.  Pages that no rule fits are allowed.
    Repeated rows each give a row; rows with a null id are judged but never
    learned from; empty tables give an empty result or no learned rules.
    Other columns (the page body) are not read.
    """
    quality = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
               .groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").alias("label")))
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    url = F.coalesce(F.col("url"), F.lit(""))
    parsed = page.withColumns({"host": host_of(url), "path": path_of(url)})
    labelled = stored(spark, parsed.join(quality, F.col("page_id") == F.col("label_id"))
                      .select(tokens(url, F.col("host"), F.col("path")).alias("tokens"), "label",
                              F.monotonically_increasing_id().alias("row")), "url-labelled")
    first = same_pages(labelled, least_pages(labelled.count()))
    learned = learn_rules(spark, labelled.withColumn("tokens", as_first(F.col("tokens"), first)))

    distinct = parsed.select("url", "host", "path").distinct().where(F.col("url").isNotNull())
    each = stored(spark, distinct.select("url", as_first(tokens(url, F.col("host"), F.col("path")), first).alias("tokens")), "url-tokens")
    fired = (each.select("url", "tokens", F.explode("tokens").alias("key")).join(learned, "key")
             .where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
             .groupBy("url").agg(F.max(F.struct("strength", "lift", "support", F.array_join("rule_tokens", " ").alias("text"),
                                                "verdict")).alias("best"))
             .select(F.col("url").alias("fired_url"), F.col("best.text").alias("learned_rule"),
                     F.col("best.verdict").alias("learned_verdict")))
    fired = stored(spark, fired, "url-fired")
    fit = fixed_rule(F.col("host"), F.col("path"), rules)
    return (parsed.join(fired, F.col("url") == F.col("fired_url"), "left").withColumn("fixed", fit)
            .select("page_id", "host", "path", F.col("fixed.rule").alias("rule"),
                    F.coalesce("fixed.verdict", "learned_verdict", F.lit("allow")).alias("verdict"), "learned_rule"))
