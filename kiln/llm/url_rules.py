"""URL filters by association rules (operator 1).  DataFrame, SQL and Spark ML functions only.

Fixed rules (``host/path``) are judged first: a rule fits its host and all subdomains if the url's
path starts with the rule's; the longest wins.  Other urls are judged by mined rules: FP-growth on the
labelled pages finds combinations of url tokens (scheme, host labels, path words, file ending, query
keys; numbers are no tokens) that imply a bad page.  Tokens that stand in the very same labelled urls are one
item, named by the first of them, so the words of one often repeated url make one item and not all their
combinations; a url holds an item if it holds one of its tokens.  A rule stays if its support and confidence
reach their bounds, the lower bound of its confidence (Wilson, SURE deviations) is above the share of bad
pages, and no rule with one item less is as confident.  Each rule is listed once in
an inverted index, under its rarest item; distinct token sets look it up and must hold all its items.

Null urls and urls without ``://``: empty host and path, no tokens, allowed.  Repeated rows are judged
each.  Without labelled pages, or if no rule passes, every url open to them is allowed.  Empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from kiln.llm.shared import stored

#: The rules of the contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MIN_SUPPORT, MIN_CONFIDENCE, MIN_COUNT = 0.002, 0.5, 5
SURE = 3.0
BAD = "=bad"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path) of a url; both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UP, _LOW), path


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fixed rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens of a url, each with the part that it stands in."""
    low = F.translate(F.coalesce(url, F.lit("")), _UP, _LOW)
    tag = lambda kind, words: F.transform(words, lambda x: F.concat(F.lit(kind), x))
    scheme = F.when(F.instr(low, "://") > 1, F.array(F.substring_index(low, "://", 1))).otherwise(F.array().cast("array<string>"))
    stem = F.regexp_replace(F.translate(path, _UP, _LOW), r"\.([a-z][a-z0-9]*)$", "")
    ending = F.regexp_extract_all(F.translate(path, _UP, _LOW), F.lit(r"\.([a-z][a-z0-9]*)$"), F.lit(1))
    keys = F.regexp_extract_all(low, F.lit(r"[?&]([^=&#]+)"), F.lit(1))
    words = F.concat(tag("scheme:", scheme), tag("host:", F.split(host, r"[.:@]")), tag("path:", F.split(stem, r"[^\p{L}\p{N}]+")),
                     tag("end:", ending), tag("key:", keys))
    return F.array_sort(F.array_distinct(F.filter(words, lambda x: ~x.rlike(r":[0-9]*$"))))


def token_items(sets: DataFrame, least: int) -> DataFrame:
    """(token, item) of the tokens in at least ``least`` baskets: tokens of the same baskets have one item.

    ``sets`` (tokens, n) has each distinct token set once.  A token's baskets are told by two exclusive-ors of set hashes."""
    told = [F.bit_xor(F.xxhash64(F.lit(i), "tokens")).alias(f"told{i}") for i in range(2)]
    per_token = (sets.withColumn("token", F.explode("tokens")).groupBy("token").agg(F.sum("n").alias("n"), *told)
                 .where(F.col("n") >= least))
    alike = per_token.groupBy("n", "told0", "told1").agg(F.min("token").alias("item"), F.collect_list("token").alias("token"))
    return alike.select(F.explode("token").alias("token"), "item")


def with_items(sets: DataFrame, items: DataFrame) -> DataFrame:
    """(tokens, items): the distinct items of each of the distinct token sets that holds one."""
    each = sets.select("tokens", F.explode("tokens").alias("token")).join(items, "token")
    return each.groupBy("tokens").agg(F.array_sort(F.collect_set("item")).alias("items"))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """((rule_id, needs, confidence, support, rarest), (token, item)) from ``labelled`` (tokens, bad boolean)."""
    spark = labelled.sparkSession
    none = (spark.createDataFrame([], "rule_id long, needs array<string>, confidence double, support double, rarest string"),
            spark.createDataFrame([], "token string, item string"))
    pages = stored(labelled.where(F.size("tokens") > 0).select("tokens", "bad"), "baskets")
    n, n_bad = pages.agg(F.count("*"), F.count_if("bad")).first()
    if not n:
        return none
    least = max(MIN_COUNT, math.ceil(min_support * n - 1e-9))
    sets = pages.groupBy("tokens").agg(F.count("*").alias("n"))
    items = stored(token_items(sets, least), "url-items")
    baskets = stored(pages.join(with_items(sets, items), "tokens").select(
        F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")), "baskets")
    held = baskets.count()
    if held < least:
        return none
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / held, minConfidence=min_confidence).fit(baskets)
    hits = F.col("support") * held / F.col("confidence")                    # urls that hold the antecedent
    z2 = SURE * SURE
    c = F.col("confidence")
    low = (c + z2 / (2 * hits) - SURE * F.sqrt(c * (1 - c) / hits + z2 / (4 * hits * hits))) / (1 + z2 / hits)
    rules = stored(model.associationRules.where((F.col("consequent") == F.array(F.lit(BAD))) & (low > n_bad / n))
                   .select(F.array_sort("antecedent").alias("needs"), "confidence", "support"), "rules")
    smaller = (rules.select("needs", "confidence", F.explode("needs").alias("x"))
               .select("needs", "confidence", F.array_except("needs", F.array("x")).alias("part")))
    weaker = (smaller.join(rules.select(F.col("needs").alias("part"), F.col("confidence").alias("c")), "part")
              .where("c >= confidence").select("needs").distinct())
    strong = rules.join(weaker, "needs", "left_anti")
    counts = baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    listed = strong.select("*", F.explode("needs").alias("item")).join(counts, "item")
    rarest = listed.groupBy("needs").agg(F.min_by("item", F.struct("n", "item")).alias("rarest"), F.first("confidence").alias("confidence"),
                                         F.first("support").alias("support"))
    return stored(rarest.select(F.xxhash64("needs").alias("rule_id"), "needs", "confidence", "support", "rarest"), "url-rules"), items


def match_rules(sets: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """(tokens, best): for each distinct token set that a rule fits, its most confident rule."""
    index = rules.select(F.col("rarest").alias("item"), "rule_id", "needs", "confidence", "support")
    found = (with_items(sets, items).withColumn("item", F.explode("items")).join(index, "item")
             .where(F.size(F.array_except("needs", "items")) == 0))
    return found.groupBy("tokens").agg(F.max(F.struct("confidence", "support", "needs")).alias("best"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT,
               min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule, confidence) for every row of ``pages``."""
    host, path = url_parts(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    judged = judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("fixed"),
                           url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    truth = (labels.where("doc_id is not null").groupBy("doc_id")
             .agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad")))
    mined, items = mine_rules(judged.join(truth, judged.page_id == truth.doc_id).select("tokens", "bad"), min_support, min_confidence)
    open_ = judged.where("fixed is null")
    hits = match_rules(open_.select("tokens").distinct(), mined, items)
    matched = open_.join(hits, "tokens", "left").unionByName(judged.where("fixed is not null"), allowMissingColumns=True)
    return matched.select("page_id", "host", "path", "rule",
                          F.coalesce("fixed", F.when(F.col("best").isNotNull(), "block").otherwise("allow")).alias("verdict"),
                          F.array_join("best.needs", " ").alias("mined_rule"), F.col("best.confidence").alias("confidence"))
