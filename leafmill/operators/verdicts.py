"""What becomes of each URL: skipped, rewritten or passed, by structure, guards and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import urls
from leafmill.functions.text import replace_first
from leafmill.sources.rules import Action, Rule, java_pattern, java_replacement, valid_java

# The reasons of the structural checks and guards.
NOT_HTTPS = "URL does not begin with HTTPS"
NOT_PARSED = "URL could not be parsed"
NO_HOST = "URL has no host"
MEDIA_FILE = "non-content file extension"
IMAGE_PROXY = "image proxy endpoint"
IP_HOST = "IP-address host"
LOCAL = "local address"
SKIPPED = "skipped (not content)"


def with_verdict(df: DataFrame, source: str, rules: list[Rule] = (), prefix: str = "") -> DataFrame:
    """``df`` with target, verdict, reason and rule of URL column ``source``.

    Checks come in the order https, fragment, parse, host, lower case, guards,
    rules (the first match wins), canonical form. verdict is skipped, rewritten or
    passthrough; target is null if skipped; rule names the rule behind a skip or a
    rewrite. A null URL is skipped as not HTTPS. Each step is a projection of its
    own, so that no expression is written out more than once.
    """
    spark = df.sparkSession
    keep = df.columns
    u = F.col("_u")
    location = urls.netloc(u)
    staged = (
        df.withColumn("_u", F.substring_index(F.coalesce(F.col(source), F.lit("")), "#", 1))
        .withColumn("_at", location)
        .withColumn("_low", F.concat(F.lit("https://"), F.lower("_at"), F.substr(u, F.length("_at") + 9)))
        .withColumn("_host", F.lower("_at"))
        .withColumn("_bare", F.regexp_replace(F.regexp_replace("_host", r"^www\.", ""), r":.*\z", ""))
        .withColumn("_domain", urls.domain_for_url(F.col("_low")))
    )
    brackets = F.regexp_count("_at", F.lit(r"\[")) != F.regexp_count("_at", F.lit(r"\]"))
    guard = (
        F.when(~F.coalesce(F.startswith(F.col(source), F.lit("https://")), F.lit(False)), NOT_HTTPS)
        .when(brackets, NOT_PARSED)
        .when(F.col("_at") == "", NO_HOST)
        .when(F.lower(urls.path(F.col("_low"))).rlike(r"\.(?:%s)\z" % "|".join(urls.MEDIA)), MEDIA_FILE)
        .when(F.col("_low").contains("/_next/image"), IMAGE_PROXY)
        .when(F.col("_bare").rlike(r"^\d{1,3}(?:\.\d{1,3}){3}\z"), IP_HOST)
        .when(F.col("_bare") == "localhost", LOCAL)
    )
    staged = staged.withColumn("_guard", guard)
    number = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        number = F.when(_matches(spark, rule), F.lit(i)).otherwise(number)
    staged = staged.withColumn("_rule", F.when(F.col("_guard").isNull(), number))
    result, reason, name = F.col("_low"), F.col("_guard"), F.lit(None).cast("string")
    for i, rule in enumerate(rules):
        changed, skip = _applied(spark, rule.actions)
        mine = F.col("_rule") == i
        result = F.when(mine, changed).otherwise(result)
        name = F.when(mine, F.lit(rule.name)).otherwise(name)
        if skip:
            reason = F.when(mine, F.lit(skip)).otherwise(reason)
    staged = staged.withColumn("_result", result).withColumn("_reason", reason).withColumn("_name", name)
    # a filter on the result stops here: pushed further down it would hold all the steps written out
    staged = urls.with_canonical(staged, "_result", "_canonical").withColumn("_row", F.monotonically_increasing_id())
    skipped = F.col("_reason").isNotNull() | (F.col("_row") < 0)
    moved = F.col("_result") != F.col("_low")
    return staged.select(
        *keep,
        F.when(~skipped, F.col("_canonical")).alias(f"{prefix}target"),
        F.when(skipped, "skipped").when(moved, "rewritten").otherwise("passthrough").alias(f"{prefix}verdict"),
        F.col("_reason").alias(f"{prefix}reason"),
        F.when(skipped | moved, F.col("_name")).alias(f"{prefix}rule"),
    )


def _matches(spark, rule: Rule) -> Column:
    if rule.match_type == "domain":
        return F.col("_domain") == rule.pattern
    if rule.match_type == "host":
        return F.col("_host") == rule.pattern
    if rule.match_type == "starts_with":
        return F.startswith(F.col("_low"), F.lit(rule.pattern))
    pattern = java_pattern(rule.pattern)
    return F.col("_low").rlike(pattern) if valid_java(spark, pattern) else F.lit(False)


def _applied(spark, actions: tuple[Action, ...]) -> tuple[Column, str | None]:
    """The URL after the actions, and the reason if one of them skips it."""
    url = F.col("_low")
    for a in actions:
        if a.type == "skip":
            return F.lit(None).cast("string"), a.reason or SKIPPED
        if a.type == "prepend":
            url = F.concat(F.lit(a.text), url)
        elif a.type == "replace":
            url = F.replace(url, F.lit(a.old), F.lit(a.new))
        elif valid_java(spark, java_pattern(a.pattern)):
            url = replace_first(url, java_pattern(a.pattern), java_replacement(a.replacement))
    return url, None


def registered(df: DataFrame, source: str, order: str, rules: list[Rule] = ()) -> DataFrame:
    """(url, original_url, domain, slug): new pending pages of ``df``'s URLs, skips left out.

    Of several URLs with one target the first by ``order``, then by itself, is the original.
    """
    told = with_verdict(df.select(source, order), source, rules).where("target is not null")
    first = told.groupBy(F.col("target").alias("url")).agg(F.min(F.struct(order, source))[source].alias("original_url"))
    domain = urls.domain_for_url(F.col("url"))
    return first.withColumn("domain", domain).withColumn("slug", urls.slug_for_url(F.col("url"), F.col("domain")))
