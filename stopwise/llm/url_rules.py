"""URL filter: fixed host rules and association rules mined from labels.

FP-growth finds combinations of URL tokens that are frequent among labelled
pages; those that are followed by the blocked label with enough support and
confidence become rules. A page's tokens, of its whole URL, find the rules through an
inverted index on each rule's rarest token. DataFrame and SQL functions only.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.llm.common import pick, stored

BLOCKED = "label=block"
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
MIN_LIFT = 1.2
MIN_ROWS = 20  # a rule rests on so many labelled rows, however few there are in all

# (verdict, host, path)
HostRule = tuple[str, str, str]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case;
    empty for null or without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host: Column, path: Column, rules: list[HostRule], field: str) -> Column:
    """``rule`` (as ``host/path``) or ``verdict`` of the longest rule that fits; null
    if none does. A rule fits its host and all subdomains, if the path starts with
    its own."""
    chosen = F.lit(None).cast("string")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        chosen = F.when(fits, F.lit(rule_host + rule_path if field == "rule" else verdict)).otherwise(chosen)
    return chosen


def url_tokens(url: Column) -> Column:
    """The URL's distinct tokens, of all its parts, marked by kind: scheme, last label of
    the host, last two, last three, every label before the last, every path segment, depth
    of the path, its ending, every query name and value, fragment and its text.

    Digits are made alike except in the scheme and the ends of the host. Apart from those
    ends a token does not tell the place of its part. Empty hosts have none."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), _UPPER, _LOWER)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(?s)^.*?://[^#]*(#.*)", 1)
    ending = F.regexp_extract(path, r"\.([^./]+)$", 1)
    parameters = F.split(query, "[&;]")

    def alike(value: Column) -> Column:
        return F.regexp_replace(value, "[0-9]+", "0")

    def last(n: int) -> Column:
        return F.when(F.size(labels) >= n, F.concat_ws(".", F.slice(labels, F.lit(-n), F.lit(n))))

    def named(name: str, value: Column) -> Column:
        return F.when(F.length(value) > 0, F.concat(F.lit(name + "="), value))

    def every(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: named(name, alike(v)))

    tokens = F.concat(
        F.array(
            named("scheme", scheme),
            named("top", last(1)),
            named("domain", last(2)),
            named("site", last(3)),
            named("depth", F.size(F.split(path, "/")).cast("string")),
            named("ending", alike(ending)),
            F.when(F.length(fragment) > 0, F.lit("fragment")),
            named("fragment", alike(F.substring(fragment, 2, 2**31 - 1))),
        ),
        every("label", F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0)))),
        every("segment", F.split(path, "/")),
        every("query", F.transform(parameters, lambda p: F.regexp_extract(p, r"(?s)^([^=]*)", 1))),
        every("value", F.transform(parameters, lambda p: F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1))),
    )
    return F.when(F.length(host) > 0, F.array_distinct(F.array_compact(tokens))).otherwise(F.array().cast("array<string>"))


def mine_rules(
    labelled: DataFrame,
    url: str = "url",
    blocked: str = "blocked",
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_lift: float = MIN_LIFT,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """``rule_id, tokens, confidence, support, lift, classes`` of the token sets that go with
    ``blocked`` in ``min_support`` of the rows and in ``min_rows`` rows; a rule that holds a shorter one of no less confidence is left out.

    Counts cover all rows of ``labelled``; a null label counts as not blocked. Tokens in
    fewer blocked rows than that are dropped before sets are sought, as no rule holds
    them. Tokens of exactly the same rows (by 128-bit hash) count as one: ``tokens`` has
    the first by name, ``classes`` for each all that may stand in its place. No blocked
    row, or no rows: no rules.
    """
    rows = stored(
        pick(labelled, url=url, blocked=blocked)
        .select(url_tokens(F.col("url")).alias("tokens"), F.coalesce(F.col("blocked").cast("boolean"), F.lit(False)).alias("b"))
        .filter(F.size("tokens") > 0)
        .select(F.monotonically_increasing_id().alias("id"), "tokens", "b")
    )
    spark = labelled.sparkSession
    kind = "tokens array<string>, confidence double, lift double, support double, rule_id long, classes array<array<string>>"
    total, blocked_rows = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("b").cast("long")), F.lit(0))).first()
    least = math.ceil(max(min_support * total, min_rows))
    if not total or blocked_rows < least:
        return spark.createDataFrame([], kind)
    single = rows.select("id", "b", F.explode("tokens").alias("token"))
    same = [F.bit_xor(F.xxhash64("id", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]
    kept = single.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("b").cast("long")).alias("bad"), *same)
    classes = stored(
        kept.filter(F.col("bad") >= least)
        .groupBy("n", "x1", "x2")
        .agg(F.sort_array(F.collect_list("token")).alias("class"))
        .select(F.col("class")[0].alias("token"), "class")
    )
    # One of each class is enough: the others are in the same rows.
    items = single.join(F.broadcast(classes.select("token")), "token").groupBy("id", "b").agg(F.collect_list("token").alias("items"))
    baskets = stored(items.select(F.when(F.col("b"), F.concat("items", F.array(F.lit(BLOCKED)))).otherwise(F.col("items")).alias("items")))
    left = baskets.count()
    if not left:
        return spark.createDataFrame([], kind)
    # Half a row less, so that the product with the number of baskets rounds up to ``least``.
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / left).fit(baskets)
    sets = stored(model.freqItemsets.select(F.sort_array("items").alias("items"), "freq"))
    both = sets.filter(F.array_contains("items", BLOCKED) & (F.size("items") > 1))
    found = (
        both.select(F.array_remove("items", BLOCKED).alias("items"), F.col("freq").alias("bad"))
        .join(sets, "items")
        .select(
            F.col("items").alias("tokens"),
            (F.col("bad") / F.col("freq")).alias("confidence"),
            (F.col("bad") / F.col("freq") / F.lit(blocked_rows / total)).alias("lift"),
            (F.col("bad") / F.lit(total)).alias("support"),
        )
        .filter((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))
        .withColumn("rule_id", F.xxhash64("tokens"))
    )
    found = stored(found)
    # Shorter rules that a rule holds: found through each of its tokens.
    one = found.select(F.col("rule_id").alias("long_id"), F.col("tokens").alias("long"), F.col("confidence").alias("own"), F.explode("tokens").alias("token"))
    two = found.select(F.col("tokens").alias("short"), "confidence", F.col("tokens")[0].alias("token"))
    implied = (
        one.join(two, "token")
        .filter((F.size("short") < F.size("long")) & (F.size(F.array_except("short", "long")) == 0) & (F.col("confidence") >= F.col("own")))
        .select("long_id")
        .distinct()
    )
    chosen = found.join(implied, found["rule_id"] == implied["long_id"], "left_anti")
    standing = (
        chosen.select("rule_id", F.posexplode("tokens").alias("at", "token"))
        .join(classes, "token")
        .groupBy("rule_id")
        .agg(F.sort_array(F.collect_list(F.struct("at", "class"))).alias("parts"))
        .select("rule_id", F.col("parts.class").alias("classes"))
    )
    return stored(chosen.join(standing, "rule_id").select("tokens", "confidence", "lift", "support", "rule_id", "classes"))


def match_rules(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``tokens, confidence``: the best confidence of any rule for every distinct
    token set of ``urls`` that a rule matches: one of each of its ``classes`` is in the
    set, or, of rules without that column, all of its ``tokens``.

    Each rule is filed under its rarest token, or the class whose tokens are rarest
    together. Rows are first reduced to their distinct token sets, with partial sums,
    so a frequent URL costs one look-up.
    """
    if "classes" not in rules.columns:
        rules = rules.withColumn("classes", F.transform("tokens", lambda t: F.array(t)))
    sets = stored(pick(urls, url=url).select(url_tokens(F.col("url")).alias("tokens")).filter(F.size("tokens") > 0).distinct())
    tokens = sets.select("tokens", F.explode("tokens").alias("token"))
    members = rules.select("rule_id", F.posexplode("classes").alias("at", "class")).select("rule_id", "at", "class", F.explode("class").alias("token"))
    often = tokens.join(members.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("often"))
    # A class with a token in no set may still have others; one without any fits no set.
    chosen = (
        members.join(often, "token")
        .groupBy("rule_id", "at")
        .agg(F.sum("often").alias("often"), F.collect_list("token").alias("class"))
        .groupBy("rule_id")
        .agg(F.min_by("class", F.struct("often", "at")).alias("class"))
    )
    filed = chosen.join(rules.select("rule_id", "confidence", "classes"), "rule_id").select(
        F.explode("class").alias("token"), "confidence", "classes"
    )
    return (
        tokens.join(filed, "token")
        .filter(F.forall("classes", lambda c: F.arrays_overlap(c, F.col("tokens"))))
        .groupBy("tokens")
        .agg(F.max("confidence").alias("confidence"))
    )


def judge(
    df: DataFrame, rules: DataFrame, host_rules: list[HostRule], key: str = "page_id", url: str = "url"
) -> DataFrame:
    """``key, url, host, path, rule, verdict, confidence`` of every row.

    The longest fitting host rule decides; else a mined rule blocks, with its
    confidence; else the row is allowed. Null urls and such without ``://`` have an
    empty host and path and are allowed. Repeated rows and null keys stay as they are.
    """
    rows = pick(df, key=key, url=url)
    matched = match_rules(df, rules, url)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = rows.select("key", "url", host.alias("host"), path.alias("path"), url_tokens(F.col("url")).alias("tokens"))
    joined = parsed.join(matched, "tokens", "left")
    by_method = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    chosen = [host_rule(F.col("host"), F.col("path"), host_rules, f) for f in ("rule", "verdict")]
    return joined.select(
        F.col("key").alias(key),
        "url",
        "host",
        "path",
        chosen[0].alias("rule"),
        F.coalesce(chosen[1], by_method).alias("verdict"),
        "confidence",
    )
