"""URL filtering: fixed host rules first, then association rules mined from labels.

FP-growth mines combinations of URL tokens that go with a label. The two labels are seldom equally frequent, so a rule's confidence is
held against its label's share of all labelled urls: rules below ``MIN_LIFT`` times that share or below the least support are pruned, and so are those that a
one-sided binomial test at ``LEVEL`` (normal approximation with continuity correction) doesn't tell from it,
and those that a shorter one with the same verdict and no less confidence covers. The rest are matched by an inverted index: a rule is filed under its rarest token;
urls that have this token are looked at, and the rule fires if all its tokens are there.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged by its tokens like any other; no
labels, too few, or no rule that survives: the verdict is ``allow``; of several rules that fire, the most confident wins, then the larger
support, then ``block``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: (verdict, host, path); fixed by the task.
HOST_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT = 0.01
#: A rule's confidence must be so many times its label's share, and significantly above it: LEVEL_Z is the normal quantile of 1 - LEVEL.
MIN_LIFT, LEVEL, LEVEL_Z = 1.25, 0.01, 2.3263
#: A rule must hold for so many labelled urls at least; with fewer labelled urls nothing is mined.
MIN_ROWS = 20
#: Items that stand for a label can't be tokens: tokens hold no blank.
LABEL = {"block": "label block", "allow": "label allow"}


def parts(url: Column) -> tuple[Column, Column]:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def host_rule(host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest host rule that fits, or nulls."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(HOST_RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Sorted distinct tokens: runs of letters and digits, A-Z in lower case, digits as one #."""
    plain = F.regexp_replace(ascii_lower(F.coalesce(url, F.lit(""))), r"[0-9]+", "#")
    return F.array_sort(F.array_distinct(F.filter(F.split(plain, r"[^\p{L}#]+"), lambda t: t != "")))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_lift: float = MIN_LIFT) -> DataFrame:
    """labelled(tokens, verdict) to rule_id, wanted (the tokens), verdict, confidence, support."""
    rows, bad = labelled.agg(F.count("*"), F.sum((F.col("verdict") == "block").cast("long"))).first()
    shares = {"block": bad / rows, "allow": 1 - bad / rows}
    items = labelled.select(F.concat("tokens", F.array(F.when(F.col("verdict") == "block", LABEL["block"]).otherwise(LABEL["allow"]))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, MIN_ROWS / rows), minConfidence=min(1.0, min_lift * min(shares.values()))).fit(items)
    verdict = F.when(F.col("consequent")[0] == LABEL["block"], "block").when(F.col("consequent")[0] == LABEL["allow"], "allow")
    share = F.when(F.col("verdict") == "block", shares["block"]).otherwise(shares["allow"])
    held, times = F.col("support") * rows, F.col("support") * rows / F.col("confidence")
    surprising = (F.col("confidence") >= min_lift * share) & (held - 0.5 - times * share >= LEVEL_Z * F.sqrt(times * share * (1 - share)))
    found = materialize(
        model.associationRules.select(F.array_sort("antecedent").alias("wanted"), verdict.alias("verdict"), "confidence", "support")
        .filter(F.col("verdict").isNotNull() & ~F.exists("wanted", lambda t: t.isin(*LABEL.values())))
        .withColumn("rule_id", F.xxhash64("wanted", "verdict"))
        .filter(surprising)
    )
    # A rule is pruned if a proper part of it is a rule with the same verdict and at least its confidence. A part of it is met under
    # the part's first token, so only rules that share a token are looked at.
    by_token = found.select("rule_id", "verdict", "confidence", "wanted", F.explode("wanted").alias("token")).alias("l")
    shorter = found.select(F.col("wanted").alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("c"), F.col("wanted")[0].alias("token")).alias("s")
    covered = by_token.join(shorter, "token").filter(
        (F.col("l.verdict") == F.col("s.v")) & (F.col("s.c") >= F.col("l.confidence")) & (F.size("s.part") < F.size("l.wanted")) & (F.size(F.array_except("s.part", "l.wanted")) == 0)
    )
    return found.join(covered.select("rule_id").distinct(), "rule_id", "left_anti")


def fire(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """token_sets(tokens, n) to tokens, mined (the rule's tokens), mined_verdict, confidence of the best rule that fires."""
    common = token_sets.select(F.explode("tokens").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("df"))
    filed = (
        rules.select("*", F.explode("wanted").alias("token"))
        .join(common, "token")
        .groupBy("rule_id")
        .agg(F.min(F.struct("df", "token")).alias("rarest"), *[F.first(c).alias(c) for c in ("wanted", "verdict", "confidence", "support")])
        .select(F.col("rarest.token").alias("token"), "wanted", "verdict", "confidence", "support")
    )
    met = token_sets.select("tokens", F.explode("tokens").alias("token")).join(filed, "token").filter(F.size(F.array_except("wanted", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", (F.col("verdict") == "block").alias("blocks"), F.array_join("wanted", " ").alias("mined")))
    return met.groupBy("tokens").agg(best.alias("b")).select("tokens", F.col("b.mined").alias("mined"), F.when(F.col("b.blocks"), "block").otherwise("allow").alias("mined_verdict"), F.col("b.confidence").alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame, min_support: float = MIN_SUPPORT, min_lift: float = MIN_LIFT) -> DataFrame:
    """pages(page_id, url) as page_id, host, path, rule, verdict, mined, confidence; labelled(url, verdict) teaches the rules."""
    taught = materialize(labelled.select(tokens(F.col("url")).alias("tokens"), "verdict"))
    host, path = parts(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"), tokens(F.col("url")).alias("tokens"))
    cut = cut.withColumn("fixed", host_rule(F.col("host"), F.col("path")))
    if taught.count() < MIN_ROWS:
        nothing = F.lit(None).cast("string")
        return cut.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", F.lit("allow")).alias("verdict"), nothing.alias("mined"), F.lit(None).cast("double").alias("confidence"))
    sets = cut.groupBy("tokens").agg(F.count("*").alias("n"))
    fired = fire(sets, materialize(mine(taught, min_support, min_lift)))
    return cut.join(fired, "tokens", "left").select(
        "page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", "mined_verdict", F.lit("allow")).alias("verdict"), "mined", "confidence"
    )
