"""URL filter: fixed rules, then association rules mined from labelled pages.

A URL becomes a set of tokens (scheme, host, its domains and names, folders, extension, query keys and so on). Spark's FP-growth mines
token combinations together with the label of the page, and rules under the confidence and support limits are left out. A rule is filed under
its rarest token (an inverted index), so a set of tokens meets few rules, and the most confident rule that fits decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceweave.llm.common import ascii_lower
from spliceweave.session import cut_lineage

#: (verdict, host and path) in force before any mined rule.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_match(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits host and path, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tested first
        name, _, folder = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{folder}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens of a URL."""
    labels = F.split(host, r"\.")
    last = F.regexp_extract(path, r"([^/]*)/?$", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    token = lambda kind, c: F.when(F.length(c) > 0, F.concat(F.lit(kind), c))
    several = lambda kind, c: F.coalesce(F.transform(c, lambda x: token(kind, x)), F.array().cast("array<string>"))
    tokens = F.array(
        token("scheme:", ascii_lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
        token("host:", host),
        token("top:", F.element_at(labels, -1)),
        token("ext:", F.regexp_extract(last, r"\.([A-Za-z0-9]{1,5})$", 1)),
        token("digits:", F.when(F.length(F.regexp_extract(last, r"^(\d+)", 1)) > 0, F.length(F.regexp_extract(last, r"^(\d+)", 1)).cast("string"))),
        token("end:", F.when(path.endswith("/"), F.lit("slash"))),
        token("part:", F.when(F.contains(url, F.lit("#")), F.lit("fragment"))),
    )
    n = F.size(labels)
    inner = F.when(n > 2, F.sequence(F.lit(2), n - 1))
    domains = F.transform(inner, lambda i: F.array_join(F.slice(labels, i, n), "."))
    names = F.when(n > 2, F.slice(labels, F.lit(1), n - 2))
    folders = F.regexp_extract_all(F.regexp_replace(path, r"\d+[^/]*/?$", ""), F.lit(r"([^/]+)/"), 1)
    keys = F.regexp_extract_all(query, F.lit(r"([^&=]+)=?[^&]*"), 1)
    found = F.concat(tokens, several("domain:", domains), several("name:", names), several("folder:", folders), several("query:", keys))
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def labelled_tokens(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, verdict) of labelled pages: ``block`` if the document that the URL's last number names is poor or toxic."""
    doc = F.expr("try_cast(regexp_extract(path, '(\\\\d+)[^/]*/?$', 1) AS bigint)")
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(bad).alias("bad"))
    return pages.select("tokens", doc.alias("doc_id")).join(marks, "doc_id").select(
        "tokens", F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))


def merged_tokens(labelled: DataFrame) -> DataFrame:
    """(items, verdict): ``labelled`` with tokens that always occur together as one item.

    The item has the name of its widest token: of its domains the shortest, else its host, else a name, else the shortest of the others. Without that, n tokens that only occur together would make 2^n combinations of equal support; what is counted stays the same.
    """
    rows = labelled.withColumn("key", F.array_join("tokens", "\n"))
    sets = cut_lineage(rows.groupBy("key").agg(F.first("tokens").alias("tokens")))
    seen = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("a"), F.bit_xor(F.xxhash64(F.lit("other"), "key")).alias("b")]
    tokens = sets.select("key", F.explode("tokens").alias("token")).groupBy("token").agg(*seen)
    kind = F.when(F.startswith("token", F.lit("domain:")), 0).when(F.startswith("token", F.lit("host:")), 1).when(F.startswith("token", F.lit("name:")), 2).otherwise(3)
    widest = F.min(F.struct(kind.alias("kind"), F.length("token").alias("size"), "token")).alias("widest")
    names = tokens.groupBy("n", "a", "b").agg(widest).select("widest.token")
    kept = sets.select("key", F.explode("tokens").alias("token")).join(names, "token").groupBy("key").agg(F.collect_list("token").alias("items"))
    none = F.array().cast("array<string>")
    return rows.select("key", "verdict").join(kept, "key", "left").select(F.coalesce("items", none).alias("items"), "verdict")


def confidence_floor(hits: Column, n: Column, z: float) -> Column:
    """Lower end of the score interval of hits / n at ``z`` standard errors."""
    share, extra = hits / n, F.lit(z * z) / n
    return (share + extra / 2 - z * F.sqrt((share * (1 - share) + extra / 4) / n)) / (1 + extra)


def mine_rules(labelled: DataFrame, min_pages: int = 10, min_confidence: float = 0.5, min_lift: float = 1.2, z: float = 3.0) -> DataFrame:
    """(rule_id, rarest, tokens, verdict, confidence, support) of rules from token combinations to a verdict.

    A rule needs ``min_pages`` pages that it gets right, a number that doesn't grow with the table, so that a rare host can have its rule. Chance is
    kept out by the confidence limit: it must hold for the confidence less ``z`` standard errors (ten of ten right pages reach 0.52).
    ``rarest`` is the token under which the rule is filed. An empty ``labelled`` gives no rules.
    """
    verdicts = F.array(F.lit("verdict:block"), F.lit("verdict:allow"))
    items = cut_lineage(merged_tokens(labelled).select(F.concat("items", F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items")))
    total = items.count()
    if not total:
        return items.sparkSession.createDataFrame([], "rule_id long, rarest string, tokens array<string>, verdict string, confidence double, support double")
    # half a page less, so that rounding of the share can't lose combinations of exactly min_pages
    model = FPGrowth(itemsCol="items", minSupport=max(min_pages - 0.5, 0) / total).fit(items)
    frequent = cut_lineage(model.freqItemsets.select(
        F.array_sort(F.array_except("items", verdicts)).alias("tokens"), F.get(F.array_intersect("items", verdicts), F.lit(0)).alias("verdict"), "freq"))
    plain = frequent.filter("verdict IS NULL").select("tokens", F.col("freq").alias("n"))
    base = frequent.filter("verdict IS NOT NULL AND size(tokens) = 0").select("verdict", (F.col("freq") / total).alias("share"))
    right = frequent.filter("verdict IS NOT NULL AND size(tokens) > 0").withColumnRenamed("freq", "hits")
    share = F.col("hits") / F.col("n")
    kept = cut_lineage(
        right.join(plain, "tokens").filter(confidence_floor(F.col("hits"), F.col("n"), z) >= min_confidence)
        .join(base, "verdict").filter(share / F.col("share") >= min_lift)
        .select("tokens", F.regexp_replace("verdict", "^verdict:", "").alias("verdict"), share.alias("confidence"), (F.col("hits") / total).alias("support"),
                F.xxhash64("tokens", "verdict").alias("rule_id")))
    single = plain.filter(F.size("tokens") == 1).select(F.get("tokens", F.lit(0)).alias("token"), F.col("n").alias("freq"))
    filed = (
        kept.select("rule_id", F.explode("tokens").alias("token")).join(single, "token")
        .groupBy("rule_id").agg(F.min(F.struct("freq", "token")).alias("least"))
    )
    return kept.join(filed, "rule_id").select("rule_id", F.col("least.token").alias("rarest"), "tokens", "verdict", "confidence", "support")


def match_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, verdict) of the best rule that fits each token set (key, tokens): most confident, best supported, longest, ``block`` on a tie."""
    met = (
        token_sets.select("key", F.col("tokens").alias("have"), F.explode("tokens").alias("rarest")).join(rules, "rarest")
        .filter(F.size(F.array_except("tokens", "have")) == 0)
    )
    best = F.max(F.struct("confidence", "support", F.size("tokens").alias("n"), "verdict", "rule_id"))
    return met.groupBy("key").agg(best.alias("best")).select("key", F.col("best.verdict").alias("mined"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, min_pages: int = 10,
               min_confidence: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    The longest fixed rule decides; without one the best mined rule; without that the page is allowed. A null url, or one without ``://``,
    has an empty host and path and no tokens, and is allowed. Rows are kept one to one; other columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    rule, verdict = rule_match(F.col("host"), F.col("path"), rules)
    parts = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    tokens = url_tokens(F.coalesce("url", F.lit("")), F.col("host"), F.col("path"))
    rows = parts.withColumns({"rule": rule, "fixed": verdict, "tokens": tokens}).withColumn("key", F.array_join("tokens", "\n"))
    mined = mine_rules(labelled_tokens(rows, labels), min_pages, min_confidence)
    sets = rows.filter("fixed IS NULL").groupBy("key").agg(F.first("tokens").alias("tokens"))
    blocked = cut_lineage(match_rules(sets, cut_lineage(mined)).filter("mined = 'block'"))
    return rows.join(blocked, "key", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("fixed", "mined", F.lit("allow")).alias("verdict"))
