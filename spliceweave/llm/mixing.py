"""Mixing sources to target weights by hierarchical budgets.

Leaves are (domain, language, source). A node's budget is shared among its children by weight; a child gets at most what its
leaves can give in ``max_epochs`` passes. What a child can't give goes to its siblings by weight, and only what a whole node can't give
goes to the node's own siblings. A leaf takes whole epochs, then the prefix of one more epoch in a seeded order, up to its budget.

All of it is joins, sums and windows over small tables. Documents are ordered in blocks of hash prefixes: only the block in which a leaf's
budget ends is sorted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceweave.llm.common import SPACE_RUN, only_names
from spliceweave.session import cut_lineage

LEVELS = ("domain", "lang", "source")
DOMAIN_WEIGHTS = {"web": 4, "books": 3, "news": 2, "forum": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
NO_NAME = "none"


def domain_of(source: Column) -> Column:
    """Domain of a source by its number modulo 4; ``web`` for sources without a number."""
    number = F.coalesce(F.regexp_extract(source, r"(\d{1,9})$", 1).try_cast("int"), F.lit(0))
    return F.element_at(F.array(*[F.lit(d) for d in DOMAIN_WEIGHTS]), number % 4 + 1)


def token_count(text: Column) -> Column:
    """Words of a text, the unit of budgets."""
    words = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_RUN, " "))
    return F.when(words == "", F.lit(0)).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "))) + 1).cast("long")


def weight_of(c: Column, weights: Mapping[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, w in weights.items():
        out = F.when(c == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children`` (parent..., name, weight, can, pot) with ``budget``: the pot by weight, none over ``can``.

    Children are taken by ``can / weight``; while the next one can't use its share of what is left it gets all it can, and
    the rest share by weight, rounded down. Children of weight 0 get nothing. One window row a child.
    """
    order = [F.col("can") / F.col("weight"), F.col(name)]
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    big = lambda c: c.cast("decimal(19,0)")
    ranked = (
        children.filter("weight > 0")
        .withColumn("pool", F.col("pot") - F.coalesce(F.sum("can").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(onward))
        .withColumn("short", big(F.col("can")) * big(F.col("rest")) <= big(F.col("pool")) * big(F.col("weight")))
    )
    own = Window.partitionBy(*parent)
    at = F.max(F.when(~F.col("short"), F.struct("rest", "pool"))).over(own)  # the first child with enough has the most rest
    return (
        ranked.withColumn("at", at)
        .withColumn("budget", F.when(F.col("short"), F.col("can")).otherwise(F.expr("cast(at.pool * cast(weight as decimal(19,0)) div at.rest as bigint)")))
        .drop("pool", "rest", "short", "at")
    )


def leaf_budgets(leaves: DataFrame, total: Column, max_epochs: int, domain_weights: Mapping[str, int] = DOMAIN_WEIGHTS,
                 lang_weights: Mapping[str, int] = LANG_WEIGHTS, other: int = 1) -> DataFrame:
    """``leaves`` (domain, lang, source, docs, tokens) with ``budget``; ``total`` is a column over the root's ``tokens``."""
    can = F.col("tokens") * max_epochs
    leaf = leaves.withColumn("can", can).withColumn("weight", F.lit(1).cast("long"))
    lang = leaf.groupBy("domain", "lang").agg(F.sum("can").alias("can")).withColumn("weight", weight_of(F.col("lang"), lang_weights, other))
    domain = (
        lang.groupBy("domain").agg(F.sum(F.when(F.col("weight") > 0, F.col("can")).otherwise(0)).alias("can"))
        .withColumn("weight", weight_of(F.col("domain"), domain_weights, other)).withColumn("root", F.lit(0))
    )
    root = leaves.agg(F.sum("tokens").alias("tokens")).select(F.lit(0).alias("root"), total.cast("long").alias("pot"))
    got = share_out(domain.join(F.broadcast(root), "root"), ["root"], "domain").select("domain", F.col("budget").alias("pot"))
    got = share_out(lang.join(got, "domain"), ["domain"], "lang").select("domain", "lang", F.col("budget").alias("pot"))
    got = share_out(leaf.join(got, ["domain", "lang"]), ["domain", "lang"], "source")
    return leaves.join(got.select(*LEVELS, "budget"), list(LEVELS), "left").withColumn("budget", F.coalesce("budget", F.lit(0).cast("long")))


def leaf_columns() -> dict[str, Column]:
    """Leaf of a document: null lang and source count as one named ``none``."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(NO_NAME))
    return {"domain": domain_of(source), "lang": F.coalesce(F.col("lang").cast("string"), F.lit(NO_NAME)), "source": source}


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def narrow(docs: DataFrame) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, text_hash): all that planning needs of the texts, from one pass over them."""
    return docs.select("doc_id", *[c.alias(n) for n, c in leaf_columns().items()], token_count(F.col("text")).alias("n_tokens"), text_hash().alias("text_hash"))


def _placed(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Rows with their leaf's plan, and their place (key) and block in the seeded order of the leaf's last epoch."""
    bits = "cast(power(2, 23 - least(bits, 23)) as bigint)"
    return rows.join(plan, list(LEVELS)).withColumn("key", F.xxhash64(F.lit(seed), F.col("full"), F.col("doc_id"), F.col("text_hash"))).withColumn(
        "block", F.expr(f"cast(shiftrightunsigned(key ^ (-9223372036854775807 - 1), 41) div {bits} as bigint)"))  # first bits, in the key's order


def plan_mix(rows: DataFrame, fraction: float, max_epochs: int, seed: int = 17, block_docs: int = 2048,
             domain_weights: Mapping[str, int] = DOMAIN_WEIGHTS, lang_weights: Mapping[str, int] = LANG_WEIGHTS) -> DataFrame:
    """One row a leaf: budget, whole epochs (full), and the block and key at which the prefix of one more epoch ends (edge, cut).

    ``rows`` is a stored ``narrow`` table. edge is null if nothing of the rest is cut off.
    """
    leaf = list(LEVELS)
    leaves = cut_lineage(rows.groupBy(*leaf).agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")))
    budgets = leaf_budgets(leaves, F.floor(F.col("tokens") * F.lit(fraction)), max_epochs, domain_weights, lang_weights)
    some = F.col("tokens") > 0
    plan = cut_lineage(budgets.select(
        *leaf, "budget", F.greatest(F.ceil(F.log2(F.col("docs") / block_docs)), F.lit(0)).cast("int").alias("bits"),
        F.when(some, F.expr("budget div nullif(tokens, 0)")).otherwise(1).cast("int").alias("full"),
        F.when(some, F.expr("budget % nullif(tokens, 0)")).otherwise(0).cast("long").alias("rest"),
    ))
    placed = _placed(rows, plan, seed).filter("rest > 0")
    sizes = placed.groupBy(*leaf, "block", "rest").agg(F.sum("n_tokens").alias("size"))
    upto = Window.partitionBy(*leaf).orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = cut_lineage(  # the block in which a leaf's rest ends: blocks before it are taken whole
        sizes.withColumn("upto", F.sum("size").over(upto)).filter("upto > rest").groupBy(*leaf)
        .agg(F.min(F.struct("block", (F.col("rest") - F.col("upto") + F.col("size")).alias("room"))).alias("e"))
        .select(*leaf, F.col("e.block").alias("edge"), F.col("e.room").alias("room"))
    )
    inside = placed.join(edges, leaf).filter("block = edge").groupBy(*leaf, "edge", "room", "key").agg(F.sum("n_tokens").alias("size"))
    order = Window.partitionBy(*leaf).orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (
        inside.withColumn("upto", F.sum("size").over(order)).filter("upto > room")
        .groupBy(*leaf, "edge").agg(F.min("key").alias("cut"))  # the first key that doesn't fit
    )
    return cut_lineage(plan.join(cuts, leaf, "left"))


def with_copies(rows: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """``rows`` (domain, lang, source, doc_id, text_hash and others) with budget and copies."""
    before = (F.col("block") < F.col("edge")) | ((F.col("block") == F.col("edge")) & (F.col("key") < F.col("cut")))
    more = F.when(F.col("rest") == 0, F.lit(0)).when(F.col("edge").isNull() | before, F.lit(1)).otherwise(F.lit(0))
    return _placed(rows, plan, seed).withColumn("copies", (F.col("full") + more).cast("int")).drop("bits", "full", "rest", "edge", "cut", "key", "block")


def mix(docs: DataFrame, fraction: float = 1.0, max_epochs: int = 3, seed: int = 17, **how) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, budget, copies) of every row: how often it is taken (0: left out).

    The mix has ``fraction`` of all tokens, as far as ``max_epochs`` passes can give them. Null lang and source count as one named ``none``.
    Rows without words cost nothing and follow the order of their leaf. Repeated rows, which tie in the order of an epoch, are taken or left
    together; the first row that passes the budget is left out. Other columns are ignored; an empty table gives an empty result.
    """
    rows = cut_lineage(narrow(docs))
    return with_copies(rows, plan_mix(rows, fraction, max_epochs, seed, **how), seed).drop("text_hash")


def take_mix(docs: DataFrame, fraction: float = 0.8, max_epochs: int = 1, seed: int = 17, **how) -> DataFrame:
    """The rows of the mix, each as often as it is taken, with the columns of ``docs``."""
    plan = plan_mix(cut_lineage(narrow(docs)), fraction, max_epochs, seed, **how)
    inner = only_names(docs, ("doc_id", "text", "lang", "source"))
    keep = {"lang": "_lang", "source": "_source"}  # as they were, nulls and all
    rows = inner.withColumns({v: F.col(k) for k, v in keep.items()}).withColumns(leaf_columns()).withColumn("text_hash", text_hash())
    taken = with_copies(rows, plan, seed).filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*[F.col(keep.get(c, c)) for c in inner.columns]).toDF(*docs.columns)
