"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree.

Tokens are counted once, into a table of the columns that order the rows. Supplies of the
leaves and what every inner node can give come from its sums. The token budget goes down the
tree by weights, level by level: siblings share what their parent gets in proportion to
their weights, one that can't use its share is held at what it can give, and what it leaves
goes to its siblings. A node never gets more than its family can give, so only what a whole
family can't use goes to the siblings of its parent. Then every leaf takes whole seeded epochs
and a prefix, by tokens, of one more: its documents in the order of a seeded hash.

The prefix of a leaf, which may hold a third of all rows, isn't one sort. Sums over buckets
of the hash are taken first; whole buckets are in or out, and rows are only summed within
the buckets. No row of the tree comes to the driver, whatever its number of leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.common import WORD, checkpoint, fresh

LEVELS = ("domain", "lang", "source")
#: Leaves whose table is broadcast, at most; a larger one is joined by shuffle.
BROADCAST_LEAVES = 100_000
#: Buckets of a leaf's seeded order.
BUCKETS = 4_096


def domain_of(source: Column) -> Column:
    """The default domain of a source: the first digits of its name modulo 4; 'other' without digits."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), (number.cast("long") % 4).cast("string")))


def weighted(nodes: DataFrame, path: list[str], weights: dict[tuple[str, ...], float]) -> DataFrame:
    """``nodes`` with weight: that of their path, 1 without one, 0 for a negative one."""
    own = [(*k, max(0.0, float(w))) for k, w in weights.items() if len(k) == len(path)]
    if not own:
        return nodes.withColumn("weight", F.lit(1.0))
    given = nodes.sparkSession.createDataFrame(own, ", ".join(f"{p} string" for p in path) + ", own double")  # the caller's weights
    return nodes.join(F.broadcast(given), path, "left").withColumn("weight", F.coalesce("own", F.lit(1.0))).drop("own")


def shared_out(children: DataFrame, parent: list[str], path: list[str]) -> DataFrame:
    """``children`` (path, weight, capacity, budget: their parent's) with their own share as budget.

    Siblings are taken by how soon a common level of budget per weight fills them. One is held at
    its capacity if the level of what is left for it and those after it would overfill it; the
    others get that level. Children of weight 0 get nothing.
    """
    up = W.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), *path)
    rest = up.rowsBetween(W.currentRow, W.unboundedFollowing)
    filled = children.filter("weight > 0").withColumn("before", F.coalesce(F.sum("capacity").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    filled = filled.withColumn("level", (F.col("budget") - F.col("before")) / F.sum("weight").over(rest))
    # the first that isn't overfilled sets the level for itself and all after it
    sets = F.first(F.when(F.col("capacity") >= F.col("level") * F.col("weight"), F.col("level")), ignorenulls=True).over(up.rowsBetween(W.unboundedPreceding, 0))
    filled = filled.withColumn("budget", F.greatest(F.lit(0.0), F.coalesce(F.least(sets * F.col("weight"), "capacity"), "capacity")))
    none = children.filter("weight <= 0").withColumn("budget", F.lit(0.0))
    return filled.drop("before", "level").unionByName(none)


def leaf_budgets(supplies: DataFrame, path: list[str], weights: dict[tuple[str, ...], float], epochs: float, budget: float) -> DataFrame:
    """(path, supply, budget) of every leaf, from (path, supply). ``weights`` has relative weights by path prefix; a node without one has 1.

    A node can give ``epochs`` times its supply, an inner node what its children of a weight above 0 can.
    """
    levels = [checkpoint(weighted(supplies.withColumn("capacity", F.col("supply") * float(epochs)), path, weights))]
    for depth in range(len(path) - 1, 0, -1):
        above = levels[0].groupBy(*path[:depth]).agg(F.sum(F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0.0)).alias("capacity"))
        levels.insert(0, checkpoint(weighted(above, path[:depth], weights)))
    can = levels[0].agg(F.sum(F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0.0))).first()[0] or 0.0
    given = levels[0].withColumn("budget", F.lit(float(min(budget, can))))
    for depth, level in enumerate(levels):
        if depth:
            above = shared_out(given, path[: depth - 1], path[:depth]).select(*path[:depth], "budget")
            given = level.join(checkpoint(above), path[:depth])
    return checkpoint(shared_out(given, path[:-1], path).select(*path, "supply", "budget"))


def mix(docs: DataFrame, budget: float | None = None, share: float = 0.5, weights: dict[tuple[str, ...], float] | None = None, epochs: int = 1, seed: int = 17, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Every selected row of ``docs`` with _domain, _lang, _source, _tokens, _copies and _leaf_budget.

    Tokens are words at ASCII white space. ``budget`` is in tokens (by default ``share`` of
    all); no document is taken more than ``epochs`` times. A leaf with a budget of q supplies
    and a rest takes each document q times and, once more, a prefix of them in the order of
    md5(seed, epoch, doc_id): the documents that the rest has room for, and the one that crosses
    its end if at least half of it lies within. So a leaf misses its budget by half a document
    at most, on either side, and the errors of many leaves offset each other.
    Documents without words cost nothing and go with the prefix they stand in.

    Null languages and sources are a value of their own ('?'). Equal rows are ordered by their
    text's digest, so repeated rows count each. An empty table gives no rows. Columns of the
    names above are replaced, whatever other names the table has.
    """
    named = {"domain": domain_of(F.col("source")), "lang": F.coalesce("lang", F.lit("?")), "source": F.coalesce("source", F.lit("?"))}
    path = [f"_{k}" for k in levels]
    leaf, tokens = [named[k].alias(p) for k, p in zip(levels, path, strict=True)], F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    counted = checkpoint(docs.select(*leaf, "doc_id", tokens.alias("tokens")))
    supplies = checkpoint(counted.groupBy(*path).agg(F.sum("tokens").cast("double").alias("supply")))
    if budget is None:
        budget = share * (supplies.agg(F.sum("supply")).first()[0] or 0.0)
    plan = leaf_budgets(supplies, path, weights or {}, epochs, budget)
    whole = F.when(F.col("supply") > 0, F.least(F.lit(epochs), F.floor(F.col("budget") / F.col("supply")).cast("int"))).otherwise(F.lit(epochs)).cast("int")
    plan = plan.select(*path, F.col("budget").alias("_leaf_budget"), "supply", whole.alias("whole"))
    plan = plan.withColumn("rest", F.when(F.col("whole") < epochs, F.greatest(F.lit(0.0), F.col("_leaf_budget") - F.col("whole") * F.col("supply"))).otherwise(0.0)).drop("supply")

    few = plan.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    small = F.broadcast if few else (lambda df: df)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))))
    bucket = F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * BUCKETS / (1 << 32))
    by_bucket = counted.join(small(plan), path).groupBy(*path, bucket.alias("bucket")).agg(F.sum("tokens").alias("held"), F.first("rest").alias("r"))
    before = W.partitionBy(*path).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    begun = by_bucket.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))).filter("before < r")
    # one bucket of each leaf at most is cut; those before it are in as a whole
    is_cut = F.col("before") + F.col("held") > F.col("r")
    edges = begun.groupBy(*path).agg(F.max("bucket").alias("last"), F.max(F.when(is_cut, F.struct("bucket", "before"))).alias("cut"))
    limits = checkpoint(plan.join(edges, path, "left"))  # a row for each leaf

    row = fresh("row")
    near = docs.select(F.struct("*").alias(row), "doc_id", "text", *leaf).join(small(limits), path).withColumn("key", key).withColumn("bucket", bucket)
    whole_in = F.col("last").isNotNull() & (F.col("bucket") <= F.col("last"))
    own = [c for c in docs.columns if c not in {*path, "_tokens", "_copies", "_leaf_budget"}]
    out = lambda copies: [*[F.col(row)[c].alias(c) for c in own], *path, tokens.alias("_tokens"), copies.cast("int").alias("_copies"), "_leaf_budget"]
    elsewhere = near.filter(F.col("cut").isNull() | (F.col("bucket") != F.col("cut.bucket")))
    inside = W.partitionBy(*path).orderBy("key", "doc_id", "digest").rowsBetween(W.unboundedPreceding, -1)
    at_cut = near.filter(F.col("bucket") == F.col("cut.bucket")).withColumn("digest", F.md5("text")).withColumn("tokens", tokens)
    at_cut = at_cut.withColumn("begin", F.col("cut.before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    mixed = elsewhere.select(*out(F.col("whole") + whole_in.cast("int"))).unionByName(at_cut.select(*out(F.col("whole") + ((F.col("begin") < F.col("rest")) & (F.col("begin") + F.col("tokens") / 2 <= F.col("rest"))).cast("int"))))
    return mixed.filter("_copies > 0")


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows as often as they were taken."""
    copy = fresh("copy")
    return mixed.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*columns)
