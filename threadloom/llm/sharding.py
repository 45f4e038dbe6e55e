"""Sharding by Hilbert order: near-equal shards that are compact in several metadata dimensions.

Every row gets the index of its cell on a Hilbert curve over quantised metadata. Rows
are sorted by that index over the whole cluster and the order is cut into runs of about
equal bytes, so each shard covers a small box of the metadata space and the min/max
statistics of its files prune on every dimension at once.

Rows of equal text stay together. Small groups lie in the order like single rows and go to
the shard that holds their middle. Large groups, of which there are few as each takes a
stated share of a shard, are laid first: one that doesn't fit what is left of a shard goes to
the head of the next, and the rows after it fill the gap. Only a group that no shard has room
for is cut.

Nothing is gathered: the global order comes from a range partitioning, prefix sums from
sums by partition, and the broadcast tables have one row for each partition, shard or large group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.common import checkpoint, fresh

#: A group of equal texts is large from this share of a shard on; so there are at most shards / LARGE_GROUP large groups.
LARGE_GROUP = 0.05


def hilbert_positions(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of cells (rows, dimensions) with ``bits`` bits in each dimension.

    The transposed form of Skilling's "Programming the Hilbert curve" (2004), over whole columns.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    if n * bits > 62:
        raise ValueError("a position must fit a long")
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            on = (x[i] >> b) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turn
    out = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """``hilbert_positions`` of integer columns, in Arrow batches."""

    @F.pandas_udf("long")
    def position(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_positions(cells.to_numpy(), bits))

    return position(F.struct(*[d.cast("long").alias(f"x{i}") for i, d in enumerate(dims)]))


def document_dims(bits: int) -> list[Column]:
    """Language, source and size of a document, quantised to ``bits`` bits; nulls get cell 0.

    Names are spread by a hash, sizes by their logarithm (an eighth of a doubling for each cell).
    """
    cells = 1 << bits
    named = lambda c: F.when(c.isNull(), F.lit(0)).otherwise(F.pmod(F.crc32(c), F.lit(cells)))
    by_size = F.least(F.floor(F.log2(F.col("size") + 1) * 8 * cells / 256), F.lit(cells - 1))
    return [named(F.col("lang")), named(F.col("source")), by_size]


def lay_large_groups(groups: list[tuple[float, float]], total: float, shards: int) -> tuple[list[list[tuple[int, float]]], list[float]]:
    """Where large groups go, and where the order of the other rows is cut.

    groups: (bytes of other rows before it, its own bytes) in curve order. The first result has for
    each group its (shard, bytes there); a group is whole if it has one of them. The second has the
    bytes of other rows at which each shard ends.
    """
    room, filler = total / shards, total - sum(size for _, size in groups)
    laid: list[list[tuple[int, float]]] = [[] for _ in groups]
    need, left = [size for _, size in groups], [room] * shards
    waiting: list[int] = []
    ends, at, k = [], 0.0, 0

    def lay(g: int, shard: int, part: float) -> None:
        laid[g].append((shard, part))
        need[g], left[shard] = need[g] - part, left[shard] - part

    for shard in range(shards):
        for g in list(waiting):  # what the shards before had no room for
            if need[g] <= left[shard] + 0.5:
                lay(g, shard, need[g])
            elif groups[g][1] > room and left[shard] > 0:
                lay(g, shard, left[shard])
        waiting = [g for g in waiting if need[g] > 0]
        while k < len(groups) and groups[k][0] <= at + max(0.0, left[shard]):  # the run of other rows reaches it
            before, size = groups[k][0] - at, groups[k][1]
            if size > room:  # cut, from where it stands
                if left[shard] > before:
                    lay(k, shard, min(size, left[shard] - before))
            elif size <= left[shard] + 0.5 and (before + size / 2 <= left[shard] or shard == shards - 1):
                lay(k, shard, size)
            waiting += [k] if need[k] > 0 else []
            k += 1
        take = max(0.0, min(left[shard], filler - at))
        at, left[shard] = at + take, left[shard] - take
        ends.append(at)
    for g in [*waiting, *range(k, len(groups))]:  # cut over what is left, if no shard has room for it: the emptiest first
        while need[g] > 0:
            shard = max(range(shards), key=lambda i: (left[i], -i))
            lay(g, shard, need[g] if left[shard] < 1 or need[g] <= left[shard] + 0.5 else left[shard])
    return laid, ends


def shard_documents(docs: DataFrame, shards: int = 24, bits: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the curve index of every row.

    ``law`` is 'bytes': the curve order is cut where the sum of sizes passes a multiple of
    total / ``shards``, each row (or small group) going to the shard that holds its middle. Rows of
    equal text share one curve index (that of the smallest doc_id) and stay in one shard, unless
    their group is larger than a shard or no shard has that much room left beside other large groups.

    A null text has size 8 and its own group with the checksum of an empty text; an empty
    table gives an empty result; repeated rows each get a slot; extra columns are ignored;
    null lang or source count as a value; rows with null doc_id sort first.
    """
    return _placed(docs, shards, bits)


def _placed(docs: DataFrame, shards: int, bits: int, *also: str) -> DataFrame:
    """``shard_documents`` with more columns of ``docs``."""
    sized = docs.select(
        "doc_id",
        *also,
        "lang",
        "source",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.md5("text")).alias("digest"),
    )
    rows = sized.select("doc_id", *also, "size", "text_crc32", "digest", hilbert_index(document_dims(bits), bits).alias("cell"))
    # small tables are checkpointed before a join, so that both sides are plain exchanges and a hot group can be split
    groups = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "cell")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", F.col("first.cell").alias("group_cell"), "n")
    groups = checkpoint(groups)
    placed = rows.join(groups, "digest", "left").select("doc_id", *also, "size", "text_crc32", "digest", F.coalesce("group_cell", "cell").alias("curve_index"), F.coalesce("n", F.lit(1)).alias("n"))

    order = ["curve_index", "digest", "doc_id", "size"]
    ranged = checkpoint(placed.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    total = ranged.agg(F.sum("size")).first()[0] or 0
    is_large = F.col("n") * F.col("size") >= F.greatest(F.lit(LARGE_GROUP * total / shards), F.lit(1.0))
    ranged = ranged.withColumn("large", (F.col("n") > 1) & is_large)
    filler = F.when(F.col("large"), 0).otherwise(F.col("size"))
    grouped = F.when(F.col("large"), F.col("size")).otherwise(0)
    before, inside = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("part").orderBy(*order)
    so_far = inside.rowsBetween(W.unboundedPreceding, -1)
    by_part = ranged.groupBy("part").agg(F.sum(filler).alias("f"), F.sum(grouped).alias("g"))
    offsets = by_part.select("part", F.coalesce(F.sum("f").over(before), F.lit(0)).alias("f_before"), F.coalesce(F.sum("g").over(before), F.lit(0)).alias("g_before"))
    at = lambda c, start: F.col(start) + F.coalesce(F.sum(c).over(so_far), F.lit(0))
    # the bytes of other rows before each row, and those of large groups: a row for each partition is broadcast
    summed = checkpoint(ranged.join(F.broadcast(offsets), "part").withColumns({"begin": at(filler, "f_before"), "within": at(grouped, "g_before")}).drop("f_before", "g_before"))
    starts = checkpoint(summed.filter("n > 1").groupBy("digest", "large").agg(F.min("begin").alias("group_begin"), F.min("within").alias("group_within"), F.first("n").alias("rows"), F.first("size").alias("each")))

    found = starts.filter("large").select("digest", "group_begin", "rows", "each").orderBy("group_begin", "digest").collect()  # shards / LARGE_GROUP rows at most
    laid, ends = lay_large_groups([(float(r["group_begin"]), float(r["rows"] * r["each"])) for r in found], float(total), shards)
    spark, upto = docs.sparkSession, lambda parts: np.cumsum([b for _, b in parts]).tolist()
    pieces = [(r["digest"], k, float(end)) for r, parts in zip(found, laid, strict=True) for (k, _), end in zip(parts, upto(parts), strict=True)]
    homes = spark.createDataFrame(pieces, "digest string, home int, until double").groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("until", "home"))).alias("homes"))
    joined = summed.join(starts.select("digest", "group_begin", "group_within"), "digest", "left").join(F.broadcast(homes), "digest", "left")
    inner = F.col("within") - F.col("group_within") + F.col("size") / 2
    home = F.coalesce(F.get(F.filter("homes", lambda h: inner <= h["until"]), 0)["home"], F.element_at("homes", -1)["home"])
    middle = F.when(F.col("group_begin").isNotNull(), F.col("group_begin") + F.col("n") * F.col("size") / 2).otherwise(F.col("begin") + F.col("size") / 2)
    run = F.size(F.filter(F.array(*[F.lit(float(e)) for e in ends[:-1]]).cast("array<double>"), lambda e: e < middle))
    cut = joined.select("part", "doc_id", *also, "size", "text_crc32", "digest", "curve_index", F.when(F.col("large"), home).otherwise(run).cast("int").alias("shard"))
    cut = checkpoint(cut)

    # slots: a number within the shard and partition, after the rows of the shard in the partitions before
    counts = cut.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    earlier = counts.select("shard", "part", F.coalesce(F.sum("rows").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    own = F.row_number().over(W.partitionBy("part", "shard").orderBy(*order))
    return cut.withColumn("own", own).join(F.broadcast(earlier), ["shard", "part"]).select(  # a row for each shard in each partition
        "doc_id",
        *also,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("earlier") + F.col("own") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve_index",
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, bits: int = 8) -> None:
    """The documents with their shard and slot, one directory for each shard, sorted by slot."""
    row = fresh("row")
    rows = checkpoint(docs.withColumn(row, F.monotonically_increasing_id()))  # ids may be null or repeated
    placed = _placed(rows, shards, bits, row).select(row, "shard", "slot")
    own = rows.drop("shard", "slot")  # columns of these names are replaced
    own.join(placed, row).drop(row).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
