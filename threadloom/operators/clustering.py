"""Topics of vectors: distances, average linkage within blocks, levels, trees, assignment of new ones."""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.vector import cosine, cosine_distance, normalise
from threadloom.operators.selection import values_at
from threadloom.sources.scratch import beside, written


def distances(rows: DataFrame) -> DataFrame:
    """(block, id_a, id_b, distance) of all pairs (block, id, vector) of a block."""
    side = lambda x: rows.select("block", F.col("id").alias(f"id_{x}"), F.col("vector").alias(x))
    pairs = side("a").join(side("b"), "block").filter("id_a < id_b")
    return pairs.select("block", "id_a", "id_b", F.round(cosine_distance("a", "b"), 9).alias("distance"))


def weighted_distances(pairs: DataFrame, lengths: DataFrame) -> DataFrame:
    """``pairs`` with distances weighted by lengths (block, id, length): two short ones are moved apart, two long ones together.

    A length counts as its share of its block's mean, between 0.5 and 2; w is the root of the product of two.
    """
    mean = F.avg("length").over(W.partitionBy("block"))
    share = lengths.withColumn("w", F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.col("length") / mean)))
    side = lambda x: share.select("block", F.col("id").alias(f"id_{x}"), F.col("w").alias(f"w_{x}"))
    both = pairs.join(side("a"), ["block", "id_a"]).join(side("b"), ["block", "id_b"])
    w = F.sqrt(F.col("w_a") * F.col("w_b"))
    factor = F.when((F.col("w_a") < 1) & (F.col("w_b") < 1), 2 - w).when((F.col("w_a") > 1) & (F.col("w_b") > 1), 1 / w).otherwise(1.0)
    return both.select("block", "id_a", "id_b", F.round(F.col("distance") * factor, 9).alias("distance"))


#: Clusters of a block that one task merges to the end: a matrix of 134 MB.
MOST = 4_096


def linkage(distance: np.ndarray, size: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Merges of average linkage over a matrix: (first member of one cluster, of the other, distance), the nearest first, ties by the smaller members.

    ``size``: of how many members the rows are the mean distances, 1 by default. Each cluster is
    followed to its nearest, the first of equal ones, until two are each other's: these merge
    whatever else there is, so the work grows with the square of the rows.
    """
    n = len(distance)
    d, size = np.minimum(distance, distance.T).astype(float, copy=False), np.ones(n) if size is None else size.astype(float)
    np.fill_diagonal(d, np.inf)
    out, chain, alive = [], [], np.ones(n, bool)
    while len(out) < n - 1:
        if not chain:
            chain = [int(np.argmax(alive))]
        last = chain[-1]
        to = int(np.argmin(d[last]))
        if len(chain) == 1 or to != chain[-2]:
            chain = [last, to] if to in chain else [*chain, to]  # a cycle can only come from rounded means
            continue
        i, j = sorted((last, to))
        out.append((i, j, float(d[i, j])))
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        chain = chain[:-2]
    # a merge comes after those that its clusters are made of, whatever rounding does to their heights
    height, key = np.zeros(n), []
    for i, j, h in out:
        inner = max(height[i], height[j])
        height[i] = h if h >= inner else np.nextafter(inner, np.inf)
        key.append(height[i])
    return [out[k] for k in sorted(range(len(out)), key=lambda k: (key[k], out[k][:2]))]


def _features(rows: DataFrame, width: int) -> DataFrame:
    """(block, id, s): numbers whose sums over two clusters give the mean distance between their members; see ``_signs``.

    A distance is 1 - cos, so 1 and the unit vector are enough. Weights by length are a factor
    of 2 - r * r' for two short members and 1 / (r * r') for two long ones, with r the root of a
    length's share: products of a number of either member, so their sums are kept as well, by
    themselves and times the unit vector.
    """
    unit = rows.select("block", "id", normalise(F.col("vector")).alias("u"), *([F.col("length").cast("double").alias("length")] if "length" in rows.columns else []))
    if "length" not in rows.columns:
        return unit.select("block", "id", F.concat(F.array(F.lit(1.0)), "u").alias("s"))
    mean = unit.groupBy("block").agg(F.avg("length").alias("mean"))
    w = F.coalesce(F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.col("length") / F.col("mean"))), F.lit(1.0))
    shared = unit.join(mean, "block").withColumn("w", w)
    none = F.array_repeat(F.lit(0.0), 2 + 2 * width)
    both = lambda r: F.concat(F.array(F.lit(1.0)), F.col("u"), F.array(r), F.transform("u", lambda x: x * r))
    short = F.when(F.col("w") < 1, both(F.sqrt("w"))).otherwise(none)
    long = F.when(F.col("w") > 1, both(1 / F.sqrt("w"))).otherwise(none)
    return shared.select("block", "id", F.concat(F.array(F.lit(1.0)), "u", short, long).alias("s"))


def _signs(size: int, width: int) -> np.ndarray:
    """The sign of each product in the sum that is the total distance between the members of two clusters."""
    plain = np.concatenate([[1.0], -np.ones(width)])
    return plain if size == len(plain) else np.concatenate([plain, plain, -plain, -plain, plain])


#: Pairs sought for a cluster, on average, while these are fewer than a task takes.
_PAIRS = 128
#: Clusters that one task takes at least, if so many have near ones.
_SHARE = 1024
#: Rows of a tile; two tiles are compared in one task.
_TILE = 8192


def _near(wide: DataFrame, signs: np.ndarray, most: int) -> tuple[DataFrame, DataFrame]:
    """(block, i, j, height) and (block, t, top): the pairs i < j of clusters (block, id, n, s, m) nearest to each other, complete up to there.

    All pairs nearer than t are among them, and those at t whose larger id is at most ``top``;
    nothing else is. Each two tiles of a block give their nearest pairs, of equal ones those with
    the smaller larger id, and the first place where one of them had to stop is the end for all.
    ``m`` is the number of a block's clusters.
    """
    tiles = F.greatest(F.least(F.lit(8), F.ceil(F.col("m") / 1024)), F.ceil(F.col("m") / _TILE)).cast("int")
    dealt = wide.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    copies = dealt.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("block", F.least("tile", "to").alias("a"), F.greatest("tile", "to").alias("b"), "tile", "tiles", "m", "id", "n", "s")

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id").combine_chunks()
        a, b, m, tiles = (rows.column(c)[0].as_py() for c in ("a", "b", "m", "tiles"))
        id_, tile = rows.column("id").to_numpy(), rows.column("tile").to_numpy()
        x = pc.list_flatten(rows.column("s")).to_numpy().reshape(len(id_), -1) / rows.column("n").to_numpy()[:, None]
        ours, theirs = np.flatnonzero(tile == a), np.flatnonzero(tile == b)
        # as many as there are pairs with one larger id, and more, so that at least one such id is complete
        room = max(min(_PAIRS * m, most * most // 8) * 5 // (2 * tiles * (tiles + 1)), 2 * max(len(ours), len(theirs)))
        kept, (t, top) = [np.empty((0,), d) for d in (float, np.int64, np.int64)], (np.inf, 0)
        for p in range(0, len(ours), 1024):
            left = x[ours[p : p + 1024]] * signs
            for q in range(0, len(theirs), 1024):
                i, j = id_[ours[p : p + 1024]][:, None], id_[theirs[q : q + 1024]][None, :]
                d = np.clip(np.round(left @ x[theirs[q : q + 1024]].T, 9), 0, None)
                if a == b:
                    d[i >= j] = np.inf
                at = np.flatnonzero((d < t) | ((d == t) & (np.maximum(i, j) < top)) if np.isfinite(t) else np.isfinite(d))
                if not len(at):
                    continue
                i, j = i[at // d.shape[1], 0], j[0, at % d.shape[1]]
                kept = [np.concatenate(c) for c in zip(kept, (d.ravel()[at], np.minimum(i, j), np.maximum(i, j)))]
                if len(kept[0]) > 2 * room or (len(kept[0]) > room and np.isfinite(t)):
                    kept, (t, top) = _first(kept, room)
        kept, end = _first(kept, room)
        t, top = end if np.isfinite(end[0]) else (t, top)
        if np.isfinite(t):  # a row without i says where this pair of tiles stopped
            kept = [np.append(kept[0], t), np.append(kept[1], 0), np.append(kept[2], top - 1)]
        none = np.arange(len(kept[0])) == (len(kept[0]) - 1 if np.isfinite(t) else -1)
        return pa.table([pa.array([rows.column("block")[0].as_py()] * len(none), pa.string()), pa.array(kept[1], mask=none), pa.array(kept[2]), pa.array(kept[0])], ["block", "i", "j", "height"])

    found = written(copies.groupBy("block", "a", "b").applyInArrow(compare, "block string, i long, j long, height double"))
    ends = found.groupBy("block").agg(F.min(F.when(F.col("i").isNull(), F.struct("height", "j"))).alias("e")).select("block", F.coalesce("e.height", F.lit(float("inf"))).alias("t"), F.coalesce("e.j", F.lit(-1)).alias("top"))
    pairs = found.filter("i IS NOT NULL")
    # clusters that one task takes: as many numbers as in the matrix of the last ones
    share = max(_SHARE, most * most // len(signs))
    large = wide.filter(F.col("m") > share).select("block").distinct().withColumn("rank", F.lit(share - 1))
    if not large.isEmpty():
        each = pairs.select("block", F.explode(F.array("i", "j")).alias("id"), "height").groupBy("block", "id").agg(F.min("height").alias("height"))
        cut = values_at(each, "block", "height", large).select("block", F.col("height").alias("cut"))
        nearer = F.col("cut") < F.col("t")
        ends = ends.join(cut, "block", "left").select("block", F.when(nearer, F.col("cut")).otherwise(F.col("t")).alias("t"), F.when(nearer, F.lit(2**63 - 1)).otherwise(F.col("top")).alias("top"))
    ends = written(ends)
    return pairs.join(F.broadcast(ends), "block").filter("height < t OR (height = t AND j <= top)").drop("t", "top"), ends


def _first(pairs: list[np.ndarray], room: int) -> tuple[list[np.ndarray], tuple[float, int]]:
    """The first ``room`` of pairs (height, i, j) by height and j, and the height and j of the first one left out."""
    if len(pairs[0]) <= room:
        return pairs, (np.inf, 0)
    some = np.flatnonzero(pairs[0] <= np.partition(pairs[0], room)[room])
    pairs = [c[some] for c in pairs]
    order = np.lexsort((pairs[2], pairs[0]))
    return [c[order[:room]] for c in pairs], (float(pairs[0][order[room]]), int(pairs[2][order[room]]))


def merged_up_to(mean: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, height: np.ndarray, signs: np.ndarray, t: float, top: int) -> list[tuple[int, int, float]]:
    """Merges of average linkage up to the height t, the nearest first, ties by the smaller rows; ``mean`` and ``size`` are changed to those of the clusters made.

    ``i``, ``j`` and ``height`` are the pairs of rows up to t (at t, those with j up to ``top``).
    Two clusters are at t or nearer only if two of their members are, so a cluster's neighbours
    are among those of the clusters that it is made of, and what they are not isn't needed.
    """
    n = len(mean)
    ends = np.concatenate([i, j])
    order = np.argsort(ends, kind="stable")
    near = np.split(np.concatenate([j, i]).astype(np.int32)[order], np.searchsorted(ends[order], np.arange(1, n)))
    home, alive = np.arange(n), size.astype(np.int64)

    def nearest(k: int) -> tuple | None:
        other = was = near[k]
        while not np.array_equal(up := home[other], other):
            other = up
        home[was] = other
        other = np.unique(other)
        other = other[other != k]
        d = np.clip(np.round(mean[other] @ (mean[k] * signs), 9), 0, None)
        other, d = other[d <= t], d[d <= t]
        near[k] = other
        if len(d):
            d = np.where((d < t) | ((other <= top) & (k <= top)), d, np.inf)
            at = int(d.argmin())
            if np.isfinite(d[at]):
                a, b = sorted((k, int(other[at])))
                return float(d[at]), a, b, k, int(alive[a]), int(alive[b])
        return None

    heap = []
    order = np.lexsort((np.concatenate([j, i]), np.concatenate([height, height]), ends))
    for at in order[np.unique(ends[order], return_index=True)[1]]:
        k, other = int(ends[at]), int(i[at - len(i)] if at >= len(i) else j[at])
        a, b = sorted((k, other))
        heap.append((float(height[at % len(i)]), a, b, k, int(alive[a]), int(alive[b])))
    heapq.heapify(heap)
    out = []
    while heap:
        d, a, b, k, size_a, size_b = heapq.heappop(heap)
        if alive[a] == size_a and alive[b] == size_b:
            out.append((a, b, d))
            mean[a] = (mean[a] * size_a + mean[b] * size_b) / (size_a + size_b)
            alive[a], alive[b], home[b] = size_a + size_b, 0, a
            near[a], near[b] = np.concatenate([near[a], near[b]]), None
            k = a
        elif alive[k] != (size_a if k == a else size_b):
            continue  # it is another cluster by now, which has a place of its own
        if (again := nearest(k)) is not None:
            heapq.heappush(heap, again)
    size[:] = alive
    return out


def _merged(wide: DataFrame, near: DataFrame, ends: DataFrame, signs: np.ndarray) -> DataFrame:
    """(block, i, j, height, n, s): the merges that the pairs of ``_near`` settle; the last one of a cluster has its n and s."""

    def merge(clusters: pa.Table, pairs: pa.Table) -> pa.Table:
        clusters = clusters.sort_by("id").combine_chunks()
        id_, n = clusters.column("id").to_numpy(), clusters.column("n").to_numpy().copy()
        mean = pc.list_flatten(clusters.column("s")).to_numpy().reshape(len(id_), -1) / n[:, None]
        i, j, height = (pairs.column(c).to_numpy() for c in ("i", "j", "height"))
        t, top = clusters.column("t")[0].as_py(), np.searchsorted(id_, clusters.column("top")[0].as_py(), "right") - 1
        steps = merged_up_to(mean, n, np.searchsorted(id_, i), np.searchsorted(id_, j), height, signs, t, int(top))
        last = {a: k for k, (a, _, _) in enumerate(steps)}
        whole = [n[a] > 0 and last[a] == k for k, (a, _, _) in enumerate(steps)]
        a, b = (np.array([s[c] for s in steps], int) for c in (0, 1))
        block = pa.array([clusters.column("block")[0].as_py()] * len(steps), pa.string())
        s = pa.array([mean[x] * n[x] if e else None for x, e in zip(a, whole)], pa.list_(pa.float64()))
        return pa.table([block, pa.array(id_[a]), pa.array(id_[b]), pa.array([x[2] for x in steps], pa.float64()), pa.array([int(n[x]) if e else None for x, e in zip(a, whole)], pa.int64()), s], ["block", "i", "j", "height", "n", "s"])

    met = near.select("block", F.explode(F.array("i", "j")).alias("id")).distinct()
    some = wide.join(met, ["block", "id"], "left_semi").join(F.broadcast(ends), "block").select("block", "id", "n", "s", "t", "top")
    return some.groupBy("block").cogroup(near.groupBy("block")).applyInArrow(merge, "block string, i long, j long, height double, n long, s array<double>")


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def merges(rows: DataFrame, most: int = MOST) -> DataFrame:
    """(block, i, j, height): the merges of average linkage of rows (block, id, vector, and length, if distances are weighted by it).

    i and j are the smallest ids of the two clusters, i the smaller. Rows without a block, an id or a vector are left out.

    Copies are one cluster from the start. While a block has more than ``most`` clusters, rounds
    find its nearest pairs, all up to a height, and one task makes all merges up to there. A
    cluster made of two others is no nearer to a third than the nearer of these was (average
    linkage is reducible), so the tree is the one that merging the nearest pair each time gives,
    and no other pairs are needed. Distances come from sums over clusters. Such a task has at most
    ``most``²/8 pairs or so, of clusters with as many numbers as a matrix of ``most`` rows. Of the
    clusters left, at most ``most`` in a block, one task makes the rest.
    """
    given = rows.filter("block IS NOT NULL AND id IS NOT NULL AND vector IS NOT NULL")
    typed = given.withColumns({"block": F.col("block").cast("string"), "id": F.col("id").cast("long"), "vector": F.col("vector").cast("array<double>")})
    first = typed.select(F.size("vector").alias("w")).first()
    spark = rows.sparkSession
    if first is None:
        return spark.createDataFrame([], "block string, i long, j long, height double")
    width = first["w"]
    features = written(_features(typed, width))
    signs = _signs(len(features.select("s").first()["s"]), width)
    classes = written(features.groupBy("block", "s").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    copies = features.join(classes.select("block", "s", F.col("id").alias("i")), ["block", "s"]).filter("id <> i").select("block", "i", F.col("id").alias("j"), F.lit(0.0).alias("height"))
    made = [copies]
    state = classes.select("block", "id", "n", F.transform("s", lambda x: x * F.col("n")).alias("s"))
    while True:
        sized = state.groupBy("block").agg(F.count("*").alias("m")).filter(F.col("m") > most)
        wide = state.join(F.broadcast(sized), "block")
        if wide.isEmpty():
            break
        steps = written(_merged(wide, *_near(wide, signs, most), signs))
        if steps.isEmpty():
            raise ValueError("the vectors of a block aren't numbers: no two have a distance")
        made.append(steps.select("block", "i", "j", "height"))
        gone = steps.select("block", F.explode(F.array("i", "j")).alias("id"))
        new = steps.filter("n IS NOT NULL").select("block", F.col("i").alias("id"), "n", "s")
        state = written(state.join(gone, ["block", "id"], "left_anti").unionByName(new))

    def rest(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id")
        n, s, ids = own["n"].to_numpy(), np.array(own["s"].tolist(), float), own["id"].to_numpy()
        mean = s / n[:, None]
        d = (mean * signs) @ mean.T
        steps = linkage(np.clip(np.round(d, 9, out=d), 0, None, out=d), n)
        block = own["block"].iloc[0]
        return pd.DataFrame([(block, ids[i], ids[j], h) for i, j, h in steps], columns=["block", "i", "j", "height"])

    made.append(state.groupBy("block").applyInPandas(rest, "block string, i long, j long, height double"))
    return written(_all(made))


def _heights(rows: DataFrame, tree: DataFrame, levels: int) -> DataFrame:
    """(block, level, cut): where each level cuts the tree of a block.

    Level 0 is just over the highest merge and the others lie at percentiles of the heights, from
    the 90th down to the 10th; with as few merges as levels, they lie at evenly spread ones.
    """
    sizes = rows.groupBy(F.col("block").cast("string").alias("block")).agg(F.lit(0).alias("_")).drop("_")
    counted = sizes.join(tree.groupBy("block").agg(F.count("*").alias("m")), "block", "left").withColumn("last", F.coalesce("m", F.lit(0)) - 1)
    share = F.array(F.lit(1.0), *[F.lit(float(p)) for p in np.linspace(0.9, 0.1, levels - 1)])
    at = F.posexplode(share).alias("level", "p")
    wide = counted.select("block", "last", at)
    up = levels - 1 - F.col("level")
    even = F.floor(up * (F.col("last") / max(1, levels - 1))) if levels > 1 else F.lit(0)
    rank = F.when(F.col("last") + 1 > levels, F.when(F.col("level") == 0, F.col("last")).otherwise(F.floor(F.col("p") * F.col("last")))).when(up == levels - 1, F.col("last") if levels > 1 else F.lit(0)).otherwise(even)
    ranked = written(wide.withColumn("rank", rank.cast("long")))
    found = values_at(tree, "block", "height", ranked.select("block", "rank"))
    over = F.when((F.col("level") == 0) & (F.col("last") + 1 > levels), 0.01).otherwise(0.0)
    return ranked.join(found, ["block", "rank"], "left").select("block", "level", (F.coalesce("height", F.lit(0.0)) + over).alias("cut"))


def _roots(edges: DataFrame) -> DataFrame:
    """(block, level, id, cluster): where the steps (block, level, id, up) of each id end; each round doubles the steps that a row looks ahead."""
    key = ["block", "level", "up"]
    open_, done = written(edges), []
    while not open_.isEmpty():
        ahead = open_.select("block", "level", F.col("id").alias("up"), F.col("up").alias("next"), F.lit(False).alias("ended"))
        for d in done:
            ahead = ahead.unionByName(d.select("block", "level", F.col("id").alias("up"), F.col("cluster").alias("next"), F.lit(True).alias("ended")))
        step = written(open_.join(ahead, key, "left").select("block", "level", "id", F.coalesce("next", "up").alias("up"), F.coalesce("ended", F.lit(True)).alias("ended")))
        done.append(step.filter("ended").select("block", "level", "id", F.col("up").alias("cluster")))
        open_ = step.filter("NOT ended").select("block", "level", "id", "up")
    return _all(done) if done else edges.select("block", "level", "id", F.col("up").alias("cluster"))


def clusters(rows: DataFrame, levels: int = 3, threshold: float | None = None, most: int = MOST) -> DataFrame:
    """(block, level, id, cluster) of rows (block, id, vector) by average linkage of cosine distances; a cluster is named by its smallest id.

    With a threshold there is one level, of the merges up to it. Else the tree is cut at
    ``levels`` heights, the coarsest first. A column ``length`` weights distances: two short rows
    are moved apart, two long ones together. For ``most`` see ``merges``.
    """
    typed = rows.filter("block IS NOT NULL AND id IS NOT NULL AND vector IS NOT NULL").select(F.col("block").cast("string").alias("block"), F.col("id").cast("long").alias("id"))
    tree = merges(rows, most)
    if threshold is not None:
        cut = typed.select("block").distinct().select("block", F.lit(0).alias("level"), F.lit(float(threshold)).alias("cut"))
    else:
        cut = _heights(typed, tree, levels)
    cut = written(cut)
    edges = tree.join(cut, "block").filter("height <= cut").select("block", "level", F.col("j").alias("id"), F.col("i").alias("up"))
    each = typed.join(cut.select("block", "level"), "block")
    return each.join(_roots(edges), ["block", "level", "id"], "left").select("block", F.col("level").cast("int").alias("level"), "id", F.coalesce("cluster", "id").alias("cluster"))


def topic_hierarchy(rows: DataFrame, levels: int = 4, most: int = MOST) -> DataFrame:
    """(topic, block, level, cluster, n, centroid, parent, children): all topics of rows (block, id, vector and length, if weighted), as a tree.

    A topic is named by its level and its smallest member; ``parent`` is the topic of the level
    above that holds its members, null at level 0, ``centroid`` the unit mean of its vectors.
    """
    found = written(clusters(rows, levels, None, most))
    unit = rows.select(F.col("block").cast("string").alias("block"), F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    first = rows.filter("vector IS NOT NULL").select(F.size("vector").alias("w")).first()
    width = first["w"] if first else 0
    mean = F.array(*[F.avg(F.col("vector")[k]) for k in range(width)]) if width else F.array().cast("array<double>")
    topics = found.join(unit, ["block", "id"]).groupBy("block", "level", "cluster").agg(F.count("*").alias("n"), mean.alias("mean"))
    name = lambda level, cluster: F.concat(F.lit("hier_topic_l"), level.cast("string"), F.lit("_c"), cluster.cast("string"))
    # levels are nested, so the topic above holds all members if it holds the smallest
    above = found.select("block", (F.col("level") + 1).alias("level"), F.col("id").alias("cluster"), name(F.col("level"), F.col("cluster")).alias("parent"))
    tree = written(topics.join(above, ["block", "level", "cluster"], "left").withColumn("topic", name(F.col("level"), F.col("cluster"))))
    children = tree.filter("parent IS NOT NULL").groupBy("block", F.col("parent").alias("topic")).agg(F.count("*").alias("children"))
    return tree.join(children, ["block", "topic"], "left").select("topic", "block", "level", "cluster", "n", normalise(F.col("mean")).alias("centroid"), "parent", F.coalesce("children", F.lit(0)).alias("children"))


def containment_tree(members: DataFrame) -> DataFrame:
    """(block, level, cluster, parent): for each cluster the smallest one of the level above that holds all its members (block, level, id, cluster), or null."""
    sizes = members.groupBy("block", "level", "cluster").agg(F.count("*").alias("n"))
    up = members.select("block", (F.col("level") + 1).alias("level"), "id", F.col("cluster").alias("parent"))
    shared = members.join(up, ["block", "level", "id"]).groupBy("block", "level", "cluster", "parent").agg(F.count("*").alias("shared"))
    whole = shared.join(sizes, ["block", "level", "cluster"]).filter("shared = n")
    above = sizes.select("block", (F.col("level") + 1).alias("level"), F.col("cluster").alias("parent"), F.col("n").alias("size"))
    best = whole.join(above, ["block", "level", "parent"]).groupBy("block", "level", "cluster").agg(F.min(F.struct("size", "parent")).alias("b"))
    return sizes.join(best, ["block", "level", "cluster"], "left").select("block", "level", "cluster", F.col("b.parent").alias("parent"))


def assigned(new: DataFrame, nodes: DataFrame, depth: int = 3, descend: float = 0.7, attach: float = 0.5) -> DataFrame:
    """(id, node, score): where new rows (id, vector) go in a tree of centroids (node, parent, vector; roots have no parent), level by level.

    A row goes down into the nearest child while its cosine reaches ``descend``; one that ``attach`` reaches is taken,
    but not gone further from. Rows that no root takes have none. The tree is broadcast if it is small (``beside``).
    """
    tree = beside(nodes.select("node", "parent", F.col("vector").alias("centroid")))
    at = new.select("id", "vector", F.lit(None).cast("long").alias("node"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("open"))
    for _ in range(depth):
        step = at.filter("open").select("id", "vector", F.col("node").alias("own")).join(tree, F.col("parent").eqNullSafe(F.col("own")))
        best = step.select("id", "node", F.round(cosine("vector", "centroid"), 9).alias("s")).groupBy("id").agg(F.max(F.struct("s", (-F.col("node")).alias("k"))).alias("b"))
        joined = at.join(best, "id", "left")
        taken = F.col("open") & (F.col("b.s") >= attach)
        at = joined.select("id", "vector", F.when(taken, -F.col("b.k")).otherwise(F.col("node")).alias("node"), F.when(taken, F.col("b.s")).otherwise(F.col("score")).alias("score"), F.coalesce(taken & (F.col("b.s") >= descend), F.lit(False)).alias("open"))
    return at.select("id", "node", "score")
