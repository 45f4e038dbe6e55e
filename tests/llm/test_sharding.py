import zlib
from collections import Counter
from itertools import product

import numpy as np

from threadloom.llm import sharding
from tests.llm.helpers import DOCS, awkward, awkward_rows, empty


def test_curve_is_a_walk_through_all_cells():
    for n, bits in ((2, 4), (3, 3)):
        cells = np.array(list(product(range(1 << bits), repeat=n)))
        at = sharding.hilbert_positions(cells, bits)
        assert sorted(at) == list(range(1 << (n * bits)))
        path = cells[np.argsort(at)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_laws(spark):
    rows = [(i, "t" * (37 * i % 400), "en", f"src{i % 5}", 0, 0, "", 0, "", "") for i in range(2000)]
    found = sharding.shard_documents(spark.createDataFrame(rows, DOCS).repartition(6)).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(2000))
    sizes, slots, texts = {}, {}, {}
    text = {r[0]: r[1] for r in rows}
    for r in found:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        texts.setdefault(text[r["doc_id"]], set()).add(r["shard"])
        assert r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
    assert sorted(sizes) == list(range(24))
    assert max(sizes.values()) - min(sizes.values()) < 0.2 * sum(sizes.values()) / 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in texts.values())


def check_laid(groups, total, shards):
    laid, ends = sharding.lay_large_groups(groups, total, shards)
    room, held = total / shards, [0.0] * shards
    for (_, size), parts in zip(groups, laid, strict=True):
        assert abs(sum(n for _, n in parts) - size) < 1e-6
        for shard, n in parts:
            held[shard] += n
    for shard, (lo, hi) in enumerate(zip([0.0, *ends], ends, strict=False)):
        assert hi >= lo
        held[shard] += hi - lo
    assert abs(sum(held) - total) < 1e-6 and max(abs(h - room) for h in held) < 1, held
    return laid


def test_large_groups_stay_whole_and_shards_equal():
    rng = np.random.default_rng(5)
    for _ in range(200):
        shards, total, free = int(rng.integers(2, 25)), 24000.0, 24000.0
        groups = []
        while free > 12000:
            groups.append(float(rng.integers(int(0.05 * total / shards) + 1, int(0.4 * total / shards))))
            free -= groups[-1]
        at = np.sort(rng.integers(0, int(free) + 1, size=len(groups))).astype(float)
        laid = check_laid(list(zip(at.tolist(), groups, strict=True)), total, shards)
        assert sum(len(p) > 1 for p in laid) <= 1  # with half of all bytes free, there is room for all but perhaps the last
    assert len(check_laid([(3000.0, 8000.0)], 24000.0, 24)[0]) in (8, 9)
    check_laid([(0.0, 24000.0)], 24000.0, 24)
    check_laid([(0.0, 600.0)] * 40, 24000.0, 24)


def test_a_group_over_a_shard_is_cut(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i:03d} ", "en", "s", 0, 0, "", 0, "", "") for i in range(600)]
    found = sharding.shard_documents(spark.createDataFrame(rows, DOCS), shards=6).collect()
    sizes = {}
    for r in found:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert max(sizes.values()) < 1.03 * sum(sizes.values()) / 6 and len(sizes) == 6


def test_groups_of_nearly_a_shard_stay_whole(spark):
    rng = np.random.default_rng(2)
    texts = [f"copy {j} " + "x" * 40 for j in range(5)]
    rows = [(i, texts[i % 10] if i % 10 < 5 else f"own {rng.integers(1 << 30)} " + "y" * 40, "en", f"s{i % 7}", 0, 0, "", 0, "", "") for i in range(4000)]
    found = sharding.shard_documents(spark.createDataFrame(rows, DOCS).repartition(5), shards=8).collect()
    text, homes, sizes, slots = {r[0]: r[1] for r in rows}, {}, {}, {}
    for r in found:
        homes.setdefault(text[r["doc_id"]], set()).add(r["shard"])
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(h) == 1 for h in homes.values())
    assert max(sizes.values()) < 1.02 * min(sizes.values()) and sorted(sizes) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_awkward_rows(spark):
    found = sharding.shard_documents(awkward(spark), shards=3).collect()
    want = sorted(((r[0] is None, r[0] or 0), len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in awkward_rows())
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["size"], r["text_crc32"]) for r in found) == want
    for shard in range(3):
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_empty_and_written(spark, tmp_path):
    assert sharding.shard_documents(empty(spark)).count() == 0
    rows = [(i, f"text {i}", "en", "s", 0, 0, "", 0, "", "") for i in range(50)]
    sharding.write_shards(spark.createDataFrame(rows, DOCS), str(tmp_path / "out"), shards=4)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 4


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(None, f"text {i}", "en", "s") for i in range(20)] + [(7, f"other {i}", "en", "s") for i in range(20)] + [(8, "same", "en", "s")] * 3
    sharding.write_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), str(tmp_path / "s"), 4)
    written = spark.read.parquet(str(tmp_path / "s"))
    sharding.write_shards(written, str(tmp_path / "again"), 3)  # with a shard and a slot already
    assert spark.read.parquet(str(tmp_path / "again")).count() == len(rows)
    assert sorted((tuple(r) for r in written.select("doc_id", "text", "lang", "source").collect()), key=str) == sorted(rows, key=str)
    assert written.select("shard", "slot").distinct().count() == len(rows)
