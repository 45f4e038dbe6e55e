import random

from threadloom.llm import contamination
from tests.llm.helpers import DOCS, awkward, awkward_rows, empty, prose, shingles

ITEMS = "item_id long, text string, extra string"


def brute(rows, items):
    out = set()
    for r in rows:
        d = shingles(r[1])
        for k, text, _ in items:
            s = shingles(text)
            if k is not None and s and len(s & d) >= 0.75 * len(s):
                out.add((r[0], k, len(s), len(s & d)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(11)
    rows = awkward_rows()
    items = [(i, prose(rng, rng.choice([5, 8, 20, 45, 200]), 5000), "x") for i in range(30)]
    items += [(100, None, "x"), (101, "", "x"), (102, "ONE", "x"), (103, "one two three four", "x"), (None, "one", "x"), (104, "a b c d e", "x")]
    for i in range(30):
        text = items[i][1].split()
        where = [prose(rng, rng.randrange(2000), 5000)]
        if i % 3 == 0:
            text[len(text) // 2] = "changed"
        if i % 3 == 1:
            text = text[: len(text) // 2] + prose(rng, 40, 5000).split() + text[len(text) // 2 :]
        rows.append((1000 + i, " ".join([*where, *text, prose(rng, 700, 5000)]).upper(), "en", "s", 0, 0, "", 0, "", ""))
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    found = contamination.contained_items(docs, spark.createDataFrame(items, ITEMS))
    assert {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in found.collect()} == brute(rows, items)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(contamination, "ITEMS_PER_PASS", 2)
    rows = awkward_rows()
    items = [(i, r[1], "x") for i, r in enumerate(rows[:7])]
    found = contamination.contained_items(awkward(spark), spark.createDataFrame(items, ITEMS))
    assert {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in found.collect()} == brute(rows, items)


def test_decontaminate_keeps_the_rest(spark):
    kept = contamination.decontaminate(awkward(spark), spark.createDataFrame([(1, "one two three four", "x")], ITEMS))
    assert kept.count() == awkward(spark).count() - 2
    assert kept.columns == awkward(spark).columns


def test_empty(spark):
    none = spark.createDataFrame([], ITEMS)
    assert contamination.contained_items(empty(spark), none).count() == 0
    assert contamination.contained_items(awkward(spark), none).count() == 0


def test_more_rows_for_more_similar_classes():
    assert contamination.rows_in_band(0.9) > contamination.rows_in_band(0.3) >= 1


def test_short_items_in_long_documents_are_all_found(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, 5 + i % 3, 100000), "x") for i in range(600)]
    items += [(600 + i, items[i][1] + " and what comes after it", "x") for i in range(3)]  # shingles in common
    rows = [(i, " ".join([prose(rng, rng.randrange(200), 100000), items[i][1], prose(rng, 200, 100000)]), "en", "s", 0, 0, "", 0, "", "") for i in range(600)]
    found = contamination.contained_items(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(items, ITEMS))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(i, i) for i in range(600)}


def test_no_row_number_is_given_where_one_row_misses_too_much():
    assert contamination.rows_in_band(1 / 32) == 0


def test_decontaminate_judges_rows_by_their_own_texts(spark):
    rows = [(None, "one two three four"), (None, "clean"), (1, "one two three four"), (1, "clean"), (2, None), (None, None)]
    kept = contamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "one two three four", "x")], ITEMS))
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([(None, "clean"), (1, "clean"), (2, None), (None, None)], key=str)


def test_recall_by_length_of_items(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, 5 + i % 60, 100000), "x") for i in range(900)]
    rows = [(i, " ".join([prose(rng, 150, 100000), items[i][1], prose(rng, 150, 100000)]), "en", "s", 0, 0, "", 0, "", "") for i in range(900)]
    index = contamination.ItemIndex([(k, t.encode()) for k, t, _ in items], 0.75)
    assert {c[0] for c in index.classes} == set(contamination.BLOCKS) and index.sizes[index.rare[2]].max() < 12  # both, and only the shortest by their rarest shingles
    found = contamination.contained_items(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(items, ITEMS))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(i, i) for i in range(900)}


def test_clashing_names(spark):
    rows = [(1, "one two three four", "x", 1), (2, "clean", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _bad string, h long")
    assert [tuple(r) for r in contamination.decontaminate(docs, spark.createDataFrame([(1, "one two three four", "x")], ITEMS)).collect()] == rows[1:]
