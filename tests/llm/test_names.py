"""Extra columns whose names clash with those inside the operators keep their values."""

import pytest

from threadloom.llm import chat, contamination, language, mixing, near_dedup, passages, quality, secrets, sharding, toxicity
from tests.llm.helpers import NAMES, awkward_rows, clashing


def ours(rows):
    return sorted((tuple(map(str, r)) for r in rows))


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark, awkward_rows()[:30]).cache()


def kept_whole(docs, out):
    """The rows of ``out`` are rows of ``docs``, with all their columns."""
    assert out.columns == docs.columns
    all_rows = ours(docs.collect())
    some = ours(out.collect())
    assert some and set(some) <= set(all_rows)


def test_stages(spark, docs):
    items = spark.createDataFrame([(1, "one two three four", "x")], "item_id long, text string, doc_id string")
    kept_whole(docs, language.keep_identified(docs))
    kept_whole(docs, near_dedup.keep_one(docs))
    kept_whole(docs, contamination.decontaminate(docs, items))
    mixed = mixing.mix(docs, share=0.8)
    kept_whole(docs, mixed.select(*docs.columns))
    assert set(mixed.columns) == set(docs.columns) | {"_domain", "_lang", "_source", "_tokens", "_copies", "_leaf_budget"}


def test_the_rest(spark, docs, tmp_path):
    n = docs.count()
    assert passages.remove_repeats(docs).count() == n
    counted = quality.text_statistics(docs)
    assert set(counted.columns) == set(docs.columns) | {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"}
    assert ours(counted.select(*NAMES).collect()) == ours(docs.select(*NAMES).collect())
    assert quality.judge_quality(docs, [[("n_words", ">", 1.0)]]).count() == n
    assert sharding.shard_documents(docs, 3).count() == n
    sharding.write_shards(docs, str(tmp_path / "s"), 3)
    assert ours(spark.read.parquet(str(tmp_path / "s")).select("doc_id", "_row", "row", "text").collect()) == ours(docs.select("doc_id", "_row", "row", "text").collect())
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int"))
    assert toxicity.score_documents(docs, model).count() == n
    assert language.identify(docs, language.fit_languages(docs), ["doc_id", "row"]).count() == n
    assert secrets.find_candidates(docs).count() >= 0
    turns = docs.selectExpr("doc_id AS conv_id", "doc_id AS turn", "source AS role", "text", *NAMES)
    assert chat.conversation_digests(chat.format_windows(turns)).count() == docs.select("doc_id").distinct().count()
