import corpus_pipeline
from tests.llm.helpers import DOCS, awkward_rows, prose


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    import random

    rng = random.Random(1)
    item = prose(rng, 30)
    rows = [*awkward_rows(), (500, prose(rng, 50) + " " + item + " " + prose(rng, 20), "en", "src1", 0, 0, "", 0, "", ""), *[(600 + i, prose(rng, 80, 9000), "en", "src2", 0, 0, "", 0, "", "") for i in range(20)]]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        if name != "mixing":
            assert {r["doc_id"] for r in docs.collect()} >= set(range(600, 620)), name
    assert 500 not in {r["doc_id"] for r in docs.collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
