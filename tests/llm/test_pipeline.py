"""The pipeline's stages take effect one after another, and its rows match brute-force decisions."""

import corpus_pipeline
from isobath.llm import line_dedup
from tests.llm.test_operators import SCHEMA, edited, odd_rows, plain_classes, prose


def test_stages(spark, tmp_path):
    item = prose(40, 7000).replace("\n", " ")
    rows = [(k, prose(90, 600 + k), "en", "s", 1) for k in range(60)]
    rows += [(100, rows[0][1].replace(" ", "### "), "en", "s", 1), (101, "short text", "en", "s", 1), (102, edited(rows[1][1].replace("\n", " "), 1, 5), "en", "s", 1), (103, edited(rows[1][1].replace("\n", " "), 0, 5), "en", "s", 1), (104, prose(50, 8000) + " " + item, "en", "s", 1)]
    rows += [(105, rows[2][1], "en", "s", 1), (None, prose(70, 9000), None, None, None), (106, None, "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(60)) <= set(kept) and None in kept
    assert not {100, 101, 104, 106} & set(kept)
    # of an exact copy a last line that makes no chunk may stay
    assert 105 not in kept or kept[105].n_bytes < 150
    assert not {102, 103} & set(kept)
    assert all(r.decodes and r.n_tokens > 0 for r in kept.values())


def test_stages_keep_the_columns(spark):
    """Columns of any name are carried on with their values, also those that the stages call their own things by."""
    rows = spark.createDataFrame(odd_rows(), SCHEMA).selectExpr("*", "doc_id + 7 _quality", "8 _row", "9 id", "10 bucket", "11 _key", "12 `a b`")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name != "decontamination":
            left = stage(spark, rows, "")
            assert left.columns == rows.columns, name
            assert all(r._quality == (None if r.doc_id is None else r.doc_id + 7) and r.id == 9 for r in left.collect()), name


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert corpus_pipeline.quality_stage(spark, empty, "").count() == 0
    assert corpus_pipeline.near_dedup_stage(spark, empty, "").count() == 0
    assert line_dedup.without_repeats(empty).count() == 0
    assert plain_classes([]) == {}
