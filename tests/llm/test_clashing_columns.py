"""Columns of the user that are named like the operators' own stay as they are; empty side tables."""
import corpus_pipeline
from complexa.llm import decontaminate, exact_dedup, ngram_join
from complexa.llm.common import fresh_name

SCHEMA = "doc_id long, text string, __rid string, __RID_ int, rid string, component long"


def docs(spark):
    words = " ".join(f"w{i}" for i in range(30))
    texts = [words, words, words + " more", "other text of its own here", None, words]
    return spark.createDataFrame([(i, t, f"mine {i}", i, "r", 7) for i, t in enumerate(texts)], SCHEMA)


def test_names(spark):
    assert fresh_name(docs(spark), "__rid") == "__rid__" and fresh_name(docs(spark), "x") == "x"


def test_stage_forms_keep_the_users_columns(spark):
    df = docs(spark)
    items = spark.createDataFrame([(1, "other text of its own here"), (2, None)], "item_id long, text string")
    for kept, ids in ((exact_dedup.exact_dedup(df), {0, 2, 3, 4}), (ngram_join.ngram_dedup(df), {0, 3, 4}), (decontaminate.decontaminate(df, items), {0, 1, 2, 4, 5})):
        rows = kept.collect()
        assert kept.columns == df.columns and {r.doc_id for r in rows} == ids
        assert all(r["__rid"] == f"mine {r.doc_id}" and r["__RID_"] == r.doc_id and r.rid == "r" and r.component == 7 for r in rows)


def test_stages_with_empty_labels_and_benchmark(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = docs(spark)
    assert corpus_pipeline.drop_contaminated(spark, df, str(tmp_path)).count() == 6
    assert 0 <= corpus_pipeline.drop_toxic(spark, df, str(tmp_path)).count() <= 6
