import duckdb
import pytest

import __spark_entry__ as E
from complexa.plans.standins import TABLES

SF = "/root/testdata/sf0.001"
FAST = ["agg24_score_report", "agg08_f1_macro", "agg16_confusion_matrix", "agg20_kfold_weighted", "agg23_dataset_stats",
        "prj02_text_to_rank", "prj04_remove_comments", "prj05_strip_comments_c", "prj11_extract_complexity",
        "prj15_merge_user_turns", "prj16_render_chat", "prj21_rename_identifiers", "flt04_drop_unreachable_lines",
        "flt05_drop_dead_declarations", "win01_stratified_split", "win02_group_kfold", "win03_fold_retry", "win04_resample",
        "win12_pack_sequences", "fea02_py_depth", "fea04_java_counts", "fea05_java_counts_v2", "join07_reachable",
        "join08_rollup_callee_features", "join10_latest_definition", "join14_reindex_edges", "ml05_knn",
        "ml07_bernoulli_nb", "src04_read_raw_responses", "snk04_write_score_report", "src08_read_score_reports"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"model", "accuracy", "f1_weighted", "hc_base"} <= set(df.columns)


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", FAST)
def test_oracle_agrees_sf0001(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    cur = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)

    def norm(rows, names):
        order = sorted(range(len(names)), key=lambda i: names[i])
        return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)

    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(cur.fetchall(), cols)
