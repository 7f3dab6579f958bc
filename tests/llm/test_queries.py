"""The contract queries over a small table: against their SQL where there is one, else their columns and invariants."""
import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_ngram_jaccard", "op3_warc", "op4_exact_dedup", "op6_decontaminate", "op7_chat_trees", "op8_substring_dedup",
                                  "op12_ranked_search", "op13_collocations"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "documents pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    cur = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    norm = lambda rows, names: sorted(repr([r[names.index(c)] for c in sorted(names)]) for r in rows)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(cur.fetchall(), cols)


COLUMNS = {
    "op1_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op5_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op9_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op11_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op10_lm_trie": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_every_document_has_rows(spark, name):
    df = E.queries()[name](spark, SF)
    assert COLUMNS[name] <= set(df.columns)
    ids = [r.doc_id for r in df.select("doc_id").collect()]
    docs = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert set(ids) == set(docs) and (name == "op9_packing" or len(ids) == len(docs))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.work_table(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0] and len(set(counts)) > 3
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_pipeline_is_registered():
    assert "pipeline" in E.queries() and set(E.oracle_sql()) <= set(E.queries())
    assert {n.split("_")[0] for n in E.queries() if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
