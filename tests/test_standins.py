import datetime

from complexa.plans import q_lexer as L
from complexa.plans import standins as S


def test_programs_are_dealt_into_several_parts_a_core(spark, tmp_path):
    """A few programs of few bytes used to be one task's work, however many cores there are."""
    rows = [(k, k, 1, n, float(n), 1000.0 * k, 0.04, 0.05, "N", "O", datetime.datetime(1999, 1, 1)) for k in range(1, 60) for n in range(1, 4)]
    spark.createDataFrame([*rows, (None, *rows[0][1:])], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(k, k, "FOP"[k % 3], "1-URGENT") for k in range(1, 60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    parts = 8 * spark.sparkContext.defaultParallelism
    for build, n in ((L.nested, 60), (L.documented, 60), (S.programs, 59)):
        done = build(spark, str(tmp_path))
        assert done.rdd.getNumPartitions() >= parts
        assert done.count() == n and done.select("doc_id").distinct().count() == n
