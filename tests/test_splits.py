from pyspark.sql import functions as F

from complexa.operators import splits as SP


def test_group_kfold_shrinking(spark):
    df = spark.createDataFrame([(0, f"p{i}") for i in range(20)], "label int, problem string")
    folds = SP.group_kfold(df, "label", "problem", 0.8, 4)
    sizes = sorted((r.fold, r.n) for r in folds.groupBy("fold").agg(F.count("*").alias("n")).collect())
    assert [n for _, n in sizes] == [3, 3, 2, 12]


def test_stratified_quota(spark):
    df = spark.range(4900).withColumn("label", (F.col("id") % 7).cast("int"))
    s = SP.stratified_split(df, "id", "label", 0.8)
    assert s.filter("split = 'test'").count() == 980


def test_hash_rank_is_exact_and_partition_independent(spark):
    df = spark.range(5000).withColumn("k", (F.col("id") % 3).cast("int")).withColumn("h", SP.hash_order(1, "id"))
    a = SP.hash_rank(df, ["k"], "h", "id").select("id", "rank")
    b = SP.hash_rank(df.repartition(7), ["k"], "h", "id").select("id", "rank")
    assert a.exceptAll(b).count() == 0
    # ranks are 1..n per key, dense
    agg = a.join(df, "id").groupBy("k").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"),
                                           F.count("*").alias("n")).collect()
    assert all(r.lo == 1 and r.hi == r.n for r in agg)


def test_folds_disjoint_and_complete(spark):
    df = spark.createDataFrame([(i % 3, f"p{i % 11}", i) for i in range(300)], "label int, problem string, doc_id int")
    a = SP.assign_fold(df, SP.group_kfold(df, "label", "problem", 0.8, 4))
    assert a.filter(F.col("fold").isNull()).count() == 0
    m = SP.fold_membership(a, 4)
    assert m.filter("is_test").groupBy("doc_id").count().filter("count <> 1").count() == 0


def test_resample_size(spark):
    r = SP.resample_to(spark.range(50).withColumnRenamed("id", "doc_id"), "doc_id", 1000)
    assert r.count() == 1000 and r.select("doc_id").distinct().count() <= 50
