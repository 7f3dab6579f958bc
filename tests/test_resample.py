from pyspark.sql import functions as F

from complexa.operators import quality as Q

PY = "# c\ndef f(n):\n    return n\n    x = 1\n"
JAVA = "// c\nclass A {\n  int f(int n) { return n; }\n}\n"


def test_resample_returns_the_texts_of_both_passes(spark):
    rows = [(i, "java", JAVA) for i in range(20)] + [(100 + i, "python", PY) for i in range(20)] + [(200, "python", "# only"), (201, "java", "// only")]
    p = spark.createDataFrame(rows, "doc_id int, lang string, src string")
    first, more = {"java": (1, 5), "python": (1, 10)}, {"java": (1, 5), "python": (1, 20)}
    a = Q.resample_augmented(p, 4 * len(rows), first, more, keep_on_failure=False)
    want = {(r.doc_id, r.n_mut): r.out for r in Q.augment_job(
        p.withColumn("n_mut", F.explode(F.sequence(F.lit(1), F.lit(20)))), F.col("n_mut")).select("doc_id", "n_mut", "out").collect()}
    got = a.select("doc_id", "draw", "lang", "failed", "n_mut", "out").collect()
    base, drawn = [r for r in got if r.draw is None], [r for r in got if r.draw is not None]
    assert sorted(r.doc_id for r in base) == [*range(20), *range(100, 120), 201]
    assert len({r.draw for r in drawn}) == len(drawn) and 3 * len(rows) - 20 < len(drawn) <= 3 * len(rows)
    assert all(r.out == want[r.doc_id, r.n_mut] for r in got)
    assert max(r.n_mut for r in got if r.lang == "java") <= 5 and max(r.n_mut for r in base) <= 10 < max(r.n_mut for r in drawn)
    assert not any(r.failed and r.lang == "python" for r in got) and any(r.failed and r.lang == "java" for r in got)


def test_draws_are_dealt_into_several_parts_a_core(spark):
    p = spark.createDataFrame([(i, "java", JAVA) for i in range(40)], "doc_id int, lang string, src string")
    a = Q.resample_augmented(p, 120, (1, 3), (1, 3))
    drawn = a.filter(F.col("draw").isNotNull())
    assert drawn.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism and drawn.count() == 80
