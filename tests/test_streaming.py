import tempfile

from pyspark.sql import functions as F

from complexa.operators import metrics as M
from complexa.streaming.scoring import start_score_stream


def test_stream_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="complexa-stream-test-")
    rows = [("linear", "linear\\n", "m", "org/m"), ("linear", "no such class", "m", "org/m"), ("cubic", "quadratic", "m", "org/m"), ("constant", "ERROR", "m", "org/m"),
            ("logn", "logn", "k", "org/k"), ("nlogn", "exponential", "k", "org/k")]
    df = spark.createDataFrame(rows, "answer string, complexity string, responce string, model_id string")
    df.limit(2).write.json(f"{base}/in/a")
    df.subtract(df.limit(2)).write.json(f"{base}/in/b")
    q = start_score_stream(spark, f"{base}/in/*", f"{base}/out", checkpoint=f"{base}/ckpt")
    q.awaitTermination(120)
    out = spark.read.parquet(f"{base}/out")
    got = {r.model: r for r in out.filter(F.col("epoch") == out.agg(F.max("epoch")).first()[0]).collect()}
    from complexa.functions.labels import text_to_rank
    from complexa.functions.text import py_strip
    preds = df.select(F.substring_index("model_id", "/", -1).alias("model"), text_to_rank(py_strip("answer")).alias("y_true"),
                      text_to_rank(py_strip("complexity")).alias("y_pred")).filter("y_pred is not null")
    want = {r.model: r for r in M.score_report(preds, ["model"]).collect()}
    assert set(got) == set(want)
    for m in want:
        assert got[m].accuracy == want[m].accuracy and got[m].hc_base == want[m].hc_base
        assert got[m].f1_macro == want[m].f1_macro
