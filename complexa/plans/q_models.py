"""Classical-model queries on the embeddings table (64 floats, 10 labels)."""

from __future__ import annotations

from pyspark.sql import functions as F

from complexa.operators import models as ML
from complexa.operators.splits import hash_order
from complexa.plans import standins as S
from complexa.plans.registry import query

_SPLIT = """e AS (SELECT vec_id, label, embedding, ('0x' || substr(md5('777|' || CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT % 4 AS fold
       FROM embeddings),
tr AS (SELECT * FROM e WHERE fold <> 0), te AS (SELECT * FROM e WHERE fold = 0)"""


def _split(spark, sf):
    e = S.table(spark, sf, "embeddings").withColumn("fold", (hash_order(777, "vec_id") % 4).cast("int"))
    return e.filter(F.col("fold") != 0), e.filter(F.col("fold") == 0)


def _model_query(name):
    def run(spark, sf):
        """Shape only: every test row with its label, and whether its prediction is a label (quality: tests/test_models.py)."""
        tr, te = _split(spark, sf)
        domain = 5 if name == "KMeans" else 10
        return ML.fit_predict(name, tr, te, 64, 10).select("test_id", "y_true", F.col("y_pred").between(0, domain - 1).alias("in_domain"))
    return run


for _key, _name in [("ml01_decision_tree", "DecisionTree"), ("ml02_random_forest", "RandomForest"),
                    ("ml03_svm_rbf", "SVM"), ("ml04_logistic_regression", "LogisticRegression"),
                    ("ml06_kmeans", "KMeans"), ("ml08_mlp", "MLP")]:
    query(_key, f"WITH {_SPLIT} SELECT vec_id AS test_id, CAST(label AS INTEGER) AS y_true, TRUE AS in_domain FROM te")(_model_query(_name))


LLOYD_STEPS = 4


def _lloyd_sql(k: int, steps: int) -> str:
    """The steps unrolled: c0 are the first centers, a<i> the nearest center of every vector, c<i + 1> the means."""
    parts = [f"""e AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS i, v AS c FROM (SELECT * FROM e ORDER BY vec_id LIMIT {k}))"""]
    for n in range(steps + 1):
        d = "list_sum(list_transform(range(1, len(v) + 1), lambda j: (v[j] - c[j]) * (v[j] - c[j])))"
        parts.append(f"""a{n} AS MATERIALIZED (SELECT vec_id, label, v, i FROM e, c{n} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {d}, i) = 1)""")
        if n < steps:
            parts.append(f"""m{n} AS (SELECT i, list(m ORDER BY j) AS c FROM (
  SELECT i, j, round(avg(x), 6) AS m FROM (SELECT i, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{n}) GROUP BY i, j) GROUP BY i),
c{n + 1} AS MATERIALIZED (SELECT c{n}.i, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} ON m{n}.i = c{n}.i)""")
    return "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, CAST(label AS INTEGER) AS label, i AS cluster FROM a{steps}"


@query("ml06_kmeans_lloyd", _lloyd_sql(5, LLOYD_STEPS))
def ml06_kmeans_lloyd(spark, sf):
    """ML6 by value: the cluster of every vector after a fixed number of steps from defined centers."""
    done, _ = ML.lloyd_kmeans(S.table(spark, sf, "embeddings"), 5, LLOYD_STEPS)
    return done.select("vec_id", F.col("label").cast("int").alias("label"), "cluster")


@query("ml05_knn", f"""WITH {_SPLIT},
d AS (SELECT te.vec_id AS test_id, te.label AS y_true, tr.vec_id AS train_id, tr.label AS nb_label,
             list_distance(CAST(te.embedding AS DOUBLE[]), CAST(tr.embedding AS DOUBLE[])) AS dist FROM te JOIN tr ON true),
top AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY dist, train_id) AS r FROM d),
v AS (SELECT test_id, y_true, nb_label, count(*) AS n FROM top WHERE r <= 5 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY n DESC, nb_label) AS r FROM v)
SELECT test_id, CAST(y_true AS INTEGER) AS y_true, CAST(nb_label AS INTEGER) AS y_pred FROM b WHERE r = 1""")
def ml05_knn(spark, sf):
    tr, te = _split(spark, sf)
    return ML.fit_predict("KNN", tr, te, 64, 10).select("test_id", "y_true", "y_pred")


@query("ml07_bernoulli_nb", f"""WITH {_SPLIT},
bits AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS j FROM tr),
cnt AS (SELECT label, j, sum(CASE WHEN x > 0 THEN 1 ELSE 0 END) AS c FROM bits GROUP BY ALL),
nc AS (SELECT label, count(*) AS n_c FROM tr GROUP BY label),
pr AS (SELECT cnt.label AS cls, cnt.j, ln((c + 1.0) / (n_c + 2.0)) AS lp, ln(1 - (c + 1.0) / (n_c + 2.0)) AS lq,
              ln(n_c / (SELECT count(*) FROM tr)::DOUBLE) AS prior FROM cnt JOIN nc USING (label)),
tb AS (SELECT vec_id, label AS y_true, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS j FROM te),
sc AS (SELECT tb.vec_id, tb.y_true, pr.cls, any_value(pr.prior) + sum(CASE WHEN x > 0 THEN lp ELSE lq END) AS s
       FROM tb JOIN pr USING (j) GROUP BY tb.vec_id, tb.y_true, pr.cls),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cls) AS r FROM sc)
SELECT vec_id AS test_id, CAST(y_true AS INTEGER) AS y_true, CAST(cls AS INTEGER) AS y_pred FROM b WHERE r = 1""")
def ml07_bernoulli_nb(spark, sf):
    tr, te = _split(spark, sf)
    return ML.fit_predict("BernoulliNB", tr, te, 64, 10).select("test_id", "y_true", "y_pred")


@query("ml09_kfold_train_eval")
def ml09_kfold_train_eval(spark, sf):
    e = S.table(spark, sf, "embeddings")
    preds = ML.kfold_train_eval(e, "DecisionTree", 4, 64, 10)
    return ML.fold_scores(preds)


_KFOLD = ["DecisionTree", "RandomForest", "SVM", "LogisticRegression", "KNN", "KMeans", "BernoulliNB"]


@query("ml09_kfold_all_models", f"""WITH {_SPLIT}, m AS (SELECT unnest({_KFOLD!r}) AS model)
SELECT model, CAST(fold AS INTEGER) AS fold, CAST(label AS INTEGER) AS y_true, CAST(count(*) AS BIGINT) AS n, TRUE AS in_domain
FROM e, m GROUP BY ALL""")
def ml09_kfold_all_models(spark, sf):
    """ML9 for the models that fit in seconds (MLP: ``jobs.classical_kfold``): each row is predicted once, by the fold that holds it out."""
    e = S.table(spark, sf, "embeddings")
    runs = [ML.kfold_train_eval(e, name, 4, 64, 10) for name in _KFOLD]
    preds = runs[0]
    for r in runs[1:]:
        preds = preds.unionByName(r)
    return preds.groupBy("model", "fold", "y_true").agg(F.count(F.lit(1)).cast("long").alias("n"), F.every(F.col("y_pred").between(0, 9)).alias("in_domain"))
