"""End-to-end jobs: the reference's three entry points as Spark jobs over files.

* ``refine_and_score``: raw responses + test examples -> refined JSONL -> score report text
  (entry point A).
* ``split_corpus``: corpus JSONL -> comment removal -> lexical gate -> grouped k folds ->
  one JSON folder per (fold, split), plus class distribution and split ratios (entry point B).
* ``classical_kfold``: fold folders -> lexical features -> one model per fold -> fold
  mean / population std of accuracy, weighted F1 and HC scores (entry point C).

Every step is an operator of the package; the jobs only wire paths and parameters.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from complexa.functions import features as FE
from complexa.functions.chat import last_assistant
from complexa.functions.extract import model_name
from complexa.functions.labels import t_label
from complexa.functions.text import remove_comments
from complexa.operators import metrics as M
from complexa.operators import models as ML
from complexa.operators import quality as Q
from complexa.operators import splits as SP
from complexa.operators.refine import encode_with_quarantine, refine_responses
from complexa.session import scratch_path
from complexa.sources import io as IO


def refine_and_score(spark: SparkSession, raw_dir: str, examples_path: str, model_id: str, refined_out: str,
                     report_out: str, tuned: bool = False, dataset: str = "corpus", quarantine_out: str | None = None) -> DataFrame:
    """Entry point A.  ``examples_path``: chat JSON with ``conv_id`` (the example index) and
    ``messages``; ``raw_dir``: one ``responce_NNNN.txt`` (or ``idx=N``) file per example.
    Rows that cannot be scored go to ``quarantine_out`` (default: beside the refined
    records) with their reason; the report has their number as ``n_quarantined``."""
    raw = IO.read_raw_responses(spark, raw_dir).withColumn("model_id", F.lit(model_id))
    ex = IO.read_chat(spark, examples_path).select(F.col("conv_id").cast("long").alias("idx"),
                                                   last_assistant("messages").alias("content"))
    refined = refine_responses(raw, ex)
    refined.select("answer", "complexity", "responce").write.mode("overwrite").json(refined_out)
    preds, quarantine = encode_with_quarantine(refined)
    kept_out = quarantine_out or refined_out.rstrip("/") + "-quarantine"
    quarantine.select("idx", "reason", "answer", "complexity", "responce").write.mode("overwrite").json(kept_out)
    n_out = spark.read.schema("idx long").json(kept_out).count()
    report = M.score_report(preds, ["model"], digits=None).withColumn("n_quarantined", F.lit(n_out).cast("long"))
    title = F.concat(F.lit(model_id), F.lit("-pretrained" if tuned else ""))
    report = report.withColumn("report", IO.report_text(title, dataset)).withColumn("report_key", model_name(F.lit(model_id)))
    IO.write_score_report(report.select("report_key", "report"), report_out)
    return report


def split_corpus(spark: SparkSession, corpus_path: str, lang: str, out_path: str, size: float = 0.8,
                 folds: int = 4, retry_seeds=tuple(range(770, 780))) -> tuple[DataFrame, DataFrame]:
    """Entry point B: fold files (label as T-order digit string, src), one folder per (f, split).
    Returns (class distribution, split ratios)."""
    c = IO.read_corpus(spark, corpus_path)
    c = c.select(t_label("complexity").alias("label"), "problem", remove_comments(F.col("src"), F.lit(lang)).alias("src"), F.lit(lang).alias("lang"))
    kept, _rejected = Q.delete_error(c)
    # read, cleaned and gated once; every later step reads the written table
    path = scratch_path(spark, f"corpus-{uuid.uuid4().hex}")
    kept.withColumn("doc_id", F.monotonically_increasing_id()).write.parquet(path)
    kept = spark.read.parquet(path)
    fold_table = SP.accepted_folds(SP.group_kfold_retry(kept, "label", "problem", size, folds, retry_seeds))
    assigned = SP.assign_fold(kept, fold_table)
    member = SP.fold_membership(assigned, folds).select(
        F.col("label").cast("string").alias("label"), "src", F.col("f").cast("int").alias("f"),
        F.when(F.col("is_test"), "test").otherwise("train").alias("split"))
    IO.write_splits(member, out_path, ("f", "split"))
    return SP.class_distribution(kept, "label"), SP.split_ratio(assigned, folds)


def classical_kfold(spark: SparkSession, folds_path: str, lang: str = "java", model: str = "DecisionTree",
                    folds: int = 4) -> DataFrame:
    """Entry point C on the folders written by ``split_corpus`` (T-order labels, scored as they are), for
    every name in ``models.MODELS``."""
    data = spark.read.schema("label STRING, src STRING").json(folds_path).filter(F.col("split") == "test") \
                .select(F.monotonically_increasing_id().alias("doc_id"), F.col("label").cast("int").alias("label"),
                        F.col("f").cast("int").alias("fold"), "src", F.lit(lang).alias("lang"))
    vec = FE.java_vector() if lang == "java" else FE.python_vector()
    feats = data.select("doc_id", "label", "fold", vec.alias("vec"))
    path = scratch_path(spark, f"features-{uuid.uuid4().hex}")
    feats.write.parquet(path)
    feats = spark.read.parquet(path)
    preds = None
    for f in range(folds):
        p = ML.fit_predict(model, feats.filter(F.col("fold") != f), feats.filter(F.col("fold") == f), 13, 8, "vec", "doc_id", "label")
        p = p.select(F.lit(model).alias("model"), F.lit(f).alias("fold"), "y_true", "y_pred")
        preds = p if preds is None else preds.unionByName(p)
    # labels are T-order ids scored as they are, as the reference's classical evaluation does
    return M.kfold_mean_std(preds, ["model"])
