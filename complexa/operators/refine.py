"""Response refinement (JOIN1 + PRJ9-11) and scoring of refined responses (entry point A)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complexa.functions.extract import assistant_segment, expected_answer, extract_complexity, model_name
from complexa.functions.labels import text_to_rank
from complexa.functions.text import py_strip


def refine_responses(responses: DataFrame, examples: DataFrame, idx: str = "idx") -> DataFrame:
    """JOIN1: response i <-> example i (left join; a response with no example is flagged).

    Output = the refined record (answer, complexity, responce) plus keys.  The
    class is extracted before the join, so a plan that does not ask for the
    response text moves (idx, complexity) and (idx, answer) only.  A model id of
    no known family, or a response that could not be read, has a null class.
    """
    ex = examples.select(F.col(idx), expected_answer("content").alias("answer"))
    # the one-element array binds the segment: it is cut out of the response once
    seg = F.transform(F.array(assistant_segment("response", "model_id")), lambda s: F.struct(
        s.alias("responce"), F.when(s.isNotNull(), extract_complexity(s)).alias("complexity")))
    r = responses.select(*[c for c in responses.columns if c != "response"], F.inline(seg))
    return r.join(ex, idx, "left").withColumn("has_example", F.col("answer").isNotNull())


def refined_predictions(refined: DataFrame) -> DataFrame:
    """Refined records -> (model, y_true, y_pred) in R-order; unknown spellings -> null."""
    return refined.select(model_name("model_id").alias("model"), "idx",
                          text_to_rank(py_strip("answer")).alias("y_true"),
                          text_to_rank(py_strip("complexity")).alias("y_pred"))


def missing_responses(examples: DataFrame, responses: DataFrame, idx: str = "idx") -> DataFrame:
    """JOIN1, other side: examples whose response file is missing (left anti join on the index)."""
    return examples.join(responses.select(idx).distinct(), idx, "left_anti")


def encode_with_quarantine(refined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PRJ2: (scorable predictions, quarantined refined rows with a ``reason``), without a join.

    A row whose response could not be read or whose model family is unknown,
    that has no example, or whose spelling is outside the accepted map (the
    reference raises on each) goes to the quarantine and not into a score.
    """
    true, pred = text_to_rank(py_strip("answer")), text_to_rank(py_strip("complexity"))
    reason = (F.when(F.col("complexity").isNull(), "no response text or unknown model family").when(F.col("answer").isNull(), "no example")
              .when(true.isNull(), "unknown answer").when(pred.isNull(), "unknown class"))
    marked = refined.withColumn("reason", reason)
    scored = marked.filter("reason is null").select(model_name("model_id").alias("model"), "idx", true.alias("y_true"), pred.alias("y_pred"))
    return scored, marked.filter("reason is not null")
