"""Incremental scoring of refined responses as they land (Structured Streaming).

The reference scores a finished response file in one pass.  When responses
arrive file by file (one inference job per model or shard), the same report
can be kept current: the stream keeps only the confusion cells (at most
8 x 8 per model) as state, and every micro-batch recomputes the metrics from
those cells with the batch operators.  State size does not grow with the
number of responses.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from complexa.functions.extract import model_name
from complexa.functions.labels import text_to_rank
from complexa.functions.text import py_strip
from complexa.operators import metrics as M
from complexa.session import scratch_path
from complexa.sources.io import REFINED_SCHEMA


def refined_stream(spark: SparkSession, path: str) -> DataFrame:
    """Refined JSONL files (answer, complexity, responce, model_id) as a stream of (model, y_true, y_pred)."""
    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType(list(REFINED_SCHEMA.fields) + [StructField("model_id", StringType())])
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).json(path)
    return raw.select(model_name("model_id").alias("model"),
                      text_to_rank(py_strip("answer")).alias("y_true"),
                      text_to_rank(py_strip("complexity")).alias("y_pred"))


def streaming_cells(preds: DataFrame) -> DataFrame:
    """Running confusion counts per (model, y_true, y_pred): the only streaming state.
    Rows with an unknown spelling are left out, as the batch job's quarantine does."""
    return preds.filter("y_true is not null and y_pred is not null").groupBy("model", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def _report_from_cells(cells: DataFrame) -> DataFrame:
    g = ["model"]
    return M.report_from_cells(cells, g)


def start_score_stream(spark: SparkSession, in_path: str, out_path: str, checkpoint: str | None = None,
                       available_now: bool = True):
    """Start the stream: complete-mode cells -> per-batch score report written to ``out_path`` (parquet).

    The checkpoint defaults to a folder of this output under the session's shared checkpoint
    directory.  Every micro-batch has its own ``epoch=N`` folder, so a reader never meets
    a half-written report; the newest epoch is the current one.
    """
    ckpt = checkpoint or scratch_path(spark, "score-stream-" + hashlib.sha256(out_path.encode()).hexdigest()[:16])
    cells = streaming_cells(refined_stream(spark, in_path))

    def publish(batch: DataFrame, epoch: int) -> None:
        _report_from_cells(batch).write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    w = cells.writeStream.outputMode("complete").option("checkpointLocation", ckpt).foreachBatch(publish)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
