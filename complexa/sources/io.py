"""Readers and writers (SRC1-SRC8, SNK1-SNK4).

Readers always pass an explicit schema (no inference pass over the data,
and JSON column pruning works).  Writers partition by the split / fold /
bucket columns so a later read of one fold prunes the others.  Raw model
responses are never ``eval``-ed: their Python-literal wrapper is parsed
with regular expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
import pandas as pd
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from complexa.sources.tsv import read_delimited

CORPUS_SCHEMA = StructType([StructField("src", StringType()), StructField("complexity", StringType()),
                            StructField("problem", StringType()), StructField("from", StringType()),
                            StructField("tags", StringType())])
LABELLED_SCHEMA = StructType([StructField("label", StringType()), StructField("src", StringType())])
MESSAGE = StructType([StructField("role", StringType()), StructField("content", StringType())])
CHAT_SCHEMA = StructType([StructField("conv_id", StringType()), StructField("messages", ArrayType(MESSAGE))])
REFINED_SCHEMA = StructType([StructField("answer", StringType()), StructField("complexity", StringType()),
                             StructField("responce", StringType())])
TSV_SCHEMA = "label INT, code STRING"


# ------------------------------------------------------------------- sources
def _json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines with a fixed schema; a malformed line fails the read (see ``malformed_lines``)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def malformed_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The non-blank lines of JSON files that do not fit ``schema``, for a quarantine: (file, line)."""
    marked = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).filter(F.trim("line") != "")
    parsed = F.from_json("line", marked, {"columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.filter(parsed.isNull() | parsed["_corrupt_record"].isNotNull())


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: corpus JSONL (src, complexity, problem, from, tags); tags -> array."""
    df = _json(spark, path, CORPUS_SCHEMA)
    return df.withColumn("tag_list", F.filter(F.transform(F.split("tags", ","), F.trim), lambda t: t != ""))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: fold JSONL (label as a digit string, src); label cast to int."""
    return _json(spark, path, LABELLED_SCHEMA).withColumn("label", F.col("label").cast("int"))


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: chat JSON with nested messages."""
    return _json(spark, path, CHAT_SCHEMA)


def chat_long(chat: DataFrame) -> DataFrame:
    """SRC3 long form: (conv_id, turn, role, content) via posexplode."""
    return chat.select("conv_id", F.posexplode("messages").alias("turn", "m")).select(
        "conv_id", "turn", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


_PY_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "'": "'", '"': '"', "\\": "\\", "a": "\x07", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
_PY_PIECE = r"(?s)\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\.|[^\\]+"


def _unescape_py(s: Column) -> Column:
    """Python string-literal escapes, piece by piece (an unknown escape stays as it is)."""
    simple = F.create_map(*[F.lit(x) for kv in _PY_ESCAPES.items() for x in kv])

    def piece(p: Column) -> Column:
        code = F.conv(F.substring(p, 3, 8), 16, 10).cast("long")
        # a code point as UTF-8 bytes
        low = lambda shift: F.shiftright(code, shift).bitwiseAND(63) + 128
        byte = lambda c: F.lpad(F.hex(c), 2, "0")
        utf8 = (F.when(code < 0x80, byte(code)).when(code < 0x800, F.concat(byte(F.shiftright(code, 6) + 0xC0), byte(low(0))))
                .when(code < 0x10000, F.concat(byte(F.shiftright(code, 12) + 0xE0), byte(low(6)), byte(low(0))))
                .otherwise(F.concat(byte(F.shiftright(code, 18) + 0xF0), byte(low(12)), byte(low(6)), byte(low(0)))))
        return (F.when(p.rlike(r"^\\[xuU][0-9a-fA-F]"), F.decode(F.unhex(utf8), "UTF-8"))
                .when(p.startswith("\\"), F.coalesce(F.element_at(simple, F.substring(p, 2, 1)), p)).otherwise(p))

    pieces = F.array_join(F.transform(F.regexp_extract_all(s, F.lit(_PY_PIECE), 0), piece), "")
    return F.when(s.contains("\\"), pieces).otherwise(s)


def read_raw_responses(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: one file per example holding ``[{'generated_text': '...'}]``; the index comes from
    the path (``responce_0042.txt`` file names or ``idx=42`` directories).  A file of another
    form has a null response (and goes to the quarantine of ``encode_with_quarantine``)."""
    raw = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"(?:idx=|responce_)(\d+)", 1).cast("long").alias("idx"),
        F.col("value"))
    wrapper = r"(?s)^\[\{'generated_text': (['\"])(.*)\1\}\]\s*$"
    body = F.regexp_extract("value", wrapper, 2)
    return raw.select("idx", F.when(F.col("value").rlike(wrapper), _unescape_py(body)).alias("response"))


def read_refined(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: refined JSONL (answer, complexity, responce)."""
    return _json(spark, path, REFINED_SCHEMA)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: ``label<TAB>code`` (quoted fields may span lines); a file is read by as many tasks as it has blocks, see ``sources.tsv``."""
    return read_delimited(spark, path, TSV_SCHEMA)


def read_tsv_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC6 by Spark's own reader: one task per file, whatever its size."""
    return spark.read.csv(path, sep="\t", schema=TSV_SCHEMA, multiLine=True, escape='"')


def read_tags(df: DataFrame, col: str = "tags", sep: str = ",") -> DataFrame:
    """SRC7: per-record multi-valued tags exploded, trimmed, empties dropped."""
    return df.select("*", F.explode(F.split(F.col(col), sep)).alias("_t")) \
             .withColumn("tag", F.trim("_t")).filter(F.col("tag") != "").drop("_t")


def read_tag_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """SRC7 (vocabulary file): one comma-separated line -> one row per non-empty, trimmed tag,
    with its position in the line."""
    line = spark.read.text(path)
    return (line.select(F.posexplode(F.split("value", ",")).alias("pos", "tag"))
            .withColumn("tag", F.trim("tag")).filter(F.col("tag") != ""))


def write_tag_vocabulary(tags: DataFrame, path: str, col: str = "tag") -> None:
    """Write the distinct tags as one sorted comma-separated line (the vocabulary is bounded
    by the number of distinct tags, not by the data)."""
    tags.select(col).distinct().agg(F.array_join(F.sort_array(F.collect_list(col)), ",").alias("value")) \
        .coalesce(1).write.mode("overwrite").text(path)


REPORT_PATTERNS = {
    "accuracy": r"acc: ([0-9.]+)", "f1_weighted": r"f1 score: ([0-9.]+)",
    "hc_base": r"Scores\nacc[^\n]*\nbase: ([0-9.]+)", "hc_w2": r"Scores\nacc[^\n]*\nbase[^\n]*exp 2: ([0-9.]+)",
    "hc_w3": r"Scores\nacc[^\n]*\nbase[^\n]*exp 3: ([0-9.]+)",
    "hc_map_base": r"\]\nbase: ([0-9.]+)", "hc_map_w2": r"\]\nbase[^\n]*exp 2: ([0-9.]+)",
    "hc_map_w3": r"\]\nbase[^\n]*exp 3: ([0-9.]+)",
}


def read_score_reports(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: report text files -> one row per report with the metrics as doubles."""
    raw = spark.read.text(path, wholetext=True)
    title = F.regexp_extract("value", r"^([^\n]*) with ", 1)
    cols = [F.regexp_extract("value", p, 1).cast("double").alias(k) for k, p in REPORT_PATTERNS.items()]
    last = F.split(F.regexp_extract("value", r"\n([0-9. &]+)\n?$", 1), " &")
    return raw.select(title.alias("title"), *cols,
                      F.transform(last, lambda x: x.cast("double")).alias("class_line"))


# --------------------------------------------------------------------- sinks
def write_splits(df: DataFrame, path: str, cols=("split", "fold"), fmt: str = "json") -> None:
    """SNK1 / SNK2: one directory per split / fold / bucket value."""
    df.write.mode("overwrite").partitionBy(*cols).format(fmt).save(path)


def prediction_lines(df: DataFrame, t: str = "y_true", p: str = "y_pred") -> DataFrame:
    """SNK3: ``"t, p"`` text lines."""
    return df.select(F.concat_ws(", ", F.col(t).cast("string"), F.col(p).cast("string")).alias("value"))


def write_predictions(df: DataFrame, path: str) -> None:
    prediction_lines(df).write.mode("overwrite").text(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    v = F.split(F.col("value"), ", ")
    return spark.read.text(path).select(F.get(v, 0).cast("int").alias("y_true"), F.get(v, 1).cast("int").alias("y_pred"))


@F.pandas_udf(StringType())
def _fixed3(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else f"{v:.3f}")


@F.pandas_udf(StringType())
def _fixed1(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else f"{v:.1f}")


def report_text(title: Column, dataset: str = "corpus") -> Column:
    """SNK4: the 7-line score report: 3 decimals, class line as ``%.1f &``.

    Numbers are formatted by Python's float formatting (correct rounding of
    the binary value) in an Arrow-batched helper: Java's ``%.3f`` rounds the
    shortest decimal form half-up (0.2125 -> 0.213 where the reports read
    0.212), and no JVM built-in reproduces the Python rule exactly.  A report
    has one row per model, so the helper's cost is negligible.
    """
    def f3(c):
        return _fixed3(F.col(c))

    def f1(c):
        return _fixed1(F.col(c) * 100)

    cls = F.concat(*[F.concat(f1(f"class_acc_{i}"), F.lit(" &")) for i in range(7)],
                   f1("f1_micro"), F.lit(" &"), f1("f1_macro"))
    return F.concat(title, F.lit(f" with {dataset}\nScores\nacc: "), f3("accuracy"), F.lit(", f1 score: "), f3("f1_weighted"),
                    F.lit("\nbase: "), f3("hc_base"), F.lit(", exp 2: "), f3("hc_w2"), F.lit(", exp 3: "), f3("hc_w3"),
                    F.lit("\nScores with [0,1,2,3,4,6,8]\nbase: "), f3("hc_map_base"), F.lit(", exp 2: "), f3("hc_map_w2"),
                    F.lit(", exp 3: "), f3("hc_map_w3"), F.lit("\n"), cls, F.lit("\n"))


def write_score_report(report: DataFrame, path: str, key: str = "report_key") -> None:
    """SNK4: one text file per report (directory per key)."""
    report.select(key, F.col("report").alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def raw_response_text(text: Column) -> Column:
    """The ``repr([{'generated_text': ...}])`` form of a response (single-quoted literal)."""
    esc = F.replace(F.replace(F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")),
                                        F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    return F.concat(F.lit("[{'generated_text': '"), esc, F.lit("'}]"))
