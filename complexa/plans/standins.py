"""Stand-in views over the driver's tables.

The reference's own inputs (corpus, responses, chat sets) are not shipped,
so each reference table is mapped onto a driver table with a fixed
projection.  The same projections are written as SQL in
``complexa.plans.oracles`` so DuckDB can check every query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from complexa.session import work_parts

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def items_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem dealt by order into several parts a core: what is done to the programs takes the time."""
    return table(spark, sf_dir, "lineitem").repartition(work_parts(spark), "l_orderkey")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> (row id, model, lang, tuned, y_true, y_pred, fold) in R-order ranks."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_returnflag").alias("model"),
        F.col("l_linestatus").alias("lang"),
        (F.col("l_partkey") % 2).cast("int").alias("tuned"),
        (F.col("l_linenumber") - 1).cast("int").alias("y_true"),
        F.when(F.col("l_quantity") >= 49, F.lit(-1))
         .otherwise(F.col("l_quantity").cast("int") % 7).cast("int").alias("y_pred"),
        (F.col("l_suppkey") % 4).cast("int").alias("fold"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> (doc_id, src, lang, problem, label) with a T-order label 0..6."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("text").alias("src"), "lang",
                    F.col("source").alias("problem"), (F.col("n_chars") % 7).cast("int").alias("label"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> a call graph: caller = floor(p_partkey / 2), callee = p_partkey (root 1)."""
    p = table(spark, sf_dir, "part")
    return p.select(F.floor(F.col("p_partkey") / 2).cast("long").alias("caller"),
                    F.col("p_partkey").alias("callee"))


def epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> a training log: run = user_id, epoch = order of ts, acc = value."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("run"), "event_id", "ts", F.col("value").alias("acc"))


# Stand-in data for model responses (values are ours, not the reference's).
MODEL_IDS = ["google/gemma-2-9b-it", "meta-llama/Meta-Llama-3.1-8B-Instruct",
             "mistralai/Mistral-Nemo-Instruct-2407", "Qwen/Qwen2-7B-Instruct"]
MODEL_MARKERS = ["<end_of_turn>", "<|eot_id|>", "[/INST]", "<|im_end|>"]
PHRASES = [
    "the time complexity is o(n log n).",
    "overall time complexity: quadratic o(n^2)",
    "complexity depends on the input: o(n)",
    "i do not know",
    "complexity is linear, o(n^3)",
    "complexity is exponential o(2^n)",
    "complexity unknown",
    "complexity is logarithmic",
    "complexity is linearithmic",
    "overall time o(1) overall time o(n^2)",
    "Complexity cubic complexity linear",
    "The Overall Time Complexity is O(N LOG N) because of sorting",
]


def _pick(values, idx):
    return F.get(F.array(*[F.lit(v) for v in values]), idx.cast("int"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> raw responses: one per line item, keyed by (idx = order, line_no)."""
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_linenumber") % 4
    return li.select(
        F.col("l_orderkey").alias("idx"), F.col("l_linenumber").alias("line_no"),
        _pick(MODEL_IDS, k).alias("model_id"),
        F.concat(F.lit("Estimate the complexity of program "), F.col("l_partkey").cast("string"),
                 _pick(MODEL_MARKERS, k), _pick(PHRASES, (F.col("l_partkey") + F.col("l_suppkey")) % 12)
                 ).alias("response"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> test examples whose assistant answer names the true class."""
    from complexa.functions.labels import R_ORDER
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("idx"),
                    F.concat(F.lit("The time complexity is: "), _pick(R_ORDER, F.col("o_custkey") % 7),
                             F.lit(": end")).alias("content"))


# Stand-in source code: one program per order, one method per line item.
# Bodies are chosen by l_quantity % 8 (the header's brace stands on its own line for body 3); a method calls the next line's method when
# l_discount < 0.05 (so some methods are dead) and itself when l_tax > 0.07.
JAVA_BODIES = [
    "for (int i = 0; i < n; i++) { s += i; }",
    "for (int i = 0; i < n; i++) {\n      for (int j = 0; j < n; j++) { s += j; }\n    }",
    "while (n > 1) { n = n / 2; s++; }",
    "if (n > 0) { s = 1; } else { s = 2; } // branch",
    "HashMap<Integer, Integer> h = new HashMap<>();\n    int[] a = new int[n];\n    Arrays.sort(a); /* sorted */",
    "for (int i = 0; i < n; i++)\n      for (int k = 0; k < i; k++)\n        s += k;\n    if (s > 9) { s = 9; }",
    "do { n--; } while (n > 0);\n    if (n == 0) s = 3;",
    "for (int i = 0; i < n; i++) {\n      while (s < n) {\n        for (int k = 0; k < 3; k++) s += k;\n      }\n      do { while (s > 9) s--; } while (s > n);\n    }",
]
PY_BODIES = [
    "    for i in range(n):\n        s += i",
    "    for i in range(n):\n        for j in range(n):\n            s += j",
    "    while n > 1:\n        n = n // 2  # halve",
    "    if n > 0:\n        s = 1\n    else:\n        s = 2",
    "    a = sorted(list(range(n)))\n    \"\"\"sorted copy\"\"\"",
    "    s = max(s,\n        n)\n    t = 1",
    "    while True:\n        break\n        s += 9",
    "    if n > 5:\n        return max(s,\n            n)\n        s += 1\n        s = [s,\n    n]",
]
#: Programs that a gate must reject: a lost brace or an open bracket, and comments only.
BROKEN_EVERY, EMPTY_EVERY = 41, 43


def programs(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    """orders + lineitem -> (doc_id, lang, label, src, problem): Java for status 'F', Python otherwise;
    the problem (for grouped folds) is the order's customer.

    Method i (dense, 1-based, in line-item order) has body JAVA/PY_BODIES[qty % 8];
    it calls itself when l_tax > 0.07 and method i+1 when l_discount < 0.05; Python
    methods get an unreachable line after the return when l_extendedprice > 50000.
    """
    li = items_by_order(spark, sf_dir)
    o = table(spark, sf_dir, "orders")
    # ``lang`` selects on the order status itself, so the predicate reaches the parquet scan
    if lang == "java":
        o = o.filter(F.col("o_orderstatus") == "F")
    elif lang == "python":
        o = o.filter((F.col("o_orderstatus") != "F") | F.col("o_orderstatus").isNull())
    oo = o.select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus", "o_custkey", "o_orderpriority")
    items = li.select(F.col("l_orderkey").alias("doc_id"), F.struct(
        F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
        F.col("l_extendedprice").alias("ep"), (F.col("l_quantity").cast("int") % 8).alias("b"),
        (F.col("l_tax") > 0.07).alias("rec"), (F.col("l_discount") < 0.05).alias("call"),
        (F.col("l_extendedprice") > 50000).alias("big")).alias("it"))
    per = items.groupBy("doc_id").agg(F.array_sort(F.collect_list("it")).alias("ms"))
    j = per.join(oo, "doc_id")

    def java(x, i):
        ln, nxt = (i + 1).cast("string"), (i + 2).cast("string")
        return F.concat(
            F.lit("  static int m"), ln, F.when(x["b"] == 3, F.lit("(int n)\n  {")).otherwise(F.lit("(int n) {")),
            F.lit("\n    int s = 0;\n    "), _pick(JAVA_BODIES, x["b"]), F.lit("\n"),
            F.when(x["rec"], F.concat(F.lit("    s += m"), ln, F.lit("(n - 1);\n"))).otherwise(F.lit("")),
            F.when(x["call"], F.concat(F.lit("    return m"), nxt, F.lit("(s);\n"))).otherwise(F.lit("    return s;\n")),
            F.lit("  }\n"))

    def py(x, i):
        ln, nxt = (i + 1).cast("string"), (i + 2).cast("string")
        return F.concat(
            F.lit("def m"), ln, F.lit("(n):\n    s = 0\n"), _pick(PY_BODIES, x["b"]), F.lit("\n"),
            F.when(x["rec"], F.concat(F.lit("    s += m"), ln, F.lit("(n - 1)\n"))).otherwise(F.lit("")),
            F.when(x["call"], F.concat(F.lit("    return m"), nxt, F.lit("(s)\n"))).otherwise(F.lit("    return s\n")),
            F.when(x["big"], F.lit("    s = s + 1\n")).otherwise(F.lit("")))

    jsrc = F.concat(F.lit("import java.util.*;\n// order "), F.col("doc_id").cast("string"),
                    F.lit("\npublic class C"), F.col("doc_id").cast("string"), F.lit(" {\n"),
                    F.array_join(F.transform("ms", java), ""),
                    F.lit("  public static void main(String[] args) {\n    int n = "),
                    (F.col("o_custkey") % 100).cast("string"), F.lit(";\n"), F.when(F.col("doc_id") % 14 == 0, "    new Helper();\n").otherwise(""),
                    F.lit("    System.out.println(m1(n));\n  }\n}\n"),
                    F.when(F.col("doc_id") % 7 == 0, "class Helper {\n  int v = 1;\n}\n").otherwise(""))
    psrc = F.concat(F.lit("# order "), F.col("doc_id").cast("string"), F.lit("\n"),
                    F.array_join(F.transform("ms", py), "\n"),
                    F.lit("\n\ndef main():\n    n = "), (F.col("o_custkey") % 100).cast("string"),
                    F.lit("\n    print(m1(n))\n"))
    lang = F.when(F.col("o_orderstatus") == "F", "java").otherwise("python")
    empty, broken = F.col("doc_id") % EMPTY_EVERY == 0, F.col("doc_id") % BROKEN_EVERY == 0
    jsrc = F.when(empty, "// nothing\n").when(broken, F.substr(jsrc, F.lit(1), F.length(jsrc) - 2)).otherwise(jsrc)
    psrc = F.when(empty, "# nothing\n").when(broken, F.concat(psrc, F.lit("print((\n"))).otherwise(psrc)
    return j.select("doc_id", lang.alias("lang"), F.substring("o_orderpriority", 1, 1).cast("int").alias("label"),
                    F.when(lang == "java", jsrc).otherwise(psrc).alias("src"),
                    F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("problem"))
