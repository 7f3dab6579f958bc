"""The augmentation job with all mutators, and its observed ledger."""
import os
import subprocess
import sys

from pyspark.sql import functions as F

from complexa.functions import text as T
from complexa.operators import augment as A
from complexa.operators import quality as Q

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JAVA = "class A { // c\n  static int m(int n) { String s = \"// m\"; return s.length(); }\n\n  /* x */ static int gone(int k) { return k; }\n" \
       "  public static void main(String[] a) { m(1); }\n}\n"
PYTHON = "# c\ndef m(n):\n    '''Doc m'''\n    a = 1\n    return f'{n}'\n    n = 2\ndef main():\n    x = 1\n    return m(1)\ndef gone():\n    return gone()\n"
SCHEMA = "doc_id long, lang string, src string, extra int"


def test_turns_equal_the_single_mutators(spark):
    rows = [(i, lang, text, 0) for lang, text in (("java", JAVA), ("python", PYTHON)) for i in range(7)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.lang, r.doc_id): (r.out, r.failed) for r in A.augmented(df, F.col("doc_id")).collect()}
    turns = {"java": [lambda s: T.remove_comments(s, F.lit("java")), T.strip_comments_c, lambda s: Q.identifiers_renamed(s, F.lit("java")),
                      lambda s: Q.dead_declarations_dropped(s)["src"]],
             "python": [lambda s: T.remove_comments(s, F.lit("python")), lambda s: Q.identifiers_renamed(s, F.lit("python")), Q.unreachable_dropped,
                        Q.unused_assignments_dropped, Q.unused_functions_dropped]}
    for lang, text in (("java", JAVA), ("python", PYTHON)):
        step = spark.createDataFrame([(text,)], "t string")
        for n in range(7):
            assert got[lang, n] == (step.first().t, False), (lang, n)
            step = spark.createDataFrame([step.select(turns[lang][n % len(turns[lang])](F.col("t")).alias("t")).first()], "t string")
    assert "gone" not in got["java", 4][0] and '"// m"' in got["java", 4][0] and "VAR" in got["java", 4][0]
    assert "METHOD1" not in got["python", 5][0] and "n = 2" not in got["python", 5][0] and "Doc m" in got["python", 5][0]


def test_failures_keep_the_last_good_text(spark, tmp_path):
    rows = [(1, "java", "// only", 0), (2, "python", "print((", 0), (3, "ruby", "x", 0), (4, None, None, 0), (5, "java", None, 0), (6, "java", JAVA, 0), (6, "java", JAVA, 0),
            (7, "python", "", 0), (8, "python", "x = 1\n" * 40_000, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.doc_id, r.out, r.failed) for r in A.augmented(df, F.lit(3)).collect()]
    by_id = {i: (out, failed) for i, out, failed in got}
    assert len(got) == len(rows) and by_id[1] == ("// only", True) and by_id[2] == ("print((", True) and by_id[3] == ("x", False) and by_id[4] == by_id[5] == (None, False)
    assert by_id[7] == ("", True) and not by_id[6][1] and not by_id[8][1]
    assert {r.doc_id for r in A.augmented(df, F.lit(3), keep_on_failure=False).collect()} == {1, 3, 4, 5, 6, 8}
    ledger = A.write_augmented(df, F.lit(3), str(tmp_path / "out"), keep_on_failure=False)
    assert ledger == {"total": 9, "failed": 3, "java_total": 4, "java_failed": 1, "python_total": 3, "python_failed": 2}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
    assert A.augmented(df.limit(0), F.lit(2)).collect() == [] and "Exchange" not in A.augmented(df, F.lit(2))._jdf.queryExecution().executedPlan().toString()


RETRY = """
import sys
sys.path.insert(0, sys.argv[1])
from complexa.session import get_session
spark = get_session(master="local[2,4]", shuffle_partitions=2)
from pyspark import TaskContext
from pyspark.sql import functions as F
from complexa.operators import augment as A
mark = spark.sparkContext.accumulator(0)
def once(batches):
    for b in batches:
        yield b
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("lost")
progs = spark.range(50).repartition(4).select(F.col("id").alias("doc_id"), F.lit("java").alias("lang"), F.when(F.col("id") % 5 == 0, "// x").otherwise("class A { }").alias("src"))
ledger = A.write_augmented(progs.mapInPandas(once, progs.schema), F.lit(2), sys.argv[2])
print("LEDGER", ledger["total"], ledger["failed"], spark.read.parquet(sys.argv[2]).count())
"""


def test_the_ledger_counts_retried_tasks_once(tmp_path):
    out = subprocess.run([sys.executable, "-c", RETRY, ROOT, str(tmp_path / "out")], capture_output=True, text=True, timeout=300)
    assert "LEDGER 50 10 50" in out.stdout, out.stderr[-2000:]


def test_still_mutations_end_the_turns(monkeypatch):
    tried = []
    turns = [lambda t: tried.append(t) or t.replace("a", "b"), lambda t: tried.append(t) or t + "("]  # the second always fails
    monkeypatch.setitem(A.MUTATORS, "java", turns)
    assert A.mutate_text("a", "java", 1000) == ("b", True) and len(tried) == 3
    assert A.mutate_text("a", "java", 1) == ("b", False)
