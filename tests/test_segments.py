"""Row rules in Arrow batches: evaluated once a row, equal to the column rules, early end of mutations, flow on cut texts."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from complexa.functions import dataflow, lexer, segments
from complexa.functions import features as FE
from complexa.functions.arrow import list_of_structs, per_row
from complexa.operators import graph as G
from complexa.operators import models as ML
from complexa.operators import quality as Q

JAVA = ('class A {\n  static int f(int n)\n  {\n    String s = "}{"; // g(1)\n    return f(n - 1) + g(n);\n  }\n  int g(int n) { return 1; }\n'
        "  void dead() {\n    new Foo(1);\n  }\n  public static void main(String[] a) {\n    f(2);\n  }\n}\n")
PYTHON = "def f(n):\n    return f(n - 1)\n    n = 2\n\ndef _g():\n    x = [1,\n2]\n\ndef main():\n    f(1)\n"
ODD = ["", "\n", "(((", "class A {\nint f(\n", "def f(\n", "\r\ndef f(x):\r\n\treturn 1\x85", "éclass B; énew C(1)", "'''q\nreturn\n x", "break \\\n  x\n  y"]


def _rows(spark):
    rows = [(i, lang, s) for i, (lang, s) in enumerate((lang, s) for s in [JAVA, PYTHON, *ODD, None] for lang in ("java", "python", "c"))]
    return spark.createDataFrame(rows, "doc_id int, lang string, src string")


def test_segment_equals_the_column_fold(spark):
    for r in _rows(spark).select("lang", "src", FE.segment_items("src", "lang").alias("items")).collect():
        if r.src is not None:
            assert [(x.line, x.method, x.is_header) for x in r["items"]] == segments.segment(r.src, r.lang), (r.lang, r.src)


def test_edges_equal_the_column_rule(spark):
    df = _rows(spark)
    want = df.select("doc_id", F.inline(FE.edge_items(FE.segment_items("src", "lang")))).collect()
    assert sorted(FE.call_edges(df).collect()) == sorted(want) and want


def test_unreachable_equals_the_column_rule(spark):
    for r in _rows(spark).select("src", Q.drop_unreachable_lines("src").alias("out")).collect():
        if r.src is not None:
            assert segments.without_unreachable(r.src) == r.out, r.src


def test_split_counts():
    assert segments.split_counts(JAVA, "java") == (4, 12, 12) and segments.split_counts(None, "java") == (None, None, None)


def test_mutations_end_after_a_turn_without_change(monkeypatch):
    calls = []
    monkeypatch.setattr(segments, "rename", lambda t: calls.append(t) or t)
    assert segments.mutated("x = 1\n", "python", 20) == ("x = 1\n", False) and len(calls) == 1


def test_every_mutation_counts_until_nothing_changes():
    def plain(text, lang, n):
        failed = False
        for i in range(n):
            turn = i % 3
            tried = segments.without_comments(text, lang) if turn == 0 else segments.rename(text) if turn == 1 else (
                segments.without_unreachable(text) if lang == "python" else text)
            text, failed = (tried, failed) if segments.passes_gate(tried) else (text, True)
        return text, failed

    for text in (JAVA, PYTHON, "// only", "# a\nclass VAR1: int VAR0; int b = (", *ODD):
        for lang in ("java", "python", "c"):
            for n in range(1, 12):
                assert segments.mutated(text, lang, n) == plain(text, lang, n)
    assert segments.mutated(None, "java", 3) == (None, None) and segments.mutated("x", "java", None) == ("x", False)


def test_null_texts_are_no_failures_and_python_ones_are_dropped(spark):
    df = spark.createDataFrame([(1, "java", None), (2, "python", None), (3, "python", "x = 1\n")], "doc_id int, lang string, src string")
    for keep, want in ((False, [(1, False), (3, False)]), (True, [(1, None), (2, None), (3, False)])):
        assert sorted((r.doc_id, r.failed) for r in Q.augment_job(df, F.lit(2), keep_on_failure=keep).collect()) == want


def test_a_rule_stands_once_in_the_plan(spark):
    """Before, the dropped rows' filter and the list's lambda evaluated the rule again."""
    done = Q.augment_job(_rows(spark), F.lit(3), keep_on_failure=False).select("doc_id", "out", "failed")
    plan = done._sc._jvm.PythonSQLUtils.explainString(done._jdf.queryExecution(), "simple")
    assert len(re.findall("ArrowEvalPython", plan)) == 1
    assert Q.dead_methods(_rows(spark)).filter("doc_id = 0").collect()[0].name == "dead"


def test_lists_of_structs():
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.list_(pa.string()))]))
    rows = [[(1, ["x"]), (2, [])], None, [], [(3, None)]]
    got = list_of_structs(rows, kind).to_pylist()
    assert got == [[{"a": 1, "b": ["x"]}, {"a": 2, "b": []}], None, [], [{"a": 3, "b": None}]]
    assert list_of_structs([], kind).to_pylist() == [] and list_of_structs([None], kind).to_pylist() == [None]


def test_per_row_nulls(spark):
    kind = pa.list_(pa.struct([("n", pa.int32())]))
    col = per_row(lambda t: None if t is None else [(len(t),)], kind, "array<struct<n:int>>", F.col("src"))
    df = spark.createDataFrame([("ab",), (None,)], "src string")
    assert [r[0] if r[0] is None else [x.n for x in r[0]] for r in df.select(col).collect()] == [[2], None]


def test_tokens_equal_the_grouped_expression():
    for text in [JAVA, PYTHON, *ODD, 'rb"x" f\'{a}\' u"""q', "/* open", "a//b\n.5e3 \\\n >>>= -> '\\"]:
        for lang in ("java", "python"):
            want = [(m.lastgroup, m.start(), m.group()) for m in lexer._TOKENS[lang].finditer(text)]
            assert list(lexer.lex(text, lang)) == want


def test_flow_of_a_cut_text():
    """A comma as the last token: failed with an IndexError before."""
    assert [e["name"] for e in dataflow.flow_edges("int a = 1,")] == ["a"]


def test_tokens_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(G, "TASK_CHARS", 100)
    docs = spark.createDataFrame([(i, "a, b a. " * 10) for i in range(40)], "doc_id int, text string")
    assert G.words(docs).rdd.getNumPartitions() == 32
    assert G.words(docs.filter("false")).count() == 0


def test_svm_trains_its_classes_one_by_one():
    assert ML.svm_rbf(10).getParallelism() == 1
