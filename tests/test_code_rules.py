"""Programs on which the lexical rules once went wrong."""
import pytest
from pyspark.sql import functions as F

from complexa.functions import features as FE
from complexa.operators import quality as Q
from complexa.operators import splits as SP
from complexa.sources import io as IO


def one(spark, column, text, lang="python"):
    return spark.createDataFrame([(text, lang)], "s string, lang string").select(column).first()[0]


@pytest.mark.parametrize("text, depth", [
    ("int x;", 0), ("for (int i = 0; i < n; i++) { s++; }", 1), ("for (;;) x++; if (a) { b(); }", 1),
    ("for (int i = 0; i < n; i++)\n for (int j = 0; j < n; j++)\n s++;", 2), ("while (a) { for (;;) { while (b) c(); } }", 3),
    ("do { n--; } while (n > 0); s = 1;", 0), ("do { while (a) b(); } while (c);", 1), ("for (;;) { } for (;;) { for (;;) ; }", 2),
    ("while (f(a, (b))) { if (x) { for (;;) { while (q) { z(); } } } }", 3), ("for (;;) if (a) { b(); } while (c) { }", 1)])
def test_loop_nesting(spark, text, depth):
    assert one(spark, FE.loop_nesting("s"), text) == depth
    assert one(spark, FE.nested_loop_depth("s", 1), text) == max(0, depth - 1)
    assert one(spark, FE.nested_loop_depth("s", 2), text) == depth


@pytest.mark.parametrize("text, out", [
    ("def f():\n    return g(\n        a,\n    )\n    dead()\nx()", "def f():\n    return g(\n        a,\n    )\nx()"),
    ("def f():\n    return a + \\\n        b\n    dead()", "def f():\n    return a + \\\n        b"),
    ("def f():\n    return 1\n    dead(a,\nb)\n    dead2()\nx()", "def f():\n    return 1\nx()"),
    ("for i in x:\n    break\n    y()\nz()", "for i in x:\n    break\nz()"),
    ('def f():\n    return 1\n    """text\nmore"""', 'def f():\n    return 1\n    """text\nmore"""')])
def test_unreachable_statements(spark, text, out):
    assert one(spark, Q.drop_unreachable_lines("s"), text) == out


def test_rename_never_merges_variables(spark):
    assert one(spark, Q.rename_identifiers("s"), "int a; int VAR0; a = VAR0;") == "int VAR0; int VAR1; VAR0 = VAR1;"


@pytest.mark.parametrize("text, out", [
    ("a = 1\nb = 2\nprint(a)", "a = 1\nprint(a)"), ("if x:\n    b = 2\nprint(1)", "if x:\n    b = 2\nprint(1)"),
    ("y = 1\nf(\n    a = 1,\n    b = 2\n)\ny", "y = 1\nf(\n    a = 1,\n    b = 2\n)\ny"), ("q = 1\nz = g()\nq", "q = 1\nz = g()\nq")])
def test_unused_assignments(spark, text, out):
    assert one(spark, Q.drop_unused_assignments("s"), text) == out


ALLMAN = """class A {
  static int dead(int n) { return n; }
  static int g(int n)
  {
    return n;
  }
  static int dead2(int n)
  {
    return n;
  }
  public static void main(String[] a) {
    g(1);
    new B();
  }
}
class B {
  int v;
}
class C {
  int w;
}
"""


def test_dead_declarations_with_braces_on_their_own_line(spark):
    p = spark.createDataFrame([(1, "java", ALLMAN)], "doc_id int, lang string, src string")
    r = Q.drop_dead_declarations(p).first()
    assert sorted(r.dropped) == ["dead", "dead2"] and r.dropped_classes == ["C"]
    assert "static int g(int n)\n  {\n    return n;\n  }" in r.src and "class B" in r.src and "class C" not in r.src
    assert r.src.count("{") == r.src.count("}")


def test_segmentation_is_row_local(spark):
    p = spark.createDataFrame([(1, "java", ALLMAN)], "doc_id int, lang string, src string")
    for df in (FE.method_segments(p), FE.call_edges(p), Q.drop_dead_declarations(p), FE.java_feature_table(p)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_every_mutation_is_applied(spark):
    text = "# c\ndef f(n):\n    return n\n    x = 1\n"
    df = spark.createDataFrame([(i, "python", text) for i in range(4)], "doc_id int, lang string, src string")
    got = {r.doc_id: (r.out, r.failed) for r in Q.augment_job(df, F.col("doc_id")).collect()}
    assert got[0] == (text, False) and "# c" not in got[1][0] and "METHOD0" in got[2][0] and "x = 1" not in got[3][0]
    bad = Q.augment_job(spark.createDataFrame([(1, "java", "// only")], "doc_id int, lang string, src string"), F.lit(2)).first()
    assert bad.failed and bad.out == "// only"


def test_unaccepted_folds_are_refused(spark):
    folds = spark.createDataFrame([(1, "p", 0, 5, True), (2, "q", 0, 5, False)], "label int, problem string, fold int, seed int, accepted boolean")
    with pytest.raises(ValueError, match=r"\[2\]"):
        SP.accepted_folds(folds)


def test_python_escapes_of_raw_responses(spark):
    raw = r"a\u200bb \xe9 \U0001F642 \\n \n \' \q \\u0041"
    assert one(spark, IO._unescape_py(F.col("s")), raw) == "a\u200bb é 🙂 \\n \n ' \\q \\u0041"


def test_unreadable_responses_are_null(spark, tmp_path):
    (tmp_path / "responce_0001.txt").write_text("no wrapper")
    (tmp_path / "responce_0002.txt").write_text("[{'generated_text': 'x'}]")
    assert {r.idx: r.response for r in IO.read_raw_responses(spark, str(tmp_path)).collect()} == {1: None, 2: "x"}


def test_unknown_family_is_quarantined(spark):
    from complexa.operators.refine import encode_with_quarantine, refine_responses
    r = spark.createDataFrame([(1, "openai/gpt-4", "time complexity is quadratic"), (2, "google/gemma-2", "p<end_of_turn>overall time complexity: quadratic o(n^2)")],
                              "idx long, model_id string, response string")
    ex = spark.createDataFrame([(1, "x: quadratic"), (2, "x: quadratic")], "idx long, content string")
    scored, out = encode_with_quarantine(refine_responses(r, ex))
    assert [x.idx for x in scored.collect()] == [2] and [(x.idx, x.reason) for x in out.collect()] == [(1, "no response text or unknown model family")]


def test_malformed_json_is_not_read_as_nulls(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"label": "1", "src": "x"}\n{"label": broken\n\n')
    assert [r.line for r in IO.malformed_lines(spark, str(tmp_path), IO.LABELLED_SCHEMA).collect()] == ['{"label": broken']
    with pytest.raises(Exception, match="(?i)malformed"):
        IO.read_labelled(spark, str(tmp_path)).collect()
