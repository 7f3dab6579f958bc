from pyspark.sql import functions as F

from complexa.functions import features as FE
from complexa.functions import text as T
from complexa.operators import quality as Q
from complexa.sources import io as IO

JAVA = """import java.util.*;
public class Main {
  static int f(int n) {
    int s = 0;
    for (int i = 0; i < n; i++) {
      while (s > 3) { s--; break; }
    }
    HashMap<Integer, Integer> m = new HashMap<>();
    Arrays.sort(new int[3]);
    return f(n - 1);
  }
  public static void main(String[] args) {
    switch (args.length) { default: break; }
    if (true) { System.out.println(f(2)); }
  }
}
"""


def test_java_counts(spark):
    df = spark.createDataFrame([(JAVA,)], "s string")
    c = df.select(FE.java_counts("s").alias("c")).first().c
    assert (c.n_if, c.n_switch, c.n_loop, c.n_break, c.n_sort, c.n_hashmap, c.n_hashset) == (1, 1, 2, 2, 1, 1, 0)
    assert c.nested == 1 and c.n_methods == 2


def test_segments_and_edges(spark):
    p = spark.createDataFrame([(1, "java", JAVA)], "doc_id int, lang string, src string")
    seg = FE.method_segments(p)
    heads = {r.method for r in seg.filter("is_header").collect()}
    assert heads == {"f", "main"}
    edges = {(r.caller, r.callee) for r in FE.call_edges(p).collect()}
    assert ("f", "f") in edges and ("main", "f") in edges and ("main", "println") in edges
    assert all(c not in ("if", "for", "while", "switch") for _, c in edges)


def test_rename_identifiers(spark):
    src = "class A { int count = 0; void step(int k) { count += k; } public static void main() { step(1); } }"
    df = spark.createDataFrame([(src,)], "s string")
    out = df.select(Q.rename_identifiers("s")).first()[0]
    assert "class CLASS0" in out and "METHOD0(" in out and "main()" in out
    assert "count" not in out and "VAR0" in out


def test_c_comment_escapes(spark):
    df = spark.createDataFrame([(r'x = "a\"//b"; // c' + "\n" + "y = '/*'; /* z */ w",)], "s string")
    assert df.select(T.strip_comments_c("s")).first()[0] == r'x = "a\"//b";  ' + "\n" + "y = '/*';   w"


def test_raw_response_round_trip(spark, tmp_path):
    texts = ["plain", "it's \"quoted\"", "back\\slash and \\n literal", "multi\nline\ttab"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "idx long, text string")
    path = str(tmp_path / "raw")
    df.select("idx", IO.raw_response_text(F.col("text")).alias("value")).write.partitionBy("idx").text(path)
    back = {r.idx: r.response for r in IO.read_raw_responses(spark, path).collect()}
    assert back == dict(enumerate(texts))


def test_delete_error_split(spark):
    df = spark.createDataFrame([(1, "int f() { return (1); }", "java"), (2, "int g() { return (1; }", "java"),
                                (3, "   // only a comment", "java")], "doc_id int, src string, lang string")
    kept, bad = Q.delete_error(df)
    assert [r.doc_id for r in kept.collect()] == [1]
    assert sorted(r.doc_id for r in bad.collect()) == [2, 3]


def test_last_assistant_nested(spark):
    from complexa.functions.chat import last_assistant, messages
    chat = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a: x"), (1, 2, "assistant", "b: y: z")],
                                 "conv_id long, turn long, role string, text string")
    assert messages(chat).select(last_assistant("messages")).first()[0] == "b: y: z"


def test_braces_in_literals_do_not_nest(spark):
    src = ('class B {\n  static int f(int n) {\n    String s = "{";\n    char c = \'{\';\n    return g(n);\n  }\n'
           '  static int g(int n) {\n    return n;\n  }\n  public static void main(String[] a) {\n    f(1);\n  }\n}\n')
    p = spark.createDataFrame([(1, "java", src)], "doc_id int, lang string, src string")
    heads = {r.method for r in FE.method_segments(p).filter("is_header").collect()}
    assert heads == {"f", "g", "main"}
