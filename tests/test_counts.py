"""Counts of one program against the column rules that they stand for."""
from pyspark.sql import functions as F

from complexa.functions import counts
from complexa.functions import features as FE
from complexa.functions import text as T

JAVA = [
    "class A {\n  static int f(int n) {\n    for (int i = 0; i < n; i++)\n      while (n > 1) { n--; g(n); }\n    do { n++; } while (n < 3);\n    if (n > 2) break ;\n    return f(n - 1) + g(n);\n  }\n"
    "  static int g(int n)\n  {\n    int[] a = new int[n]; List<Integer> l = new HashSet<>();\n    Arrays.sort (a); g(1); String s = \"for (\";\n    return h(n);\n  }\n"
    "  public static void main(String[] args) {\n    f(1); f(2); // f(3)\n    switch (f(g(1))) { default: new PriorityQueue<>(); new HashMap<>(); }\n  }\n}\n",
    "class A {\n  void main() { for (;;) for (;;) { while (true) do { } while (x); } }\n}\n", "class B {\n  void f() { }\n}\n", "", "// nothing\n",
    "class A {\n  void main() {\n    xif (1); \u00e9for (a) { while_(b); } do while (q) { for (a) ; } while (c);\n  }\n",
]
PYTHON = ["def f(n):\n    s = 0\n\tdef g(x): pass\n    self.a = s\n    self.b += 'if # x'  # list\n    for i in n:\n        while x == 1:\n            break\n", "", "\n", "x =\n y = 1",
          "a = 1\r\nb == 2\rdef f(): pass\u2028def g(): pass\x85  def h(): pass\x0bz = 1", "  \n   if x:\n  y = \"a\n b\" + 'c\\'d'\nself .q = 1\n\u00e9self.r = 2\nself.s= =3\n", "no break"]


def test_python_counts_are_those_of_the_columns(spark):
    df = spark.createDataFrame([(t,) for t in [*PYTHON, None]], "src string")
    c, d, n = T.py_counts("src"), T.py_depth("src"), FE.py_names("src")
    cols = [c["n_if"], c["n_loop"], c["n_break"], c["n_sort"], c["n_list"], c["n_lines"], n["n_names"], n["n_attrs"], d["max_depth"], d["max_stack"],
            n["n_assign"], n["n_methods"], n["n_funcs"]]
    rows = df.select("src", F.array(*[x.cast("double") for x in cols]).alias("old"), FE.python_vector().alias("new")).collect()
    assert [r.src for r in rows if r.old != r.new] == []
    # a rule on one text, not thirteen column expressions in which the folds are worked out again
    assert counts.python_counts(PYTHON[0])[8:10] == [3.0, 3.0]


def test_java_counts_are_those_of_the_columns(spark):
    rows = spark.createDataFrame([(t,) for t in JAVA], "src string").select("src", FE.java_counts("src", 2).alias("c")).collect()
    for r in rows:
        own = counts.java_counts(r.src)
        assert {n: own[n] for n in r.c.asDict() if n != "n_methods"} == {n: x for n, x in r.c.asDict().items() if n != "n_methods"}


def test_levels_weigh_the_call_paths(spark):
    found = dict(zip(counts.LEVEL_COUNTS, counts.level_counts(JAVA[0]), strict=True))
    # main twice f, f(g(1)) once more with g: f 3 times and g once; both are of the first level, and h is no method
    assert (found["n_methods"], found["n_recursive"], found["nested"]) == (1 + 3 + 1, 2, 2)
    assert (found["n_loop"], found["n_switch"], found["n_sort"], found["n_priority"], found["n_hashmap"], found["n_hashset"]) == (3 * 2 + 1, 1, 1, 1, 1, 1)
    df = spark.createDataFrame([(t,) for t in [*JAVA, None]], "src string")
    assert [len(r.c) if r.c else 0 for r in df.select(FE.level_counts("src").alias("c")).collect()] == [1, 1, 0, 0, 0, 1, 0]
