from pyspark.sql import functions as F

from complexa.operators import graph as G
from complexa.operators import quality as Q


def test_reachability_fixture(spark):
    e = spark.createDataFrame([("main", "a"), ("a", "b"), ("b", "c")], "caller string, callee string")
    roots = spark.createDataFrame([("main",)], "node string")
    full = {r.node for r in G.reachable(e, roots).collect()}
    parity = {r.node for r in G.reachable(e, roots, max_depth=1).collect()}
    assert full == {"main", "a", "b", "c"} and parity == {"main", "a"}


def test_merge_and_prune(spark):
    e = spark.createDataFrame([(1, "x", 3, "comesFrom", 1), (1, "x", 3, "comesFrom", 2)],
                              "doc_id int, name string, idx int, kind string, parent_idx int")
    m = G.merge_edges(e).first()
    assert m.parents == [1, 2]
    nodes = spark.createDataFrame([(1, i) for i in range(5)], "doc_id int, idx int")
    assert sorted(r.idx for r in G.prune_edges(nodes, e).collect()) == [1, 2, 3]


def test_dead_methods_fixture(spark):
    src = ("public class A {\n  static int f(int n) {\n    return n;\n  }\n  static int g(int n) {\n    return n;\n  }\n"
           "  public static void main(String[] a) {\n    f(1);\n  }\n}\n")
    p = spark.createDataFrame([(1, "java", src)], "doc_id int, lang string, src string")
    assert [(r.name) for r in Q.dead_methods(p).collect()] == ["g"]
    out = Q.drop_dead_declarations(p).first().src
    assert "static int g" not in out and "static int f" in out


def test_unreachable_lines(spark):
    src = "def f(x):\n    return x\n    y = 1\n    z = 2\nprint(f(1))"
    df = spark.createDataFrame([(src,)], "s string")
    assert df.select(Q.drop_unreachable_lines("s")).first()[0] == "def f(x):\n    return x\nprint(f(1))"


def test_as_of_latest_definition(spark):
    docs = spark.createDataFrame([(1, "a, b a. a a")], "doc_id int, text string")
    ld = G.latest_definition(G.words(docs)).orderBy("idx").collect()
    assert [r.def_idx for r in ld] == [None, None, 0, 2, 2]


def test_reachable_per_graph_matches_bfs(spark):
    e = spark.createDataFrame([(1, "main", "a"), (1, "a", "b"), (1, "b", "a"), (1, "b", "c"), (2, "main", "x"), (2, "y", "z")],
                              "g int, caller string, callee string")
    roots = spark.createDataFrame([(1, "main"), (2, "main")], "g int, node string")
    small = {(r.g, r.node, r.depth) for r in G.reachable_per_graph(e, roots, ["g"]).collect()}
    big = {(r.g, r.node, r.depth) for r in G.reachable(e, roots, ["g"]).collect()}
    assert small == big == {(1, "main", 0), (1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "main", 0), (2, "x", 1)}
    d1 = {(r.g, r.node) for r in G.reachable_per_graph(e, roots, ["g"], max_depth=1).collect()}
    assert d1 == {(1, "main"), (1, "a"), (2, "main"), (2, "x")}


def test_shared_callees_and_cycles_count_once(spark):
    edges = [("g", "main", "a"), ("g", "main", "b"), ("g", "a", "c"), ("g", "b", "c"), ("h", "x", "y"), ("h", "y", "z"), ("h", "z", "x"), ("h", "z", "z"), ("h", "r", "x")]
    edges += [("k", f"n{i}", f"n{i + 1}") for i in range(40)] + [("k", None, "n0"), ("k", "n40", None)]
    values = [("g", n, v) for n, v in (("main", 1), ("a", 10), ("b", 100), ("c", 1000))] + [("h", "x", 1), ("h", "y", 2), ("h", "z", 4), ("k", "n40", 7)]
    e = spark.createDataFrame(edges, "doc string, caller string, callee string")
    v = spark.createDataFrame(values, "doc string, node string, value int")
    got = {(r.doc, r.node): (r.sum_v, r.max_v) for r in G.rollup_reachable(e, v, ["doc"]).collect()}
    assert [got["g", n] for n in ("main", "a", "b", "c")] == [(1111, 1000), (1010, 1000), (1100, 1000), (1000, 1000)]
    assert {got["h", n] for n in "xyzr"} == {(7, 4)} and all(got["k", f"n{i}"] == (7, 7) for i in range(41))
    assert G.rollup_reachable(e.limit(0), v, ["doc"]).count() == 0


def test_closure_keeps_distances_and_never_joins_all_pairs(spark, monkeypatch):
    kept = []
    checkpoint = G._ckpt
    monkeypatch.setattr(G, "_ckpt", lambda df: kept.append(checkpoint(df)) or kept[-1])
    edges = [(1, a, a + 1) for a in range(9)] + [(1, 0, 4), (1, 9, 7), (1, 9, 7), (2, 0, 0), (2, 3, None)]
    got = {tuple(r) for r in G.closure(spark.createDataFrame(edges, "g int, caller int, callee int"), ["g"]).collect()}
    want = {(1, a, b) for a in range(10) for b in range(a, 10)} | {(1, a, b) for a in (8, 9) for b in (7, 8, 9)} | {(2, 0, 0)}
    assert got == want
    far = {(r.node, r.below): r.d for r in kept[-1].filter("g = 1").collect()}  # of each pair, so that only those at distance k are joined
    assert far[0, 4] == 1 and far[0, 9] == 6 and far[1, 9] == 8 and far[9, 8] == 2 and far[5, 5] == 0
