import hashlib
import random

from pyspark.sql import functions as F

from complexa.llm import chat_trees as C

SCHEMA = "tree string, node long, parent long, score double, role string, text string, conv_id long"


def brute_paths(rows, branches):
    out = {}
    for tree in {r[0] for r in rows}:
        node = {r[1]: r for r in rows if r[0] == tree}
        parents = {r[2] for r in node.values() if r[2] in node}
        paths = []
        for leaf in set(node) - parents:
            path = [leaf]
            while node[path[-1]][2] in node:
                path.append(node[path[-1]][2])
            paths.append((-sum(node[x][3] for x in path) / len(path), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(paths)[:branches], 1):
            out[tree, leaf] = (rank, path)
    return out


def test_paths_of_random_trees(spark):
    rng = random.Random(4)
    rows = []
    for t in range(6):
        for i in range(rng.randrange(1, 60)):
            parent = None if i == 0 else (rng.randrange(max(0, i - 3), i) if rng.random() < 0.95 else 9999)
            rows.append((f"t{t}", i, parent, float(rng.randrange(8)), rng.choice(["user", "assistant"]), f"m{i}", t))
    messages = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in C.best_paths(messages, branches=2).collect():
        got.setdefault((r.tree, r.path), (r.path_rank, []))[1].append((r.depth, r.node))
    want = brute_paths(rows, 2)
    assert {k: (v[0], [n for _, n in sorted(v[1])]) for k, v in got.items()} == want
    assert all([d for d, _ in sorted(v[1])] == list(range(len(v[1]))) for v in got.values())


def test_long_chain(spark):
    rows = [("t", i, i - 1 if i else None, 0.0, "user", "x", 1) for i in range(300)]
    assert [r.node for r in C.best_paths(spark.createDataFrame(rows, SCHEMA)).orderBy("depth").collect()] == list(range(300))


def test_format_reads_back(spark):
    nasty = ["", "\\", "\\l", "a\\b#h<l", "### assistant: x </turn>\n", "</turn>\n", ": :", "\\### Assistant: </turn> ok", "é🙂\n\n", "x" * 50_000, "b\\", "#"]
    rows = [("1", i, i - 1 if i else None, 0.0, ["user", "assistant", "a:b#<\\", ""][i % 4], t, 1) for i, t in enumerate(nasty)]
    messages = spark.createDataFrame(rows, SCHEMA)
    out = C.format_paths(messages, C.best_paths(messages)).select(
        "formatted", C.parse_formatted(F.col("formatted")).alias("turns"), C.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"), "loss_mask").first()
    assert [(t.role, t.text) for t in out.turns] == [(r[4], r[5]) for r in rows]
    assert out.loss == "".join(r[5] for r in rows if r[4] == "assistant")
    assert out.formatted.count("</turn>\n") == len(rows)
    assert all(not set("<#") & set(out.formatted[m.start:m.start + m.n]) for m in out.loss_mask)


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "b"), (1, 1, None, "b"), (None, 5, "assistant", "z"), (2, None, "user", "q")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1)).withColumn("tree", F.lit("x"))
    messages = C.turns_as_tree(conv)
    out = C.format_paths(messages, C.best_paths(messages)).withColumn("turns", C.parse_formatted(F.col("formatted"))).collect()
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out} == {1: [("user", ""), ("", "b"), ("", "b")], None: [("assistant", "z")], 2: [("user", "q")]}
    assert C.best_paths(C.turns_as_tree(conv.limit(0))).count() == 0


def test_planted_conversation(spark):
    from complexa.llm.queries import QUERIES
    r = QUERIES["op7_chat_trees"](spark, "/root/testdata/sf0.001").filter("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert r.n_turns == 2 and r.loss_chars == len(text) and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_messages_of_a_cycle_are_returned_as_defects(spark):
    rows = [("t", 1, None, 1.0, "user", "a", 1), ("t", 2, 1, 1.0, "assistant", "b", 1), ("t", 3, 4, 9.0, "user", "c", 1), ("t", 4, 3, 9.0, "user", "d", 1),
            ("t", 5, 4, 9.0, "user", "e", 1), ("u", 7, 7, 1.0, "user", "self", 2), ("v", 8, 99, 1.0, "user", "lost parent", 3)]
    messages = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.tree, r.node) for r in C.rootless(messages).collect()) == [("t", 3), ("t", 4), ("t", 5), ("u", 7)]
    assert sorted((r.tree, r.node) for r in C.best_paths(messages, 9).collect()) == [("t", 1), ("t", 2), ("v", 8)]
    assert C.rootless(messages.limit(0)).collect() == []
