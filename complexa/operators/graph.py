"""Graph and data-flow operators (JOIN7-JOIN15, WIN10, WIN11).

Graphs are edge DataFrames keyed by a graph id (one call graph per program,
or one graph for the whole table).  Traversals are level-synchronous: each
level is one join of the frontier with the edges and an anti-join with what
has been visited, so work per level is proportional to the frontier; lineage
is cut with ``checkpoint()`` into the cluster's checkpoint folder every few
levels.  The driver only counts the frontier, it never holds graph data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from complexa.session import ensure_checkpoint_dir

CHECKPOINT_EVERY = 4
#: Characters of text whose tokens one task holds, so a task's memory does not grow with the table.
TASK_CHARS = 4_000_000


def _ckpt(df: DataFrame) -> DataFrame:
    """Materialise into the shared checkpoint folder and cut the lineage (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reachable(edges: DataFrame, roots: DataFrame, keys: Sequence[str] = (), src: str = "caller",
              dst: str = "callee", max_depth: int | None = None) -> DataFrame:
    """JOIN7: nodes reachable from the roots with their BFS depth (root = 0).

    ``roots`` has columns (*keys, node).  ``max_depth=None`` gives the full
    closure; ``max_depth=1`` stops at the roots' callees (the reference's
    two-level behaviour).  Each new frontier is checkpointed (its size is the
    level's new nodes); the visited set is re-checkpointed every few levels,
    and the result is a flat union of checkpointed levels, so plan size stays
    constant however deep the graph is.
    """
    keys = list(keys)
    e = edges.select(*keys, F.col(src).alias("node"), F.col(dst).alias("next")).distinct() \
             .repartition(*keys, "node").persist(StorageLevel.MEMORY_AND_DISK)
    frontier = _ckpt(roots.select(*keys, "node").distinct().withColumn("depth", F.lit(0)))
    levels = [frontier]
    visited = frontier.select(*keys, "node")
    level = 0
    while max_depth is None or level < max_depth:
        nxt = (frontier.join(e, keys + ["node"]).select(*keys, F.col("next").alias("node")).distinct()
               .join(visited, keys + ["node"], "left_anti")
               .withColumn("depth", F.lit(level + 1)))
        nxt = _ckpt(nxt)
        if nxt.isEmpty():
            break
        levels.append(nxt)
        visited = visited.unionByName(nxt.select(*keys, "node"))
        if level % CHECKPOINT_EVERY == CHECKPOINT_EVERY - 1:
            visited = _ckpt(visited)
        frontier = nxt
        level += 1
    e.unpersist()
    return _union_all(levels)


def reachable_per_graph(edges: DataFrame, roots: DataFrame, keys: Sequence[str], src: str = "caller",
                        dst: str = "callee", max_depth: int | None = None) -> DataFrame:
    """JOIN7 for many small graphs (one call graph per program): (*keys, node, depth).

    Each graph's edge list is bounded by its program, so it is collected per
    graph and the BFS runs as an ``aggregate`` fold, one level per step
    (at most one per callee, none after the last new node), in a single pass with no Spark-level iteration.
    """
    keys = list(keys)
    es = edges.groupBy(*keys).agg(F.collect_set(F.struct(F.col(src).alias("a"), F.col(dst).alias("b"))).alias("es"))
    rs = roots.groupBy(*keys).agg(F.collect_set("node").alias("r"))
    g = rs.join(es, keys, "left").withColumn("es", F.coalesce("es", F.array().cast("array<struct<a:string,b:string>>")))
    most = F.size(F.array_distinct(F.transform("es", lambda e: e["b"])))
    steps = most if max_depth is None else F.least(most, F.lit(max_depth))
    init = F.struct(F.transform("r", lambda n: F.struct(n.alias("node"), F.lit(0).alias("depth"))).alias("seen"),
                    F.col("r").alias("front"))

    def level(acc, d):
        nxt = F.array_except(
            F.array_distinct(F.transform(F.filter("es", lambda e: F.array_contains(acc["front"], e["a"])), lambda e: e["b"])),
            F.transform(acc["seen"], lambda x: x["node"]))
        return F.when(F.size(acc["front"]) == 0, acc).otherwise(F.struct(
            F.concat(acc["seen"], F.transform(nxt, lambda n: F.struct(n.alias("node"), d.alias("depth")))).alias("seen"), nxt.alias("front")))

    out = F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), init, level)
    return g.select(*keys, F.inline(out["seen"]))


def rollup_tree(edges: DataFrame, values: DataFrame, root: DataFrame, keys: Sequence[str] = (),
                src: str = "caller", dst: str = "callee", value: str = "value") -> DataFrame:
    """JOIN8: bottom-up roll-up over the BFS tree from the root: sum of values and max of values
    over each node's reachable subtree, one join + aggregate per level from the deepest up.
    Every level is checkpointed and the output is a flat union of the levels."""
    keys = list(keys)
    r = _ckpt(reachable(edges, root, keys, src, dst))
    tree = _ckpt(edges.select(*keys, F.col(src).alias("parent"), F.col(dst).alias("node"))
                 .join(r.select(*keys, "node", "depth"), keys + ["node"])
                 .join(r.select(*keys, F.col("node").alias("parent"), F.col("depth").alias("pdepth")), keys + ["parent"])
                 .filter(F.col("pdepth") == F.col("depth") - 1).drop("pdepth"))
    vals = _ckpt(r.join(values.select(*keys, "node", F.col(value).alias("v")), keys + ["node"], "left")
                 .withColumn("v", F.coalesce("v", F.lit(0))))
    max_depth = vals.agg(F.max("depth")).first()[0] or 0
    acc = _ckpt(vals.filter(F.col("depth") == max_depth)
                .select(*keys, "node", F.col("v").alias("sum_v"), F.col("v").alias("max_v"), "depth"))
    levels = [acc]
    for d in range(max_depth - 1, -1, -1):
        child = (tree.filter(F.col("depth") == d + 1).join(acc.select(*keys, "node", "sum_v", "max_v"), keys + ["node"])
                 .groupBy(*keys, "parent").agg(F.sum("sum_v").alias("cs"), F.max("max_v").alias("cm")))
        lvl = vals.filter(F.col("depth") == d).join(child.withColumnRenamed("parent", "node"), keys + ["node"], "left")
        acc = _ckpt(lvl.select(*keys, "node", (F.col("v") + F.coalesce("cs", F.lit(0))).alias("sum_v"),
                               F.greatest(F.col("v"), F.coalesce("cm", F.col("v"))).alias("max_v"), "depth"))
        levels.append(acc)
    return _union_all(levels)


def closure(edges: DataFrame, keys: Sequence[str] = (), src: str = "caller", dst: str = "callee") -> DataFrame:
    """Distinct (*keys, node, below): every node of ``edges`` with itself and all that it reaches, on any graph.

    After a round all pairs up to distance k are known with their distance; those at distance k are joined with all
    up to k, which gives those up to 2 k.  So a chain or cycle of n nodes takes about log2(n) rounds, and a pair is
    found once for each node halfway, not for every node between.  A round's pairs are checkpointed.  Null ends are
    ignored.  The pairs themselves are the output, as many as there are.
    """
    keys = list(keys)
    e = edges.select(*keys, F.col(src).alias("node"), F.col(dst).alias("below")).dropna(subset=["node", "below"])
    own = e.select(*keys, "node").unionByName(e.select(*keys, F.col("below").alias("node"))).withColumn("below", F.col("node"))
    key, k = [*keys, "node", "below"], 1
    steps = e.withColumn("d", F.lit(1)).unionByName(own.withColumn("d", F.lit(0)))
    pairs = _ckpt(steps.groupBy(key).agg(F.min("d").alias("d")))
    while True:
        far = pairs.filter(F.col("d") == k).select(*keys, "node", F.col("below").alias("mid"))
        if far.isEmpty():  # nor is any pair farther
            return pairs.select(key)
        on = pairs.filter(F.col("d") > 0).select(*keys, F.col("node").alias("mid"), "below", (F.col("d") + k).alias("d"))
        pairs = _ckpt(pairs.unionByName(far.join(on, [*keys, "mid"]).select(*key, "d")).groupBy(key).agg(F.min("d").alias("d")))
        k *= 2


def rollup_reachable(edges: DataFrame, values: DataFrame, keys: Sequence[str] = (), src: str = "caller",
                     dst: str = "callee", value: str = "value") -> DataFrame:
    """JOIN8 on any call graph: (*keys, node, sum_v, max_v) over the distinct nodes that a node reaches, itself included.

    A callee shared by several callers counts once for each node above it (``rollup_tree``
    adds it once per path), and methods that call each other have equal sums.  Nodes
    without a value count as 0; a node with several values counts their sum.
    """
    keys = list(keys)
    v = values.groupBy(*keys, F.col("node").alias("below")).agg(F.sum(value).alias("v"))
    return closure(edges, keys, src, dst).join(v, keys + ["below"], "left").groupBy(*keys, "node").agg(
        F.sum(F.coalesce("v", F.lit(0))).alias("sum_v"), F.max(F.coalesce("v", F.lit(0))).alias("max_v"))


def self_recursive(edges: DataFrame, keys: Sequence[str] = ("doc_id",), src: str = "caller", dst: str = "callee") -> DataFrame:
    """JOIN9: number of methods that call themselves, per graph."""
    return (edges.filter(F.col(src) == F.col(dst)).groupBy(*keys)
            .agg(F.countDistinct(src).cast("long").alias("n_recursive")))


def words(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Token table for data flow: (doc_id, idx, word, name, is_def). A word ending in ',' or
    '.' defines its name, other words use it; names are lower-cased letters/digits.

    The texts are clustered by document once, before the explode (a text is several
    times smaller than its token rows, which would move instead); every later
    per-document window and aggregate (partitioned by the document, or by
    document and name) reuses that partitioning, so the data-flow operators have
    a single shuffle.
    """
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    d = docs.select(doc, text).repartition(max(8, -(-chars // TASK_CHARS)), doc)
    w = d.select(doc, F.posexplode(F.split(F.col(text), r"\s+")).alias("idx", "word")).filter(F.col("word") != "")
    return w.select(doc, "idx", "word", F.lower(F.regexp_replace("word", r"[^\p{L}\p{N}_]", "")).alias("name"),
                    F.col("word").rlike(r"[,.]$").alias("is_def")).filter(F.col("name") != "")


def latest_definition(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """JOIN10 (as-of join): each use takes the index of the most recent definition of its name."""
    w = Window.partitionBy(doc, "name").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("def_idx", F.last(F.when(F.col("is_def"), F.col("idx")), ignorenulls=True).over(w))


def flow_edges(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Data-flow edges (doc_id, name, idx, kind, parent_idx, via): every use gets a comesFrom edge
    to its latest definition and one to the first definition of its name (two parent sources
    for JOIN12 to merge).  Both come from one window pass and one ``inline``, no self-join."""
    whole = Window.partitionBy(doc, "name")
    ld = latest_definition(tokens, doc).withColumn("first_def", F.min(F.when(F.col("is_def"), F.col("idx"))).over(whole))
    uses = ld.filter(~F.col("is_def") & F.col("def_idx").isNotNull())
    both = F.array(
        F.struct(F.lit("comesFrom").alias("kind"), F.col("def_idx").alias("parent_idx"), F.lit("latest").alias("via")),
        F.struct(F.lit("comesFrom").alias("kind"),
                 F.when(F.col("first_def") < F.col("idx"), F.col("first_def")).alias("parent_idx"), F.lit("first").alias("via")))
    return uses.select(doc, "name", "idx", F.inline(both)).filter(F.col("parent_idx").isNotNull())


def flow_edges_of_programs(progs: DataFrame, doc: str = "doc_id", src: str = "src") -> DataFrame:
    """JOIN10, JOIN12 and JOIN13 on Java programs: (doc_id, name, idx, kind, parents), the definitions that reach each variable
    token through branches and loops, merged and sorted; see ``functions.dataflow``.  Arrow batches where the rows are: no
    shuffle.  A null text has no edges."""
    import pyarrow as pa

    from complexa.functions.arrow import per_row
    from complexa.functions.dataflow import flow_rows

    kind = pa.list_(pa.struct([("name", pa.string()), ("idx", pa.int32()), ("kind", pa.string()), ("parents", pa.list_(pa.int32()))]))
    edges = per_row(lambda t: [] if t is None else flow_rows(t), kind, "array<struct<name:string,idx:int,kind:string,parents:array<int>>>", F.col(src))
    return progs.select(doc, edges.alias("e")).select(doc, F.inline("e"))


def merge_edges(edges: DataFrame, doc: str = "doc_id") -> DataFrame:
    """JOIN12: same (name, idx, kind) -> sorted union of parents."""
    return edges.groupBy(doc, "name", "idx", "kind").agg(F.sort_array(F.collect_set("parent_idx")).alias("parents"))


def merge_branch_states(states: DataFrame, doc: str = "doc_id", var: str = "name", branch: str = "branch") -> DataFrame:
    """JOIN13: per variable, the sorted union of definition indices over all branches."""
    return states.groupBy(doc, var).agg(F.sort_array(F.collect_set("def_idx")).alias("defs"),
                                        F.countDistinct(branch).cast("long").alias("n_branches"))


def prune_edges(nodes: DataFrame, edges: DataFrame, doc: str = "doc_id") -> DataFrame:
    """JOIN11: keep nodes that have parents or are a parent (semi join with the id union)."""
    ids = edges.select(doc, "idx").unionByName(edges.select(doc, F.col("parent_idx").alias("idx"))).distinct()
    return nodes.join(ids, [doc, "idx"], "left_semi")


def reindex_edges(edges: DataFrame, doc: str = "doc_id", nodes: DataFrame | None = None) -> DataFrame:
    """JOIN14: dense positions over the nodes that edges touch; with ``nodes`` (a truncated or
    pruned node set) edges whose endpoints are not kept are dropped first.

    Each edge is split into its two endpoints, ``dense_rank`` per document numbers
    the endpoints, and the edge is re-assembled by grouping on its own columns;
    all three steps are keyed by the document, so they share one partitioning.
    """
    e = edges
    if nodes is not None:
        kept = nodes.select(doc, "idx")
        e = e.join(kept, [doc, "idx"], "left_semi").join(kept.withColumnRenamed("idx", "parent_idx"),
                                                        [doc, "parent_idx"], "left_semi")
    cols = [c for c in e.columns if c != doc]
    ends = e.select(doc, *cols, F.inline(F.array(F.struct(F.lit(0).alias("role"), F.col("idx").alias("node")),
                                                 F.struct(F.lit(1).alias("role"), F.col("parent_idx").alias("node")))))
    ranked = ends.withColumn("p", F.dense_rank().over(Window.partitionBy(doc).orderBy("node")) - 1)
    return ranked.groupBy(doc, *cols).agg(F.max(F.when(F.col("role") == 0, F.col("p"))).alias("pos"),
                                          F.max(F.when(F.col("role") == 1, F.col("p"))).alias("parent_pos"))


def token_spans(tokens: DataFrame, doc: str = "doc_id", piece: int = 4) -> DataFrame:
    """WIN10: sub-token span [a, b) of every word: ceil(len/piece) pieces, running sum per document."""
    n = F.greatest(F.ceil(F.length("word") / piece), F.lit(1)).cast("long")
    w = Window.partitionBy(doc).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    t = tokens.withColumn("n_sub", n).withColumn("b", F.sum("n_sub").over(w))
    return t.withColumn("a", F.col("b") - F.col("n_sub"))


def span_pairs(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """JOIN15: node <-> sub-token positions with a <= tok < b (range join as explode(sequence))."""
    return spans.select(doc, "idx", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("tok"))


def edge_budget(edges: DataFrame, budget: int, doc: str = "doc_id") -> DataFrame:
    """WIN11: the first ``budget`` edges of each document in token order (the model's DFG length)."""
    w = Window.partitionBy(doc).orderBy("idx", "parent_idx")
    return edges.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= budget).drop("_rn")
