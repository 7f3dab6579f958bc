"""Chat-turn preparation (PRJ14-PRJ20, WIN12) on the long form (conv_id, turn, role, text)
and on the nested form ``array<struct<role, content>>``.

Per-conversation work is a window or a group keyed by the conversation, so
it is bounded by one chat; packing uses a two-level prefix sum, so no
operator needs a global single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference (do not edit).
HUMAN_PREFIX = "\n\nHuman: "
ASSISTANT_PREFIX = "\n\nAssistant: "
MAX_LENGTH = 2048
# ---------------------------------------------------------------------------
EOS = "<|eot_id|>"


def messages(chat: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Long form -> nested form (conv_id, messages array<struct<role, content>>), ordered by turn."""
    return (chat.groupBy(conv)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), "role",
                                                      F.col("text").alias("content")))).alias("m"))
            .select(conv, F.transform("m", lambda x: F.struct(x["role"].alias("role"),
                                                             x["content"].alias("content"))).alias("messages")))


def remove_assistant(msgs) -> Column:
    """PRJ14: drop assistant messages from a nested message array."""
    return F.filter(msgs, lambda m: m["role"] != "assistant")


def truncate_messages(msgs, n: int = MAX_LENGTH) -> Column:
    """PRJ17: every content cut to ``n`` characters."""
    return F.transform(msgs, lambda m: F.struct(m["role"].alias("role"), F.left(m["content"], F.lit(n)).alias("content")))


def render_chat(msgs, eos: str = EOS, add_generation_prompt: bool = False) -> Column:
    """PRJ16: system -> content, user -> Human turn, assistant -> Assistant turn, others -> ''."""
    piece = lambda m: (F.when(m["role"] == "system", m["content"])
                       .when(m["role"] == "user", F.concat(F.lit(HUMAN_PREFIX), m["content"], F.lit(eos)))
                       .when(m["role"] == "assistant", F.concat(F.lit(ASSISTANT_PREFIX), m["content"], F.lit(eos)))
                       .otherwise(F.lit("")))
    out = F.array_join(F.transform(msgs, piece), "")
    return F.concat(out, F.lit(ASSISTANT_PREFIX)) if add_generation_prompt else out


def last_assistant(msgs) -> Column:
    """PRJ9 (nested form): content of the last assistant message."""
    a = F.filter(msgs, lambda m: m["role"] == "assistant")
    return F.get(a, F.size(a) - 1)["content"]


def merge_user_turns(chat: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """PRJ15 on the long form -> (conv_id, pos, role, text).

    system/user texts are concatenated (no separator) into one user message
    that is flushed before every other message, even when empty, and once at
    the end when non-empty.  One ``aggregate`` fold per conversation (the
    turns of one chat), so the whole operator is a single shuffle by
    conversation.
    """
    msgs = messages(chat, conv, turn)
    init = F.struct(F.array().cast("array<struct<role:string,content:string>>").alias("out"), F.lit("").alias("buf"))

    def step(acc, m):
        is_user = m["role"].isin("system", "user")
        flushed = F.concat(acc["out"], F.array(F.struct(F.lit("user").alias("role"), acc["buf"].alias("content")),
                                                 F.struct(m["role"].alias("role"), m["content"].alias("content"))))
        return F.struct(F.when(is_user, acc["out"]).otherwise(flushed).alias("out"),
                        F.when(is_user, F.concat(acc["buf"], m["content"])).otherwise(F.lit("")).alias("buf"))

    def finish(acc):
        tail = F.array(F.struct(F.lit("user").alias("role"), acc["buf"].alias("content")))
        return F.when(acc["buf"] != "", F.concat(acc["out"], tail)).otherwise(acc["out"])

    merged = msgs.select(conv, F.aggregate("messages", init, step, finish).alias("m"))
    return merged.select(conv, F.posexplode("m").alias("pos", "msg")).select(
        conv, F.col("pos").cast("long").alias("pos"), F.col("msg.role").alias("role"), F.col("msg.content").alias("text"))


def truncate_pad(ids, max_len: int, pad: int) -> Column:
    """PRJ18: first ``max_len`` ids, right-padded with ``pad`` to exactly ``max_len``."""
    head = F.slice(_c(ids), 1, max_len)
    return F.concat(head, F.array_repeat(F.lit(pad), F.greatest(F.lit(max_len) - F.size(head), F.lit(0))))


def argmax(values) -> Column:
    """PRJ19: index of the largest value, first index wins ties (0-based)."""
    v = _c(values)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _range_starts(totals: DataFrame, size: int) -> DataFrame:
    """(rg, rg_start) for (rg, rg_len): the sum of all lower ranges, level by level."""
    widest = totals.agg(F.min("rg"), F.max("rg")).first()
    levels, lo, hi = 0, widest[0] or 0, widest[1] or 0
    while lo != hi:  # ranges of the next level, until there is one
        lo, hi, levels = lo // size, hi // size, levels + 1
        if (lo, hi) == (-1, 0):
            break
    level = totals.select("rg", F.col("rg_len").alias("len"))
    stack = []
    for _ in range(levels):
        level = level.withColumn("up", F.floor(F.col("rg") / size))
        stack.append(level)
        level = level.groupBy("up").agg(F.sum("len").alias("len")).withColumnRenamed("up", "rg")
    top = F.coalesce(F.sum(F.when(F.col("rg") < 0, F.col("len"))).over(Window.partitionBy(F.lit(0))), F.lit(0))  # at most two rows
    starts = level.select("rg", F.when(F.col("rg") >= 0, top).otherwise(0).cast("long").alias("rg_start"))
    for level in reversed(stack):
        before = Window.partitionBy("up").orderBy("rg").rowsBetween(Window.unboundedPreceding, -1)
        inner = level.withColumn("before", F.coalesce(F.sum("len").over(before), F.lit(0)))
        upper = starts.select(F.col("rg").alias("up"), F.col("rg_start").alias("up_start"))
        starts = inner.join(upper, "up").select("rg", (F.col("up_start") + F.col("before")).alias("rg_start"))
    return starts


def pack_sequences(texts: DataFrame, order: str, text: str = "text", block: int = MAX_LENGTH,
                   range_size: int = 4096) -> DataFrame:
    """WIN12: concatenate all texts in ``order`` and cut the stream into ``block``-character blocks.

    Offsets come from a multi-level prefix sum: totals per key range, per range
    of ranges and so on, each level with a window inside its ranges only, until
    one range is left; no window sees more than ``range_size`` keys (sparse keys
    make smaller ranges, ties of a key go together, in the order of their texts' hashes).  A text spanning blocks is cut into pieces with
    ``explode(sequence(...))`` (a range join without a join); each block is
    re-assembled from its pieces, which total at most ``block`` characters.
    """
    t = texts.select(F.col(order).alias("k"), F.col(text).alias("t")).withColumn("len", F.length("t"))
    t = t.withColumn("rg", F.floor(F.col("k") / range_size))
    totals = t.groupBy("rg").agg(F.sum("len").alias("rg_len"))
    base = _range_starts(totals, range_size)
    inner = Window.partitionBy("rg").orderBy("k", "tie").rowsBetween(Window.unboundedPreceding, -1)
    t = (t.withColumn("tie", F.xxhash64("t")).withColumn("in_start", F.coalesce(F.sum("len").over(inner), F.lit(0)))
          .join(base.select("rg", "rg_start"), "rg")
          .withColumn("start", F.col("rg_start") + F.col("in_start"))
          .filter(F.col("len") > 0))
    pieces = t.select("k", "t", "start", "len", F.explode(F.sequence(
        F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("len") - 1) / block))).alias("block"))
    lo = F.greatest(F.col("start"), F.col("block") * block)
    hi = F.least(F.col("start") + F.col("len"), (F.col("block") + 1) * block)
    pieces = pieces.select("block", "start", F.substring(F.col("t"), (lo - F.col("start") + 1).cast("int"),
                                                     (hi - lo).cast("int")).alias("piece"))
    return (pieces.groupBy("block")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))),
                                          lambda x: x["piece"]), "").alias("text")))
