"""Exact dedup by content-defined chunk recipes.

Each text is normalised (white space deleted) and cut into content-defined
chunks where it is read; only chunk identifiers and digests move on, a long
text is never shuffled.  A chunk's identifier is the first eight bytes of its
SHA-256; identifiers are *verified* over all chunks of the corpus: one that
stands for two different (length, SHA-256) is found by a pre-aggregated count
and texts that use it are compared by their full digests instead.  Texts are
equal when their ordered identifier lists are equal.

Defined cases: null text counts as empty, empty texts are equal to each other;
a null doc_id sorts after every other; of rows with the same doc_id, length
and text one (any) is kept; an empty table gives an empty result; columns
other than doc_id and text are ignored by ``exact_groups``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complexa.llm.common import WHITE, _BYTE, fresh_name, inverse, powers, row_key, text_array, work_table

#: A cut falls where the top bits of a rolling hash over 32 bytes are zero (one place in 1,024).
ROLL, CUT_BITS, MIN_CHUNK, MAX_CHUNK = 32, 10, 512, 8192
_G = 0xA0761D6478BD642D
_SCHEMA = ("doc_id long, rid long, n_cp long, text_sha256 string, recipe array<long>, "
           "evidence array<struct<id:long,size:int,digest:binary>>")


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of ``data`` (the last one is its length)."""
    n, ends, at = len(data), [], 0
    if n > MIN_CHUNK:
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[np.frombuffer(data, np.uint8)] * powers(_G, n), out=total[1:])
        roll = (total[ROLL:] - total[:-ROLL]) * powers(inverse(_G), n)[:n - ROLL + 1]
        for cut in (np.flatnonzero(roll >> np.uint64(64 - CUT_BITS) == 0) + ROLL).tolist():
            while cut - at > MAX_CHUNK:
                at += MAX_CHUNK
                ends.append(at)
            if cut - at >= MIN_CHUNK:
                ends.append(cut)
                at = cut
    while n - at > MAX_CHUNK:
        at += MAX_CHUNK
        ends.append(at)
    if at < n or not ends:
        ends.append(n)
    return ends


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = text_array(batch)
        for a in range(0, len(col), 1000):
            sizes, shas, recipes, evidence = [], [], [], []
            for s in col.slice(a, 1000):
                text = s.as_py()
                data = text.encode("utf-8").translate(None, WHITE)
                sizes.append(len(text))
                shas.append(hashlib.sha256(data).hexdigest())
                ids, proof, at = [], [], 0
                for end in chunk_ends(data):
                    digest = hashlib.sha256(data[at:end]).digest()
                    ids.append(int.from_bytes(digest[:8], "big", signed=True))
                    proof.append({"id": ids[-1], "size": end - at, "digest": digest})
                    at = end
                recipes.append(ids)
                evidence.append(proof)
            part = batch.slice(a, 1000)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("rid"), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()),
                 pa.array(recipes, pa.list_(pa.int64())),
                 pa.array(evidence, pa.list_(pa.struct([("id", pa.int64()), ("size", pa.int32()), ("digest", pa.binary())])))],
                names=["doc_id", "rid", "n_cp", "text_sha256", "recipe", "evidence"])


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, rid, keep_id, group_size, kept, text_sha256, n_chunks."""
    rows = docs.select(F.col("doc_id").cast("long"), row_key().alias("rid"), F.col("text").cast("string"))
    # the row number is fixed by the written table; it decides between rows that repeat each other
    found = work_table(rows.mapInArrow(_recipes, _SCHEMA).withColumn("row_no", F.monotonically_increasing_id()), "recipes")
    chunks = found.select("rid", F.explode("evidence").alias("e"))
    proof = F.struct("e.size", "e.digest")
    unverified = (chunks.groupBy(F.col("e.id").alias("id")).agg(F.min(proof).alias("lo"), F.max(proof).alias("hi"))
                  .filter("lo != hi").select("id"))
    suspects = chunks.join(unverified, F.col("e.id") == F.col("id"), "left_semi").select("rid").distinct()
    lists = found.join(suspects.withColumn("suspect", F.lit(True)), "rid", "left").select(
        "doc_id", "rid", "row_no", "n_cp", "text_sha256", "recipe",
        F.when(F.col("suspect"), F.col("evidence.digest")).otherwise(F.expr("cast(array() as array<binary>)")).alias("full"))
    # longest original first, then the smallest doc_id (nulls last)
    order = F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("row_no").alias("r"))
    groups = lists.groupBy("recipe", "full").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return lists.join(groups, ["recipe", "full"]).select(
        "doc_id", "rid", F.col("best.d").alias("keep_id"), "group_size", (F.col("row_no") == F.col("best.r")).alias("kept"),
        "text_sha256", F.size("recipe").alias("n_chunks"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    rid = fresh_name(docs, "__rid")
    kept = exact_groups(docs).filter("kept").select(F.col("rid").alias(rid))
    return docs.withColumn(rid, row_key()).join(kept, rid, "left_semi").dropDuplicates([rid]).select(*docs.columns)
