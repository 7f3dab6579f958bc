"""Benchmark decontamination by size-partitioned MinHash containment search
(DataFrame operations only).

A test item with q distinct n-gram shingles is contained in a document that
has at least ``num / den`` of them.  The item's sketch is its bottom-k MinHash
sample, the k smallest shingle hashes, with k = u - ceil(u * num / den) + 1 for
the largest size u of the item's size partition.  A containing document lacks
fewer than k shingles of the item, so it has at least one of the sketch: the
search misses nothing.  Documents stream past the sketches of the partitions
that they are large enough for; pairs that meet are verified by the exact
intersection of the shingle sets.  Document rows are never shuffled unless the
sketches or the candidates outgrow a checked broadcast size.

Signatures of equal length and banding would need a bound on the similarity,
which is near zero between a short item and a long document; the bottom-k form
keeps MinHash but is exact for containment.

Defined cases: null or blank text (of either side) has no shingle and matches
nothing; fewer words than n: the whole sequence is the only shingle; repeated
documents and items give a row each; null ids are kept; empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from complexa.llm.common import WHITE_CLASS, fresh_name, row_key, work_table

#: A side of a join is broadcast up to this many (16-byte) rows; beyond it Spark shuffles.
BROADCAST_ROWS = 500_000


def shingled(df: DataFrame, n: int, text: str = "text") -> DataFrame:
    """Add ``shingles``: 64-bit hashes of the distinct word n-grams of the lower-cased text."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), WHITE_CLASS + "+"), lambda w: w != "")

    def grams(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))
        short = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.expr("cast(array() as array<bigint>)"))
        return F.when(F.size(h) >= n, runs).otherwise(short)

    # the one-element array binds the word hashes to a lambda variable: they are computed once per text, not once per n-gram
    bound = F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), grams)
    return df.withColumn("shingles", F.array_distinct(F.get(bound, F.lit(0))))


def _small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its counted size allows one (give a written table)."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, items: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, rid, item_id, n_item, n_shared for every pair with n_shared / n_item >= num / den."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("rid"))
    tests = shingled(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), n).select(
        "item_id", "shingles", F.size("shingles").alias("n_item")).filter("n_item > 0")
    tests = work_table(tests.withColumn("item_no", F.monotonically_increasing_id()), "items")
    # size partitions: (2**(c-1), 2**c]; the sketch length is that of the largest size of the partition
    upper = F.pow(F.lit(2.0), F.ceil(F.log2("n_item"))).cast("long")
    k = (upper - F.ceil(upper * num / den) + 1).cast("int")
    least = F.ceil((F.floor(upper / 2) + 1) * num / den).cast("int")
    sketch = work_table(tests.select("item_no", F.when(F.col("n_item") == 1, 1).otherwise(least).alias("least_size"),
                                     F.explode(F.slice(F.sort_array("shingles"), F.lit(1), k)).alias("h")), "sketches")
    # explode_outer: Spark would test the size of a plain explode's array first, and so compute it twice
    probes = shingled(rows, n).select("rid", F.explode_outer("shingles").alias("h"), F.size("shingles").alias("n_doc"))
    met = probes.join(_small(sketch), "h").filter("n_doc >= least_size").select("rid", "item_no").distinct()
    pairs = work_table(met, "candidates")
    near = work_table(pairs.select("rid").distinct(), "candidate-docs")
    texts = shingled(rows.join(_small(near), "rid", "left_semi"), n).select("doc_id", "rid", "shingles")
    checked = texts.withColumnRenamed("shingles", "doc_shingles").join(_small(pairs), "rid").join(
        tests.hint("broadcast") if tests.count() <= BROADCAST_ROWS // 50 else tests, "item_no").withColumn(
        "n_shared", F.size(F.array_intersect("shingles", "doc_shingles")))
    return checked.filter(F.col("n_shared") * den >= F.col("n_item") * num).select(
        "doc_id", "rid", "item_id", F.col("n_item").cast("long").alias("n_item"), F.col("n_shared").cast("long").alias("n_shared"))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that contain no test item."""
    rid = fresh_name(docs, "__rid")
    hit = contaminated(docs, items, n, num, den).select(F.col("rid").alias(rid)).distinct()
    hit = _small(work_table(hit, "contaminated"))
    return docs.withColumn(rid, row_key()).join(hit, rid, "left_anti").select(*docs.columns)
