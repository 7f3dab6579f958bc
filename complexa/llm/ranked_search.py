"""Ranked lexical search with MaxScore over term pairs.

Documents are cut into segments of about two megabytes of text, each with its
own inverted index, a file in the shared folder: postings with final impacts for the terms that the batch
of queries uses, the highest impact of each term, and for pairs of terms the
precomputed intersection list with the joint impact of each shared document and
the highest joint impact.  The terms of a query are paired by falling weight, so
each term is in one pair at most.  What a pair can add to any document of the
segment is the largest of its joint maximum and its two single maxima (with a
repeated term, the joint maximum of the common repeats plus single maxima for the
rest), which is less than the sum of two independent maxima.

A query walks its pairs by falling bound.  As soon as the bounds that remain cannot
lift an unseen document to the score of the best ``top`` so far, only documents with
a score are looked up, and only those that can still reach it.  Documents of equal
score are never skipped, so ties stay right.  The threshold goes on from segment
to segment of a task; the tasks' best are ranked at last.

A score is integer arithmetic throughout (see the query); only the logarithm in a
term's weight is a double.

Queries are taken in blocks of about ``BLOCK_CHARS`` characters, so that what is
sent to the tasks is bounded; each block scans the documents once.

Defined cases: null texts have no terms; documents without terms do not count; equal
(item_id, text) rows are one item; repeated documents are ranked each; a null
doc_id sorts first among equal scores and a null item_id stays an item; items without
terms, and empty tables, give no rows; whole texts are indexed, whatever their length;
other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from complexa.llm.blocks import read_block, write_block
from complexa.llm.common import Words, release_path, text_array, text_chunks, work_table
from complexa.session import qualified, scratch_path

TOP = 20
SEGMENT_BYTES, BLOCK_CHARS = 2 << 20, 4_000_000
#: Segments that a task opens, one after the other.
TASK_SEGMENTS = 16

_NO_ID = -2**63
_SPACE = np.ones(256, bool)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _SPACE[_a:_b + 1] = False
_SEGMENT = "docs long, total long, terms array<int>, df array<int>, path string"


def terms_of(col: pa.Array, limit: int = SEGMENT_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, terms) of runs of texts."""
    for a, b, raw, rows in text_chunks(col, limit):
        yield a, b, Words(raw, rows, lower=True, space=_SPACE)


# ------------------------------------------------------------------ queries
class Queries:
    """A block of queries: their distinct terms, and for each query its pairs of terms with repeats."""

    def __init__(self, texts: list[str]):
        found = [w.hash for text in texts for _, _, w in terms_of(pa.array([text]), 1 << 40)]
        self.terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))
        self.own = [np.unique(np.searchsorted(self.terms, h), return_counts=True) for h in found]
        self.weights = np.zeros(len(self.terms), np.int64)
        self.pairs = np.zeros((0, 2), np.int64)
        self.units: list[tuple] = []

    def weigh(self, n_docs: int, df: dict[int, int]) -> None:
        """Weights from the document counts; then the pairs, by falling weight in each query."""
        for t, d in df.items():
            self.weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1)))
        number: dict[tuple, int] = {}
        for terms, repeats in self.own:
            order = np.lexsort((terms, -self.weights[terms]))
            t, q = terms[order], repeats[order]
            first, second = t[0::2], np.append(t[1::2], [-1] * (len(t) % 2)).astype(np.int64)
            q2 = np.append(q[1::2], [0] * (len(t) % 2)).astype(np.int64)
            pair = [number.setdefault((int(x), int(y)), len(number)) if y >= 0 else -1 for x, y in zip(first, second, strict=True)]
            self.units.append((first, second, q[0::2], q2, np.array(pair, np.int64)))
        self.pairs = np.array(list(number), np.int64).reshape(-1, 2)


# ------------------------------------------------------------------ index
def _segments(folder: str, terms: np.ndarray):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with terms, their lengths, and the postings (document, occurrences) of ``terms``."""
        for batch in batches:
            ids = pc.fill_null(batch.column("doc_id"), _NO_ID).to_numpy()
            for a, b, words in terms_of(text_array(batch)):
                n = np.diff(words.rows)
                here = np.flatnonzero(n)
                if not len(here):
                    continue
                local = np.cumsum(n > 0) - 1
                at = np.minimum(np.searchsorted(terms, words.hash), max(len(terms) - 1, 0))
                hit = np.flatnonzero(terms[at] == words.hash) if len(terms) else np.zeros(0, np.int64)
                code, tf = np.unique(at[hit] * len(here) + local[words.row_of()[hit]], return_counts=True)
                term, post = code // len(here), code % len(here)
                first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
                path = write_block(folder, {"ids": ids[a:b][here].astype("<i8"), "lengths": n[here].astype("<i8"), "post": post.astype("<i4"), "tf": tf.astype("<i4")})
                df = np.diff(np.append(first, len(term)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(here)], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([term[first].astype(np.int32)], pa.list_(pa.int32())),
                     pa.array([df.astype(np.int32)], pa.list_(pa.int32())), pa.array([path], pa.string())], names=[c.split()[0] for c in _SEGMENT.split(", ")])

    return build


def _impacts(source: str, folder: str, queries: Queries, n_docs: int, total: int):
    pairs = queries.pairs

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Impacts of all postings; intersection lists and joint impacts of the pairs."""
        for batch in batches:
            for r in batch.to_pylist():
                r |= read_block(source, r["path"])
                terms, df = np.array(r["terms"], np.int64), np.array(r["df"], np.int64)
                starts = np.append(0, np.cumsum(df))
                post, tf = np.frombuffer(r["post"], "<i4"), np.frombuffer(r["tf"], "<i4").astype(np.int64)
                m = 100 - 25 + (25 * np.frombuffer(r["lengths"], "<i8") * n_docs) // total
                impact = np.repeat(queries.weights[terms], df) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[post]))
                where = np.full(len(queries.terms) + 1, -1)
                where[terms] = np.arange(len(terms))
                got, sizes, shared, joint = [], [], [], []
                dense, last = np.zeros(len(m), np.int64), -1
                left, right = where[pairs[:, 0]], where[pairs[:, 1]]
                both = np.flatnonzero((left >= 0) & (right >= 0))
                for p in both[np.argsort(left[both], kind="stable")]:
                    x, y = left[p], right[p]
                    if x != last:
                        dense[:] = -1
                        dense[post[starts[x]:starts[x + 1]]] = impact[starts[x]:starts[x + 1]]
                        last = x
                    docs = post[starts[y]:starts[y + 1]]
                    own = dense[docs]
                    meet = np.flatnonzero(own >= 0)
                    if len(meet):
                        got.append(p)
                        sizes.append(len(meet))
                        shared.append(docs[meet])
                        joint.append(own[meet] + impact[starts[y]:starts[y + 1]][meet])
                path = write_block(folder, {
                    "ids": np.frombuffer(r["ids"], "<i8"), "terms": terms, "starts": starts, "post": post, "impacts": impact,
                    "pairs": np.array(got, np.int64), "pair_starts": np.append(0, np.cumsum(sizes)).astype(np.int64),
                    "pair_post": np.concatenate([np.zeros(0, "<i4"), *shared]), "pair_impacts": np.concatenate([np.zeros(0, np.int64), *joint])})
                yield pa.RecordBatch.from_pydict({"path": pa.array([path], pa.string())})

    return index


class Segment:
    """The index of a segment, opened."""

    def __init__(self, row: dict, n_terms: int, n_pairs: int):
        long = {c: np.frombuffer(row[c], "<i8") for c in ("ids", "terms", "starts", "impacts", "pairs", "pair_starts", "pair_impacts")}
        self.ids, self.starts, self.impacts = long["ids"], long["starts"], long["impacts"]
        self.post, self.pair_post = np.frombuffer(row["post"], "<i4"), np.frombuffer(row["pair_post"], "<i4")
        self.pair_starts, self.pair_impacts = long["pair_starts"], long["pair_impacts"]
        self.where, self.highest = np.full(n_terms + 1, -1), np.zeros(n_terms + 1, np.int64)
        self.where[long["terms"]] = np.arange(len(long["terms"]))
        if len(self.impacts):
            self.highest[long["terms"]] = np.maximum.reduceat(self.impacts, self.starts[:-1])
        self.pair_where, self.pair_highest = np.full(n_pairs + 1, -1), np.zeros(n_pairs + 1, np.int64)
        self.pair_where[long["pairs"]] = np.arange(len(long["pairs"]))
        if len(self.pair_impacts):
            self.pair_highest[long["pairs"]] = np.maximum.reduceat(self.pair_impacts, self.pair_starts[:-1])

    def bounds(self, unit: tuple) -> np.ndarray:
        """The most that each pair of a query can add to a document of the segment."""
        first, second, q1, q2, pair = unit
        one, two = q1 * self.highest[first], q2 * self.highest[second]
        common = np.minimum(q1, q2)
        joint = common * self.pair_highest[pair] + (q1 - common) * self.highest[first] + (q2 - common) * self.highest[second]
        joint = np.where(self.pair_highest[pair] > 0, np.minimum(joint, one + two), 0)
        return np.maximum(np.maximum(one, two), joint)

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.where[term]
        a, b = (self.starts[at], self.starts[at + 1]) if at >= 0 else (0, 0)
        return self.post[a:b], self.impacts[a:b]

    def pair_postings(self, pair: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.pair_where[pair]
        a, b = (self.pair_starts[at], self.pair_starts[at + 1]) if at >= 0 else (0, 0)
        return self.pair_post[a:b], self.pair_impacts[a:b]


def _found(post: np.ndarray, impacts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Impact of each of the sorted ``docs`` in a list (-1: not there)."""
    if not len(post):
        return np.full(len(docs), -1, np.int64)
    at = np.minimum(np.searchsorted(post, docs), len(post) - 1)
    return np.where(post[at] == docs, impacts[at], -1)


def search(segment: Segment, unit: tuple, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (positions) and scores that may be among the best ``top``, given that ``top`` others have ``floor``."""
    bounds = segment.bounds(unit)
    order = np.argsort(-bounds, kind="stable")
    order = order[bounds[order] > 0]
    rest = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)
    score = np.zeros(len(segment.ids), np.int64)
    i = 0
    # any document may still get in: whole lists
    while i < len(order) and rest[i] >= floor:
        first, second, q1, q2, _ = (x[order[i]] for x in unit)
        for term, q in ((first, q1), (second, q2)):
            post, impacts = segment.postings(term)
            score[post] += q * impacts
        i += 1
        if i < len(order) and len(score) >= top:
            floor = max(floor, int(np.partition(score, len(score) - top)[len(score) - top]))
    docs = np.flatnonzero((score > 0) & (score + rest[i] >= floor))
    own = score[docs]
    # only documents with a score can: lookups
    while i < len(order) and len(docs):
        first, second, q1, q2, pair = (x[order[i]] for x in unit)
        more = np.zeros(len(docs), np.int64)
        joint = _found(*segment.pair_postings(pair), docs)
        inside = joint >= 0
        if q1 == q2:
            more[inside] = q1 * joint[inside]
            left = np.flatnonzero(~inside)
        else:
            left = np.arange(len(docs))
        for term, q in ((first, q1), (second, q2)):
            more[left] += q * np.maximum(_found(*segment.postings(term), docs[left]), 0)
        own = own + more
        i += 1
        if len(own) >= top:
            floor = max(floor, int(np.partition(own, len(own) - top)[len(own) - top]))
        stay = own + rest[i] >= floor
        docs, own = docs[stay], own[stay]
    return docs, own


def _searcher(folder: str, queries: Queries, top: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for path in batch.column("path").to_pylist():
                segment = Segment(read_block(folder, path), len(queries.terms), len(queries.pairs))
                for q, unit in enumerate(queries.units):
                    ids, scores = best.get(q, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    docs, found = search(segment, unit, top, int(scores[-1]) if len(scores) == top else 1)
                    if len(docs):
                        ids, scores = np.append(ids, segment.ids[docs]), np.append(scores, found)
                        order = np.lexsort((ids, -scores))[:top]
                        best[q] = ids[order], scores[order]
        for q, (ids, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q), pa.int64()), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)],
                                             names=["query", "doc_id", "score"])

    return scan


def _rank_block(docs: DataFrame, items: list, top: int) -> DataFrame | None:
    spark, queries = docs.sparkSession, Queries([r["text"] for r in items])
    base = qualified(spark, scratch_path(spark, f"search-{uuid.uuid4().hex}"))
    segments = work_table(docs.mapInArrow(_segments(f"{base}/postings", queries.terms), _SEGMENT), "search-segments")
    size = segments.agg(F.sum("docs").alias("n"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("segments")).first()
    if not size["n"]:
        return None
    df = segments.select(F.explode(F.arrays_zip("terms", "df")).alias("e")).groupBy("e.terms").agg(F.sum("e.df").alias("df"))
    queries.weigh(size["n"], {r["terms"]: r["df"] for r in df.collect()})  # one row per term of the block at most
    tasks = -(-size["segments"] // TASK_SEGMENTS)
    weighted = _impacts(f"{base}/postings", f"{base}/index", queries, size["n"], size["total"])
    index = work_table(segments.select("terms", "df", "path").repartition(tasks, "path").mapInArrow(weighted, "path string"), "search-index")
    release_path(spark, f"{base}/postings")
    found = index.repartition(tasks, "path").mapInArrow(_searcher(f"{base}/index", queries, top), "query long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], "query long, item_id long")
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item (module docstring)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    chars = asked.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    out = None
    for k in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        ranked = _rank_block(texts, block, top) if block else None
        if ranked is not None:
            out = ranked if out is None else out.unionByName(ranked)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
