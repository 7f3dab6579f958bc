"""LM scoring with an Elias-Fano n-gram trie.

Level 1 holds the words (as 64-bit hashes, sorted; a word's id is its rank),
their exact counts and their back-off weights.  Level k, up to the order, holds
for each context, which is a position in level k - 1, the ids of the words that
follow it, made monotone by the context's place (context * (V + 1) + word), with
a monotone pointer per context and the quantised smoothed probability of each
n-gram.  All are Elias-Fano coded, split into shards by the range of the context,
written to the shared folder by the tasks that counted them, and memory-mapped by
the tasks that count the next level or score.

Counting: tasks add up their tokens and n-grams before they send them, packed
(sorted differences by byte), to the shard of the context; one pass over the
texts a level.  All training texts are counted in full.

Smoothing: absolute discounting, interpolated with the add-one unigram model
p1(w) = (c + 1) / (N + V + 1), whose extra type is the unknown word:
p(w | u) = max(c(uw) - d, 0) / c(u) + d * types(u) / c(u) * p(w | u'), where u' is
u without its first word, down to p1(w).  A context that was not seen counts as
u'; the begin of a text is one word of a context.  So the probabilities after any
context sum to one (up to quantisation).

Defined cases: null text counts as empty (it is the end token alone); a null
doc_id counts as the text '' for the fold; no training text: every token has
probability 1 / (N + V + 1) = 1; repeated rows count as often as they occur;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from complexa.llm.common import Words, mix, text_array, text_chunks, work_table
from complexa.llm.elias_fano import EliasFano, map_arrays, write_arrays
from complexa.llm.tiles import tile_of, tiles_for
from complexa.session import qualified, scratch_path

#: Hash of the end token, which is counted and scored like a word; the id of the begin context is V.
END = mix(np.array([0x656E64], np.uint64))[0]
DISCOUNT = 0.75
#: Log10 probabilities are stored in steps of RANGE / 65535.
RANGE = 14.0
CHARS_PER_SHARD = 32_000_000
FLUSH_TOKENS = 2_000_000
#: Levels of the trie that the query scores with.
ORDER = 3
_U = np.uint64
_PACKED = "tile int, keys binary, counts binary"


def quantise(log10p: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(-log10p, 0, RANGE) * (65535 / RANGE)).astype(np.uint16)


def restore(q: np.ndarray) -> np.ndarray:
    return q.astype(np.float64) * (-RANGE / 65535)


def token_stream(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, token hashes with one end per text, token offsets of the rows)."""
    for a, b, data, rows in text_chunks(col):
        words = Words(data, rows, lower=True)
        counts = np.diff(words.rows)
        tokens = np.insert(words.hash, words.rows[1:], END)
        yield a, b, tokens, np.append(0, np.cumsum(counts + 1))


def _deltas(keys: np.ndarray) -> bytes:
    """Differences of sorted keys, byte by byte: the high ones are mostly zero and compress well."""
    return np.diff(keys, prepend=_U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _sums(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _pack(tile: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(tile, kind="stable")
    tile, keys, counts = tile[order], keys[order], np.minimum(counts[order], 2**32 - 1).astype("<u4")
    cuts = np.append(np.flatnonzero(np.append(True, tile[1:] != tile[:-1])), len(tile))
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(tile[cuts[:-1]].astype(np.int32)), pa.array([_deltas(keys[a:b]) for a, b in spans], pa.binary()),
         pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary())], names=["tile", "keys", "counts"])


def _add_up(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of a shard's rows and their total counts."""
    keys = np.concatenate([_sums(raw) for raw in part["keys"]])
    counts = np.frombuffer(b"".join(part["counts"]), "<u4").astype(np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


@dataclass
class Level:
    """Where the shards of a level above the first are."""

    files: list[str | None]
    contexts: list[int]  # first context of each shard, then the end
    places: list[int]  # first position of each shard, then the number of n-grams


@dataclass
class Model:
    """Where the levels are; opened lazily in each process."""

    folder: str
    shards: int
    words: list[str | None]  # file of each word shard
    offsets: list[int]  # first word id of each shard, then V
    tokens: int  # N
    levels: list[Level] = field(default_factory=list)  # level 2 (its last shard is that of the begin context), 3, ...
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def types(self) -> int:
        return self.offsets[-1]

    def opened(self, path: str | None) -> dict | None:
        if path is None:
            return None
        cache = _OPEN.setdefault(self.key, {})
        if path not in cache:
            arrays = map_arrays(self.folder, path)
            cache[path] = arrays | {k: EliasFano(arrays, k) for k in {n[:-4] for n in arrays if n.endswith("meta")}}
        return cache[path]

    def ids_counts(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word id (V: unknown) and count of each of the sorted distinct ``hashes``."""
        ids, counts = np.full(len(hashes), self.types, np.int64), np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted(tile_of(hashes, self.shards), np.arange(self.shards + 1))
        for s in range(self.shards):
            a, b = int(cuts[s]), int(cuts[s + 1])
            level = self.opened(self.words[s])
            if a == b or level is None:
                continue
            at, found = level["word."].find(hashes[a:b])
            ids[a:b][found] = self.offsets[s] + at[found]
            counts[a:b][found] = level["count"][at[found]]
        return ids, counts

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct word ids (below V)."""
        out, cuts = np.zeros(len(ids), np.int64), np.searchsorted(ids, self.offsets)
        for s in range(self.shards):
            a, b = int(cuts[s]), int(cuts[s + 1])
            if a < b:
                out[a:b] = self.opened(self.words[s])["count"][ids[a:b] - self.offsets[s]]
        return out

    def log_unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.types + 1))

    @property
    def bits(self) -> int:
        """Bits of a word id in a key, those of the begin and the unknown context included."""
        return (self.types + 1).bit_length()

    def parts(self, firsts: list[int], at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(shard, a, b) of the runs of sorted ``at`` that lie in a shard."""
        cuts = np.searchsorted(at, firsts)
        return ((s, int(cuts[s]), int(cuts[s + 1])) for s in range(len(firsts) - 1) if cuts[s] < cuts[s + 1])

    def log_next(self, level: Level, context: np.ndarray, word: np.ndarray, lower: np.ndarray | None) -> tuple[np.ndarray | None, np.ndarray]:
        """log10 p(word | context) of entries sorted by context, and their positions in the level (its size: not there);
        ``lower``: log10 p(word | context without its first word), or None if positions are enough."""
        out, place = None if lower is None else lower.copy(), np.full(len(context), level.places[-1], np.int64)
        for s, a, b in self.parts(level.contexts, context):
            shard = self.opened(level.files[s])
            if shard is None:
                continue
            local = context[a:b] - level.contexts[s]
            some = np.arange(b - a)
            if out is not None:
                # the context's own range of successors, by its pointers; looked up once a context
                first = np.flatnonzero(np.append(True, local[1:] != local[:-1]))
                own, runs = local[first], np.diff(np.append(first, b - a))
                begin, end = shard["pointer."].get(own).astype(np.int64), shard["pointer."].get(own + 1).astype(np.int64)
                some = np.flatnonzero(np.repeat(end > begin, runs))
                score = lower[a:b].copy()
                score[some] += np.repeat(restore(shard["backoff"][own]), runs)[some]
            known = some[word[a:b][some] < self.types]
            at, found = shard["next."].find((local[known] * (self.types + 1) + word[a:b][known]).astype(np.uint64))
            if out is not None:
                score[known[found]] = restore(shard["prob"][at[found]])
                out[a:b] = score
            place[a + known[found]] = level.places[s] + at[found]
        return out, place

    def log_pairs(self, context: np.ndarray, word: np.ndarray, unigram: np.ndarray) -> np.ndarray:
        """log10 p(word | context) of pairs sorted by context (V: begin, V + 1: unknown); unigram: log10 p1(word)."""
        return self.log_next(self.levels[0], context, word, unigram)[0]

    def next_of(self, level: Level, context: np.ndarray, word: np.ndarray, lower: np.ndarray | None) -> tuple[np.ndarray | None, np.ndarray]:
        """``log_next`` of entries in any order, each distinct one looked up once (``lower`` is a function of the entry)."""
        distinct, back = np.unique(context.astype(np.uint64) << _U(self.bits) | word.astype(np.uint64), return_inverse=True)
        below = None
        if lower is not None:
            below = np.empty(len(distinct))
            below[back] = lower
        logs, place = self.log_next(level, (distinct >> _U(self.bits)).astype(np.int64),
                                    (distinct & _U((1 << self.bits) - 1)).astype(np.int64), below)
        return None if logs is None else logs[back], place[back]

    def shorter(self, order: int, place: np.ndarray) -> np.ndarray:
        """Positions in level ``order`` - 1 (2: word ids) of the n-grams at ``place`` in level ``order`` without their first words."""
        level, (place, back) = self.levels[order - 2], np.unique(place, return_inverse=True)
        context, word = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
        for s, a, b in self.parts(level.places, place):
            value = self.opened(level.files[s])["next."].get(place[a:b] - level.places[s]).astype(np.int64)
            context[a:b], word[a:b] = level.contexts[s] + value // (self.types + 1), value % (self.types + 1)
        if order > 2:
            word = self.next_of(self.levels[order - 3], self.shorter(order - 1, context), word, None)[1]
        return word[back]

    def descend(self, word: np.ndarray, offsets: np.ndarray, unigram: np.ndarray | None, levels: list[Level]) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
        """Down the levels, for every token (``word``: ids, V for unknown ones): log10 p(token | context) (``unigram`` None: not worked out), the position of
        the longest n-gram in the last level (its size: not there), and whether the text is long enough for one."""
        place, logs = word, unigram
        whole = np.ones(len(word), bool)
        for k, level in enumerate(levels):
            context = np.empty(len(word), np.int64)
            context[1:] = place[:-1]
            size = self.types if k == 0 else levels[k - 1].places[-1]
            if k == 0:
                context[1:][word[:-1] == self.types] = self.types + 1
                context[offsets[:-1]] = self.types
            else:
                whole[1:] = whole[:-1].copy()
                whole[offsets[:-1]] = False
                context[~whole] = size
            here = np.arange(len(word)) if k == 0 else np.flatnonzero(context < size)
            below, place = None if logs is None else logs[here], np.full(len(word), level.places[-1], np.int64)
            found, place[here] = self.next_of(level, context[here], word[here], below)
            if logs is not None:
                logs = logs.copy()
                logs[here] = found
        return logs, place, whole


_OPEN: dict[str, dict] = {}


def _flushed(batches: Iterator[pa.RecordBatch], keys_of: Callable, tile_of_keys: Callable) -> Iterator[pa.RecordBatch]:
    """Adds up the keys of a task, flush by flush, and packs them by tile."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        return _pack(*tile_of_keys(keys), counts)

    for batch in batches:
        for _, _, tokens, offsets in token_stream(text_array(batch)):
            held.append(keys_of(tokens, offsets))
            size += len(tokens)
            if size >= FLUSH_TOKENS:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def train(spark: SparkSession, texts: DataFrame, folder: str | None = None, order: int = 2) -> Model:
    """Count ``texts`` and write the trie of ``order`` levels (2 at least)."""
    folder = folder or scratch_path(spark, f"lm-{uuid.uuid4().hex}")
    folder = qualified(spark, folder)
    shards = tiles_for(texts, CHARS_PER_SHARD)
    texts = texts.select("text")

    def word_shard(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        words, counts = _add_up(part)
        path = write_arrays(folder, f"words-{key[0]}", EliasFano.encode(words, 2**64, "word.") | {"count": counts})
        return pd.DataFrame({"shard": [int(key[0])], "n": [len(words)], "total": [int(counts.sum())], "path": [path]})

    schema = "shard long, n long, total long, path string"
    sent = texts.mapInArrow(lambda it: _flushed(it, lambda t, o: t, lambda k: (tile_of(k, shards), k)), _PACKED)
    made = {r["shard"]: r for r in work_table(sent.groupBy("tile").applyInPandas(word_shard, schema), "lm-words").collect()}
    sizes = [made[s]["n"] if s in made else 0 for s in range(shards)]
    model = Model(folder, shards, [made[s]["path"] if s in made else None for s in range(shards)],
                  [0, *np.cumsum(sizes).tolist()], sum(r["total"] for r in made.values()))

    def count_level(k: int, contexts: list[int]) -> Level:
        """Count and write level ``k``, whose shards begin at ``contexts``."""
        starts, bits, mask = np.array(contexts), _U(model.bits), _U((1 << model.bits) - 1)

        def keys_of(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
            words, back = np.unique(tokens, return_inverse=True)
            ids = model.ids_counts(words)[0][back]
            _, place, whole = model.descend(ids, offsets, None, model.levels)
            context = np.empty_like(place)
            context[1:] = place[:-1]
            if k == 2:
                context[offsets[:-1]] = model.types
                used = whole
            else:
                used = np.append(False, whole[:-1])
                used[offsets[:-1]] = False
            return context[used].astype(np.uint64) << bits | ids[used].astype(np.uint64)

        def tiles(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            # empty shards share their start with the next one: take the last
            return (np.searchsorted(starts[:-1], (keys >> bits).astype(np.int64), "right") - 1).astype(np.int32), keys

        def shard(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            s, (keys, counts) = int(key[0]), _add_up(part)
            size = contexts[s + 1] - contexts[s]
            context = (keys >> bits).astype(np.int64)
            local, word = context - contexts[s], (keys & mask).astype(np.int64)
            types = np.bincount(local, minlength=size)
            total = np.bincount(local, counts, minlength=size)
            if k == 2:
                distinct, back = np.unique(word, return_inverse=True)
                lower = ((model.counts_of(distinct) + 1) / (model.tokens + model.types + 1))[back]
            else:  # every shorter n-gram is in the level above
                lower = 10 ** model.next_of(model.levels[-1], model.shorter(k - 1, context), word, np.zeros(len(word)))[0]
            backoff = DISCOUNT * types / np.maximum(total, 1)
            p = (counts - DISCOUNT) / total[local] + backoff[local] * lower
            arrays = EliasFano.encode((local * (model.types + 1) + word).astype(np.uint64), size * (model.types + 1), "next.")
            arrays |= EliasFano.encode(np.append(0, np.cumsum(types)).astype(np.uint64), len(keys) + 1, "pointer.")
            arrays |= {"prob": quantise(np.log10(p)), "backoff": quantise(np.log10(np.maximum(backoff, 1e-300)))}
            path = write_arrays(folder, f"level-{k}-{s}", arrays)
            return pd.DataFrame({"shard": [s], "n": [len(keys)], "total": [int(counts.sum())], "path": [path]})

        sent = texts.mapInArrow(lambda it: _flushed(it, keys_of, tiles), _PACKED)
        made = {r["shard"]: r for r in work_table(sent.groupBy("tile").applyInPandas(shard, schema), f"lm-level-{k}").collect()}
        n = [made[s]["n"] if s in made else 0 for s in range(len(contexts) - 1)]
        return Level([made[s]["path"] if s in made else None for s in range(len(n))], contexts, [0, *np.cumsum(n).tolist()])

    for k in range(2, order + 1):
        # positions in the level above in even ranges, finer as n-grams are more than pairs; words by their shards, then the begin context
        size = model.levels[-1].places[-1] if model.levels else 0
        contexts = [*model.offsets[:-1], model.types, model.types + 1] if k == 2 else [size * s // (4 * shards) for s in range(4 * shards + 1)]
        model.levels.append(count_level(k, contexts))
    return model


def score_texts(docs: DataFrame, model: Model, keep: str = "doc_id long") -> DataFrame:
    """Columns ``keep``, then n_tokens, n_known, base_score, score per row."""
    names = [c.split()[0] for c in keep.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, tokens, offsets in token_stream(text_array(batch)):
                words, back = np.unique(tokens, return_inverse=True)
                ids, counts = model.ids_counts(words)
                unigram = model.log_unigram(counts)
                # all words out of the vocabulary are one word to the levels below, and have one unigram value
                logs = model.descend(ids[back], offsets, unigram[back], model.levels)[0]
                n = np.diff(offsets)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names]
                    + [pa.array(n), pa.array(np.add.reduceat((counts[back] > 0).astype(np.int64), offsets[:-1])),
                       pa.array(np.add.reduceat(unigram[back], offsets[:-1])), pa.array(np.add.reduceat(logs, offsets[:-1]))],
                    names=[*names, "n_tokens", "n_known", "base_score", "score"])

    return docs.select(*names, "text").mapInArrow(scan, f"{keep}, n_tokens long, n_known long, base_score double, score double")


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % parts


def lm_scores(spark: SparkSession, docs: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; texts of fold 2 of 7 are not learned from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 7) == 2).alias("held_out"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model = train(spark, rows.filter("not held_out"), order=order)
    out = score_texts(rows, model, "doc_id long, held_out boolean")
    return out.withColumn("train_tokens", F.lit(model.tokens).cast("long"))
