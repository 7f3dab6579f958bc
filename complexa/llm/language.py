"""Language identification by words first, then by shorter and shorter character n-grams.

A text is lower-cased; its words are runs of letters (with their marks).  A word
that the model knows scores, for each language, the log10 of its relative
frequency there (``PENALTY`` if it was not seen in that language).  An unknown word is
written between two blanks and scored by the mean over its n-grams of the longest
length of which the model knows at least one, from ``LONGEST`` down to one
character.  A word without any known character says nothing.  The language with
the highest mean over the words is predicted.

Learning counts all words of all training texts: tasks add up and send distinct
words, packed and dealt by word; n-gram counts are made from the distinct words with
their totals, once each.  The model holds, for words and for each n-gram length, what
has at least ``languages / MAX_FEATURES`` of a language's occurrences, so it has at
most ``MAX_FEATURES`` entries a length, whatever the corpus; only they reach the driver.

Defined cases: ``und`` with score 0 for a null text or one without a letter; rows with
null lang or text teach nothing; without any training text all is ``und``; a text
whose words say nothing gets the language with most words, ties go to the smaller
name; a null doc_id counts as the text '' for the fold; repeated rows count as often
as they occur; an empty table gives no rows; other columns are ignored.  Whole texts
are read, whatever their length.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complexa.llm.common import Words, inside, mix, ragged_range, sequence_hashes, text_array, text_chunks, work_table
from complexa.llm.ngram_lm import fold
from complexa.llm.tiles import deltas, sums, tile_of

LONGEST = 4
PENALTY = -7.0
MAX_FEATURES = 400_000
#: Words that a task holds before it adds up; words of the corpus per counting task; words from which a score is as sure as it gets.
FLUSH_WORDS, TILE_WORDS, SURE_WORDS = 2_000_000, 5_000_000, 16

_U = np.uint64
_SENT = "tile int, lang string, n_words long, keys binary, counts binary, texts binary, lengths binary"
_COUNTED = "lang string, size int, total long, keys array<long>, counts array<long>"
_tables: dict[str, np.ndarray] = {}


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it a letter; is it part of a word (letters and marks)."""
    if not _tables:
        kinds = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
        _tables["letter"] = np.array([k == "L" for k in kinds])
        _tables["word"] = np.array([k in "LM" for k in kinds])
    return _tables["letter"], _tables["word"]


def _code_points(raw: np.ndarray) -> np.ndarray:
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")


def words_of(raw: np.ndarray, rows: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words of lower-cased texts, and for each text whether it holds a letter."""
    letter, word = _classes()
    points = _code_points(raw)
    lead = (raw & 0xC0) != 0x80
    width = np.diff(np.append(np.flatnonzero(lead), len(raw)))
    data = np.where(np.repeat(word[points], width), raw, np.uint8(32))
    before = np.append(0, np.cumsum(letter[points]))
    at = np.append(0, np.cumsum(lead))[rows]
    return Words(data, rows), before[at[1:]] > before[at[:-1]]


def gram_keys(texts: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams of ``size`` characters of words between blanks, and the word of each."""
    points = _code_points(texts)
    starts = (texts & 0xC0) != 0x80
    chars = np.diff(np.append(0, np.cumsum(starts))[np.append(0, np.cumsum(lengths))])
    # a blank before and after each word
    rows = np.append(0, np.cumsum(chars + 2))
    padded = np.full(rows[-1], 32, np.uint32)
    padded[ragged_range(rows[:-1] + 1, chars)] = points
    own = np.repeat(np.arange(len(lengths)), np.maximum(chars + 2 - size + 1, 0))
    keys = sequence_hashes(mix(padded.astype(np.uint64) + _U(1)), size, salt=size)
    return keys[inside(rows, size)], own


# ------------------------------------------------------------------ learning
class _Held:
    """Words of one language that a task has not added up yet."""

    def __init__(self) -> None:
        self.hashes, self.start, self.lengths, self.raw, self.bytes, self.n = [], [], [], [], 0, 0

    def add(self, hashes: np.ndarray, start: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> None:
        # one text of each distinct word of the run is enough
        distinct, spot, back = np.unique(hashes, return_index=True, return_inverse=True)
        self.hashes.append((distinct, np.bincount(back)))
        lengths = lengths[spot]
        self.start.append(np.cumsum(lengths) - lengths + self.bytes)
        self.lengths.append(lengths)
        self.raw.append(data[ragged_range(start[spot], lengths)])
        self.bytes += int(lengths.sum())
        self.n += len(hashes)

    def rows(self, lang: str, tiles: int) -> pa.RecordBatch:
        keys, counts = (np.concatenate([h[i] for h in self.hashes]) for i in (0, 1))
        start, lengths, raw = np.concatenate(self.start), np.concatenate(self.lengths), np.concatenate(self.raw)
        keys, spot, back = np.unique(keys, return_index=True, return_inverse=True)
        counts = np.bincount(back, counts).astype(np.int64)
        start, lengths = start[spot], lengths[spot]
        tile = tile_of(keys, tiles)
        cuts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
        spans = list(zip(cuts, np.append(cuts[1:], len(keys)), strict=True))
        columns = {"tile": pa.array(tile[cuts].astype(np.int32)), "lang": pa.array([lang] * len(spans), pa.string()),
                   "n_words": pa.array([int(counts[a:b].sum()) for a, b in spans], pa.int64())}
        columns |= {c: pa.array(v, pa.binary()) for c, v in {
            "keys": [deltas(keys[a:b]) for a, b in spans], "counts": [counts[a:b].astype("<i8").tobytes() for a, b in spans],
            "texts": [raw[ragged_range(start[a:b], lengths[a:b])].tobytes() for a, b in spans],
            "lengths": [lengths[a:b].astype("<i4").tobytes() for a, b in spans]}.items()}
        return pa.RecordBatch.from_pydict(columns)


def _send_words(tiles: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Held] = {}
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            for a, b, raw, rows in text_chunks(pc.utf8_lower(text_array(batch))):
                words = words_of(raw, rows)[0]
                if not len(words.start):
                    continue
                lang = code[a:b][words.row_of()]
                for c in np.unique(lang):
                    mine = lang == c
                    keep = held.setdefault(names[c], _Held())
                    keep.add(words.hash[mine], words.start[mine], (words.end - words.start)[mine], words.data)
                    if keep.n >= FLUSH_WORDS:
                        yield held.pop(names[c]).rows(names[c], tiles)
        for lang, keep in held.items():
            yield keep.rows(lang, tiles)

    return send


def _count_tile(part: pd.DataFrame) -> pd.DataFrame:
    """Totals of a tile's words by language, and of the n-grams in them."""
    out = []
    for lang, rows in part.groupby("lang"):
        keys = np.concatenate([sums(raw) for raw in rows["keys"]])
        counts = np.frombuffer(b"".join(rows["counts"]), "<i8")
        lengths = np.frombuffer(b"".join(rows["lengths"]), "<i4").astype(np.int64)
        texts = np.frombuffer(b"".join(rows["texts"]), np.uint8)
        start = np.cumsum(lengths) - lengths
        keys, spot, back = np.unique(keys, return_index=True, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, back, counts)
        out.append((lang, 0, keys, total))
        lengths = lengths[spot]
        texts = texts[ragged_range(start[spot], lengths)]
        for size in range(1, LONGEST + 1):
            grams, word = gram_keys(texts, lengths, size)
            grams, back = np.unique(grams, return_inverse=True)
            seen = np.zeros(len(grams), np.int64)
            np.add.at(seen, back, total[word])
            out.append((lang, size, grams, seen))
    return pd.DataFrame({"lang": [o[0] for o in out], "size": np.array([o[1] for o in out], np.int32), "total": [int(o[3].sum()) for o in out],
                         "keys": [o[2].view(np.int64) for o in out], "counts": [o[3] for o in out]})


@dataclass
class LanguageModel:
    """For words (size 0) and each n-gram length: sorted keys, and the (language, log10 frequency - PENALTY) entries of each."""

    langs: list[str]
    fallback: int
    keys: list[np.ndarray]
    ends: list[np.ndarray]
    lang: list[np.ndarray]
    gain: list[np.ndarray]

    def values(self, size: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, log10 frequencies by language) of ``keys``."""
        have, out = self.keys[size], np.full((len(keys), len(self.langs)), PENALTY)
        if not len(have):
            return np.zeros(len(keys), bool), out
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        known = have[at] == keys
        here = np.flatnonzero(known)
        first, n = self.ends[size][at[here]], self.ends[size][at[here] + 1] - self.ends[size][at[here]]
        entry = ragged_range(first, n)
        out[np.repeat(here, n), self.lang[size][entry]] += self.gain[size][entry]
        return known, out

    def word_values(self, hashes: np.ndarray, texts: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(says something, log10 frequencies by language) of distinct words; ``start`` and ``lengths`` in the bytes of ``texts``."""
        known, out = self.values(0, hashes)
        left = np.flatnonzero(~known)
        for size in range(LONGEST, 0, -1):
            if not len(left):
                break
            grams, word = gram_keys(texts[ragged_range(start[left], lengths[left])], lengths[left], size)
            distinct, back = np.unique(grams, return_inverse=True)
            seen, value = self.values(size, distinct)
            seen = seen[back]
            n = np.bincount(word[seen], minlength=len(left))
            got = n > 0
            for j in range(len(self.langs)):
                mean = np.bincount(word[seen], value[back[seen], j], minlength=len(left))[got] / n[got]
                out[left[got], j] = mean
            known[left[got]] = True
            left = left[~got]
        return known, out


def learn_languages(docs: DataFrame) -> LanguageModel | None:
    """From all ``text`` and ``lang`` of ``docs`` (None if there is nothing to learn from)."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    tiles = int(max(8, -(-chars // (6 * TILE_WORDS))))
    sent = rows.mapInArrow(_send_words(tiles), _SENT)
    counted = work_table(sent.groupBy("tile").applyInPandas(_count_tile, _COUNTED), "language-counts")
    total = {(r["lang"], r["size"]): r["n"] for r in counted.groupBy("lang", "size").agg(F.sum("total").alias("n")).collect()}
    langs = sorted({lang for lang, _ in total})
    if not langs:
        return None
    floors = docs.sparkSession.createDataFrame([(*k, n * len(langs) / MAX_FEATURES) for k, n in total.items()], "lang string, size int, floor double")
    # what stays is at most MAX_FEATURES entries a size
    entries = counted.select("lang", "size", F.explode(F.arrays_zip("keys", "counts")).alias("e")).groupBy(
        "lang", "size", F.col("e.keys").alias("key")).agg(F.sum("e.counts").alias("count")).join(F.broadcast(floors), ["lang", "size"]).filter("count >= floor")
    kept = entries.select("lang", "size", "key", "count").toArrow()
    code = {lang: i for i, lang in enumerate(langs)}
    lang = np.array([code[x] for x in kept.column("lang").to_pylist()], np.int32)
    size, key, count = (kept.column(c).to_numpy() for c in ("size", "key", "count"))
    parts: list[tuple] = []
    for s in range(LONGEST + 1):
        here = np.flatnonzero(size == s)
        k, who = key[here].view(np.uint64) if len(here) else np.zeros(0, np.uint64), lang[here]
        order = np.lexsort((who, k))
        k, who, c = k[order], who[order], count[here][order]
        all_of = np.array([total.get((x, s), 1) for x in langs], np.float64)
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        parts.append((k[first], np.append(first, len(k)), who, np.log10(c / all_of[who]) - PENALTY))
    words = np.array([total.get((x, 0), 0) for x in langs])
    return LanguageModel(langs, int(np.argmax(words)), *(list(x) for x in zip(*parts, strict=True)))


# ------------------------------------------------------------------ prediction
def predict(model: LanguageModel | None, raw: np.ndarray, rows: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each lower-cased text."""
    n = len(rows) - 1
    words, letters = words_of(raw, rows)
    if model is None:
        return ["und"] * n, np.zeros(n)
    hashes, spot, back = np.unique(words.hash, return_index=True, return_inverse=True)
    says, value = model.word_values(hashes, words.data, words.start[spot], (words.end - words.start)[spot])
    row, heard = words.row_of(), says[back]
    count = np.bincount(row[heard], minlength=n)
    mean = np.stack([np.bincount(row[heard], value[back[heard], j], minlength=n) for j in range(len(model.langs))], axis=1) / np.maximum(count, 1)[:, None]
    mean[count == 0, model.fallback] += 1e-9
    best = np.argmax(mean, axis=1)
    odds = 10.0 ** ((mean - mean.max(axis=1, keepdims=True)) * np.minimum(count, SURE_WORDS)[:, None])
    score = np.where(letters, 1 / odds.sum(axis=1), 0.0)
    return [model.langs[j] if ok else "und" for j, ok in zip(best, letters, strict=True)], score


def predict_languages(docs: DataFrame, model: LanguageModel | None, keep: str = "doc_id long") -> DataFrame:
    """Columns ``keep``, then lang_pred and score per row."""
    names = [c.split()[0] for c in keep.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: MAX_FEATURES entries a length

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, rows in text_chunks(pc.utf8_lower(text_array(batch))):
                langs, score = predict(shared.value, raw, rows)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(langs, pa.string()), pa.array(score)],
                                                 names=[*names, "lang_pred", "score"])

    return docs.select(*names, "text").mapInArrow(scan, f"{keep}, lang_pred string, score double")


def languages(docs: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows of the held-out fold (crc32 of the id as text) are not learned from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", folds) == held_out).alias("held_out"),
                       F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = learn_languages(rows.filter("not held_out"))
    return predict_languages(rows, model, "doc_id long, held_out boolean")
