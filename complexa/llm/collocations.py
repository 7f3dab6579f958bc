"""Phrase collocation mining by set-oriented (SETM) relations.

The relation of level k has one entry (piece, position, phrase) for every
occurrence of a k-word phrase that may still grow, sorted by position, where
positions of different pieces are never adjacent.  It is persisted in blocks of
some hundred thousand words of one language, one file each in the shared folder; a
piece is never cut.  A table names the files of the attempts that were kept.  A level
is made in three steps, as in SETM:

1. group-count: each block sends its distinct phrases with their counts, packed
   and dealt by phrase, to a task that adds them up;
2. semi-join: that task answers each block which of its phrases are frequent, with
   their totals, and tells one block of each phrase to report it as a candidate;
3. merge-join: a block joins its frequent occurrences with themselves at the next
   position; what meets is the relation of the next level.

A phrase travels once per block and not once per occurrence, so a word that is a
third of all words is no larger a group than any other.  Totals of all first and
last parts stay beside the phrases of a block, so that a candidate's cuts need no
join.  Phrases are compared by 64-bit hashes of language and words; the
candidates' own texts come from their occurrences.

Defined cases: null text is empty and has no words; a null lang is ``und``;
repeated rows count as often as they occur, null doc_ids as well; texts of any
length are cut only between pieces for a block's size, never for the counts; ties of
score and count go by the phrase's UTF-8 bytes; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from complexa.llm.blocks import read_block, write_block
from complexa.llm.common import Words, mix, ragged_range, release, release_path, text_array, text_chunks, work_table
from complexa.llm.tiles import deltas, sums, tile_of
from complexa.session import qualified, scratch_path

#: Pieces end at these characters (fixed by the contract); inside pieces, words are separated by space and tab.
PIECE_END = b".,;:!?\n\x0b\x0c\r"
MAX_WORDS, MIN_COUNT, INSIDE_PERCENT, TOP = 4, 30, 80, 2000
#: Words of a block, bytes of text that are split at once, and words of the corpus per counting task.
BLOCK_WORDS, SPLIT_BYTES, TILE_WORDS = 800_000, 2 << 20, 5_000_000
#: Blocks that a task opens, one after the other.
TASK_BLOCKS = 8

_U = np.uint64
_BREAK = np.zeros(256, bool)
_BREAK[list(PIECE_END)] = True
_SPACE = _BREAK.copy()
_SPACE[list(b" \t")] = True
_RELATION = ("block string, lang string, level int, n_words long, "
             "found_keys array<long>, found_texts array<string>, found_totals array<long>")
_ARRAYS = [("places", "ids", "words", "texts", "lengths"),
           ("places", "ids", "words", "texts", "lengths", "left", "right", "parts", "totals", "prefix", "suffix")]
_SENT = "tile int, block string, lang string, n_words long, keys binary, counts binary"
_ANSWER = "block string, lang string, n_words long, tile int, n int, frequent binary, totals binary, reports binary"


def _lang_salt(lang: str) -> np.uint64:
    return _U(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


def _phrase_keys(words: np.ndarray, lang: str) -> np.ndarray:
    """Keys of phrases; ``words`` has a row of word hashes each."""
    key = np.full(len(words), _lang_salt(lang), np.uint64)
    for j in range(words.shape[1]):
        key = mix(key * _U(0xD1342543DE82EF95) + words[:, j])
    return key


def _gather(blob: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return blob[ragged_range(start, lengths)]


@dataclass
class Known:
    """Frequent phrases of a block: their words (numbers in the block's word list), totals, and the totals of their first and last parts."""

    parts: np.ndarray
    totals: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray

    def joined(self, left: np.ndarray, right: np.ndarray) -> Known:
        """Phrases one word longer: each from the one that begins it and the one that ends it (totals to come)."""
        return Known(np.concatenate([self.parts[left], self.parts[right][:, -1:]], axis=1), np.zeros(len(left), np.int64),
                     np.concatenate([self.prefix[left], self.totals[left][:, None]], axis=1),
                     np.concatenate([self.suffix[right], self.totals[right][:, None]], axis=1))

    def arrays(self) -> dict[str, np.ndarray]:
        return {"parts": self.parts.astype("<i4"), "totals": self.totals.astype("<i8"), "prefix": self.prefix.astype("<i8"), "suffix": self.suffix.astype("<i8")}

    @staticmethod
    def read(r: dict[str, bytes], level: int) -> Known:
        totals = np.frombuffer(r["totals"], "<i8")
        return Known(np.frombuffer(r["parts"], "<i4").reshape(len(totals), level), totals,
                     *(np.frombuffer(r[c], "<i8").reshape(len(totals), level - 1) for c in ("prefix", "suffix")))


def _relation_row(folder: str, lang: str, level: int, n_words: int, places: np.ndarray, ids: np.ndarray, arrays: dict[str, np.ndarray],
                  found: tuple = ((), (), ())) -> dict:
    """Write a block's relation: sorted occurrences (place, phrase), and what tells its distinct phrases (``arrays``)."""
    block = write_block(folder, arrays | {"places": np.diff(places, prepend=0).astype("<i4"), "ids": ids.astype("<i4")})
    return {"block": block, "lang": lang, "level": level, "n_words": n_words,
            "found_keys": list(found[0]), "found_texts": list(found[1]), "found_totals": list(found[2])}


def _ends(r: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct phrase the frequent ones, one word shorter, that begin and end it."""
    return np.cumsum(np.frombuffer(r["left"], "<i4"), dtype=np.int64), np.frombuffer(r["right"], "<i4").astype(np.int64)


def _distinct_keys(r: dict[str, bytes], level: int, lang: str) -> np.ndarray:
    """Keys of a block's distinct phrases (not stored: they follow from the words)."""
    words = np.frombuffer(r["words"], np.uint64)
    if level == 1:
        return _phrase_keys(words[:, None], lang)
    left, right = _ends(r)
    parts = np.frombuffer(r["parts"], "<i4").reshape(-1, level - 1)
    return _phrase_keys(words[np.concatenate([parts[left], parts[right][:, -1:]], axis=1)], lang)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"block": pa.string(), "lang": pa.string(), "level": pa.int32(), "n_words": pa.int64(), "found_keys": pa.list_(pa.int64()),
             "found_texts": pa.list_(pa.string()), "found_totals": pa.list_(pa.int64())}
    names = [c.split()[0] for c in _RELATION.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.binary())) for c in names], names=names)


class _Held:
    """Words of one language that wait for their block."""

    def __init__(self) -> None:
        self.hashes, self.first, self.start, self.end, self.raw, self.bytes, self.n = [], [], [], [], [], 0, 0

    def add(self, hashes: np.ndarray, first: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> None:
        lengths = end - start
        at = np.cumsum(lengths) - lengths + self.bytes
        self.hashes.append(hashes)
        self.first.append(first)
        self.start.append(at)
        self.end.append(at + lengths)
        self.raw.append(_gather(data, start, lengths))
        self.bytes += int(lengths.sum())
        self.n += len(hashes)

    def row(self, folder: str, lang: str) -> dict:
        hashes, first = np.concatenate(self.hashes), np.concatenate(self.first)
        start, end, raw = np.concatenate(self.start), np.concatenate(self.end), np.concatenate(self.raw)
        words, spot, ids = np.unique(hashes, return_index=True, return_inverse=True)
        lengths = (end - start)[spot]
        # a place is the number of the word plus that of its piece: words of two pieces are never adjacent
        places = np.arange(len(hashes), dtype=np.int64) + np.cumsum(first)
        return _relation_row(folder, lang, 1, len(hashes), places, ids, {"words": words, "texts": _gather(raw, start[spot], lengths), "lengths": lengths.astype("<i4")})


def _occurrences(folder: str):
    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Level 1: every word of every piece."""
        held: dict[str, _Held] = {}
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            for a, b, raw, rows in text_chunks(text_array(batch), SPLIT_BYTES):
                words = Words(raw, rows, lower=True, space=_SPACE)
                if not len(words.start):
                    continue
                row = words.row_of()
                piece = np.cumsum(_BREAK[raw])[words.start]
                first = np.append(True, (piece[1:] != piece[:-1]) | (row[1:] != row[:-1]))
                lang = code[a:b][row]
                for c in np.unique(lang):
                    mine = lang == c
                    keep = held.setdefault(names[c], _Held())
                    keep.add(words.hash[mine], first[mine], words.start[mine], words.end[mine], words.data)
                    if keep.n >= BLOCK_WORDS:
                        yield _rows([held.pop(names[c]).row(folder, names[c])])
        for lang, keep in held.items():
            yield _rows([keep.row(folder, lang)])

    return occurrences


def _send(folder: str, tiles: int, level: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's distinct phrases and their counts, dealt by phrase."""
        for batch in batches:
            for block, lang, n_words in zip(*(batch.column(c).to_pylist() for c in ("block", "lang", "n_words")), strict=True):
                r = read_block(folder, block, ("ids", "words") if level == 1 else ("ids", "words", "left", "right", "parts"))
                keys = _distinct_keys(r, level, lang)
                order = np.argsort(keys)
                keys, counts = keys[order], np.bincount(np.frombuffer(r["ids"], "<i4"), minlength=len(keys))[order].astype("<i4")
                if not len(keys):
                    continue
                tile = tile_of(keys, tiles)
                cuts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
                spans = list(zip(cuts, np.append(cuts[1:], len(tile)), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tile[cuts].astype(np.int32)), pa.array([block] * len(spans), pa.string()),
                     pa.array([lang] * len(spans), pa.string()), pa.array([n_words] * len(spans), pa.int64()),
                     pa.array([deltas(keys[a:b]) for a, b in spans], pa.binary()),
                     pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary())], names=[c.split()[0] for c in _SENT.split(", ")])

    return send


def _answers(min_count: int):
    def answer(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """Totals of a tile's phrases; for each block, which of its phrases are frequent."""
        lists = [sums(raw) for raw in part["keys"]]
        sizes = np.array([len(x) for x in lists])
        keys, counts = np.concatenate(lists), np.frombuffer(b"".join(part["counts"]), "<i4").astype(np.int64)
        _, spot, back = np.unique(keys, return_index=True, return_inverse=True)
        totals = np.bincount(back, counts.astype(np.float64)).astype(np.int64) if counts.sum() < 2**53 else _exact_sums(back, counts)
        totals = totals[back]
        reports = np.zeros(len(keys), bool)
        reports[spot] = True
        frequent = totals >= min_count
        cuts = np.append(0, np.cumsum(sizes))
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        return pd.DataFrame({
            "block": part["block"].to_numpy(), "lang": part["lang"].to_numpy(), "n_words": part["n_words"].to_numpy(), "tile": np.full(len(part), int(key[0]), np.int32), "n": sizes.astype(np.int32),
            "frequent": [np.packbits(frequent[a:b]).tobytes() for a, b in spans],
            "totals": [totals[a:b][frequent[a:b]].astype("<i8").tobytes() for a, b in spans],
            "reports": [np.packbits(reports[a:b][frequent[a:b]]).tobytes() for a, b in spans]})

    return answer


def _exact_sums(back: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(int(back.max()) + 1, np.int64)
    np.add.at(out, back, counts)
    return out


def _extend(source: str, folder: str, level: int, last: int):
    names = [c.split()[0] for c in _RELATION.split(", ")]

    def extend(key: tuple, answers: pd.DataFrame) -> pd.DataFrame:
        """Semi-join with the frequent phrases, report candidates, merge-join at adjacent places."""
        answers = answers.sort_values("tile")
        lang, n_words = answers["lang"].iloc[0], int(answers["n_words"].iloc[0])
        r = read_block(source, key[0], _ARRAYS[min(level, 2) - 1])
        bits = [np.unpackbits(np.frombuffer(m, np.uint8), count=n).astype(bool) for m, n in zip(answers["frequent"], answers["n"], strict=True)]
        hit = np.concatenate(bits)
        order = np.argsort(_distinct_keys(r, level, lang))  # the order in which the phrases were sent
        frequent, total, reports = np.zeros(len(order), bool), np.zeros(len(order), np.int64), np.zeros(len(order), bool)
        frequent[order] = hit
        total[order[hit]] = np.frombuffer(b"".join(answers["totals"]), "<i8")
        reports[order[hit]] = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=int(b.sum())).astype(bool)
                                              for m, b in zip(answers["reports"], bits, strict=True)])
        some = np.flatnonzero(frequent)
        words, lengths = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["lengths"], "<i4").astype(np.int64)
        texts = np.frombuffer(r["texts"], np.uint8)
        if level == 1:
            known = Known(some[:, None], total[some], *(np.zeros((len(some), 0), np.int64) for _ in range(2)))
        else:
            left, right = _ends(r)
            known = Known.read(r, level - 1).joined(left[some], right[some])
            known.totals = total[some]
        found: tuple = ((), (), ())
        if level > 1:
            found = _candidates(lang, known, words, texts, lengths, np.flatnonzero(reports[some]))
        out = None
        if level < last:
            places, ids = np.cumsum(np.frombuffer(r["places"], "<i4"), dtype=np.int64), np.frombuffer(r["ids"], "<i4")
            stays = frequent[ids]
            places, ids = places[stays], (np.cumsum(frequent) - 1)[ids[stays]]
            meet = np.flatnonzero(places[1:] == places[:-1] + 1)
            pairs, new_ids = np.unique(ids[meet] * len(some) + ids[meet + 1], return_inverse=True)
            left, right = pairs // max(len(some), 1), pairs % max(len(some), 1)
            used, inverse = np.unique(known.parts, return_inverse=True)
            start = np.cumsum(lengths) - lengths
            known.parts = inverse.reshape(known.parts.shape)
            arrays = known.arrays() | {"left": np.diff(left, prepend=0).astype("<i4"), "right": right.astype("<i4"), "words": words[used], "texts": _gather(texts, start[used], lengths[used]),
                                       "lengths": lengths[used].astype("<i4")}
            out = _relation_row(folder, lang, level + 1, n_words, places[meet], new_ids, arrays, found)
        else:
            out = {c: None for c in names} | {"lang": lang, "level": level + 1, "n_words": n_words,
                                              "found_keys": list(found[0]), "found_texts": list(found[1]), "found_totals": list(found[2])}
        return pd.DataFrame({c: pd.Series([out[c]], dtype=object if c not in ("level", "n_words") else None) for c in names})

    return extend


def _candidates(lang: str, known: Known, words: np.ndarray, texts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[list, list, list]:
    """Keys, texts and totals (flat; see ``_columns``) of the phrases ``at``."""
    level, blob, start = known.parts.shape[1], texts.tobytes(), np.cumsum(lengths) - lengths
    hashes = words[known.parts[at]]
    spans = [(s, n) for n in range(2, level) for s in range(level - n + 1)] + [(0, level)]
    keys = np.stack([_phrase_keys(hashes[:, s:s + n], lang).view(np.int64) for s, n in spans], axis=1)
    # cut after j words: the first j are a prefix, the other level - j a suffix
    numbers = np.concatenate([known.totals[at][:, None], known.prefix[at], known.suffix[at][:, ::-1]], axis=1)
    ends = start + lengths
    said = [b" ".join(blob[start[w]:ends[w]] for w in row).decode("utf-8", "replace") for row in known.parts[at]]
    return keys.ravel().tolist(), said, numbers.ravel().tolist()


def _columns(found: DataFrame, level: int) -> DataFrame:
    """lang, level, key, phrase, a, l and r of the lowest cut, its score, and the keys of the candidates inside."""
    inner = level * (level + 1) // 2 - level - 1
    width, per = inner + 1, 2 * level - 1
    one = found.select("lang", F.posexplode("found_texts").alias("i", "phrase"), "found_keys", "found_totals").select(
        "lang", "phrase", F.slice("found_keys", F.col("i") * width + 1, F.lit(width)).alias("k"),
        F.slice("found_totals", F.col("i") * per + 1, F.lit(per)).alias("t"))
    cuts = F.expr(f"transform(sequence(1, {level - 1}), j -> named_struct("
                  f"'score', CAST(t[0] AS DECIMAL(19,0)) * 2000000 div (CAST(t[j] AS DECIMAL(19,0)) + t[{level - 1} + j]), 'cut', j, 'l', t[j], 'r', t[{level - 1} + j]))")
    return one.select("lang", "phrase", F.lit(level).alias("level"), F.col("k")[inner].alias("key"), F.slice("k", 1, inner).alias("inner"),
                      F.col("t")[0].alias("a"), F.array_min(cuts).alias("cut")).select("*", "cut.score", "cut.l", "cut.r").drop("cut")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, inside_percent: int = INSIDE_PERCENT,
                 top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of 2 to ``max_words`` words of each language (module docstring)."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    spark, found = docs.sparkSession, []
    base = qualified(spark, scratch_path(spark, f"setm-{uuid.uuid4().hex}"))
    folders = [f"{base}/level-{k}" for k in range(max_words + 1)]  # a level's blocks go when the next level is written
    relation = work_table(texts.mapInArrow(_occurrences(folders[0]), _RELATION), "setm-1")
    lang_words = relation.groupBy("lang").agg(F.sum("n_words").alias("n"))
    tiles = int(max(8, -(-(relation.agg(F.sum("n_words")).first()[0] or 0) // TILE_WORDS)))
    for level in range(1, max_words + 1):
        blocks = relation.select("block", "lang", "n_words").filter("block is not null")
        tasks = max(1, -(-blocks.count() // TASK_BLOCKS))
        sent = blocks.repartition(tasks, "block").mapInArrow(_send(folders[level - 1], tiles, level), _SENT)
        answers = work_table(sent.groupBy("tile").applyInPandas(_answers(min_count), _ANSWER), f"setm-answers-{level}")
        step = _extend(folders[level - 1], folders[level], level, max_words)
        longer = work_table(answers.repartition(tasks, "block").groupBy("block").applyInPandas(step, _RELATION), f"setm-{level + 1}")
        release(answers)
        release_path(spark, folders[level - 1])
        relation = longer
        if level > 1:
            found.append(_columns(relation, level))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = work_table(every, "setm-candidates")
    around = every.select(F.explode("inner").alias("key"), "a").groupBy("key").agg(F.max("a").alias("longest"))
    kept = every.join(around, "key", "left").filter(
        f"longest is null or CAST(longest AS DECIMAL(19,0)) * 100 < CAST(a AS DECIMAL(19,0)) * {inside_percent}")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of each slice of a language first, so that no task sorts a whole language
    part = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("key"), F.lit(64))).orderBy(*best))
    some = kept.withColumn("rank", part).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    return ranked.join(lang_words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
