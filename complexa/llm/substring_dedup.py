"""Substring dedup by fixed-block anchors.

A window is ``window`` consecutive words.  With blocks of (window + 1) // 2
words every window holds one whole block of its own document's fixed grid, so
two places with the same window meet at the anchor of either of them.

1. The non-overlapping grid blocks of all documents are the index; *every*
   rolling run of block length in every document probes it (packed tiles, five
   bytes a probe).  A block that occurs at two or more places is a hit.
2. Hits are extended: each window around a hit is a candidate, and candidates
   are counted over the whole corpus by a (tile, 32 + 32 bit) hash of all their
   words.  Windows found twice are repeats; runs of them are the maximal exact
   repeats.
3. Words under a repeated window go.  Every window is judged on the input.

Texts move twice: once to meet their hits, and (only those with candidates)
once to meet their repeats.  Defined cases: null text has no words; a text
shorter than the window loses nothing; repeated rows are separate places, so
their windows repeat; a null doc_id stays null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complexa.llm.common import Words, inside, row_key, sequence_hashes, text_array, text_chunks, work_table
from complexa.llm.tiles import TILE_SCHEMA, Packer, by_owner, packed_home, tile_of, tiles_for, unpack

WINDOW = 35
CHARS_PER_TILE = 16_000_000
_SALT = 0x51ED270B
_U = np.uint64


def _index_rows(blocks: np.ndarray, tiles: int) -> pa.RecordBatch:
    blocks = np.unique(blocks)  # sorted, so entries of a tile are adjacent
    tile = tile_of(blocks, tiles)
    cuts = np.append(np.flatnonzero(np.append(True, tile[1:] != tile[:-1])), len(tile))
    keys = [blocks[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    n = len(keys)
    return pa.RecordBatch.from_arrays(
        [pa.array(tile[cuts[:-1]].astype(np.int32)), pa.array([[]] * n, pa.list_(pa.int64())), pa.array([[]] * n, pa.list_(pa.int32())),
         pa.array(keys, pa.binary()), pa.array([b"index"] * n, pa.binary())], names=["tile", "owners", "counts", "keys", "extra"])


def block_hits(docs: DataFrame, block: int, tiles: int) -> DataFrame:
    """rid, hits: the runs of ``block`` words of a document that are a grid block somewhere and occur twice or more."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, index = Packer(tiles), []
        for batch in batches:
            rids = batch.column("rid").to_numpy(zero_copy_only=False)
            for a, b, data, rows in text_chunks(text_array(batch)):
                words = Words(data, rows)
                at, counts = inside(words.rows, block), np.maximum(np.diff(words.rows) - block + 1, 0)
                if not len(at):
                    continue
                runs = sequence_hashes(words.hash, block)[at]
                place = at - np.repeat(words.rows[:-1], counts)
                index.append(runs[place % block == 0])
                if packer.add(np.repeat(rids[a:b], counts), runs):
                    yield packer.pack()
                    yield _index_rows(np.concatenate(index), tiles)
                    index = []
        if (last := packer.pack()) is not None:
            yield last
            yield _index_rows(np.concatenate(index), tiles)

    def probe(part: pd.DataFrame) -> pd.DataFrame:
        marked = part["extra"].notna()
        index = np.unique(np.frombuffer(b"".join(part.loc[marked, "keys"]), "<u4"))
        owner, keys, _ = unpack(part[~marked])
        at = np.searchsorted(index, keys)
        found = at < len(index)
        found[found] = index[at[found]] == keys[found]
        owner, at = owner[found], at[found]
        many = np.bincount(at, minlength=len(index))[at] >= 2
        return packed_home(owner[many], index[at[many]], tiles)

    sent = docs.select("rid", "text").mapInArrow(send, TILE_SCHEMA)
    return by_owner(sent.groupBy("tile").applyInPandas(probe, TILE_SCHEMA), "<u4", "hits")


def _packed(batch: pa.RecordBatch, column: str, kind: str) -> list[np.ndarray | None]:
    return [None if x is None else np.frombuffer(x, kind) for x in batch.column(column).to_pylist()]


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _candidates(batches: Iterator[pa.RecordBatch], window: int, block: int) -> Iterator[pa.RecordBatch]:
    """doc_id, rid, n_words, and either kept_sha256 (no candidate) or text with the starts of its candidate windows."""
    for batch in batches:
        hits = _packed(batch, "hits", "<u4")
        for a, b, data, rows in text_chunks(text_array(batch)):
            words = Words(data, rows)
            runs = sequence_hashes(words.hash, block)
            out = []
            for i in range(b - a):
                lo, hi = int(words.rows[i]), int(words.rows[i + 1])
                raw = data[rows[i]:rows[i + 1]].tobytes()
                starts = np.zeros(0, "<u4")
                if hits[a + i] is not None and hi - lo >= window:
                    seeds = np.flatnonzero(np.isin(runs[lo:hi - block + 1].astype(np.uint32), hits[a + i]))
                    edge = np.zeros(hi - lo + 2, np.int64)
                    np.add.at(edge, np.maximum(seeds - (window - block), 0), 1)
                    np.add.at(edge, seeds + 1, -1)
                    starts = np.flatnonzero(np.cumsum(edge)[:hi - lo - window + 1]).astype("<u4")
                if len(starts):
                    out.append((hi - lo, None, raw.decode("utf-8"), starts.tobytes()))
                else:
                    out.append((hi - lo, _sha(raw.split()), None, None))
            n, sha, text, starts = zip(*out, strict=True)
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("rid"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string()),
                 pa.array(starts, pa.binary())], names=["doc_id", "rid", "n_words", "kept_sha256", "text", "starts"])


def _window_hashes(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    return sequence_hashes(words.hash, window), sequence_hashes(words.hash, window, _SALT).astype("<u4")


def window_repeats(suspects: DataFrame, window: int, tiles: int) -> DataFrame:
    """rid, repeats: the candidate windows (low 32 bits of one hash, 32 of another) that occur twice or more."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(tiles)
        for batch in batches:
            rids, col = batch.column("rid").to_numpy(zero_copy_only=False), batch.column("starts")
            for a, b, data, rows in text_chunks(text_array(batch)):
                words = Words(data, rows)
                first, second = _window_hashes(words, window)
                starts = [np.frombuffer(x.as_py(), "<u4") for x in col.slice(a, b - a)]
                counts = np.array([len(x) for x in starts])
                at = np.concatenate(starts).astype(np.int64) + np.repeat(words.rows[:-1], counts)
                if packer.add(np.repeat(rids[a:b], counts), first[at], second[at]):
                    yield packer.pack()
        if (last := packer.pack()) is not None:
            yield last

    def count(part: pd.DataFrame) -> pd.DataFrame:
        owner, low, second = unpack(part, "<u4")
        whole = low.astype("<u8") << _U(32) | second
        order = np.argsort(whole, kind="stable")
        sorted_ = whole[order]
        same = sorted_[1:] == sorted_[:-1]
        many = order[np.append(same, False) | np.append(False, same)] if len(order) else order
        return packed_home(owner[many], whole[many], tiles)

    sent = suspects.select("rid", "text", "starts").mapInArrow(send, TILE_SCHEMA)
    return by_owner(sent.groupBy("tile").applyInPandas(count, TILE_SCHEMA), "<u8", "repeats")


def _cleaned(batches: Iterator[pa.RecordBatch], window: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        repeats = _packed(batch, "repeats", "<u8")
        for a, b, data, rows in text_chunks(text_array(batch)):
            words = Words(data, rows)
            first, second = _window_hashes(words, window)
            keys = first << _U(32) | second
            out = []
            for i in range(b - a):
                lo, hi = int(words.rows[i]), int(words.rows[i + 1])
                parts = data[rows[i]:rows[i + 1]].tobytes().split()
                starts = np.zeros(0, int)
                if repeats[a + i] is not None:
                    starts = np.flatnonzero(np.isin(keys[lo:hi - window + 1], repeats[a + i]))
                edge = np.zeros(hi - lo + 1, np.int64)
                edge[starts] += 1
                edge[starts + window] -= 1
                keep = np.cumsum(edge)[:-1] == 0
                kept = list(compress(parts, keep.tolist()))
                out.append((hi - lo - len(kept), _sha(kept), b" ".join(kept).decode("utf-8") if texts else None))
            removed, sha, text = zip(*out, strict=True)
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("rid"), part.column("n_words"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()),
                 pa.array(text, pa.string())], names=["doc_id", "rid", "n_words", "n_removed", "kept_sha256", "kept_text"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """doc_id, rid, n_words, n_removed, kept_sha256 per row, and kept_text of the rows that had candidate windows
    (with ``texts``; null: nothing was removed)."""
    block = (window + 1) // 2
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("rid"))
    tiles = tiles_for(rows, CHARS_PER_TILE)
    hits = work_table(block_hits(rows, block, tiles), "hits")
    judged = work_table(
        rows.join(hits, "rid", "left").select("doc_id", "rid", "text", "hits").mapInArrow(
            lambda it: _candidates(it, window, block),
            "doc_id long, rid long, n_words long, kept_sha256 string, text string, starts binary"), "judged")
    suspects = judged.filter("text is not null")
    repeats = work_table(window_repeats(suspects, window, tiles), "repeats")
    done = suspects.select("doc_id", "rid", "n_words", "text").join(repeats, "rid", "left").select(
        "doc_id", "rid", "n_words", "text", "repeats").mapInArrow(
        lambda it: _cleaned(it, window, texts), "doc_id long, rid long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    clean = judged.filter("text is null").select("doc_id", "rid", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256",
                                                 F.lit(None).cast("string").alias("kept_text"))
    return done.unionByName(clean)
