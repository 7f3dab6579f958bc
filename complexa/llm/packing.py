"""Packing into fixed-length training sequences: first-fit decreasing with a
tournament tree of bin capacities, run on its own in each randomised group.

Tasks tokenise whole texts and cut every document into full sequences and a
rest; ids stay there (only their CRC and length move on).  Pieces are dealt at
random (a seeded uniform draw, so no key can make a group hot) to groups of
about ``GROUP_PIECES``; within a group the rests, longest first, go to the
first bin that still has room, found by walking a tree whose nodes hold the
largest room below them.

Defined cases: null text counts as empty (a document is then its end id
alone); repeated rows are separate documents; a null doc_id stays null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complexa.llm.common import text_array, work_table

SEQUENCE, END_ID = 1024, 0
#: Mean number of pieces in a randomised group.
GROUP_PIECES = 4096
VOCABULARY = "byte_bpe_50k.json"
#: Texts of these characters are cut into words alike by both tokeniser libraries.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7eÀ-ɏ]")
_loaded: dict[str, object] = {}


def encoder(vocabulary: str):
    """ids(text) by ``tokenizers``.

    Its rank-file twin in ``tiktoken`` gives the same ids several times faster
    and is used for texts of plain characters without special tokens.
    """
    if vocabulary not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        full = Tokenizer.from_file(vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary))
        ranks = (vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)).removesuffix(".json") + ".tiktoken"
        fast = None
        if os.path.exists(ranks):
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})

        def ids(text: str) -> list[int]:
            if fast is None or "<|" in text or _PLAIN.search(text):
                return full.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _loaded[vocabulary] = ids
    return _loaded[vocabulary]


def cut_documents(docs: DataFrame, vocabulary: str = VOCABULARY, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens (all pieces but a document's last are full)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary)
        for batch in batches:
            col, doc_ids = text_array(batch), batch.column("doc_id").to_pylist()
            out: list[tuple] = []
            for doc_id, text in zip(doc_ids, col, strict=True):
                ids = np.array([*ids_of(text.as_py()), END_ID], "<u4")
                for a in range(0, len(ids), sequence):
                    part = ids[a:a + sequence]
                    out.append((doc_id, a, len(part), zlib.crc32(part.tobytes()), len(ids)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class Rooms:
    """Tournament tree over bins in order of opening: ``first(size)`` is the first bin with that much room."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def first(self, size: int) -> int:
        node, room, leaves = 1, self.room, self.leaves
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        return node - leaves

    def take(self, bin_: int, size: int) -> int:
        """Use ``size`` of a bin's room; where in the bin it begins (room left before)."""
        node, room = bin_ + self.leaves, self.room
        before = room[node]
        room[node] -= size
        node //= 2
        while node:
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
            node //= 2
        return before


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every size (each 1..capacity)."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    rooms = Rooms(max(1, len(sizes)), capacity)
    for i in order.tolist():
        size = int(sizes[i])
        b = rooms.first(size)
        bins[i], offsets[i] = b, capacity - rooms.take(b, size)
    return bins, offsets


def pack_pieces(pieces: DataFrame, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES, seed: int = 11) -> DataFrame:
    """Add sequence_id and offset to ``pieces``.  ``pieces`` is read twice: give a written table."""
    groups = max(1, -(-pieces.count() // group_pieces))

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(part["length"].to_numpy(), sequence)
        part["sequence_id"], part["offset"] = int(key[0]) + groups * bins, offsets
        return part.drop(columns="bin_group")

    dealt = pieces.withColumn("bin_group", F.floor(F.rand(seed) * groups).cast("long"))
    schema = ", ".join(f"{c} long" for c in [*pieces.columns, "sequence_id", "offset"])
    return dealt.groupBy("bin_group").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece."""
    return pack_pieces(work_table(cut_documents(docs, vocabulary, sequence), "pieces"), sequence)
