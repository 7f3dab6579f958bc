"""Exchange of very many small hash entries between tasks.

Entries (owner, 64-bit key) are dealt by key to *tiles*.  What a task has for
one tile goes into one row of packed arrays: the owners, how many entries each
has, and the low 32 bits of the keys (the tile fixes the high bits), about
five bytes an entry where plain rows take three times as much.  The number of
tiles grows with the corpus, so a tile stays small at every size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complexa.llm.common import list_array, mix

TILE_SCHEMA = "tile int, owners array<long>, counts array<int>, keys binary, extra binary"
#: Entries that a task gathers before it packs them.
FLUSH_ENTRIES = 1_500_000


def tiles_for(docs: DataFrame, chars_per_tile: int, column: str = "text") -> int:
    """Number of tiles for the corpus, from its total length."""
    total = docs.agg(F.sum(F.length(column))).first()[0] or 0
    return int(max(8, -(-total // chars_per_tile)))


def tile_of(keys: np.ndarray, tiles: int) -> np.ndarray:
    t = ((keys >> np.uint64(32)) * np.uint64(tiles)) >> np.uint64(32)
    return t.astype(np.uint16 if tiles < 65536 else np.int32)


def deltas(keys: np.ndarray) -> bytes:
    """Differences of sorted uint64 keys, byte by byte: the high ones are mostly zero and compress well."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def sums(raw: bytes) -> np.ndarray:
    """The keys of ``deltas``."""
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


class Packer:
    """Gathers entries and packs them.  ``extra``: fixed-width values beside each key (or None)."""

    def __init__(self, tiles: int):
        self.tiles, self.parts, self.size = tiles, [], 0

    def add(self, owners: np.ndarray, keys: np.ndarray, extra: np.ndarray | None = None) -> bool:
        """True if it is time to pack.  Entries of an owner must be adjacent."""
        self.parts.append((owners.astype(np.int64, copy=False), keys, extra))
        self.size += len(keys)
        return self.size >= FLUSH_ENTRIES

    def pack(self) -> pa.RecordBatch | None:
        if not self.size:
            self.parts = []
            return None
        owners = np.concatenate([p[0] for p in self.parts])
        keys = np.concatenate([p[1] for p in self.parts])
        extra = None if self.parts[0][2] is None else np.concatenate([p[2] for p in self.parts])
        self.parts, self.size = [], 0
        return packed_rows(tile_of(keys, self.tiles), owners, keys.astype("<u4"), extra)


def packed_rows(tile: np.ndarray, owners: np.ndarray, values: np.ndarray, extra: np.ndarray | None = None) -> pa.RecordBatch:
    """One row per tile: owners, their counts, and the packed values (entries of an owner adjacent in the input)."""
    order = np.argsort(tile, kind="stable")
    tile, owners, values = tile[order], owners[order], values[order]
    new_tile = np.append(True, tile[1:] != tile[:-1])
    runs = np.flatnonzero(new_tile | np.append(True, owners[1:] != owners[:-1]))
    counts = np.diff(np.append(runs, len(tile)))
    cuts = np.append(np.flatnonzero(new_tile), len(tile))
    per_tile = np.diff(np.searchsorted(runs, cuts))

    def cut(x: np.ndarray) -> list[bytes]:
        return [x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    return pa.RecordBatch.from_arrays(
        [pa.array(tile[cuts[:-1]].astype(np.int32)), list_array(owners[runs], per_tile, pa.int64()),
         list_array(counts.astype(np.int32), per_tile, pa.int32()), pa.array(cut(values), pa.binary()),
         pa.array([None] * (len(cuts) - 1) if extra is None else cut(extra[order]), pa.binary())],
        names=["tile", "owners", "counts", "keys", "extra"])


def packed_home(owners: np.ndarray, values: np.ndarray, homes: int) -> pd.DataFrame:
    """Values on their way to their owners: packed rows dealt by owner, so there are as many rows as homes, not owners."""
    if not len(owners):
        return pd.DataFrame({"tile": np.zeros(0, np.int32)} | {c: np.zeros(0, object) for c in ("owners", "counts", "keys", "extra")})
    order = np.argsort(owners, kind="stable")
    owners = owners[order]
    return packed_rows(tile_of(mix(owners.view(np.uint64)), homes), owners, values[order]).to_pandas()


def by_owner(packed: DataFrame, kind: str, name: str) -> DataFrame:
    """rid and ``name`` (binary of the distinct values) for every owner in ``packed`` rows of ``packed_home``."""

    def gather(part: pd.DataFrame) -> pd.DataFrame:
        owners, values, _ = unpack(part, kind=kind)
        order = np.lexsort((values, owners))
        owners, values = owners[order], values[order]
        first = np.flatnonzero(np.append(True, owners[1:] != owners[:-1])) if len(owners) else np.zeros(0, int)
        ends = np.append(first[1:], len(owners))
        packed_values = [np.unique(values[a:b]).tobytes() for a, b in zip(first, ends, strict=True)]
        return pd.DataFrame({"rid": owners[first], name: pd.Series(packed_values, dtype=object)})

    return packed.groupBy("tile").applyInPandas(gather, f"rid long, {name} binary")


def unpack(part: pd.DataFrame, extra: str | None = None, kind: str | np.dtype = "<u4"):
    """(owner, key, extra) of every entry of a tile's rows."""
    if not len(part):
        return np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, extra or "u1")
    owners = np.concatenate([np.asarray(x, np.int64) for x in part["owners"]])
    counts = np.concatenate([np.asarray(x, np.int64) for x in part["counts"]])
    keys = np.frombuffer(b"".join(part["keys"]), kind)
    more = None if extra is None else np.frombuffer(b"".join(part["extra"]), extra)
    return np.repeat(owners, counts), keys, more
