"""Helpers shared by the operators: text columns as byte arrays, vectorised
word hashing, and written work tables that cut lineage.

Hashes are 64-bit polynomials over bytes (per word) and over mixed word
hashes (per word sequence), computed with prefix sums modulo 2**64, so a whole
batch of texts is hashed by a few array passes and no per-word Python code.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from complexa.session import scratch_path

#: The white space of every operator contract: space and \x09-\x0D.
WHITE = b" \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"
#: Bytes of text handled by one array pass (a longer single text is handled alone).
CHUNK_BYTES = 2 << 20

_U = np.uint64
_P, _WP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, = 5 modulo 8
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[list(WHITE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back (recovery point)."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()  # shuffle files that nothing needs any more are dropped now
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a ``work_table`` whose successors are written."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        release_path(df.sparkSession, folder)


def release_path(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """Key of a row from its contents: rows with equal key are repeated rows."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")),
                      F.col(doc_id).isNull())


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_``, ``name__``, ... that is no column of ``df`` (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        x = np.full(size, base & (2**64 - 1), np.uint64)
        x[0] = 1
        have = np.multiply.accumulate(x)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def text_array(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    col = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    return pc.fill_null(col, "")


def text_chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) for runs of rows of about ``limit`` bytes."""
    n = len(col)
    if not n:
        return
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int32, n + 1, col.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a run of texts: byte spans, 64-bit hashes, word offsets of the rows."""

    def __init__(self, data: np.ndarray, rows: np.ndarray, lower: bool = False, space: np.ndarray = _SPACE):
        n = len(data)
        white = space[data]
        edge = np.zeros(n + 1, bool)
        edge[rows] = True
        edge[0] = edge[n] = True
        first, last = edge[:-1].copy(), edge[1:].copy()
        first[1:] |= white[:-1]
        last[:-1] |= white[1:]
        self.start = np.flatnonzero(first & ~white)
        self.end = np.flatnonzero(last & ~white) + 1
        self.rows = np.searchsorted(self.start, rows)
        if lower:
            data = LOWER[data]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(_P, n), out=total[1:])
        self.hash = (total[self.end] - total[self.start]) * powers(inverse(_P), n + 1)[self.start]
        self.hash = mix(self.hash + (self.end - self.start).astype(np.uint64))
        self.data = data

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def sequence_hashes(words: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``length`` word hashes (row edges are the caller's)."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64)
    w = mix(words + _U(salt)) if salt else words
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(w * powers(_WP, n), out=total[1:])
    return mix((total[length:] - total[:-length]) * powers(inverse(_WP), n)[:n - length + 1] + _U(length))


def whole_hash(words: np.ndarray, rows: np.ndarray, salt: int = 0) -> np.ndarray:
    """One hash per row over all its words, in order."""
    w = mix(words + _U(salt)) if salt else words
    total = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * powers(_WP, len(w)), out=total[1:])
    back = powers(inverse(_WP), len(w) + 1)[rows[:-1]]
    return mix((total[rows[1:]] - total[rows[:-1]]) * back + (rows[1:] - rows[:-1]).astype(np.uint64))


def inside(rows: np.ndarray, length: int) -> np.ndarray:
    """Starts (word positions) of the runs of ``length`` words that lie in one row."""
    counts = np.maximum(np.diff(rows) - length + 1, 0)
    return ragged_range(rows[:-1], counts)


def ragged_range(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (counts[0] values), start[1], ..."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(np.asarray(start, np.int64) - (np.cumsum(counts) - counts), counts)
    return np.arange(total, dtype=np.int64) + shift


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
