"""Blocks of arrays as compressed files in the shared folder; tables hold their paths.

A block moves between steps by its path, so large arrays neither pass through
shuffles nor pile up in record batches.  Every attempt of a task writes its own files;
only those that a committed table names are ever read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs


def write_block(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """One new file below ``folder`` (a URI); its path."""
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    path = f"{base}/{uuid.uuid4().hex}"
    batch = pa.RecordBatch.from_pydict({k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in arrays.items()})
    with store.open_output_stream(path, compression=None) as out, pa.ipc.new_file(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
        f.write_batch(batch)
    return path


def read_block(folder: str, path: str, names: tuple[str, ...] = ()) -> dict[str, bytes]:
    """The arrays' bytes (only those of ``names``, if given)."""
    store, _ = pafs.FileSystem.from_uri(folder)
    with store.open_input_file(path) as f:
        fields = [pa.ipc.open_file(f).schema.get_field_index(n) for n in names]
        return pa.ipc.open_file(f, options=pa.ipc.IpcReadOptions(included_fields=fields or None)).get_batch(0).to_pylist()[0]
