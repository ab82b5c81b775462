"""Plain arrays in the cluster's shared folder: written whole by tasks, memory-mapped by workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np


def _local(uri: str) -> str | None:
    """The path if every machine sees the folder as files."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def write_array(uri: str, values: np.ndarray) -> None:
    """Appears whole or not at all; a repeated task replaces it by the same bytes."""
    path, data = _local(uri), np.ascontiguousarray(values)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data.tobytes())
        os.replace(part, path)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(inner), recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data.tobytes())
    store.move(part, inner)


def map_array(uri: str, dtype) -> np.ndarray:
    """Memory-mapped values. From a store that is no file system the bytes go to an unnamed file of this worker first."""
    path = _local(uri)
    if path is not None:
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(inner) as source, tempfile.TemporaryFile() as f:
        while block := source.read(1 << 22):
            f.write(block)
        f.flush()
        return np.memmap(f, dtype, "r") if f.tell() else np.empty(0, dtype)
