"""Files of sorted arrays in the shared folder: written by tasks, memory-mapped by workers."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np


def _local(path: str) -> str | None:
    """The path on a file system that can be mapped, if the folder is on one."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def save(path: str, data: np.ndarray) -> None:
    """Writes the array's bytes whole or not at all: a task that runs twice leaves the same file."""
    local = _local(path)
    if local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        part = f"{local}.{uuid.uuid4().hex}.part"
        data.tofile(part)
        os.replace(part, local)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(at), recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(memoryview(np.ascontiguousarray(data)).cast("B"))
    store.move(part, at)


def load(path: str, kind: str, n: int) -> np.ndarray:
    """The array, mapped. A file on a remote store is copied once and its local name removed at once, so nothing stays."""
    if not n:
        return np.zeros(0, kind)
    local = _local(path)
    if local:
        return np.memmap(local, kind, "r", shape=(n,))
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    handle, copy = tempfile.mkstemp()
    with os.fdopen(handle, "wb") as out, store.open_input_stream(at) as source:
        while chunk := source.read(8 << 20):
            out.write(chunk)
    mapped = np.memmap(copy, kind, "r", shape=(n,))
    os.unlink(copy)
    return mapped
