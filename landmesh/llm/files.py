"""Files that Python workers write to the folder all machines share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse


def write_whole(folder: str, name: str, data: bytes) -> str:
    """Write ``folder``/``name`` in one step: a retried task replaces its file, a reader never sees half of it."""
    at = urlparse(folder)
    if at.scheme in ("", "file"):
        os.makedirs(at.path, exist_ok=True)
        part = os.path.join(at.path, f".{name}.{uuid.uuid4().hex}")
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, os.path.join(at.path, name))
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(data)
        store.move(part, f"{path}/{name}")
    return f"{folder}/{name}"


@contextmanager
def open_whole(path: str) -> Iterator[tuple]:
    """A file of the shared folder for reading at any place, and its length."""
    at = urlparse(path)
    if at.scheme in ("", "file"):
        with open(at.path, "rb") as f:
            yield f, os.fstat(f.fileno()).st_size
    else:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        with store.open_input_file(name) as f:
            yield f, f.size()
