"""Writing whole files from executors to the shared folder, and reading files in pieces."""

from __future__ import annotations

import os
import uuid
from typing import BinaryIO


def write_file(uri: str, data: bytes) -> None:
    """Writes the file in one step: under another name first, then renamed, so that a lost executor leaves no half file
    and a repeated task writes the same file again. file: paths are opened; others go through pyarrow's file systems."""
    scheme, _, path = uri.rpartition(":") if "://" in uri or uri.startswith("file:") else ("file", "", uri)
    if scheme == "file":
        path = "/" + path.lstrip("/")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def open_file(uri: str) -> BinaryIO:
    """A file for reading in pieces, of any length; file: paths are opened, others go through pyarrow's file systems."""
    scheme, _, path = uri.rpartition(":") if "://" in uri or uri.startswith("file:") else ("file", "", uri)
    if scheme == "file":
        return open("/" + path.lstrip("/"), "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
