"""Binary files in the folder that driver and executors share."""

from __future__ import annotations

import mmap
from urllib.parse import unquote, urlparse

import numpy as np
from pyarrow import fs


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path in it."""
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> str:
    system, path = file_system(uri)
    system.create_dir(path, recursive=True)
    return uri


def write_bytes(uri: str, data: bytes) -> None:
    system, path = file_system(uri)
    with system.open_output_stream(path) as out:
        out.write(data)


def open_output(uri: str):
    system, path = file_system(uri)
    return system.open_output_stream(path)


def mapped(uri: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the folder is mounted, else read."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        with open(unquote(parts.path), "rb") as source:
            source.seek(0, 2)
            if source.tell() == 0:
                return np.empty(0, dtype)
            return np.frombuffer(mmap.mmap(source.fileno(), 0, access=mmap.ACCESS_READ), dtype)
    system, path = file_system(uri)
    with system.open_input_file(path) as source:
        return np.frombuffer(source.read(), dtype)
