"""Small files of runs by URI: listing, reading, atomic writing."""

from __future__ import annotations

import os
import uuid
from fnmatch import fnmatch
from typing import Any

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a URI or plain path."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def read(uri: str) -> bytes | None:
    """The bytes of a file, or None if there is none."""
    store, path = located(uri)
    if store.get_file_info(path).type != fs.FileType.File:
        return None
    with store.open_input_stream(path) as held:
        return held.read()


def write(uri: str, data: bytes) -> None:
    """Write under a name of its own, then move: readers see the old bytes or the new ones."""
    store, path = located(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temporary) as out:
        out.write(data)
    store.move(temporary, path)


def delete(uri: str) -> None:
    store, path = located(uri)
    if store.get_file_info(path).type == fs.FileType.File:
        store.delete_file(path)


def listed(folder: str, names: str = "*") -> dict[str, tuple[int, int]]:
    """{name: (time of the last change in nanoseconds, size)} of a folder's files."""
    store, path = located(folder)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return {f.base_name: (f.mtime_ns or 0, f.size) for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, names) and not f.base_name.endswith(".tmp")}


def join(folder: str, *parts: Any) -> str:
    return "/".join([folder.rstrip("/"), *map(str, parts)])
