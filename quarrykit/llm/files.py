"""Binary files in the shared folder: written once by tasks, read as memory maps by workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
from pyarrow import fs


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI or plain path, else None."""
    parsed = urlparse(uri)
    return unquote(parsed.path) if parsed.scheme in ("", "file") else None


def write_bytes(uri: str, *blocks) -> None:
    """Writes a file and moves it to its name at the end: a task that is lost or repeated leaves no torn file."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(temp := f"{path}.{uuid.uuid4().hex}.tmp", "wb") as f:
            for block in blocks:
                f.write(block)
        os.replace(temp, path)
        return
    store, name = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(name), recursive=True)
    with store.open_output_stream(temp := f"{name}.{uuid.uuid4().hex}.tmp") as f:
        for block in blocks:
            f.write(block)
    store.move(temp, name)


def make_folder(uri: str) -> None:
    path = local_path(uri)
    if path is not None:
        os.makedirs(path, exist_ok=True)
    else:
        store, name = fs.FileSystem.from_uri(uri)
        store.create_dir(name, recursive=True)


def list_files(uri: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(URI, bytes) of a file, whatever its name, or of the files with one of the suffixes anywhere under a folder, sorted.
    A path at which nothing is raises FileNotFoundError."""
    path = local_path(uri)
    if path is not None:
        if os.path.isfile(path):
            return [(f"file://{path}", os.path.getsize(path))]
        if not os.path.isdir(path):
            raise FileNotFoundError(path)
        names = [f"{folder}/{x}" for folder, _, found in os.walk(path) for x in found if x.endswith(suffixes)]
        return [(f"file://{x}", os.path.getsize(x)) for x in sorted(names)]
    store, name = fs.FileSystem.from_uri(uri)
    own = store.get_file_info(name)
    if own.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [own] if own.type == fs.FileType.File else [x for x in store.get_file_info(fs.FileSelector(name, recursive=True)) if x.type == fs.FileType.File and x.base_name.endswith(suffixes)]
    base = uri[: len(uri.rstrip("/")) - len(name.rstrip("/"))] if uri.rstrip("/").endswith(name.rstrip("/")) else f"{urlparse(uri).scheme}://{urlparse(uri).netloc}"
    return sorted((f"{base}{x.path}", x.size) for x in found)


def open_stream(uri: str):
    path = local_path(uri)
    if path is not None:
        return open(path, "rb")
    store, name = fs.FileSystem.from_uri(uri)
    return store.open_input_file(name)


def write_array(uri: str, values: np.ndarray) -> None:
    write_bytes(uri, np.ascontiguousarray(values).tobytes())


def map_array(uri: str, dtype) -> np.ndarray:
    """The file as an array that the system pages in as needed; a file that isn't local is fetched and unlinked."""
    path = local_path(uri)
    if path is not None:
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    with open_stream(uri) as f, tempfile.TemporaryFile() as own:
        while block := f.read(1 << 24):
            own.write(block)
        own.flush()
        return np.memmap(own, dtype=dtype, mode="r") if own.tell() else np.zeros(0, dtype)
