"""Files and folders by path or URL: local paths by the operating system, others through pyarrow's file systems."""

from __future__ import annotations

import os
from typing import IO
from urllib.parse import unquote, urlparse

from pyarrow.fs import FileSelector, FileSystem, FileType


def plain(path: str) -> str:
    """A file: URL as a local path, a local path as it is, other URLs too."""
    url = urlparse(path)
    return unquote(url.path) if url.scheme == "file" else path


def is_remote(path: str) -> bool:
    return "://" in plain(path)


def absolute(path: str) -> str:
    return path if is_remote(path) else os.path.abspath(plain(path))


def _kind(path: str) -> FileType:
    fs, at = FileSystem.from_uri(path)
    return fs.get_file_info(at).type


def is_dir(path: str) -> bool:
    return _kind(path) == FileType.Directory if is_remote(path) else os.path.isdir(plain(path))


def is_file(path: str) -> bool:
    return _kind(path) == FileType.File if is_remote(path) else os.path.isfile(plain(path))


def exists(path: str) -> bool:
    return _kind(path) != FileType.NotFound if is_remote(path) else os.path.exists(plain(path))


def visible(folder: str) -> list[str]:
    """What lies right in a folder, by name, but for hidden names."""
    if is_remote(folder):
        fs, at = FileSystem.from_uri(folder)
        names = [i.base_name for i in fs.get_file_info(FileSelector(at))]
    else:
        names = os.listdir(plain(folder))
    return [os.path.join(folder, n) for n in sorted(names) if not n.startswith(".")]


def walk(folder: str) -> list[str]:
    """Visible files at any depth; hidden and linked folders are not entered."""
    if not is_remote(folder):
        found: list[str] = []
        for here, folders, names in os.walk(plain(folder)):
            folders[:] = [f for f in folders if not f.startswith(".")]
            found += [os.path.join(here, n) for n in names if not n.startswith(".")]
        return sorted(found)
    fs, at = FileSystem.from_uri(folder)
    below = [i.path[len(at) :].lstrip("/") for i in fs.get_file_info(FileSelector(at, recursive=True)) if i.type == FileType.File]
    return [os.path.join(folder, p) for p in sorted(below) if not any(part.startswith(".") for part in p.split("/"))]


def open_input(path: str) -> IO[bytes]:
    if not is_remote(path):
        return open(plain(path), "rb")
    fs, at = FileSystem.from_uri(path)
    return fs.open_input_stream(at)


def open_seekable(path: str) -> IO[bytes]:
    if not is_remote(path):
        return open(plain(path), "rb")
    fs, at = FileSystem.from_uri(path)
    return fs.open_input_file(at)


def size(path: str) -> int:
    """Bytes of a file."""
    if not is_remote(path):
        return os.path.getsize(plain(path))
    fs, at = FileSystem.from_uri(path)
    return fs.get_file_info(at).size


def open_output(path: str) -> IO[bytes]:
    if not is_remote(path):
        os.makedirs(os.path.dirname(plain(path)) or ".", exist_ok=True)
        return open(plain(path), "wb")
    fs, at = FileSystem.from_uri(path)
    fs.create_dir(os.path.dirname(at))
    return fs.open_output_stream(at)


def move(before: str, after: str) -> None:
    if not is_remote(before):
        os.replace(plain(before), plain(after))
        return
    fs, at = FileSystem.from_uri(before)
    fs.move(at, FileSystem.from_uri(after)[1])
