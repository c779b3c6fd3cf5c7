"""Files by URI, as tasks open them: local paths, ``file:`` URIs and the stores that Arrow knows."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyarrow import fs

FIRST_LINE = 1 << 16  # bytes read at a time to find a first line's end


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a URI or a local path."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), uri.rstrip("/") if not parts.scheme else unquote(parts.path).rstrip("/")
    system, path = fs.FileSystem.from_uri(uri)
    return system, path.rstrip("/")


def inside(path: str) -> str:
    """A relative path in plain form; one that is empty or leaves its folder is a ValueError."""
    plain = posixpath.normpath(path)
    if not path or plain in (".", "..") or plain.startswith(("../", "/")):
        raise ValueError(f"{path!r} leaves the folder")
    return plain


def children(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda i: i.base_name)


def below(system: fs.FileSystem, folder: str) -> Iterator[fs.FileInfo]:
    """All files under a folder; one folder's names are held at a time."""
    waiting = [folder]
    while waiting:
        for info in children(system, waiting.pop()):
            if info.is_file:
                yield info
            else:
                waiting.append(info.path)


def first_line(system: fs.FileSystem, path: str) -> str:
    """The first line of a text file, without its end; no more is read than it takes."""
    read = b""
    with system.open_input_stream(path, compression=None) as stream:
        while b"\n" not in read and (more := stream.read(FIRST_LINE)):
            read += more
    return read.split(b"\n", 1)[0].rstrip(b"\r").removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")


def merged(system: fs.FileSystem, source: str, target: str, replace: bool) -> None:
    """Moves what is below ``source`` to ``target``: whole folders where it has none, else file by file.

    Without ``replace`` a file that is there already is a ValueError.
    """
    for info in children(system, source):
        there = system.get_file_info(f"{target}/{info.base_name}")
        if there.type == fs.FileType.NotFound:
            system.create_dir(target)
            system.move(info.path, there.path)
        elif info.is_file and there.is_file and replace:
            system.move(info.path, there.path)
        elif not info.is_file and not there.is_file:
            merged(system, info.path, there.path, replace)
        else:
            raise ValueError(f"{there.path!r} is written twice, or is both file and folder")
