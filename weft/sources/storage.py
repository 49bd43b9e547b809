"""Byte ranges of files in any store that pyarrow reaches."""

from __future__ import annotations

import os

from pyarrow import fs

from weft.sources.headers import FormatError, Header, Truncated, parse

_FIRST = 1 << 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def stamp(path: str) -> tuple[int, int]:
    """Size and time of last change, to notice a file that changes between header and payload."""
    files, inner = opened(path)
    info = files.get_file_info(inner)
    if not info.is_file:
        raise FormatError(f"cannot open {path}: no such file")
    return info.size, int(info.mtime_ns or 0)


def read_header(path: str) -> tuple[Header, int, int]:
    """Header, size and time of a file, reading no further than the header."""
    size, changed = stamp(path)
    if size < 8:
        raise FormatError(f"cannot open {path}: file is too short")
    files, inner = opened(path)
    with files.open_input_file(inner) as f:
        n = min(size, _FIRST)
        head = f.read_at(n, 0)
        if head[:4] != b"GGUF":
            n = min(size, 8 + min(int.from_bytes(head[:8], "little"), 1 << 27))
            head = head if n <= len(head) else f.read_at(n, 0)
        while True:
            try:
                return parse(head, size), size, changed
            except Truncated:
                n = min(size, 4 * len(head))
                head = f.read_at(n, 0)
