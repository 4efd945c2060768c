"""Byte ranges of files: local paths, any file system that Arrow opens, or HTTP servers that answer range requests."""

from __future__ import annotations

import urllib.request
from typing import Protocol


class Ranges(Protocol):
    def read(self, offset: int, length: int) -> bytes: ...

    def size(self) -> int: ...


class FileRanges:
    def __init__(self, path: str) -> None:
        from pyarrow.fs import FileSystem, LocalFileSystem

        fs, inner = FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path)
        self.file = fs.open_input_file(inner)

    def read(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)

    def size(self) -> int:
        return self.file.size()


class HttpRanges:
    def __init__(self, url: str) -> None:
        self.url = url

    def read(self, offset: int, length: int) -> bytes:
        if not length:
            return b""
        asked = urllib.request.Request(self.url, headers={"Range": f"bytes={offset}-{offset + length - 1}"})
        with urllib.request.urlopen(asked) as answer:  # noqa: S310
            if answer.status != 206:
                raise OSError(f"{self.url}: no answer to a range request (status {answer.status})")
            return answer.read()

    def size(self) -> int:
        with urllib.request.urlopen(urllib.request.Request(self.url, method="HEAD")) as answer:  # noqa: S310
            return int(answer.headers["Content-Length"])


def open_ranges(path: str) -> Ranges:
    return HttpRanges(path) if path.startswith(("http://", "https://")) else FileRanges(path)
