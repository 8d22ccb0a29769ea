"""Files as the data sources of this package see them: any store that pyarrow opens, by path or URI."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def exists(store: fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type == fs.FileType.File


def read_small(store: fs.FileSystem, path: str) -> bytes:
    with store.open_input_stream(path) as f:
        return f.read()


def replace(store: fs.FileSystem, path: str, content: bytes, mark: str) -> None:
    """Writes a small file beside its place and moves it there: readers see the old content or the new."""
    with store.open_output_stream(f"{path}.{mark}") as f:
        f.write(content)
    store.move(f"{path}.{mark}", path)


class Hashed:
    """A file object that digests what passes."""

    def __init__(self, raw):
        self.raw, self.sha, self.size, self.closed = raw, hashlib.sha256(), 0, False

    def write(self, data) -> int:
        data = memoryview(data).cast("B") if not isinstance(data, bytes) else data
        self.sha.update(data)
        self.size += len(data)
        self.raw.write(data)
        return len(data)

    def read(self, n: int = -1) -> bytes:
        data = self.raw.read(n if n is not None and n >= 0 else None)
        self.sha.update(data)
        self.size += len(data)
        return data

    def flush(self) -> None:
        pass

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            self.raw.close()

    def readable(self) -> bool:
        return True

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False


def batches_of(stream: Hashed) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_stream(pa.PythonFile(stream, mode="r")) as reader:
        yield from reader
