"""Files as tasks see them: listing folders and reading byte ranges of any file."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Stores that tasks can open, by the scheme of a path, and what PyArrow calls them.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}
#: Bytes that are read on to find the end of a line.
STEP_BYTES = 1 << 20


@dataclass(frozen=True)
class Entry:
    """A name below the root: ``file``, ``folder``, or ``unread`` with the reason."""

    path: str
    kind: str
    length: int | None = None
    reason: str | None = None
    #: Whether a walk goes into it. As in a walk over folders, links to folders are shown, not entered.
    entered: bool = False


@dataclass(frozen=True)
class Store:
    """A root folder, or one file of it, that every task opens by itself."""

    scheme: str
    root: str
    #: The only file that is asked for.
    only: str | None = None

    def _full(self, path: str) -> str:
        return f"{self.root}/{path}" if path else self.root or "/"

    def _system(self):
        from pyarrow import fs

        if self.scheme == "file":
            return fs.LocalFileSystem()
        host = self.root.split("/", 1)[0]
        return fs.FileSystem.from_uri(f"{SCHEMES[self.scheme]}://{host}/")[0]

    def _place(self, path: str) -> str:
        full = self._full(path)
        # Distributed file systems are named by host; in object stores the bucket is part of the path.
        return "/" + full.split("/", 1)[1] if self.scheme == "hdfs" else full

    def entries(self, folder: str) -> Iterator[Entry]:
        """What is directly in a folder. What can't be read is told, not raised."""
        try:
            yield from self._local(folder) if self.scheme == "file" else self._remote(folder)
        except OSError as error:
            yield Entry(folder, "unread", reason=_reason(error))

    def _local(self, folder: str) -> Iterator[Entry]:
        before = f"{folder}/" if folder else ""
        with os.scandir(self._full(folder)) as found:
            for item in found:
                path = before + item.name.encode("utf-8", "replace").decode()
                try:
                    if item.is_dir():
                        yield Entry(path, "folder", entered=not item.is_symlink())
                    elif item.is_file():
                        yield Entry(path, "file", item.stat().st_size)
                except OSError as error:
                    yield Entry(path, "unread", reason=_reason(error))

    def _remote(self, folder: str) -> Iterator[Entry]:
        from pyarrow import fs

        before = f"{folder}/" if folder else ""
        for item in self._system().get_file_info(fs.FileSelector(self._place(folder))):
            if item.type == fs.FileType.Directory:
                yield Entry(before + item.base_name, "folder", entered=True)
            elif item.type == fs.FileType.File:
                yield Entry(before + item.base_name, "file", item.size)

    def file(self) -> Entry:
        """The only file that is asked for."""
        size = self._system().get_file_info(self._place(self.only)).size
        return Entry(self.only, "file", size)

    def opener(self) -> Opener:
        return Opener(self)


class Opener:
    """Reads ranges of files, one after the other; the last file stays open."""

    def __init__(self, store: Store) -> None:
        self._store, self._system = store, store._system()
        self._path, self._file = None, None

    def _open(self, path: str):
        if path != self._path:
            self.close()
            self._file, self._path = self._system.open_input_file(self._store._place(path)), path
        return self._file

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
        self._path, self._file = None, None

    def whole(self, path: str, length: int) -> bytes:
        return self._open(path).read_at(length, 0)

    def wholes(self, path: str, length: int) -> Iterator[bytes]:
        """The whole file as its only piece."""
        yield self.whole(path, length)

    def lines(self, path: str, start: int, end: int, length: int) -> bytes:
        """The whole lines that begin in a range of bytes; a line ends with a line feed or the file."""
        return next(self.pieces(path, start, end, max(end - start, 1), length))

    def pieces(self, path: str, start: int, end: int, size: int, length: int) -> Iterator[bytes]:
        """The whole lines that begin in each range of ``size`` bytes from ``start`` to ``end``, range by range.

        The file is read on in steps, each byte once; what is held is a step and the lines of one range.
        """
        file = self._open(path)
        # What is held of the file begins at ``at``.
        at, held = max(start - 1, 0), b""

        def line_start(x: int, keep: int | None, until: int) -> int:
            """The first line that begins at ``x`` or later, or ``until`` if there is none before it."""
            nonlocal at, held, length
            if x <= 0:
                return 0
            seen = x - 1
            while True:
                found = held.find(b"\n", max(seen, x - 1) - at)
                if found >= 0:
                    return at + found + 1
                seen = at + len(held)
                if seen >= until:
                    return until
                # Beyond the range, steps double: a long line is not copied for each step.
                more = file.read_at(min(max(STEP_BYTES, x - seen, seen - x), length - seen), seen)
                if not more:
                    length = seen
                    return seen
                if keep is None:
                    at, held = seen, more
                else:
                    at, held = keep, held[keep - at :] + more

        # A line that began before the range is no more than passed over.
        begin = line_start(start, None, end)
        for stop in range(start + size, max(end, start + 1) + size, size):
            stop = min(stop, end)
            then = begin if begin >= stop else line_start(stop, begin, length)
            yield held[begin - at : then - at]
            begin = then


def _reason(error: OSError) -> str:
    return (error.strerror or type(error).__name__).lower()


def located(spark: SparkSession, path: str) -> Store | None:
    """Where a path of Spark's is for tasks; None in a store that only Spark's own readers open."""
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = given.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(given):
        raise FileNotFoundError(path)
    full = store.makeQualified(given).toUri()
    scheme, host, where = full.getScheme(), full.getAuthority(), full.getPath().rstrip("/")
    if scheme not in SCHEMES:
        return None
    root = f"{host}{where}" if host else where
    if store.getFileStatus(given).isDirectory():
        return Store(scheme, root)
    root, _, name = root.rpartition("/")
    return Store(scheme, root, name)


def open_store(store: Store):
    """For ``with``: an opener that closes its last file."""
    return closing(store.opener())
