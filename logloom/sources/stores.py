"""Where log files are: file systems that Arrow reaches, or a server's log directory over a connection.

A store lists files and opens them for reading by byte; everything above it is the same for both.
"""

from __future__ import annotations

import base64
import bz2
import fnmatch
import gzip
import io
import lzma
import os
import posixpath
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import BinaryIO, Protocol

# First bytes by codec, and the file name endings that promise one.
MAGIC = {"gzip": b"\x1f\x8b", "bzip2": b"BZh", "xz": b"\xfd7zXZ\x00", "zstd": b"\x28\xb5\x2f\xfd"}
ENDINGS = {".gz": "gzip", ".bz2": "bzip2", ".xz": "xz", ".zst": "zstd"}


def opened(f: BinaryIO, codec: str | None) -> BinaryIO:
    if codec == "zstd":
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True))
    return {"gzip": gzip.open, "bzip2": bz2.open, "xz": lzma.open}[codec](f) if codec else f


def matches(name: str, glob: str | None) -> bool:
    return not glob or fnmatch.fnmatchcase(name, glob.replace("[^", "[!"))


@dataclass(frozen=True)
class Seen:
    """A file as listed: when it changed (ns) and what tells it from another of its name, where the store knows."""

    path: str
    size: int
    changed: int = 0
    identity: str = ""


class FileStore:
    """Files by path or by URI; what Arrow's file systems reach."""

    def __init__(self):
        self.known: dict[str, object] = {}

    def _of(self, path: str):
        from pyarrow import fs

        scheme = path.split("://", 1)[0] if "://" in path else ""
        if scheme in ("", "file"):
            return fs.LocalFileSystem(), path.removeprefix("file://")
        name = posixpath.join(*path.split("/", 3)[:3]) if scheme else ""
        if name not in self.known:
            self.known[name] = fs.FileSystem.from_uri(path)[0]
        return self.known[name], path.split("://", 1)[1]

    def open(self, path: str) -> BinaryIO:
        f, at = self._of(path)
        return f.open_input_file(at)

    def list(self, path: str, glob: str | None) -> list[tuple[str, int]]:
        """(path, size) of a file, or of the files of a directory, hidden ones aside, by name; FileNotFoundError for neither."""
        from pyarrow import fs

        f, at = self._of(path)
        uri = path[: len(path) - len(at)] if path.endswith(at) else ""
        if any(c in posixpath.basename(at) for c in "*?["):
            at, glob = posixpath.split(at)
        info = f.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no such path: {path}")
        if info.type == fs.FileType.File:
            return [(uri + at, info.size)]
        found = f.get_file_info(fs.FileSelector(at))
        return sorted((uri + x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")) and matches(x.base_name, glob))

    def watch(self, directory: str, glob: str | None) -> list[Seen]:
        """The files of a directory of this machine or one it shares, by name, without opening any."""
        with os.scandir(directory) as found:
            files = [(x.name, os.stat(x.path)) for x in found if matches(x.name, glob) and x.is_file()]
        return [Seen(os.path.join(directory, n), s.st_size, s.st_mtime_ns, f"{s.st_dev}:{s.st_ino}") for n, s in sorted(files, key=lambda x: x[0])]

    def by_line(self, path: str) -> BinaryIO:
        """A file of a watched directory, for reading by line."""
        return open(path, "rb")

    def codec(self, f: BinaryIO, path: str) -> str | None:
        """The codec that a file's first bytes show; ValueError where its name promises one that they don't."""
        head = f.read(8)
        f.seek(0)
        codec = next((name for name, magic in MAGIC.items() if head.startswith(magic)), None)
        promised = next((c for ending, c in ENDINGS.items() if path.endswith(ending)), None)
        if promised and codec is None and head:
            raise ValueError(f"{path} is not a {promised} file")
        return codec

    def close(self) -> None:
        pass


class Session(Protocol):
    """A connection to a server as the remote store uses it."""

    def list(self) -> Iterable[tuple]:
        """(name, size) or (name, size, seconds since 1970 when changed) of each file in the log directory."""

    def read(self, path: str, offset: int, length: int) -> bytes | str | None:
        """At most length bytes from offset, fewer only at the end; text stands for its UTF-8 bytes."""

    def close(self) -> None: ...


@dataclass(frozen=True)
class SqlServer:
    """Sessions over any DB-API driver: connect() opens a connection, in the driver's process and in tasks.

    Bytes are read as such; as_text is for servers where only the text function is granted, which fails
    on bytes that are none of the server's encoding and on a range that cuts a character.
    """

    connect: Callable[[], object]
    as_text: bool = False
    placeholder: str = "%s"

    def __call__(self) -> Session:
        return _SqlSession(self)


class _SqlSession:
    def __init__(self, server: SqlServer):
        self.connection = server.connect()
        p = server.placeholder
        self.reading = f"SELECT {'pg_read_file' if server.as_text else 'pg_read_binary_file'}({p}, {p}, {p})"

    def _rows(self, sql: str, *values) -> list[tuple]:
        cursor = self.connection.cursor()
        try:
            cursor.execute(sql, values)
            return cursor.fetchall()
        finally:
            cursor.close()

    def list(self) -> list[tuple]:
        return self._rows("SELECT name, size, extract(epoch FROM modification) FROM pg_ls_logdir() ORDER BY name")

    def read(self, path: str, offset: int, length: int) -> bytes | str | None:
        found = self._rows(self.reading, path, offset, length)
        got = found[0][0] if found else None
        return bytes(got) if isinstance(got, memoryview) else got

    def close(self) -> None:
        self.connection.close()


class _RemoteFile(io.RawIOBase):
    """A file of a server, fetched in chunks; no chunk is held."""

    def __init__(self, session: Session, path: str, chunk: int):
        self.session, self.path, self.chunk, self.at = session, path, chunk, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        if whence == io.SEEK_END:
            raise io.UnsupportedOperation("a remote file is read from its start")
        self.at = offset + (self.at if whence == io.SEEK_CUR else 0)
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, into) -> int:
        got = self.session.read(self.path, self.at, min(len(into), self.chunk)) or b""
        got = got.encode() if isinstance(got, str) else got
        if len(got) > len(into):
            raise ValueError("the server gave more bytes than asked for: its encoding isn't UTF-8")
        into[: len(got)] = got
        self.at += len(got)
        return len(got)


class RemoteStore:
    """A server's log directory: files are listed by name and size, and read by byte range, a chunk a query.

    One session is opened where the store is used first, in a task or the driver, and closed with it.
    A file is told from another of its name by size alone.
    """

    def __init__(self, server: Callable[[], Session], chunk: int):
        self.server, self.chunk, self._session = server, chunk, None

    @property
    def session(self) -> Session:
        if self._session is None:
            self._session = self.server()
        return self._session

    def _listed(self, directory: str, glob: str | None) -> list[Seen]:
        if not directory:
            raise ValueError("a remote log directory needs its path on the server")
        found = [Seen(f"{directory.rstrip('/')}/{name}", int(size), int(float(more[0]) * 1e9) if more and more[0] is not None else 0) for name, size, *more in self.session.list() if matches(name, glob)]
        return sorted(found, key=lambda s: s.path)

    def list(self, path: str, glob: str | None) -> list[tuple[str, int]]:
        """(path, size) of the directory's files, by name; of one file, if path is that of one listed."""
        directory, name = posixpath.split(path)
        one = [(s.path, s.size) for s in self._listed(directory, None) if s.path == path] if directory and name else []
        return one or [(s.path, s.size) for s in self._listed(path, glob)]

    def open(self, path: str) -> BinaryIO:
        return io.BufferedReader(_RemoteFile(self.session, path, self.chunk), min(self.chunk, 1 << 16))

    def watch(self, directory: str, glob: str | None) -> list[Seen]:
        return self._listed(directory, glob)

    def by_line(self, path: str) -> BinaryIO:
        return self.open(path)

    def codec(self, f: BinaryIO, path: str) -> str | None:
        return None  # a server writes its logs as plain text

    def close(self) -> None:
        if self._session is not None:
            self._session.close()
            self._session = None


#: Bytes of one query for a remote file.
CHUNK_BYTES = 10 << 20


def as_option(server: Callable[[], Session] | None) -> str | None:
    """A server as text that a data source's options can carry to tasks."""
    from pyspark import cloudpickle

    return None if server is None else base64.b64encode(cloudpickle.dumps(server)).decode()


def store(server: str | None, chunk: int = CHUNK_BYTES) -> FileStore | RemoteStore:
    from pyspark import cloudpickle

    return RemoteStore(cloudpickle.loads(base64.b64decode(server)), chunk) if server else FileStore()
