"""Packs as tables: a directory or a ZIP file, as an index without payloads and as files with them.

These are Python data sources, because Spark's own file sources leave out every path with a part that
begins with ``_`` or ``.``.  A directory is listed on the driver.  Of an archive the driver only looks where the
entries of its own directory lie, and each task parses the entries it reads.  On a cluster the path must be
visible to executors.
"""

from __future__ import annotations

import io
import os
import stat
import struct
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from bundleloom.schema import PACK_FILES, PACK_INDEX
from bundleloom.sinks.archive import end_records

#: Bytes of payload that one partition reads, about, and entries at most.
PART_BYTES, PART_ROWS = 32 << 20, 50_000


def iter_dir(root: str):
    """(path, size) of the regular files below root, directories with a leading dot left out at any depth."""
    todo = [(os.path.abspath(root), "")]
    while todo:
        at, prefix = todo.pop()
        with os.scandir(at) as it:
            for e in it:
                if e.is_dir(follow_symlinks=False):
                    if not e.name.startswith("."):
                        todo.append((e.path, f"{prefix}{e.name}/"))
                elif e.is_file(follow_symlinks=False):
                    yield prefix + e.name, e.stat(follow_symlinks=False).st_size


class _Slice(InputPartition):
    """Entries of an archive's directory: the place of the first, where they lie, how many; and where the directory
    begins, by the file and by what its closing records say."""

    def __init__(self, first: int, at: int, size: int, count: int, start: int, said: int):
        self.first, self.at, self.size, self.count, self.start, self.said = first, at, size, count, start, said


def _directory(f) -> tuple[int, int, int]:
    """(place, size, place by the closing records) of an archive's directory."""
    total = f.seek(0, os.SEEK_END)
    back = f.seek(max(0, total - 22 - 0xFFFF))
    tail = f.read()
    i = len(tail) - 22 if tail[-22:-18] == b"PK\5\6" and tail[-2:] == b"\0\0" else tail.rfind(b"PK\5\6")
    if i < 0 or i + 22 > len(tail):
        raise zipfile.BadZipFile("File is not a zip file")
    size, said = struct.unpack_from("<II", tail, i + 12)
    end = back + i
    if end >= 76:
        f.seek(end - 76)
        wide = f.read(76)
        if wide[56:60] == b"PK\6\7" and wide[:4] == b"PK\6\6":
            size, said = struct.unpack_from("<QQ", wide, 40)
            end -= 76
    if end < size:
        raise zipfile.BadZipFile("Bad offset for central directory")
    return end - size, size, said


def zip_slices(path: str, most: int):
    """The directory of an archive in slices of about PART_BYTES of content and ``most`` entries; nothing is kept."""
    with open(path, "rb", buffering=1 << 20) as f:
        start, size, said = _directory(f)
        f.seek(start)
        at = begun = start
        first = n = content = 0
        while at < start + size:
            head = f.read(46)
            if len(head) < 46 or head[:4] != b"PK\1\2":
                raise zipfile.BadZipFile("Bad magic number for central directory")
            own, (name, extra, note) = struct.unpack_from("<I", head, 24)[0], struct.unpack_from("<HHH", head, 28)
            if n and (content + own > PART_BYTES or n >= most):
                yield _Slice(first, begun, at - begun, n, start, said)
                first, begun, n, content = first + n, at, 0, 0
            n, content, at = n + 1, content + own, at + 46 + name + extra + note
            f.seek(at) if name + extra + note > 1 << 20 else f.read(name + extra + note)
        if n:
            yield _Slice(first, begun, at - begun, n, start, said)


class _View(io.RawIOBase):
    """An archive up to its directory, and a shorter directory in the place of that."""

    def __init__(self, f, start: int, rest: bytes):
        self.f, self.start, self.rest, self.at = f, start, rest, 0

    def seekable(self):
        return True

    def readable(self):
        return True

    def tell(self):
        return self.at

    def seek(self, to, whence=os.SEEK_SET):
        to += (0, self.at, self.start + len(self.rest))[whence]
        if to < 0:
            raise OSError("before the beginning")
        self.at = to
        return to

    def readinto(self, into):
        if self.at < self.start:
            self.f.seek(self.at)
            got = self.f.read(min(len(into), self.start - self.at))
        else:
            got = self.rest[self.at - self.start :][: len(into)]
        into[: len(got)] = got
        self.at += len(got)
        return len(got)


def zip_members(f, part: _Slice):
    """(archive, [(member, its place)]) of the regular members in a slice of an open archive's directory."""
    f.seek(part.at)
    entries = f.read(part.size)
    z = zipfile.ZipFile(io.BufferedReader(_View(f, part.start, entries + end_records(part.count, part.size, part.said))))
    modes = ((m, i, m.external_attr >> 16) for i, m in enumerate(z.infolist(), part.first))
    return z, [(m, i) for m, i, mode in modes if not (m.is_dir() or (m.create_system == 3 and stat.S_IFMT(mode) not in (0, stat.S_IFREG)))]


def is_zip(path: str) -> bool:
    """False for a directory; anything but that or a ``.zip`` is an error."""
    if os.path.isdir(path):
        return False
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    if not path.lower().endswith(".zip"):
        raise ValueError(f"{path}: neither a directory nor a .zip file")
    return True


def check(path: str) -> None:
    """Raise for what isn't a pack with a file in it; it is walked only up to its first file."""
    if is_zip(path):
        with open(path, "rb") as f:
            empty = not any(zip_members(f, part)[1] for part in zip_slices(path, PART_ROWS))
    else:
        empty = next(iter_dir(path), None) is None
    if empty:
        raise ValueError(f"{path}: no files")


def listing(path: str) -> list[tuple[str, int, int]]:
    """[(rel, size, ordinal)] of a directory in path order."""
    rows = sorted(iter_dir(path), key=lambda r: r[0].encode("utf-8", "surrogateescape"))
    if not rows:
        raise ValueError(f"{path}: no files")
    return [(rel, size, i) for i, (rel, size) in enumerate(rows)]


class _Part(InputPartition):
    def __init__(self, rows: list[tuple[str, int, int]]):
        self.rows = rows


class _Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload

    def partitions(self):
        if is_zip(self.path):
            return list(zip_slices(self.path, PART_ROWS))
        parts, size = [[]], 0
        for r in listing(self.path):  # packed by size, so that large files don't end up together
            if parts[-1] and (size + r[1] > PART_BYTES if self.payload else len(parts[-1]) >= PART_ROWS):
                parts.append([])
                size = 0
            parts[-1].append(r)
            size += r[1]
        return [_Part(p) for p in parts]

    def read(self, part):
        where = os.path.abspath(self.path)
        if isinstance(part, _Slice):
            with open(where, "rb") as f:
                z, members = zip_members(f, part)
                for m, i in members:
                    yield m.filename.removeprefix("./"), m.file_size, i, where, True, *(_tried(lambda m=m: z.read(m)) if self.payload else ())
            return
        for rel, size, i in part.rows:
            yield rel, size, i, where, False, *(_tried(lambda rel=rel: _bytes(os.path.join(where, rel))) if self.payload else ())


def _bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _tried(read) -> tuple[bytes | None, str | None]:
    try:
        return read(), None
    except Exception as e:  # reported with the file, and fails the build at its end
        return None, f"{type(e).__name__}: {e}"


class PackIndexSource(DataSource):
    """Format ``bundleloom_index``: paths and sizes only."""

    @classmethod
    def name(cls):
        return "bundleloom_index"

    def schema(self):
        return PACK_INDEX

    def reader(self, schema):
        return _Reader(self.options["path"], payload=False)


class PackSource(PackIndexSource):
    """Format ``bundleloom_pack``: paths, sizes, payloads and read errors."""

    @classmethod
    def name(cls):
        return "bundleloom_pack"

    def schema(self):
        return PACK_FILES

    def reader(self, schema):
        return _Reader(self.options["path"], payload=True)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackIndexSource)
    spark.dataSource.register(PackSource)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    check(path)
    register(spark)
    return spark.read.format("bundleloom_index").option("path", path).load()


def read_pack(spark: SparkSession, path: str) -> DataFrame:
    check(path)
    register(spark)
    return spark.read.format("bundleloom_pack").option("path", path).load()
