"""Page archives: a Python data source that reads ZIP files safely, and one that writes them.

Reading: one partition for each archive, so archives are read in parallel where the executors
run.  Names are filtered before anything is inflated.  Guards (all fatal): several disks,
ZIP64, too many entries, too large entries or totals, encryption, methods other than stored
and deflated, links, unsafe paths, wrong sizes or checksums.

Writing: one stored (uncompressed) archive for each partition of (name, content) rows.
"""

from __future__ import annotations

import os
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MAX_ENTRIES = 2000
MAX_ENTRY = 128 << 20
MAX_TOTAL = 2 << 30
IMAGES = (".png", ".jpg", ".jpeg", ".webp")
SCHEMA = "archive string, name string, position int, size long, crc32 long, content binary"


class ArchiveError(ValueError):
    """The archive breaks a guard."""


def safe_name(raw: str) -> str:
    """Relative path of an entry with forward slashes, or an ArchiveError."""
    name = raw.replace("\\", "/").rstrip("/")
    parts = name.split("/")
    if not name or re.search("[\0�:]", name) or name.startswith("/") or any(p in ("", ".", "..") or p[-1] in ". " for p in parts):
        raise ArchiveError(f"unsafe path: {raw!r}")
    return name


def natural(name: str) -> list:
    return [(1, int(p), "") if p.isdigit() else (0, 0, p) for p in re.findall(r"\d+|\D+", name.lower())]


def read_archive(path: str, extensions: tuple[str, ...] = IMAGES) -> Iterator[tuple[str, int, int, int, bytes]]:
    """(name, position, size, crc, content) in natural order of names."""
    with open(path, "rb") as f:
        f.seek(0, os.SEEK_END)
        f.seek(max(0, f.tell() - 66_000))
        tail = f.read()
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ArchiveError("no end of central directory")
    disk, first, here, entries = struct.unpack_from("<HHHH", tail, at + 4)
    if disk or first or here != entries:
        raise ArchiveError("several disks")
    if entries == 0xFFFF or tail.rfind(b"PK\6\7") >= 0:
        raise ArchiveError("ZIP64")
    if entries > MAX_ENTRIES:
        raise ArchiveError("too many entries")
    with zipfile.ZipFile(path) as z:
        chosen = []
        for i in z.infolist():
            if i.is_dir():
                continue
            name = safe_name(i.orig_filename)
            if i.flag_bits & 1:
                raise ArchiveError(f"encrypted: {name}")
            if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise ArchiveError(f"method {i.compress_type}: {name}")
            if (i.external_attr >> 16) & 0o170000 == 0o120000:
                raise ArchiveError(f"link: {name}")
            if i.file_size > MAX_ENTRY:
                raise ArchiveError(f"too large: {name}")
            if name.lower().endswith(extensions):
                chosen.append((natural(name), name, i))
        if sum(i.file_size for _, _, i in chosen) > MAX_TOTAL:
            raise ArchiveError("too large in all")
        for k, (_, name, i) in enumerate(sorted(chosen, key=lambda c: (c[0], c[1]))):
            try:
                content = z.read(i)
            except (zipfile.BadZipFile, zlib.error, EOFError) as e:
                raise ArchiveError(f"{name}: {e}") from e
            if len(content) != i.file_size or zlib.crc32(content) != i.CRC:
                raise ArchiveError(f"size or checksum: {name}")
            yield name, k, len(content), i.CRC, content


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_Part(p) for p in self.paths]

    def read(self, partition):
        for name, k, size, crc, content in read_archive(partition.path):
            yield partition.path, name, k, size, crc, content


class _Message(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class _Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator):
        rows = [(safe_name(r["name"]), bytes(r["content"])) for r in iterator]
        if not rows:
            return _Message(None)
        from pyspark import TaskContext

        path = os.path.join(self.folder, f"part-{TaskContext.get().partitionId():05d}.cbz")
        os.makedirs(self.folder, exist_ok=True)
        with open(path + ".tmp", "wb") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_STORED, allowZip64=False) as z:
            for name, content in sorted(rows, key=lambda r: natural(r[0])):
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
        os.replace(path + ".tmp", path)
        return _Message(path)

    def commit(self, messages):
        pass

    def abort(self, messages):
        for m in messages:
            if m is not None and m.path and os.path.exists(m.path):
                os.unlink(m.path)


class PageArchive(DataSource):
    """``spark.dataSource.register(PageArchive)``, then format ``page_archive``; option ``path``: file or folder."""

    @classmethod
    def name(cls):
        return "page_archive"

    def schema(self):
        return SCHEMA

    def _paths(self) -> list[str]:
        path = self.options["path"]
        if os.path.isdir(path):
            return sorted(os.path.join(r, f) for r, _, fs in os.walk(path) for f in fs if f.lower().endswith((".zip", ".cbz")))
        return [path]

    def reader(self, schema):
        return _Reader(self._paths())

    def writer(self, schema, overwrite):
        folder = self.options["path"]
        if os.path.isdir(folder) and os.listdir(folder) and not overwrite:
            raise ArchiveError(f"{folder} isn't empty")
        return _Writer(folder)
