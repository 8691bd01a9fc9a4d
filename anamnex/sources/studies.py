"""Imaging studies in folders: read by ranges, packed where the data is.

`study_files` is a data source: it lists a folder, deals the files to tasks, and opens each only as far as the asked
columns need: nothing for names and lengths, 132 bytes for its kind, a growing part of the header for its tags (seldom more than
16 KiB), and everything, a chunk at a time, only for its checksum (null
for what is no slice, where kinds are asked for too). Ask for fewer columns with `.schema(...)`.

Files that come as rows (`taken`) lie in folders only while their study is read, packed and checked, one study a task at a
time: small files take whole blocks of a disk, and all of them at once would take many times what their bytes do.

A study's archive is one stream by nature, as its hash is, so one task writes it: with checksums and lengths known, all
headers and places are, and the files' bytes pass through in chunks. A task holds the list of a study's files and one
chunk. The archive is moved to its name, its own hash, only as a whole; a lost executor leaves a file that nothing names.

Odd files. One that can't be read, or is too short, is no slice. A file that changed between the passes ends the packing
with an error. A folder of no files has no rows, and packs to nothing. DICOMDIR, in any case, is packed but gives no tags.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Collection, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .dicom import HEADER_BYTES, MAGIC, MAGIC_AT, tags_and_end

SCHEMA = "path string, name string, length long, kind string, tags map<string,string>, crc long"
#: Suffixes of files that look like documents (fixed values).
DOCUMENT_LIKE = (".pdf", ".rtf", ".doc", ".docx", ".txt", ".html", ".htm")
DIRECTORY_FILE = "DICOMDIR"
CHUNK = 1 << 20
#: Bytes of a header that are read at first, and then at most.
FIRST_BYTES, MOST_BYTES = 1 << 14, MAGIC_AT + len(MAGIC) + 12 + 2 * HEADER_BYTES
#: Files, and bytes where checksums are asked for, of one task.
TASK_FILES, TASK_BYTES = 500, 256 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def chunks(fs: pafs.FileSystem, path: str) -> Iterator[bytes]:
    with fs.open_input_stream(path) as f:
        while part := f.read(CHUNK):
            yield part


def kind_of(fs: pafs.FileSystem, path: str) -> str:
    """slice, document or other."""
    try:
        with fs.open_input_file(path) as f:
            if f.read_at(len(MAGIC), MAGIC_AT) == MAGIC:
                return "slice"
    except OSError:
        pass
    return "document" if path.lower().endswith(DOCUMENT_LIKE) else "other"


def tags(fs: pafs.FileSystem, path: str) -> dict[str, str]:
    """Header tags; more of the file is read only while the header goes on."""
    try:
        with fs.open_input_file(path) as f:
            size = FIRST_BYTES
            while True:
                data = f.read_at(size, 0)
                found, whole = tags_and_end(data)
                if whole or len(data) < size or size >= MOST_BYTES:
                    return found
                size = min(size * 8, MOST_BYTES)
    except OSError:
        return {}


def listed(fs: pafs.FileSystem, root: str) -> list[tuple[str, str, int]]:
    """(path, name below the folder, length) of all files below a folder, by path."""
    root = root.rstrip("/")
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted((i.path, i.path[len(root) + 1 :], i.size) for i in found if i.type == pafs.FileType.File)


def looked(fs: pafs.FileSystem, path: str, name: str, size: int, columns: Collection[str]) -> dict:
    """What is asked of one file."""
    row = {"path": path, "name": name, "length": size}
    if "kind" in columns or "tags" in columns:
        row["kind"] = kind_of(fs, path)
    if "tags" in columns:
        row["tags"] = tags(fs, path) if row["kind"] == "slice" and name.rpartition("/")[2].upper() != DIRECTORY_FILE else {}
    if "crc" in columns and row.get("kind", "slice") == "slice":
        crc = 0
        for part in chunks(fs, path):
            crc = zlib.crc32(part, crc)
        row["crc"] = crc
    return row


class Part(InputPartition):
    def __init__(self, files: list[tuple[str, str, int]]):
        self.files = files


class StudyReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.columns, self.path = [f.name for f in schema.fields], path.rstrip("/")

    def partitions(self) -> list[Part]:
        fs, root = opened(self.path)
        out, held = [], 0
        for path, name, size in listed(fs, root):
            if not out or len(out[-1]) >= TASK_FILES or ("crc" in self.columns and held + size > TASK_BYTES):
                out.append([])
                held = 0
            out[-1].append((path, name, size))
            held += size
        return [Part(files) for files in out] or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        fs, _ = opened(self.path)
        for path, name, size in partition.files:
            row = looked(fs, path, name, size, self.columns)
            yield tuple(row.get(c) for c in self.columns)


class StudyFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "study_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> StudyReader:
        return StudyReader(schema, self.options["path"])


def files(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Files below a folder, with the asked columns of SCHEMA (all but the checksum by default)."""
    spark.dataSource.register(StudyFiles)
    kinds = dict(c.split(" ") for c in SCHEMA.split(", "))
    return spark.read.format("study_files").schema(", ".join(f"{c} {kinds[c]}" for c in columns or ("path", "name", "length", "kind", "tags"))).load(path)


def entry(name: str, length: int, crc: int) -> zipfile.ZipInfo:
    """An archive entry with every field pinned that host, clock or library could set."""
    info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
    info.create_system, info.create_version, info.extract_version, info.external_attr = 0, 20, 20, 0o600 << 16
    info.compress_size = info.file_size = length
    info.CRC = crc
    return info


def local_header(info: zipfile.ZipInfo) -> bytes:
    if info.file_size * 1.05 > zipfile.ZIP64_LIMIT:
        raise ValueError(f"{info.filename} is too large for an entry")
    return info.FileHeader(zip64=False)


def directory(entries: list[zipfile.ZipInfo], start: int) -> bytes:
    """The central directory and the end of an archive, whose entries know their places."""
    parts = []
    for i in entries:
        name, flags = (i.filename.encode("ascii"), 0) if i.filename.isascii() else (i.filename.encode(), 0x800)
        extra, at, version = b"", i.header_offset, 20
        if at > zipfile.ZIP64_LIMIT:
            extra, at, version = struct.pack("<HHQ", 1, 8, at), 0xFFFFFFFF, 45
        parts.append(struct.pack("<4s4B4HL2L5H2L", b"PK\1\2", version, 0, version, 0, flags, 0, 0, 33, i.CRC, i.file_size, i.file_size, len(name), len(extra), 0, 0, 0, i.external_attr, at) + name + extra)
    out = b"".join(parts)
    n, size, at = len(entries), len(out), start
    if n > 0xFFFF or at > zipfile.ZIP64_LIMIT or size > zipfile.ZIP64_LIMIT:
        out += struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, start) + struct.pack("<4sLQL", b"PK\6\7", 0, start + size, 1)
        n, size, at = min(n, 0xFFFF), min(size, 0xFFFFFFFF), min(at, 0xFFFFFFFF)
    return out + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, n, n, size, at, 0)


def archive(members: list[tuple[str, str, int, int]]) -> Iterator[bytes]:
    """The bytes of the canonical archive of (path, name, length, crc), in chunks; stored, in the order of their names."""
    made, at, fs = [], 0, None
    for path, name, length, crc in sorted(members, key=lambda m: m[1]):
        fs, own = opened(path)
        info = entry(name, length, crc)
        info.header_offset = at
        head = local_header(info)
        yield head
        found, size = 0, 0
        for part in chunks(fs, own):
            found, size = zlib.crc32(part, found), size + len(part)
            yield part
        if (found, size) != (crc, length):
            raise ValueError(f"{path} changed while it was packed")
        made.append(info)
        at += len(head) + length
    yield directory(made, at)


PACKED = "study string, sha256 string, n_files long, bytes long, packed_at string"


def put(members: list[tuple[str, str, int, int]], fs: pafs.FileSystem, root: str) -> tuple[str, int, str]:
    """Write the archive of (path, name, length, crc) below root, under a name of its own: its hash, size and place."""
    place, digest, size = f"{root}/.{uuid.uuid4().hex}.part", hashlib.sha256(), 0
    with fs.open_output_stream(place) as out:
        for part in archive(members):
            digest.update(part)
            out.write(part)
            size += len(part)
    return digest.hexdigest(), size, place


def packed(rows: DataFrame, folder: str) -> DataFrame:
    """A row for each study of slices (study, path, name, length, crc): its archive's hash, size and place below folder, under a name of its own."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        members = list(zip(*(table[c].to_pylist() for c in ("path", "name", "length", "crc"))))
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        sha, size, place = put(members, fs, root)
        return pa.table({"study": [key[0].as_py()], "sha256": [sha], "n_files": [len(members)], "bytes": [size], "packed_at": [place]})

    return rows.select("study", "path", "name", "length", "crc").groupBy("study").applyInArrow(pack, PACKED)


def blob_name(sha: str) -> str:
    return f"{sha[:2]}/{sha}.dcm.zip"


def keep(fs: pafs.FileSystem, root: str, sha: str, place: str) -> str:
    """Move a packed archive to its name below root; that name."""
    target = f"{root}/{blob_name(sha)}"
    fs.create_dir(target.rpartition("/")[0], recursive=True)
    if fs.get_file_info(place).type == pafs.FileType.File:
        fs.move(place, target)  # the same bytes, whoever else has put them there
    return target


def kept(rows: DataFrame, folder: str) -> DataFrame:
    """Move packed archives to their names below folder; one that is there already stays, and the new one goes."""

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = opened(folder)
        for b in batches:
            yield b.assign(packed_at=[keep(fs, root, sha, place) for sha, place in zip(b["sha256"], b["packed_at"])])

    return rows.mapInPandas(move, rows.schema)


def holds(fs: pafs.FileSystem, path: str, sha: str, size: int) -> bool:
    """Whether the bytes of a file are as many as they should be and have this hash."""
    digest, n = hashlib.sha256(), 0
    for part in chunks(fs, path):
        digest.update(part)
        n += len(part)
    return (digest.hexdigest(), n) == (sha, size)


TAKEN = "study string, sha256 string, n_files long, bytes long, whole boolean"


def taken(rows: DataFrame, folder: str) -> DataFrame:
    """A row for each study of files that come as rows (study, name, content), the rows of a study after one another in one task.

    A study's files are put in a folder as they come. It is read by ranges, its slices are packed, the archive is kept under
    its hash, and whole says whether the bytes kept have it. Then the folder and the archive go. No slices, no row.
    """

    def finished(study: str, fs: pafs.FileSystem, root: str) -> list[tuple]:
        found = [looked(fs, *file, ("kind", "crc")) for file in listed(fs, f"{root}/in")]
        members = [(f["path"], f["name"], f["length"], f["crc"]) for f in found if f["kind"] == "slice"]
        out = []
        if members:
            sha, size, place = put(members, fs, root)
            at = keep(fs, root, sha, place)
            out.append((study, sha, len(members), size, holds(fs, at, sha, size)))
            fs.delete_file(at)
        fs.delete_dir_contents(f"{root}/in")  # the folder itself serves the next study
        return out

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(f"{folder}/{uuid.uuid4().hex}")  # of this attempt alone
        study, made, schema = None, set(), pa.schema([("study", pa.string()), ("sha256", pa.string()), ("n_files", pa.int64()), ("bytes", pa.int64()), ("whole", pa.bool_())])
        for b in batches:
            out = []
            for own, name, content in zip(*(c.to_pylist() for c in b.columns)):
                if made and own != study:
                    out += finished(study, fs, root)
                    made = set()
                study, parent = own, f"{root}/in/{name}".rpartition("/")[0]
                if parent not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                with fs.open_output_stream(f"{root}/in/{name}") as f:
                    f.write(content)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
        if made:
            last = finished(study, fs, root)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in last], schema)
            fs.delete_dir(root)

    return rows.select("study", "name", "content").mapInArrow(take, TAKEN)


def dropped(rows: DataFrame) -> int:
    """Delete packed archives that are not kept; how many."""
    gone = 0
    for r in rows.select("packed_at").toLocalIterator():  # names only
        fs, path = opened(r["packed_at"])
        if fs.get_file_info(path).type == pafs.FileType.File:
            fs.delete_file(path)
            gone += 1
    return gone


def slices(found: DataFrame) -> DataFrame:
    """Rows for dicom.studies(): path, directory and tags of the slices among files (all but DICOMDIR)."""
    own = found.where((F.col("kind") == "slice") & (F.upper(F.regexp_extract("name", r"([^/]*)$", 1)) != DIRECTORY_FILE))
    return own.select("path", F.regexp_extract("name", r"^(?:(.*)/)?[^/]*$", 1).alias("directory"), "tags")
