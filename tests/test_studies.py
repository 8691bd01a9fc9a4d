"""Studies: what is read of a file, and archives equal to those of the standard library, to the byte."""

import hashlib
import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from anamnex.sources import dicom, studies

from .test_sources import slice_bytes

#: The archive of the two files below (fixed value).
GOLDEN = "07368b18d1294cc67eafa48e25c6a7798281db45ac0dd77acea8a336c4d6b2b9"


def library(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in sorted(files):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.create_system, info.external_attr = 0, 0o600 << 16
            with z.open(info, "w") as f:
                f.write(files[name])
    return out.getvalue()


def study_of(root, files):
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    return str(root)


def packed(spark, root, tmp_path, study="x"):
    rows = studies.files(spark, root, "path", "name", "length", "crc").withColumn("study", F.lit(study))
    return studies.packed(rows, str(tmp_path / "blobs"))


def test_golden_hash_from_an_executor(spark, tmp_path):
    head = b"\0" * 128 + b"DICM"
    root = study_of(tmp_path / "in", {"IM000001": head + b"payload-a", "IM000002": head + b"payload-b"})
    row = packed(spark, root, tmp_path).first()
    assert row["sha256"] == GOLDEN and row["n_files"] == 2
    again = studies.kept(spark.createDataFrame([row]), str(tmp_path / "blobs")).first()["packed_at"]
    assert again.endswith(f"07/{GOLDEN}.dcm.zip") and hashlib.sha256(open(again, "rb").read()).hexdigest() == GOLDEN


def test_archives_equal_the_library(spark, tmp_path):
    files = {"b/é 日": b"1", "a": b"", "a/b": b"x" * 3_000_000, "B": b"2", "DICOMDIR": b"3", "z" * 90: b"4"}
    del files["a/b"]
    files["a0/b"] = b"x" * 3_000_000
    root = study_of(tmp_path / "in", files)
    row = packed(spark, root, tmp_path).first()
    assert open(row["packed_at"], "rb").read() == library(files) and row["bytes"] == len(library(files))
    assert studies.dropped(spark.createDataFrame([row])) == 1 and studies.dropped(spark.createDataFrame([row])) == 0


def test_many_entries_and_far_places(monkeypatch):
    files = {f"{k:06d}": b"" for k in range(70_000)}
    entries, at = [], 0
    for name in files:
        info = studies.entry(name, 0, 0)
        info.header_offset = at
        at += len(studies.local_header(info))
        entries.append(info)
    assert library(files)[at:] == studies.directory(entries, at)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 40)  # places beyond it are written wide
    few = {k: b"abc" for k in ("p", "q", "r")}
    whole = library(few)
    entries, at, body = [], 0, b""
    for name, content in few.items():
        info = studies.entry(name, 3, zlib.crc32(content))
        info.header_offset = at
        body += studies.local_header(info) + content
        at = len(body)
        entries.append(info)
    assert whole == body + studies.directory(entries, at)


def test_changed_files_end_the_packing(spark, tmp_path):
    root = study_of(tmp_path / "in", {"a": b"123"})
    rows = studies.files(spark, root, "path", "name", "length", "crc").withColumn("study", F.lit("x")).withColumn("crc", F.col("crc") + 1)
    with pytest.raises(Exception, match="changed while it was packed"):
        studies.packed(rows, str(tmp_path / "blobs")).collect()


def test_kinds_tags_and_columns(spark, tmp_path):
    files = {"DICOMDIR": slice_bytes("DIR"), "s/1": slice_bytes("AXIAL"), "s/short": b"x" * 40, "report.PDF": b"%PDF", "VIEWER.EXE": b"MZ" * 99, "s/2": b"\0" * 128 + b"DICM", "sub/dicomdir": slice_bytes("DIR")}
    root = study_of(tmp_path / "in", files)
    got = {r["name"]: r for r in studies.files(spark, root).collect()}
    assert {n: r["kind"] for n, r in got.items()} == {n: "slice" if files[n][128:132] == b"DICM" else "document" if n == "report.PDF" else "other" for n in files}
    assert got["s/1"]["tags"] == dicom.tags_of(files["s/1"]) and got["s/1"]["tags"] and not any(got[n]["tags"] for n in files if n != "s/1")
    assert {r["name"] for r in studies.slices(studies.files(spark, root)).withColumn("name", F.regexp_extract("path", "in/(.*)$", 1)).collect()} == {"s/1", "s/2"}
    assert studies.files(spark, root, "name", "length").columns == ["name", "length"]
    (tmp_path / "empty").mkdir()
    assert studies.files(spark, str(tmp_path / "empty")).count() == 0 and packed(spark, str(tmp_path / "empty"), tmp_path).count() == 0


class Spy:
    """A file system that counts what is read."""

    def __init__(self, data):
        self.data, self.read = data, 0

    def open_input_file(self, path):
        return self

    def read_at(self, n, at):
        part = self.data[at : at + n]
        self.read += len(part)
        return part

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


def test_headers_are_read_by_ranges():
    big = slice_bytes("AXIAL") + b"\0" * 50_000_000
    fs = Spy(big)
    assert studies.kind_of(fs, "a") == "slice" and fs.read == 4
    assert studies.tags(fs, "a") == dicom.tags_of(big) and fs.read <= 4 + studies.FIRST_BYTES
    long = slice_bytes("A" * 60_000 + "B")  # the header goes beyond what is read at first
    fs = Spy(long)
    assert studies.tags(fs, "a") == dicom.tags_of(long) != {}


def test_files_that_come_as_rows_lie_there_only_while_they_are_taken(spark, tmp_path):
    head = b"\0" * 128 + b"DICM"
    rows = [("golden", "IM000002", head + b"payload-b"), ("golden", "notes.txt", b"none"), ("golden", "IM000001", head + b"payload-a"), ("bare", "a", b""), ("deep", "s/1", head), ("deep", "DICOMDIR", head)]
    df = spark.createDataFrame(rows, "study string, name string, content binary").repartition("study").sortWithinPartitions("study")
    got = {r["study"]: r for r in studies.taken(df, str(tmp_path / "blobs")).collect()}
    assert got.keys() == {"golden", "deep"} and all(r["whole"] for r in got.values())
    assert got["golden"]["sha256"] == GOLDEN and got["golden"]["n_files"] == 2
    want = library({"s/1": head, "DICOMDIR": head})
    assert got["deep"]["sha256"] == hashlib.sha256(want).hexdigest() and got["deep"]["bytes"] == len(want)
    assert [p for p in (tmp_path / "blobs").rglob("*") if p.is_file()] == []


def test_the_query_leaves_no_files_of_slices(spark, sf_dir):
    from pathlib import Path

    from anamnex.plans import registry

    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    assert registry.QUERIES["study_archives"](spark, sf_dir).where("whole").count() > 100
    assert [p for d in set(shared.iterdir()) - before for p in d.rglob("*") if p.is_file()] == []
