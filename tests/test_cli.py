import json

import pytest

from anamnex import cli
from anamnex.plans import catalog as snapshots


@pytest.fixture
def store(spark, tmp_path, monkeypatch):
    import datetime as dt

    ticks = iter(range(1, 100))
    monkeypatch.setattr(snapshots, "snapshot_name", lambda now: f"anamnex-20260101-{next(ticks):04d}00")
    root = str(tmp_path / "store")

    def go(*args):
        return cli.run(spark, cli.parser().parse_args(["--store", root, *args]))

    assert dt and go("init") == 0
    return go


def test_cli_round_trip(store, tmp_path, capsys):
    store("person-add", "jane", "Jane Doe")
    store("person-list")
    assert "dry run" in capsys.readouterr().out
    store("--apply", "person-add", "jane", "Jane Doe")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Jane Doe labs")
    store("--apply", "ingest", str(tmp_path / "in"), "jane", "--category", "lab")
    rows = [{"test_name": "Glucose", "value_num": 90, "unit": "mg/dL", "collected_at": "2026-01-01"}, {"test_name": "glucose", "value_num": 99.5, "unit": "MG/DL", "collected_at": "2026-01-03"}]
    (tmp_path / "rows.json").write_text(json.dumps(rows))
    store("--apply", "commit", "lab_result", str(tmp_path / "rows.json"), "1")
    capsys.readouterr()
    store("trends", "jane", "glucose")
    r = json.loads(capsys.readouterr().out)
    assert (r["count"], r["latest"], r["slope_per_day"], r["unit"]) == (2, 99.5, 4.75, "mg/dL")
    store("find", "labs", "--person", "jane")
    assert "[labs]" in capsys.readouterr().out
    (tmp_path / "bad.json").write_text('[{"test_name": "x", "collected_at": "yesterday"}]')
    with pytest.raises(ValueError):
        store("commit", "lab_result", str(tmp_path / "bad.json"), "1")
    store("restore", "latest")
    assert "anamnex-2026" in capsys.readouterr().out


def test_new_verbs(store, tmp_path, capsys):
    def say(*args):
        capsys.readouterr()
        assert store(*args) == 0
        return [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]

    store("--apply", "person-add", "jane", "Jane Doe", "--dob", "1962-03-14")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Jane Doe labs")
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF-1.4 nothing to read")
    store("--apply", "ingest", str(tmp_path / "in"), "jane")
    store("--apply", "unit-pref", "jane", "Weight", "--unit", "pounds")
    assert [(r["key"], r["unit"]) for r in say("unit-prefs", "jane")] == [("weight", "lb")]
    assert [(r["slug"], r["unit_prefs"], r["lab_result"]) for r in say("person-show", "jane")] == [("jane", [{"key": "weight", "unit": "lb"}], 0)]
    shown = say("document-show", "1")[0]
    assert (shown["ocr_text"], shown["slug"], shown["allergy"]) == ("Jane Doe labs", "jane", 0)
    assert {r["status"] for r in say("document-reextract", str(tmp_path / "in"))} == {"unchanged", "failed"}  # no reader for PDF files
    store("--apply", "tombstone-add", "ab" * 32, "--reason", "spam")
    assert [r["reason"] for r in say("tombstones")] == ["spam"]
    store("--apply", "tombstone-remove", "AB" * 32)
    assert say("tombstones") == []
    assert say("verify", "--cap", "1") == []
    (tmp_path / "map.json").write_text(json.dumps({"orphans": [{"record_type": "lab_result", "old_base": "x", "new_base": "y"}, {"record_type": "lab_result", "old_base": "z", "new_base": None}]}))
    assert say("reaffirm", str(tmp_path / "map.json")) == []
    assert cli.choices("unit=incoming, flag=existing") == {"unit": "incoming", "flag": "existing"} and cli.choices(None) is None
    with pytest.raises(ValueError):
        cli.choices("unit=mine")


def dicom_file(values):
    import struct

    from anamnex.sources import dicom

    def element(tag, value, form=b"LO"):
        value += b"\0" * (len(value) % 2)
        return struct.pack("<HH2sH", *tag, form, len(value)) + value

    syntax = element(dicom.SYNTAX, dicom.EXPLICIT.encode(), b"UI")
    body = b"".join(element(dicom.TAGS[n], v.encode()) for n, v in sorted(values.items(), key=lambda x: dicom.TAGS[x[0]]))
    return b"\0" * 128 + b"DICM" + struct.pack("<HH2sHI", 2, 0, b"UL", 4, len(syntax)) + syntax + body


def test_study_ingest(spark, store, tmp_path, capsys):
    from anamnex.operators import ingest

    store("--apply", "person-add", "jane", "Jane Doe", "--dob", "1962-03-14")
    study = tmp_path / "knee"
    (study / "s1").mkdir(parents=True)
    for k in range(3):
        (study / "s1" / f"{k}.dcm").write_bytes(dicom_file({"study_date": "20240105", "modality": "MR", "patient_name": "DOE^JANE", "patient_birth_date": "19620314"}))
    (study / "note.txt").write_text("no slice")
    args = ("study-ingest", str(study), "jane", str(tmp_path / "blobs"))
    capsys.readouterr()
    store("--apply", *args)
    first = json.loads(capsys.readouterr().out.splitlines()[0])
    assert (first["status"], first["verdict"]) == ("new", "match")
    assert [p.name for p in (tmp_path / "blobs").rglob("*.zip")] == [first["sha256"] + ".dcm.zip"]
    assert (first["excluded_documents"], first["excluded_other"]) == (["note.txt"], 0)
    store(*args)
    assert json.loads(capsys.readouterr().out.splitlines()[0])["status"] == "duplicate"
    assert [p.name for p in (tmp_path / "blobs").rglob("*") if p.is_file() and ".crc" not in p.name] == [first["sha256"] + ".dcm.zip"]
    cat = snapshots.Catalog(spark, {})
    with pytest.raises(ingest.TooLargeError):
        ingest.ingest_study(cat, "jane", str(study), str(tmp_path), most=10)
    with pytest.raises(ValueError):
        ingest.ingest_study(cat, "jane", str(tmp_path / "blobs"), str(tmp_path))
