"""Snapshots: only what changed is written, what is damaged is named, and a crash leaves the store as it was."""

import json

import pytest
from pyspark.sql import functions as F

from anamnex.plans import catalog as snapshots
from anamnex.plans.catalog import Catalog, SnapshotError

A, B, C = "anamnex-20260101-0900", "anamnex-20260102-0900", "anamnex-20260103-0900"


def labs(spark, n=400):
    return spark.range(n).select(F.col("id").alias("lab_result_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("test_name"), F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("value_num"))


@pytest.fixture
def store(spark, tmp_path):
    root = str(tmp_path / "store")
    cat = Catalog(spark, {"lab_result": labs(spark), "loose": spark.createDataFrame([("a", 1), ("a", 1), (None, None)], "k string, v int")})
    snapshots.snapshot(cat, root, A, bucket_rows=20)
    return root, cat, tmp_path / "store"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_one_changed_row_rewrites_one_bucket(spark, store):
    root, cat, path = store
    changed = cat.with_tables(lab_result=labs(spark).withColumn("value_num", F.when(F.col("lab_result_id") == 7, 1.5).otherwise(F.col("value_num"))))
    made = snapshots.snapshot(changed, root, B)
    assert made["tables"]["lab_result"]["buckets"] == 20 and len(made["written"]["lab_result"]) == 1 and made["written"]["loose"] == []
    assert len(list((path / B).rglob("*.parquet"))) == 1
    assert snapshots.changed_buckets(spark, root, A, B) == {"lab_result": made["written"]["lab_result"]}
    assert rows(snapshots.difference(spark, root, A, B, "lab_result")) == [(7, "t7", 1.0, "one"), (7, "t7", 1.5, "other")]
    read = snapshots.difference(spark, root, A, B, "lab_result").inputFiles()
    assert len(read) == 2
    assert rows(snapshots.load(spark, root)["lab_result"].select("lab_result_id", "test_name", "value_num")) == rows(changed["lab_result"])
    same = snapshots.snapshot(changed, root, C)
    assert not any(same["written"].values()) and snapshots.changed_buckets(spark, root, B, C) == {} and same["root"] == made["root"] and snapshots.integrity(spark, root, C) == "ok"
    snapshots.restore(spark, root, A)
    assert rows(snapshots.load(spark, root)["lab_result"].select("lab_result_id", "test_name", "value_num")) == rows(cat["lab_result"])


def test_repeats_new_tables_and_forms(spark, store):
    root, cat, _ = store
    more = Catalog(spark, {"loose": spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), "new": labs(spark, 3), "lab_result": labs(spark).drop("value_num")})
    snapshots.snapshot(more, root, B)
    assert rows(snapshots.difference(spark, root, A, B, "loose")) == [("a", 1, "one"), ("b", 2, "other"), (None, None, "one")]
    assert set(snapshots.changed_buckets(spark, root, A, B)) == {"loose", "new", "lab_result"} and snapshots.changed_buckets(spark, root, A, B)["lab_result"] is None
    assert snapshots.difference(spark, root, A, B, "new").count() == 3
    with pytest.raises(SnapshotError):
        snapshots.difference(spark, root, A, B, "absent")
    snapshots.snapshot(Catalog(spark, {"loose": more["loose"].limit(0)}), root, C)
    assert snapshots.load(spark, root)["loose"].count() == 0 and snapshots.integrity(spark, root, C) == "ok"


@pytest.mark.parametrize("harm", ["cut", "other", "gone", "folder"])
def test_a_damaged_file_is_named(spark, store, harm):
    root, _, path = store
    own = [p for p in (path / A / "lab_result").rglob("*.parquet") if "__bucket=3" in str(p)]
    for p in own:
        crc = p.with_name(f".{p.name}.crc")
        if harm == "cut":
            p.write_bytes(p.read_bytes()[:50])
        elif harm == "other":
            crc.unlink()
            other = next(q for q in (path / A / "lab_result").rglob("*.parquet") if "__bucket=4" in str(q))
            p.write_bytes(other.read_bytes())
        else:
            p.unlink()
            if harm == "folder":
                for q in p.parent.iterdir():
                    q.unlink()
                p.parent.rmdir()
    state = snapshots.integrity(spark, root, A)
    assert "bucket 3 of table lab_result" in state
    with pytest.raises(SnapshotError, match="bucket 3"):
        snapshots.restore(spark, root, A)


def test_a_wrong_write_is_deleted_and_the_store_stays(spark, store, monkeypatch):
    root, cat, path = store
    true = snapshots._hashes_of
    monkeypatch.setattr(snapshots, "_hashes_of", lambda *a: {k: {**v, "hash": "x"} for k, v in true(*a).items()})
    with pytest.raises(SnapshotError, match="differs from what was to be written"):
        snapshots.snapshot(cat.with_tables(lab_result=labs(spark, 50)), root, B)
    assert not (path / B).exists() and json.loads((path / "current.json").read_text())["current"] == A
    monkeypatch.undo()
    assert snapshots.integrity(spark, root, A) == "ok" and snapshots.load(spark, root)["lab_result"].count() == 400


def test_what_a_crash_left_is_no_snapshot(spark, store):
    root, cat, path = store
    (path / "anamnex-20270101-0900" / "lab_result").mkdir(parents=True)
    assert snapshots.resolve(spark, root, "latest") == A
    snapshots.snapshot(cat, root, B)
    assert snapshots.rotate(spark, root, keep_daily=1, keep_weekly=0) == [A]
    assert (path / A).exists() and snapshots.integrity(spark, root, B) == "ok"  # B still names A's buckets
    snapshots.snapshot(cat.with_tables(lab_result=labs(spark, 5), loose=labs(spark, 2)), root, C)
    assert snapshots.rotate(spark, root, keep_daily=1, keep_weekly=0) == [B] and snapshots.integrity(spark, root, C) == "ok"


def test_manifests_are_swapped_in_one_step(spark, tmp_path):
    files = snapshots.Files(spark, str(tmp_path))
    files.write("current.json", "1")
    files.write("current.json", "2")
    assert files.read("current.json") == "2" and [n for n in files.names() if n.endswith(".new")] == []
    files.put("a.json", "1")
    with pytest.raises(SnapshotError):
        files.put("a.json", "2")
    assert files.read("a.json") == "1"


def test_observations_of_an_old_store_are_promoted(spark, tmp_path):
    root = str(tmp_path / "store")
    old = "observation_id long, person_id long, obs_type string, key string, value_text string, observed_at string, dedup_key string, dedup_base string, dedup_occurrence int"
    rows = [(4, 1, "allergy", "zinc", "rash", "2020", "k4", None, 0), (2, 1, "allergy", "iron", None, None, "k2", "b2", 1), (3, 2, "condition", "gout", "old", "2019", "k3", None, 0), (5, 2, "allergy", None, "x", None, "k5", None, 0), (6, 2, None, "y", None, None, "k6", None, 0), (7, 1, "vital", "w", None, None, "k7", None, 0)]
    cat = Catalog(spark, {"observation": spark.createDataFrame(rows, old), "allergy": spark.createDataFrame([(9, 3, "wool")], "allergy_id long, person_id long, substance string")})
    snapshots.snapshot(cat, root, A)
    path = tmp_path / "store" / A / "manifest.json"
    (path.parent / ".manifest.json.crc").unlink(missing_ok=True)
    path.write_text(json.dumps({**json.loads(path.read_text()), "schema_version": 5}))
    new = snapshots.load(spark, root)
    assert sorted(map(tuple, new["allergy"].select("allergy_id", "substance", "reaction", "noted_on", "dedup_base", "dedup_occurrence").collect())) == [(9, "wool", None, None, None, 0), (10, "iron", None, None, "b2", 1), (11, "zinc", "rash", "2020", "k4", 0)]
    assert [tuple(r) for r in new["condition"].select("condition_id", "person_id", "name", "status", "onset_on", "note", "dedup_base").collect()] == [(1, 2, "gout", "active", "2019", "old", "k3")]
    assert sorted(r["observation_id"] for r in new["observation"].collect()) == [5, 6, 7]


def test_evidence_window(spark):
    from anamnex.operators.ingest import evidence

    texts = ["x" * 10 + " DOB " + "y" * 200, "z" * 300 + "\n MRN\t" + "w" * 300, "Name : A", "none", "", None, "PATIENT"]
    want = ["x" * 10 + " DOB " + "y" * 57, "z" * 58 + " MRN " + "w" * 58, "Name : A", None, None, None, "PATIENT"]
    got = [r["e"] for r in spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", evidence(F.col("t")).alias("e")).orderBy("k").collect()]
    for own, w, t in zip(got, want, texts):
        if w is None or len(w) < 20:
            assert own == w
        else:  # the middle of the anchor, 60 characters to both sides
            import re

            m = re.search("(?i)dob|mrn", t)
            mid = (m.start() + m.end()) // 2
            assert own == " ".join(t[max(0, mid - 60) : mid + 60].split())
