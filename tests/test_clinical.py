import datetime as dt

import pytest
from pyspark.sql import functions as F

from anamnex.operators import clinical, commit, overlay, registryops, render, search, sections
from anamnex.operators.segments import SegmentedIndex
from anamnex.plans import bridge
from anamnex.plans.catalog import Catalog
from anamnex.functions import identity
from anamnex.specs import FIELDS, TYPES, schema_of

NOW = "2026-08-02"


def table(spark, name, *rows):
    """Rows as dicts; ids by place, identities computed."""
    schema, pk = schema_of(name), f"{name}_id"
    full = [{pk: k + 1, "person_id": 1, "dedup_occurrence": 0, **r} if name in FIELDS else r for k, r in enumerate(rows)]
    df = spark.createDataFrame([tuple(float(v) if isinstance(v := r.get(f.name), int) and f.dataType.typeName() == "double" else v for f in schema) for r in full], schema)
    if name in FIELDS:
        df = df.withColumn("dedup_base", identity.dedup_base(name)).withColumn("dedup_key", identity.occurrence_key(F.col("dedup_base"), F.col("dedup_occurrence")))
    return spark.createDataFrame(df.select(*schema.names).collect(), schema)


def settled(cat):
    """As after a snapshot: tables that no longer carry the plans which made them."""
    return Catalog(cat.spark, {n: cat.spark.createDataFrame(df.collect(), df.schema) for n, df in cat.tables.items()})


def only(cat, *names):
    return Catalog(cat.spark, {n: cat[n] for n in names})


@pytest.fixture(scope="module")
def cat(spark):
    person = table(spark, "person", {"person_id": 1, "slug": "jane-doe", "full_name": "Jane Doe"}, {"person_id": 2, "slug": "john-doe", "full_name": "John Doe", "dob": "1962-03-14"})
    labs = table(
        spark, "lab_result", {"test_name": "HbA1c", "value_num": 5.5, "unit": "%", "collected_at": "2024-01-01", "document_id": 1}, {"test_name": "hba1c", "value_num": 6.0, "unit": "%", "collected_at": "2025-01-01"},
        {"test_name": "HBA1C", "value_num": 6.5, "unit": "%", "collected_at": "2026-01-01"}, {"test_name": "LDL", "value_num": 130, "unit": "mg/dL", "flag": "H", "collected_at": "2026-01-01"},
        {"test_name": "HbA1c (POC)", "value_num": 7.0, "unit": "%", "collected_at": "2026-02-01"}, {"test_name": "hba1c", "value_num": 9.0, "unit": "%", "collected_at": "2026-01-01", "person_id": 2},
    )
    meds = table(spark, "medication", {"name": "ALPHA HCL", "dose": "5 mg", "started_on": "2024-01-01"}, {"name": "Beta", "started_on": "2023-01-01", "ended_on": "2024-06-01", "status": "discontinued"})
    conds = table(spark, "condition", {"name": "Asthma", "status": "active", "onset_on": "2001"}, {"name": "Flu", "status": "Resolved", "resolved_on": "2020-02"}, {"name": "Gout", "status": "Family History", "relation": "father", "onset_on": "1980"})
    obs = table(
        spark, "observation", {"obs_type": "vital", "key": "weight", "value_num": 90, "unit": "kg", "observed_at": "2026-01-01"}, {"obs_type": "vital", "key": "Weight", "value_num": 196, "unit": "lb", "observed_at": "2026-01-31"},
        {"obs_type": "symptom", "key": "headache", "value_num": 4, "observed_at": "2026-07-20T08:00"}, {"obs_type": "symptom", "key": "headache", "value_num": 0, "observed_at": "2026-07-25 08:00"}, {"obs_type": "order", "key": "HbA1c", "observed_at": "2025-12-20"}, {"obs_type": "order", "key": "MRI", "observed_at": "2026-01-05"},
    )
    return Catalog(
        spark,
        {
            "person": person, "lab_result": labs, "medication": meds, "condition": conds, "observation": obs, "procedure": table(spark, "procedure", {"name": "Colonoscopy", "performed_on": "2019-05-05"}),
            "appointment": table(spark, "appointment", {"scheduled_for": "2026-09-01", "provider": "Dr Roe", "reason": "checkup"}), "allergy": table(spark, "allergy", {"substance": "Penicillin", "reaction": "rash", "criticality": "high"}),
            "person_unit_pref": table(spark, "person_unit_pref", {"person_id": 1, "key": "weight", "unit": "lb"}), "document": table(spark, "document", {"document_id": 1, "sha256": "0" * 64, "person_id": 1, "ocr_text": "Análisis de HbA1c for jane"}),
        },
    )


def test_labs_and_isolation(cat):
    assert clinical.labs(cat, "Jane-Doe ").count() == 5
    assert clinical.labs(cat, "jane-doe", test="HBA1C").count() == 4
    assert clinical.labs(cat, "jane-doe", since="2025-01-01").count() == 4
    with pytest.raises(clinical.PersonNotFoundError):
        clinical.labs(cat, "nobody")


@pytest.mark.parametrize(
    "status, ended, reason, current",
    [
        (None, None, None, True), ("", None, None, True), ("prn", None, None, True), ("completed", None, None, False), ("Stopped", None, None, False), (" discontinued ", None, None, False), (None, "2024-06-01", None, False),
        ("active", "2026-08-01", None, False), ("active", "2026-08-02", None, True), ("active", "2026-09-04", None, True), ("active", "2026-08-02T00:00:00", None, True), ("active", "2024", None, False), ("active", "2026-07", None, False),
        ("active", "2026", None, True), ("active", "2026-08", None, True), ("discontinued", "2024-01-01", "Re-Order", True), ("discontinued", "2024-01-01", "Therapy Completed", False),
    ],
)
def test_currency(spark, status, ended, reason, current):
    df = spark.createDataFrame([(status, ended, reason)], "status string, ended_on string, status_reason string")
    assert df.select(clinical.is_current(NOW).alias("c")).first()["c"] is current


def test_trends(cat):
    r = clinical.trends(cat, "hba1c", "jane-doe").first()
    assert (r["count"], r["min"], r["max"], r["latest"], r["latest_at"], r["unit"]) == (3, 5.5, 6.5, 6.5, "2026-01-01", "%")
    assert r["slope_per_day"] > 0 and r["other_assays"] == ["hba1c (poc)"] and r["other_assay_count"] == 1
    assert {x["person_id"]: x["max"] for x in clinical.trends(cat, "hba1c").collect()} == {1: 6.5, 2: 9.0}
    nothing = clinical.trends(cat, "zinc", "jane-doe").first()
    assert nothing["count"] == 0 and nothing["test"] == "zinc" and nothing["latest"] is None
    w = clinical.trends(cat, "Weight", "jane-doe").first()
    assert (w["unit"], w["converted_count"], w["min"], w["latest"]) == ("lb", 1, 196.0, 196.0)


def test_ambiguous_series(cat, spark):
    both = cat.with_tables(lab_result=cat["lab_result"].unionByName(table(spark, "lab_result", {"lab_result_id": 99, "test_name": "weight", "value_num": 1, "collected_at": "2024-01-01"})))
    slug = both["person"].join(both["lab_result"].where("lab_result_id = 99"), "person_id").first()["slug"] if both["lab_result"].where("lab_result_id = 99").first()["person_id"] else None
    if slug:
        with pytest.raises(clinical.AmbiguousTestError):
            clinical.trends(both, "weight", slug)
    rows = {r["person_id"]: r for r in clinical.trends(both, "weight").collect()}  # one person's names cost the others nothing
    alone = {r["person_id"]: r for r in clinical.trends(cat, "weight").collect()}
    for who, r in rows.items():
        mixed = who in alone and who == both["lab_result"].where("lab_result_id = 99").first()["person_id"]
        assert r["ambiguous"] == mixed and ((r["min"], r["unit"]) == (None, None) if mixed else r["min"] is not None)


def test_verdicts(cat, spark):
    base = cat["lab_result"].where("lab_result_id = 3").first()["dedup_base"]
    ruled = cat.with_tables(curation=table(spark, "curation", {"record_type": "lab_result", "dedup_base": base, "record_id": 0, "status": "superseded", "note": "n"}))
    r = clinical.trends(ruled, "hba1c", "jane-doe").first()
    assert (r["count"], r["max"], r["suppressed_count"]) == (2, 6.0, 1)
    both = ruled.with_tables(curation=ruled["curation"].unionByName(table(spark, "curation", {"record_type": "lab_result", "dedup_base": "elsewhere", "record_id": 3, "status": "confirmed", "note": "ok"})))
    assert clinical.trends(both, "hba1c", "jane-doe").first()["count"] == 3
    assert overlay.live(cat["lab_result"], cat, "lab_result").count() == 6


def test_timeline(cat):
    rows = [(r["date"], r["type"], r["summary"]) for r in clinical.timeline(cat, "jane-doe").collect()]
    assert rows == sorted(rows, key=lambda r: r[:2])
    assert ("2024-06-01", "med-stop", "stopped Beta") in rows and ("2024-01-01", "lab", "HbA1c 5.5 %") in rows
    assert not any("Gout" in r[2] for r in rows) and ("2020-02", "condition-resolved", "resolved Flu") in rows


def test_sections(cat):
    assert [r["value_num"] for r in sections.latest_vitals(cat, "jane-doe").collect()] == [196.0]
    s = sections.symptoms(cat, NOW, "jane-doe").first()
    assert s["reports"] == 2 and s["resolved"]["observation_id"] == 4 and s["latest"]["observation_id"] == 3
    assert [r["key"] for r in sections.open_orders(cat, "jane-doe").collect()] == ["MRI"]
    assert [r["test_name"] for r in sections.abnormal_labs(cat, NOW, "jane-doe").collect()] == ["LDL"]


def test_summary_text(cat):
    text = render.person_text(render.summaries(cat, NOW, NOW, overrides=None), cat, "jane-doe")
    assert "- Alpha HCl 5 mg (since 2024-01-01)" in text and "Beta" not in text
    assert "- weight" not in text and "- Weight: 196.0 lb  (2026-01-31)" in text
    assert "- headache - 2 reports in 30d, latest 2026-07-20 (severity 4/10); last reported resolved 2026-07-25" in text
    assert "- father: Gout" in text and "- Penicillin [HIGH] - rash" in text and "## Procedures\n\n- 2019-05-05  Colonoscopy" in text
    other = render.person_text(render.summaries(cat, NOW, NOW), cat, "john-doe")
    assert "Self-Reported" not in other and "_none recorded_" in other


def test_brief_and_journal(cat):
    brief = render.briefs(cat, NOW, NOW).first()["text"]
    assert "- When: 2026-09-01" in brief and "2026-01-01  LDL  130.0 mg/dL [H]  [!]" in brief and "headache" not in brief
    journal = render.person_text(render.journals(cat, NOW), cat, "jane-doe")
    assert "## 2024-01-01\n\n- **lab** -- HbA1c 5.5 % [^1]" in journal and "[^1]: document #1" in journal


def test_find(cat):
    rows = search.find(cat, "analisis hba1c").collect()
    assert [(r["source_table"], r["slug"]) for r in rows] == [("document", "jane-doe")]
    assert rows[0]["snippet"] == "[Análisis] de [HbA1c] for jane" and rows[0]["rank"] < 0
    assert search.find(cat, "...").count() == 0 and search.find(cat, "hba1c", "john-doe").count() == 1


def test_stored_index_gives_the_same(cat, tmp_path):
    index = SegmentedIndex(cat.spark, str(tmp_path / "index"))
    index.apply(search.record_text(cat))
    for q in ("hba1c", "for_jane", ""):
        a = [(r["source_table"], r["source_id"], round(r["rank"], 9)) for r in search.find(cat, q, snippets=False).collect()]
        assert [(r["source_table"], r["source_id"], round(r["rank"], 9)) for r in index.find(q).collect()] == a


def test_numbering_by_bucket(spark, monkeypatch):
    from anamnex.functions import plan

    monkeypatch.setattr(plan, "NUMBERED_ROWS", 7)
    got = plan.numbered(spark.range(50).withColumnRenamed("id", "pos"), "n", 10, "pos").collect()
    assert sorted(r["n"] for r in got) == list(range(10, 60))


def rows_for(spark, name, *rows):
    fields = FIELDS[name]
    schema = "pos long, person_id long, document_id long, " + ", ".join(f"`{n}` {k}" for n, k in fields.items())
    return spark.createDataFrame([(k, 1, 7, *(r.get(f) for f in fields)) for k, r in enumerate(rows)], schema)


def test_commit_fold_depends_on_order(spark):
    empty = Catalog(spark, {"allergy": spark.createDataFrame([], schema_of("allergy"))})
    cat, found = commit.commit(empty, "allergy", rows_for(spark, "allergy", {"substance": "Latex"}, {"substance": "latex", "reaction": "x"}, {"substance": "LATEX", "reaction": "y"}))
    assert [r["outcome"] for r in found.orderBy("pos").collect()] == ["new", "enriched", "conflict"]
    cat = settled(cat)
    assert [r["reaction"] for r in cat["allergy"].collect()] == ["x"] and cat["conflict"].count() == 1
    again, found = commit.commit(cat, "allergy", rows_for(spark, "allergy", {"substance": "latex", "reaction": "x"}))
    assert [r["outcome"] for r in found.collect()] == ["duplicate"] and again["allergy"].count() == 1
    kept, out = commit.resolve(cat, 1, "both")
    assert out["occurrence"] == 1 and kept["allergy"].count() == 2 and kept["conflict"].first()["status"] == "resolved"
    merged, out = commit.resolve(cat, 1, "merge", fields={"reaction": "incoming"})
    assert merged["allergy"].first()["reaction"] == "y"
    with pytest.raises(commit.ResolutionError):
        commit.resolve(cat, 1, "merge")


def test_validation(spark):
    bad = rows_for(spark, "observation", {"obs_type": "symptom", "key": " ", "observed_at": "2024-01-01"}, {"obs_type": "symptom", "key": "k", "observed_at": "2024-01-01T08:00", "value_num": 11.0}, {"obs_type": "vital"})
    sizes = [len(r["e"]) for r in bad.select("pos", commit.errors("observation").alias("e")).orderBy("pos").collect()]
    assert sizes == [2, 1, 0]
    raw = spark.createDataFrame([('{"name": "A", "dose": 5}',), ('{"name": "A", "colour": "b"}',), ('{"name": "A"}',)], "json string")
    assert [len(r["errors"]) for r in commit.parsed(raw, "medication").collect()] == [1, 1, 0]
    empty = Catalog(spark, {"lab_result": spark.createDataFrame([], schema_of("lab_result"))})
    with pytest.raises(commit.ValidationError):
        commit.commit(empty, "lab_result", rows_for(spark, "lab_result", {"test_name": "A", "collected_at": "2024-01-01", "value_num": 1.0}, {"test_name": "a", "collected_at": "2024-01-01T09:00", "value_num": 2.0}))


def test_rekey(cat, spark):
    cat = only(cat, "lab_result", "medication")
    same, changes, clashed = commit.rekey(cat, {})
    assert changes.count() == 0 and clashed.count() == 0
    d = {"hba1c": "a1c", "ldl": "cholesterol"}
    moved, changes, clashed = commit.rekey(cat, d)
    assert changes.count() == 6 and clashed.count() == 0
    again, changes, _ = commit.rekey(settled(moved), d)
    assert changes.count() == 0
    fuse = {"ldl": "hba1c"}
    blocked, _, clashed = commit.rekey(cat, fuse)
    assert [(r["row_id"], r["clash_id"], r["kind"], r["settlement"]) for r in clashed.collect()] == [(4, 3, "fused", None)]
    assert blocked["lab_result"].where("lab_result_id = 4").first()["dedup_key"] == cat["lab_result"].where("lab_result_id = 4").first()["dedup_key"]
    base = cat["lab_result"].where("lab_result_id = 4").first()["dedup_base"]
    ruled = cat.with_tables(curation=table(spark, "curation", {"record_type": "lab_result", "dedup_base": base, "record_id": 0, "status": "distinct", "note": "two facts"}))
    done, _, _ = commit.rekey(ruled, fuse)
    assert done["lab_result"].where("lab_result_id = 4").first()["dedup_occurrence"] == 1
    assert done["curation"].first()["record_id"] == 4


def test_record_verbs(cat):
    edited = registryops.edit_record(cat, "medication", 1, {"route": "oral"}, "typo", "jane")
    assert edited["medication"].where("medication_id = 1").first()["route"] == "oral" and edited["record_edit"].count() == 1
    with pytest.raises(registryops.RefusedError):
        registryops.edit_record(cat, "medication", 1, {"name": "Gamma"}, "n")
    moved = registryops.edit_record(cat, "medication", 1, {"name": "Gamma"}, "n", identity_too=True)
    row = moved["medication"].where("medication_id = 1").first()
    assert row["dedup_base"] == row["dedup_key"] != cat["medication"].where("medication_id = 1").first()["dedup_base"]
    gone = registryops.remove_record(cat, "medication", 2)
    assert gone["medication"].count() == 1
    new, state = registryops.assert_record(cat, "allergy", "jane-doe", {"substance": "Latex"}, "jane", "2026-01-01")
    new = settled(new)
    assert state == "new" and registryops.attested(new).count() == 1
    assert registryops.assert_record(cat, "allergy", "jane-doe", {"substance": "penicillin"}, "jane", "2026-01-01")[1] == "duplicate"


def test_verdict_verbs(cat):
    base = cat["lab_result"].where("lab_result_id = 1").first()["dedup_base"]
    other = cat["lab_result"].where("person_id = 2").first()["dedup_base"]
    ruled = settled(registryops.annotate(cat, "lab_result", base, "disputed", "check", attributed_to="jane"))
    assert registryops.verdict_list(ruled).first()["label"] == "HbA1c" and "DISPUTED: check" in render.person_text(render.journals(ruled, NOW), ruled, "jane-doe")
    with pytest.raises(registryops.RefusedError):
        registryops.annotate(cat, "lab_result", base, "merged-into", "same", merged_into_base=other)
    assert registryops.clear_verdict(ruled, "lab_result", base)["curation"].count() == 0
    lost = settled(ruled.with_tables(lab_result=ruled["lab_result"].where("lab_result_id <> 1")))
    assert [r["kinds"] for r in registryops.orphans(lost).collect()] == [["no-live-family"]]
    to = cat["lab_result"].where("lab_result_id = 2").first()["dedup_base"]
    successors = cat.spark.createDataFrame([("lab_result", base, to)], "record_type string, old_base string, new_base string")
    back, plan = registryops.reaffirm(lost, successors)
    assert [r["action"] for r in plan.collect()] == ["reaffirmed"] and back["curation"].first()["dedup_base"] == to


def test_document_verbs(cat):
    with pytest.raises(registryops.RefusedError):
        registryops.remove_person(cat, "jane-doe")
    gone = registryops.remove_document(cat, 1, tombstone=True, now=dt.datetime(2026, 1, 1))
    gone = settled(gone)
    assert gone["document"].count() == 0 and gone["lab_result"].count() == 5 and registryops.tombstones(gone).count() == 1
    moved, counts = registryops.reassign(cat, 1, "john-doe")
    assert counts["lab_result"] == 1 and moved["lab_result"].where("person_id = 2").count() == 2
    assert registryops.documents(cat).first()["lab_result"] == 1
    assert registryops.verify(cat).count() == 0
    pref = registryops.set_pref(cat, "john-doe", "Weight", "LBS")
    assert registryops.prefs(pref, "john-doe").first()["unit"] == "lb"
    with pytest.raises(registryops.RefusedError):
        registryops.set_pref(cat, "john-doe", "Weight", "stone")


def test_bridge_views_have_all_types(spark, sf_dir):
    cat = bridge.catalog(spark, sf_dir)
    assert all(cat[t].columns == schema_of(t).names for t in TYPES)


def test_bridge_keeps_whole_texts(spark, sf_dir):
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("conv_id * 1000 + turn AS appointment_id", "text AS reason", "CASE WHEN role = 'assistant' THEN text END AS summary")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS document_id", "text AS ocr_text")
    for name, own in (("appointment", said), ("document", docs)):
        got = bridge.view(spark, sf_dir, name).select(*own.columns)
        assert got.exceptAll(own).count() == 0 and own.exceptAll(got).count() == 0


def test_documents_without_text(spark, cat):
    rows = [{"document_id": k, "sha256": str(k), "person_id": 1, "ocr_text": t} for k, t in enumerate((None, "", " ", "\n\t", "a", " a "), 1)]
    own = cat.with_tables(document=table(spark, "document", *rows))
    assert [r["document_id"] for r in registryops.without_text(own).collect()] == [1, 2, 3, 4]


def test_plain_outcomes_equal_a_fold(spark):
    """Types whose rows agree or not: joins and aggregates give what a fold in the order of submission gives."""
    import random

    from anamnex.operators import commit

    r = random.Random(8)
    fields = "test_name string, loinc string, value_num double, value_text string, unit string, ref_low double, ref_high double, flag string, collected_at string"

    def row(k):
        return ("x", None, r.choice([1.0, 2.0, None, -0.0, 0.0]), None, r.choice(["mg", " MG", None, ""]), None, None, r.choice([None, "H"]), "2024")

    stored = [(k, f"b{r.randrange(12)}", k % 3, r.choice([None, 5]), r.choice([None, "me"]), *row(k)) for k in range(30)]
    incoming = [(k, f"b{r.randrange(20)}", 9, *row(k)) for k in range(200)]
    old = spark.createDataFrame(stored, f"lab_result_id long, dedup_base string, dedup_occurrence int, document_id long, attested_by string, {fields}")
    new = spark.createDataFrame(incoming, f"pos long, dedup_base string, document_id long, {fields}")
    names = [f.split()[0] for f in fields.split(", ")]
    families, want = {}, {}
    for s in sorted(stored, key=lambda s: (s[2], s[0])):
        families.setdefault(s[1], []).append({"id": s[0], "document_id": s[3], "attested_by": s[4], **dict(zip(names, s[5:]))})
    for pos, base, document, *rest in incoming:
        pay, family = dict(zip(names, rest)), families.setdefault(base, [])
        twin = next((f for f in family if commit._same("lab_result", f, pay)), None)
        if not family:
            family.append({"id": None, "document_id": document, "attested_by": None, **pay})
            want[pos] = ("new", None)
        elif twin is None:
            want[pos] = ("conflict", family[0]["id"])
        elif twin["attested_by"] is not None and twin["document_id"] is None:
            twin["document_id"] = document
            want[pos] = ("promoted", twin["id"])
        else:
            want[pos] = ("duplicate", twin["id"])
    found = commit.outcomes(old, new, "lab_result").collect()
    assert {r["pos"]: (r["outcome"], r["target_id"]) for r in found} == want and len(found) == len(want)
    assert {o for o, _ in want.values()} == {"new", "conflict", "promoted", "duplicate"}
    assert commit.outcomes(old, new.limit(0), "lab_result").count() == 0
