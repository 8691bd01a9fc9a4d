"""What only showed on larger or other tables: queries on small tables made for it, held against their SQL or counted by hand."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from anamnex.functions import dates, text
from anamnex.operators import commit, diagnostics, overlay, piiscan, registryops, render, segments
from anamnex.operators.segments import SegmentedIndex
from anamnex.plans import catalog as snapshots
from anamnex.plans import bridge, registry, registry_sources, registry_verbs
from anamnex.plans.bridge import DICTIONARY, catalog
from anamnex.sources import decoders


def against_sql(spark, folder, name, *tables):
    """Rows of a query, and of its SQL, in some order."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = registry.QUERIES[name](spark, str(folder))
    found = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in found.description]
    want = [tuple(dict(zip(columns, r))[c] for c in df.columns) for r in found.fetchall()]
    return sorted(map(tuple, df.collect()), key=repr), sorted(want, key=repr)


def test_an_anchor_inside_a_word_counts_as_in_the_sql(spark, tmp_path):
    texts = ["by ADOBE systems " + "x" * 150, "the patient " + "y z" * 90, "a" * 300, "", "DOB", None]
    pq.write_table(pa.table({"doc_id": [100, 50, 7, 1, 3, 2], "text": texts}), f"{tmp_path}/documents.parquet")
    got, want = against_sql(spark, tmp_path, "evidence_windows", "documents")
    assert got == want and len(got) == len(texts)


def test_what_ends_a_live_log_is_in_no_stall_window(spark, tmp_path):
    last = dt.datetime(2024, 1, 9, 12)
    rows = [(25, 1, "signup", last - dt.timedelta(hours=1), 5.0), (1, 1, "view", last, 7.0), (2, 1, "error", last - dt.timedelta(hours=2), 1.0), (3, 2, "view", last - dt.timedelta(days=9), 2.0)]
    events = pa.table(dict(zip(("event_id", "user_id", "event_type", "ts", "value"), zip(*rows))))
    pq.write_table(events.cast(events.schema.set(3, pa.field("ts", pa.timestamp("us")))), f"{tmp_path}/events.parquet")
    got, want = against_sql(spark, tmp_path, "live_stall_windows", "events")
    assert got == want and got[0][:3] == (25, 3, 1)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_outcomes_take_one_shuffle_without_payloads(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    rows = cat["medication"]
    found = commit.outcomes(rows.where("started_on < '1995-06-17'"), rows.withColumn("pos", rows["medication_id"]), "medication").select("pos", "outcome", "target_id")
    assert shuffles(found) == 1 and "prescriber" not in str(found._jdf.queryExecution().optimizedPlan().toString()).split("Window", 1)[0]


def test_conflicts_are_made_once_and_settled_without_a_shuffle(spark, sf_dir):
    cat = registry_verbs._conflicted(spark, sf_dir)
    assert shuffles(cat["conflict"]) == 0 and shuffles(cat["lab_result"]) == 0
    first = cat["conflict"].agg(F.min("conflict_id")).first()[0]
    after, _ = commit.resolve(cat, first, "incoming", dictionary=DICTIONARY)
    assert shuffles(after["lab_result"]) == 0 and after["conflict"].where("status = 'resolved'").count() == 1


def test_events_of_journals_are_shuffled_once(spark, sf_dir):
    assert shuffles(registry.QUERIES["journal_notes"](spark, sf_dir)) == 1 and shuffles(registry.QUERIES["journal_dates"](spark, sf_dir)) == 1


def test_only_ruled_types_meet_verdicts(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    assert overlay.ruled_types(cat) == ("lab_result",)
    rows = overlay.with_verdict(cat["procedure"], cat, "procedure")
    assert "Join" not in str(rows._jdf.queryExecution().optimizedPlan().toString()) and rows.where("_curation IS NOT NULL").count() == 0
    none = overlay.with_verdict(cat["lab_result"], cat.with_tables(curation=cat["curation"].where("false")), "lab_result")
    assert none.where("_curation IS NOT NULL").count() == 0 and none.count() == cat["lab_result"].count()


def test_a_rekey_plan_takes_one_shuffle_for_each_type(spark, sf_dir):
    assert shuffles(registry.QUERIES["rekey_changes"](spark, sf_dir)) == len(registry_verbs._KEYED)


def test_all_types_are_rekeyed_and_repeated_ids_queue_by_place(spark, sf_dir, tmp_path):
    """Procedures too, whose ids are not unique: of two rows of one id, the second queues behind the first."""
    tables = ("events", "orders", "conversations", "part", "supplier", "labels")
    for t in tables:
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    rows = pq.read_table(f"{sf_dir}/lineitem.parquet")
    pq.write_table(pa.concat_tables([rows, rows.slice(0, 150), rows.slice(100, 100)]), f"{tmp_path}/lineitem.parquet")
    got, want = against_sql(spark, tmp_path, "rekey_changes", "lineitem", *tables)
    assert got == want and len([r for r in got if r[0] == "procedure"]) >= 250
    doubled = commit.collisions(catalog(spark, str(tmp_path)), "procedure", {}).where("row_id = clash_id AND kind = 'doubled'")
    assert doubled.count() >= 150


def test_tasks_that_write_a_snapshot_stay_of_one_size(spark, tmp_path):
    assert [snapshots.written_parts(*x) for x in ((0, 1), (999, 1), (216_000_000, 216), (216_000_000, 4))] == [(1, 1), (2, 1), (1728, 4), (1728, 216)]
    rows = spark.range(1000).select(F.col("id").alias("allergy_id"), F.lit("x").alias("substance"))
    made = snapshots.snapshot(snapshots.Catalog(spark, {"allergy": rows}), str(tmp_path), "anamnex-20240201-0000", bucket_rows=100)
    assert len(made["written"]["allergy"]) == 10 and snapshots.integrity(spark, str(tmp_path), "anamnex-20240201-0000") == "ok"


def test_hashes_take_half_their_digits_in_a_snapshot(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").alias("allergy_id"), F.sha2(F.col("id").cast("string"), 256).alias("substance"))
    snapshots.snapshot(snapshots.Catalog(spark, {"allergy": rows}), str(tmp_path), "anamnex-20240201-0000")
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 5000 * 50 and snapshots.integrity(spark, str(tmp_path), "anamnex-20240201-0000") == "ok"


def test_stall_windows_shuffle_samples_and_not_pairs(spark):
    at = dt.datetime(2024, 1, 9, 12)
    samples = spark.createDataFrame([(at + dt.timedelta(seconds=s), None if s % 7 == 0 else float(s % 13), s % 7 == 0) for s in range(-200, 200)], "ts timestamp, ms double, lost boolean")
    times = [at + dt.timedelta(seconds=s) for s in range(-240, 240, 3)]
    markers = spark.createDataFrame([*enumerate(times), (7, times[100]), (900, None)], "marker_id long, marker_ts timestamp")
    found = diagnostics.stall_windows(markers, samples, 30)
    plan = str(found._jdf.queryExecution().executedPlan().toString())
    assert "FlatMapCoGroupsInArrow" in plan
    want = diagnostics.around(markers, diagnostics.near(markers, samples, 30))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect())) and found.where("samples = 0").count() > 1


def test_postings_of_new_records_are_shuffled_once(spark, tmp_path):
    index = SegmentedIndex(spark, f"{tmp_path}/index", tokens_per_shard=50)
    rows = spark.range(200).select(F.lit("t").alias("source_table"), F.col("id").alias("source_id"), F.col("id").alias("person_id"), F.lit(1).cast("long").alias("document_id"), F.concat(F.lit("the one the "), F.col("id").cast("string")).alias("text"))
    exploded = rows.select("source_table", "source_id", "person_id", "document_id", F.col("source_id").alias("ordinal"), F.lit(4).cast("long").alias("len"), F.posexplode(F.split("text", " ")).alias("pos", "token"))
    dealt = index._dealt(exploded, 800, 16, exploded=True)
    assert str(dealt._jdf.queryExecution().executedPlan().toString()).count("Exchange") == 1
    assert {(r["token"], tuple(r["positions"])) for r in dealt.where("source_id = 7").collect()} == {("the", (0, 2)), ("one", (1,)), ("7", (3,))}
    index.apply(rows)
    assert index.find("the 7").count() == 1 and index.find("one").count() == 200


def test_a_line_scan_reads_its_lines_once_and_they_do_not_carry_the_text(spark):
    texts = ["Patient: Ann, Lee\nJames Brown and Zora Brown\nDOB: 3/4/1999 ssn 123-45-6789\nlinda-long \\nMRN: 12345\nCARD 4111 1111 1111 1111", "James Brown\n\nNHS no. 943 476 5919 nhs 9434765918", "chart --person ann-lee add_person(conn, 'li-wu') --person ann-roe", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    found = piiscan.scan(docs, spark.createDataFrame([("James",), (" LINDA",), ("linda",), (None,)], "n string"))
    plan = str(found._jdf.queryExecution().optimizedPlan().toString())
    assert "Union" not in plan and plan.count("Generate posexplode") == 1
    below = plan.split("Generate posexplode", 1)[1]
    assert "(patient|" in below and "(patient|" not in plan[: -len(below)]  # what the whole text says is asked before there are lines
    assert sorted((r["doc_id"], r["line"], r["rule"], r["match"]) for r in found.collect()) == [
        (0, 1, "patient-name", "Patient: Ann, Lee"), (0, 2, "full-name", "James Brown"), (0, 3, "dob", "3/4/1999"), (0, 3, "ssn", "123-45-6789"), (0, 4, "bare-slug", "linda-long"), (0, 4, "mrn", "MRN: 12345"),
        (0, 5, "card", "4111 1111 1111 1111"), (1, 3, "nhs", "943 476 5919"), (2, 1, "person-slug", "ann-lee"), (2, 1, "person-slug", "li-wu"),
    ]


def test_verdicts_meet_only_families_and_rows_that_they_name(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    found = registryops.verdict_list(cat)
    assert "lineitem" not in str(found._jdf.queryExecution().optimizedPlan().toString()) and "procedure_id" not in str(found._jdf.queryExecution().optimizedPlan().toString())
    all_of_them = cat["curation"].join(registryops.families(cat), ["record_type", "dedup_base"], "left").join(registryops.labelled_rows(cat), ["record_type", "record_id"], "left")
    want = all_of_them.selectExpr("record_type", "dedup_base", "record_id", "if(record_id > 0, row_label, label) AS label", "coalesce(if(record_id > 0, 1, family_size), 0) AS family_size", "if(record_id > 0, row_owner, owner) AS owner")
    assert sorted(map(repr, found.select(*want.columns).collect())) == sorted(map(repr, want.collect())) and found.count() > 20
    none = registryops.verdict_list(cat.with_tables(curation=cat["curation"].where("false")))
    assert none.count() == 0 and none.columns == found.columns


def test_one_brief_is_made_of_its_persons_rows(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    first = cat["appointment"].join(cat["person"].select("person_id"), "person_id").agg(F.min("appointment_id")).first()[0]
    one = render.briefs(cat, "2024-02-01", "2024-02-01", DICTIONARY, appointment=first)
    assert "EqualTo(user_id" in str(one._jdf.queryExecution().executedPlan().toString()) or "(user_id#" in str(one._jdf.queryExecution().optimizedPlan().toString())
    assert one.collect() == render.briefs(cat, "2024-02-01", "2024-02-01", DICTIONARY).where(F.col("appointment_id") == first).collect() and one.count() == 1
    assert render.briefs(cat, "2024-02-01", "2024-02-01", DICTIONARY, appointment=-1).count() == 0


def test_texts_are_dealt_to_tasks_before_files_are_made_of_them(spark, sf_dir):
    assert shuffles(registry.QUERIES["decoded_formats"](spark, sf_dir)) == 1


def test_problems_of_verdicts_shuffle_no_record_that_no_verdict_names(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    labs = cat["lab_result"].where("lab_result_id < 400").orderBy("lab_result_id").select("lab_result_id", "dedup_base", "person_id").collect()
    one, other = labs[0], next(x for x in labs if x["person_id"] != labs[0]["person_id"])
    verdicts = [
        ("lab_result", one[1], one[0], "merged-into", other[1]), ("lab_result", one[1], 0, "merged-into", "nowhere"), ("lab_result", "gone", 0, "superseded", None),
        ("lab_result", "moved", other[0], "confirmed", None), ("lab_result", one[1], 10**9, "confirmed", None), ("procedure", "gone", 0, "confirmed", None), ("odd", "gone", 3, "confirmed", None),
    ]
    made = spark.createDataFrame(verdicts, "record_type string, dedup_base string, record_id long, status string, merged_into_base string")
    cat = cat.with_tables(curation=bridge.whole(made, "curation"))
    found = registryops.curation_problems(cat)
    assert sorted(map(tuple, found.collect())) == sorted([
        ("merged across persons", "lab_result", one[0], one[1]), ("dangling-merge-target", "lab_result", 0, one[1]), ("no-live-family", "lab_result", 0, "gone"),
        ("row has moved", "lab_result", other[0], "moved"), ("row is gone", "lab_result", 10**9, one[1]), ("no-live-family", "procedure", 0, "gone"), ("unknown type", "odd", 3, "gone"),
    ])
    plan = str(found._jdf.queryExecution().optimizedPlan().toString())
    assert not any(f"{c}#" in plan for c in ("event_id", "l_orderkey", "o_orderkey"))


def test_doubled_keys_travel_as_bytes(spark):
    a, b = "ab" * 32, "0f" * 32
    held = [a] * 3 + [a.upper()] * 2 + [b] + ["x"] * 4 + ["", "", a + "0", None, None, bytes.fromhex("61" * 32).decode(), "61" * 32]
    found = registryops.doubled_keys(spark.createDataFrame([(k,) for k in held], "dedup_key string"))
    assert sorted(r["n"] for r in found.collect()) == [2, 2, 3, 4]
    sent = [x for x in str(found._jdf.queryExecution().executedPlan().toString()).splitlines() if "Exchange hashpartitioning(__digest" in x]
    assert sent and "__key" not in sent[0]


def test_postings_of_a_common_token_go_to_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "SLICE_POSTINGS", 100)
    index = SegmentedIndex(spark, f"{tmp_path}/index", tokens_per_shard=50)
    body = F.when(F.col("id") % 50 == 0, F.repeat(F.lit("proc and "), 40)).otherwise(F.concat(F.lit("proc the proc "), (F.col("id") % 3).cast("string")))
    rows = spark.range(1000).select(F.lit("t").alias("source_table"), F.col("id").alias("source_id"), F.col("id").alias("person_id"), F.lit(1).cast("long").alias("document_id"), body.alias("text"))

    def tasks():
        found = spark.read.parquet(f"{tmp_path}/index/postings").where("token = 'proc'").groupBy("segment", F.input_file_name()).count().groupBy("segment").count().orderBy("segment")
        return [r["count"] for r in found.collect()]

    index.apply(rows)
    assert tasks()[0] > 5
    index.apply(rows.where("source_id < 10").withColumn("text", F.lit("proc new")))
    index.merge(whole=True)
    assert tasks()[-1] > 5 and index.find("proc").count() == 1000 and index.find("new").count() == 10 and index.find("the_proc").count() == 971
    held = {r["source_id"]: tuple(r["positions"]) for r in spark.read.parquet(f"{tmp_path}/index/postings/segment={index.state()['segments'][0]['id']}").where("token = 'proc'").collect()}
    assert len(held) == 1000 and held[11] == (0, 2) and held[50] == tuple(range(0, 80, 2)) and held[3] == (0,)


def test_all_pages_of_a_document_are_decoded(spark, tmp_path):
    """Beyond the twentieth page too: two texts that differ there alone have different digests, as in the SQL."""
    texts = ["\n".join(f"page {k}" for k in range(25)), "\n".join(f"page {k}" for k in range(24)) + "\nother", "\n" * 30 + "last", "one", "", None]
    pq.write_table(pa.table({"doc_id": list(range(6)), "text": texts}), f"{tmp_path}/documents.parquet")
    got, want = against_sql(spark, tmp_path, "decoded_formats", "documents")
    assert got == want and len({r[-1] for r in got if r[1] == "pdf" and r[0] < 3} - {None}) == 3


def test_a_missing_program_is_looked_for_once(monkeypatch):
    asked = []
    monkeypatch.setattr("shutil.which", lambda name: asked.append(name))
    decoders.program.cache_clear()
    assert decoders.pdf_text(b"a\nb\nc", registry_sources.READER) == "a\fb\fc" and asked == ["tesseract"]
    decoders.program.cache_clear()


def test_dates_that_filters_ask_for_are_made_once(spark, sf_dir):
    lines = render.medication_lines(catalog(spark, sf_dir), registry.TODAY, 0, True, None, DICTIONARY)
    filters = [x for x in lines._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert filters and not any("o_orderdate" in x for x in filters)


def test_short_ways_of_names_and_dates_say_what_the_patterns_do(spark):
    odd = ["", " a", "A_b", "a__b", "a ( SP )", "hits", "VIEW_level", "a\u3000b", "\xa02024-01-05T10:00\x85", "2024-01-01\n x", "2024-02-30", "0000-01-01", "2024", "24", "2024-1-5", "\u00c9t\u00c9 x", "a\t b", "(x)", None]
    df = spark.createDataFrame([(v,) for v in odd], "v string")
    v = F.col("v")
    trimmed = F.regexp_replace(v, r"(?U)^\s+|\s+$", "")
    day = F.coalesce(F.split(F.replace(trimmed, F.lit("T"), F.lit(" ")), " ")[0], F.lit(""))
    full = F.when(day.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(day, "yyyy-MM-dd"))
    pairs = [
        (text.stripped(v), trimmed), (text.squeezed(v), F.trim(F.regexp_replace(v, r"(?U)\s+", " "))), (text.norm(v, DICTIONARY), text.identity(v, DICTIONARY)["canonical"]),
        (dates.date_only(v), day), (dates.full_date(v), full),
    ]
    assert df.where(~F.forall(F.array(*(a.eqNullSafe(b) for a, b in pairs)), lambda same: same)).count() == 0
    assert "gettimestamp" not in df.select(dates.full_date(v))._jdf.queryExecution().optimizedPlan().toString().lower()
