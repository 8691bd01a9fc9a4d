import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from anamnex.operators import diagnostics, ingest, piiscan
from anamnex.plans import catalog as snapshots
from anamnex.plans.catalog import Catalog
from anamnex.sources import decoders, dicom
from anamnex.specs import schema_of
from anamnex.streaming import ping


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_html():
    page = "<title>T</title><script>no()</script><p>a&amp;b <b>c</b><br>d</p><table><tr><td>1</td><td>x<p>y</p></td></tr><tr><td></td></tr></table><ul><li>i</ul>tail"
    assert decoders.html_text(page) == "T\na&b c\nd\n1\tx y\ni\ntail"


def test_docx_and_xlsx():
    w, s = decoders.WORD[1:-1], decoders.SHEET[1:-1]
    doc = f'<w:document xmlns:w="{w}"><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>world</w:t></w:r></w:p><w:p><w:t>two</w:t></w:p></w:document>'
    assert decoders.docx_text(archive(word__document_xml=doc)) == "Hello world\ntwo"
    shared = f'<sst xmlns="{s}"><si><t>alpha</t></si></sst>'

    def sheet(cells):
        return f'<worksheet xmlns="{s}"><sheetData><row>{cells}</row></sheetData></worksheet>'

    book = archive(xl__sharedStrings_xml=shared, xl__worksheets__sheet2_xml=sheet("<c><v>2</v></c>"), xl__worksheets__sheet10_xml=sheet("<c><v>10</v></c>"), xl__worksheets__sheet1_xml=sheet('<c t="s"><v>0</v></c><c t="s"><v>9</v></c><c t="inlineStr"><is><t>in</t></is></c>'))
    assert decoders.xlsx_text(book) == "alpha\t\tin\n2\n10"
    evil = f'<!DOCTYPE x [<!ENTITY a "b">]><w:document xmlns:w="{w}"/>'
    assert decoders.decode(".docx", archive(word__document_xml=evil))[2] == "word/document.xml: a DOCTYPE is not allowed"
    assert decoders.decode(".docx", b"no zip")[0] is None


def test_zip_budget(monkeypatch):
    with pytest.raises(decoders.DecodeError):
        decoders.Members(archive(a="x" * 100), budget=50).read("a")


def test_clinical_document():
    xml = """<?xml version="1.0"?><ClinicalDocument xmlns="urn:hl7-org:v3"><recordTarget><patientRole><patient><name><given>Jane</given><given>A</given><family>Doe</family></name><birthTime value="19620314"/></patient></patientRole></recordTarget>
    <component><structuredBody><component><section><title>Meds</title><text>intro<table><thead><tr><th>Name</th><th>Dose</th></tr></thead><tbody><tr><td>A</td><td>5 mg</td></tr></tbody></table>after<paragraph>One <content>two</content></paragraph><list><item>i</item></list><renderMultiMedia>img</renderMultiMedia></text></section></component></structuredBody></component></ClinicalDocument>"""
    assert decoders.clinical_text(xml.encode()).split("\n") == ["Patient: Jane A Doe", "DOB: 1962-03-14", "", "Meds", "intro", "Name\tDose", "A\t5 mg", "after", "One two", "i"]
    assert decoders.clinical_text(b"<x/>") is None
    assert [decoders.timestamp_text(v) for v in ("199805", "1998", "x", None)] == ["1998-05", "1998", None, None]


def test_pointers_and_routes():
    assert decoders.is_pointer(".gdoc", b'{"url": "https://docs.google.com/x"}')
    assert decoders.is_pointer(".gsheet", b'{"doc_id": "a", "email": "b"}') and not decoders.is_pointer(".gdoc", b"[]") and not decoders.is_pointer(".txt", b"{}")
    assert decoders.decode(".txt", b"\xef\xbb\xbfa\xff")[0] == "a�" and decoders.decode(".png", b"x")[1] == "ocr" and decoders.decode(".zzz", b"x") == (None, "none", None)


def element(group, number, form, value):
    value = value.encode() + b" " * (len(value) % 2)
    head = struct.pack("<HH", group, number) + form
    return head + (struct.pack("<HI", 0, len(value)) if form in dicom.LONG_FORMS else struct.pack("<H", len(value))) + value


def slice_bytes(description="AXIAL", syntax=dicom.EXPLICIT):
    meta = element(2, 0x10, b"UI", syntax)
    body = element(8, 0x20, b"DA", "20240105") + element(8, 0x60, b"CS", "MR") + element(8, 0x103E, b"LO", description) + element(0x10, 0x10, b"PN", "DOE^JANE") + element(0x7FE0, 0x10, b"OW", "pixels")
    return b"\0" * 128 + b"DICM" + struct.pack("<HH2sHI", 2, 0, b"UL", 4, len(meta)) + meta + body


def test_studies(spark, tmp_path):
    for k, (d, text) in enumerate([("s1", "AXIAL"), ("s1", "AXIAL"), ("s2", "SAG")]):
        (tmp_path / d).mkdir(exist_ok=True)
        (tmp_path / d / f"{k}.dcm").write_bytes(slice_bytes(text))
    (tmp_path / "note.txt").write_bytes(b"no slice")
    rows = dicom.slices(decoders.files(spark, str(tmp_path))).withColumn("study", F.lit("brain"))
    assert rows.count() == 3
    study = dicom.studies(rows)
    r = study.select("*", dicom.summary_text(F.col("study"), F.lit(4)).alias("text"), dicom.identity_text().alias("who")).first()
    assert (r["slices"], len(r["series"]), r["study_date"], r["modality"]) == (3, 2, "2024-01-05", "MR")
    assert "slices: 3 in 2 series" in r["text"] and "  - SAG - 1 slices" in r["text"] and r["who"] == "Patient: DOE^JANE"
    assert dicom.tags_of(slice_bytes(syntax="1.2.840.10008.1.2.2")) == {} and dicom.tags_of(b"short") == {}


def test_human_bytes(spark):
    got = [spark.range(1).select(dicom.human_bytes(F.lit(n)).alias("x")).first()["x"] for n in (5, 2048, 3 << 20, 5 << 30)]
    assert got == ["5 B", "2.0 KiB", "3.0 MiB", "5.0 GiB"]


PINGS = """2026-07-16 09:00:00.000  Reply from 1.1.1.1: bytes=32 time=12ms TTL=5
2026-07-16 09:00:01.000  Request timed out.
2026-07-16 09:00:02.000  Destination host unreachable.
2026-07-16 09:00:02.500  ### STALL MARKER ### froze
2026-07-16 09:00:03.000  Reply from 1.1.1.1: time<1ms
noise
2026-07-16 09:05:00.000  Reply: time=40ms""".split("\n")


def test_ping_log(spark):
    df = diagnostics.ping_lines(spark.createDataFrame([(x,) for x in PINGS], "value string"))
    samples = df.where("NOT marker")
    s = diagnostics.ping_summary(samples).first()
    assert (s["samples"], s["lost"], s["loss_pct"], s["median_ms"], s["p99_ms"]) == (5, 2, 40.0, 12.0, 40.0)
    assert [r["losses"] for r in diagnostics.loss_bursts(samples).collect()] == [2]
    markers = df.where("marker").select(F.lit(1).alias("marker_id"), F.col("ts").alias("marker_ts"), "note")
    w = diagnostics.stall_windows(markers, samples.select("ts", "ms", "lost")).first()
    assert (w["note"], w["samples"], w["lost"], w["max_ms"]) == ("froze", 4, 2, 12.0)
    assert [r["ms"] for r in diagnostics.worst(samples, limit=2).collect()] == [40.0, 12.0]
    assert "Packet loss 2 / 5" in diagnostics.report(diagnostics.ping_summary(samples), diagnostics.loss_bursts(samples))


def test_counters(spark):
    name = "\\\\HOST\\PhysicalDisk(_Total)\\Avg. Disk sec/Read"
    wide = spark.createDataFrame([("07/16/2026 09:00:00.000", "0.01", "5"), ("07/16/2026 09:00:01.000", "0.09", " "), ("bad", "x", "7")], ["(PDH-CSV 4.0)", name, "\\\\HOST\\Process(app)\\% Processor Time"])
    stats = diagnostics.counter_stats(diagnostics.unpivoted_counters(wide))
    assert [r["p99"] for r in diagnostics.red_flags(stats).collect()] == [0.09]
    assert [r["n"] for r in diagnostics.top_processes(stats).collect()] == [2]


def test_ping_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(PINGS))
    q = ping.to_parquet(ping.ping_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_line_scan(spark):
    lines = ["ssn 123-45-6789", "card 4111 1111 1111 1111", "NHS number: 943 476 5919", "NHS: 943 476 5918", "DOB: 03/14/1962", "DOB: 05/05/1985", "--person melanie-ashworth", "--person jane-doe", "repro (gregory-fielding)", "src/gregory-fielding", "Gregory Ashworth", "Robert Alan Roe", "MRN: 12345 pii-allow", "MRN: 12345", "Patient: ASHWORTH, MEL"]
    docs = spark.createDataFrame([(1, "\r\n".join(lines)), (2, None), (3, "Gregory Ashworth")], "doc_id long, text string")
    names = spark.createDataFrame([("Melanie",), ("gregory",), ("robert ",), (None,)], "name string")
    got = {(r["line"], r["rule"]) for r in piiscan.scan(docs, names).collect() if r["doc_id"] == 1}
    assert got == {(1, "ssn"), (2, "card"), (3, "nhs"), (6, "dob"), (7, "person-slug"), (7, "bare-slug"), (9, "bare-slug"), (11, "full-name"), (14, "mrn"), (15, "patient-name")}
    assert piiscan.scan(docs, names).where("doc_id = 3").count() == 0
    diff = spark.createDataFrame([(1, "--- a/x\n+++ b/x\n-MRN: 1111\n+MRN: 2222\n MRN: 3333")], "doc_id long, text string")
    added = piiscan.added_lines(diff)
    assert [(r["file"], r["content"]) for r in added.collect()] == [("x", "MRN: 2222")] and piiscan.scan_lines(added.drop("file"), names).count() == 1


def roster(spark):
    rows = [(1, "jane-doe", "Jane Q Doe", "1962-03-14"), (2, "bob-roe", "Bob Roe", None)]
    schema = schema_of("person")
    return spark.createDataFrame([tuple(dict(zip(("person_id", "slug", "full_name", "dob"), r)).get(f.name) for f in schema) for r in rows], schema)


def test_owner_checks(spark):
    texts = ["Report for DOE, jane", "born 3/14/1962", "born 3/14/19620", "Patient: somebody else", "plain prose", None, "Bob and Roe met", "janet does"]
    docs = spark.createDataFrame([(k, 1, t) for k, t in enumerate(texts)], "document_id long, person_id long, text string")
    got = {r["document_id"]: (r["verdict"], r["matched_slug"]) for r in ingest.owner_checks(docs, roster(spark)).collect()}
    assert got == {0: ("match", "jane-doe"), 1: ("match", "jane-doe"), 2: ("unverified", None), 3: ("suspect", None), 4: ("unverified", None), 5: ("unverified", None), 6: ("mismatch", "bob-roe"), 7: ("unverified", None)}
    other = {r["document_id"]: r["verdict"] for r in ingest.owner_checks(docs.withColumn("person_id", F.lit(2)), roster(spark)).collect()}
    assert other[0] == "mismatch" and other[1] == "mismatch"


def test_ingest(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Jane Doe visit")
    (tmp_path / "b.txt").write_text("Jane Doe visit")
    (tmp_path / "c.html").write_text("<p>Patient: Bob Roe</p>")
    (tmp_path / "d.gdoc").write_text('{"url": "https://docs.google.com/d"}')
    cat = Catalog(spark, {"person": roster(spark)})
    files = decoders.with_text(decoders.files(spark, str(tmp_path)))
    done, report = ingest.ingest(cat, files, "jane-doe")
    got = {r["path"][-5:]: r["status"] for r in report.collect()}
    assert got == {"a.txt": "new", "b.txt": "duplicate", ".html": "suspect", ".gdoc": "pointer"} or got[".html"] == "mismatch"
    assert [r["ocr_text"] for r in done["document"].collect()] == ["Jane Doe visit"]
    new = spark.createDataFrame([(done["document"].first()["sha256"], "Jane", "native", None)], "sha256 string, text string, route string, error string")
    assert ingest.reextracted(done, new)[1].first()["status"] == "present"
    assert ingest.reextracted(done, new, force=True)[1].first()["status"] == "shrunk"
    assert ingest.reextracted(done, new, force=True, allow_shrink=True)[0]["document"].first()["ocr_text"] == "Jane"


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "store")
    cat = Catalog(spark, {"person": roster(spark)})
    assert not snapshots.exists(spark, root)
    snapshots.snapshot(cat, root, "anamnex-20260101-0900")
    snapshots.snapshot(cat.with_tables(person=roster(spark).where("person_id = 1")), root, "anamnex-20260102-0900")
    assert snapshots.load(spark, root)["person"].count() == 1
    with pytest.raises(snapshots.SnapshotError):
        snapshots.snapshot(cat, root, "anamnex-20260101-0900")
    assert snapshots.resolve(spark, root, "latest") == "anamnex-20260102-0900"
    assert snapshots.restore(spark, root, "anamnex-20260101-0900") and snapshots.load(spark, root)["person"].count() == 2
    assert snapshots.integrity(spark, root, "anamnex-20260101-0900") == "ok"
    assert snapshots.rotate(spark, root, keep_daily=1, keep_weekly=0) == []  # the current one stays
    snapshots.restore(spark, root, "latest")
    assert snapshots.rotate(spark, root, keep_daily=1, keep_weekly=0) == ["anamnex-20260101-0900"] and snapshots.integrity(spark, root, "anamnex-20260102-0900") == "ok"
    assert "no manifest" in snapshots.integrity(spark, root, "anamnex-20260101-0900")


def test_retention(spark):
    import datetime as dt

    days = [dt.datetime(2026, 1, d, h) for d in range(1, 29) for h in (8, 20)]
    df = spark.createDataFrame([(f"s{k}", t) for k, t in enumerate(days)], "name string, ts timestamp")
    kept = {r["ts"] for r in snapshots.retained(df, 7, 2).where("keep").collect()}
    left = [t for t in days if not (t.hour == 20 and t.day > 21)]
    newest: dict = {}
    for t in left:
        newest[t.isocalendar()[:2]] = t
    assert kept == {t for t in days if t.hour == 20 and t.day > 21} | set(sorted(newest.values())[-2:])


def test_old_tables_are_migrated(spark):
    old = spark.createDataFrame([(1, 1, "A", "k")], "medication_id long, person_id long, name string, dedup_key string")
    cat = Catalog(spark, {"medication": old})
    assert snapshots.pending(cat) == ["medication"]
    r = snapshots.migrate(cat)["medication"].first()
    assert (r["dedup_base"], r["dedup_occurrence"], r["status_reason"]) == ("k", 0, None)


def test_owner_check_meets_dates_that_letters_touch(spark):
    people = spark.createDataFrame([(1, "ann-one", "Ann One", "1970-02-03"), (2, "bob-two", "Bob Two", "1950-01-15"), (3, "cy-three", "Cy Three", None)], "person_id long, slug string, full_name string, dob string")
    texts = ["Patient DOB1950-01-15", "bornJanuary 15, 1950x", "dob: 01/15/1950", "id 91950-01-15", "1950-01-150", "DOB1970-02-03"]
    docs = spark.createDataFrame([(k, 1, t) for k, t in enumerate(texts)], "document_id long, person_id long, text string")
    got = {r["document_id"]: (r["verdict"], r["matched_slug"]) for r in ingest.owner_checks(docs, people).collect()}
    assert got == {0: ("mismatch", "bob-two"), 1: ("mismatch", "bob-two"), 2: ("mismatch", "bob-two"), 3: ("unverified", None), 4: ("unverified", None), 5: ("match", "ann-one")}


def test_damaged_documents_are_rows_with_an_error(spark):
    """Whatever a decoder raises concerns its own row; all others are decoded."""
    import io
    import zipfile

    def book(**members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in members.items():
                z.writestr(name.replace("__", "/") + ".xml", text)
        return out.getvalue()

    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c t="s"><v>{}</v></c><c><v>7</v></c></row></sheetData></worksheet>'
    odd = [sheet.format(v) for v in ("\u00b2", "99999999999999999999", "-1", "", "1")]
    rows = [(k, ".xlsx", book(xl__worksheets__sheet1=x)) for k, x in enumerate(odd)]
    rows += [(10, ".docx", book(word__document='<?xml version="1.0" encoding="no-such"?><a/>')), (11, ".docx", b"PK"), (12, ".html", b"a<![foo bar]>b"), (13, ".xml", b'<?xml version="1.0" encoding="no-such"?><ClinicalDocument xmlns="urn:hl7-org:v3"/>'), (14, ".docx", book(word__document="<a>")), (15, ".txt", b"fine"), (16, None, b"x"), (17, ".txt", None)]
    df = spark.createDataFrame(rows, "id int, suffix string, content binary").withColumn("length", F.length("content"))
    got = {r["id"]: r for r in decoders.with_text(df).collect()}
    assert [got[k]["text"] for k in range(5)] == ["\t7"] * 5 and got[15]["text"] == "fine"
    assert all(got[k]["text"] is None and got[k]["error"] for k in (10, 11, 12, 14)) and got[13]["text"].startswith("<?xml")
    pages = spark.createDataFrame([(1, "<p>a</p>"), (2, "a<![foo bar]>b"), (3, None)], "id int, html string")
    texts = {r["id"]: r for r in pages.select("id", decoders.html_to_text("html").alias("t"), decoders.page_decoded("html")["error"].alias("e")).collect()}
    assert (texts[1]["t"], texts[1]["e"], texts[2]["t"], texts[3]["t"]) == ("a", None, None, None) and texts[2]["e"]


def test_owner_checks_meet_few_rows(spark):
    """Birth dates are met whole, in every spelling, and two of those who share one are enough."""
    people = spark.range(1, 3001).select(F.col("id").alias("person_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("slug"), F.concat(F.lit("Common Name"), F.col("id").cast("string")).alias("full_name"), F.expr("CAST(DATE'1950-01-01' + CAST(id % 365 AS INT) AS STRING)").alias("dob"))
    people = people.unionByName(spark.createDataFrame([(9001, "same-a", "Twin Person", "1950-03-05"), (9002, "same-b", "Twin Person", "1950-03-05")], people.schema))
    texts = ["born 1950-03-05", "born 03/05/1950.", "3/5/1950", "03-05-1950", "MARCH 5, 1950", "5 March 1950", "Mar 5, 1950", "DOB5 Mar 1950x", "13/5/1950", "1950-03-055", "in 1950, on the 5th of March", "a Twin of this person", "12-03-05-1950-03-05"]
    docs = spark.createDataFrame([(k, 9001, t) for k, t in enumerate(texts)], "document_id long, person_id long, text string")
    rest = docs.select("document_id", F.lit(1).cast("long").alias("claimed"), "text", ingest.alnum(F.col("text")).alias("plain"))
    roster = people.select("person_id", "slug", ingest.name_tokens(F.col("full_name")).alias("tokens"), ingest.dob_renderings(F.col("dob")).alias("dobs"))
    met = ingest.born_others(rest, roster)
    assert {r[0] for r in met.select("document_id").collect()} == {0, 1, 2, 3, 4, 5, 6, 7, 12} and met.groupBy("document_id").count().agg(F.max("count")).first()[0] <= 4
    assert {r[0] for r in ingest.named_others(rest, roster).select("slug").collect()} == {"same-a", "same-b"}
    got = {r["document_id"]: r["verdict"] for r in ingest.owner_checks(docs, people).collect()}
    assert all(got[k] == "match" for k in (0, 1, 2, 3, 4, 5, 6, 7, 11, 12)) and got[8] != "match"


READER = """
class Reader:
    def pages(self, data):
        if data == b"broken":
            raise OSError("can't read")
        return [None if p == "-" else p for p in data.decode().split("|")]

    def image(self, data, page, dpi):
        return b"image %d at %d" % (page, dpi)

reader = Reader()
"""


def test_pdf_pages(monkeypatch, tmp_path):
    """Text layers, images of pages without one, the first twenty pages, files that can't be read, and no reader."""
    (tmp_path / "own_pdf_reader.py").write_text(READER)
    monkeypatch.syspath_prepend(str(tmp_path))
    name, asked = "own_pdf_reader:reader", []
    monkeypatch.setattr(decoders, "recognised", lambda suffix, data: asked.append(data) or (None if b"image 2" in data else "seen on the image"))
    layer = "a text layer of more than twenty characters"
    assert decoders.decode(".PDF", f"{layer}|short|-".encode(), name) == (f"{layer}\fseen on the image\f", "ocr", None)
    assert asked == [b"image 1 at 300", b"image 2 at 300"]
    assert decoders.pdf_text("|".join([layer] * 25).encode(), name).count("\f") == 19 and decoders.pdf_page_count("|".join(["x"] * 25).encode(), name) == 25
    monkeypatch.setattr(decoders, "recognised", lambda suffix, data: None)
    assert decoders.decode(".pdf", b"-|-", name) == (None, "ocr", None)
    assert decoders.decode(".pdf", b"broken", name) == (None, "ocr", "OSError: can't read") and decoders.pdf_page_count(b"broken", name) is None
    assert decoders.decode(".pdf", b"x") == (None, "ocr", "no reader for PDF files is set") and decoders.pdf_page_count(b"x", None) is None
