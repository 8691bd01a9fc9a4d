"""Tools over a snapshot store, for programs: JSON-RPC 2.0, a message a line, on standard input and output.

python -m anamnex.server --store DIR [--dictionary FILE]

Methods: initialize, ping, tools/list and tools/call. Tools that read answer with JSON rows; the person's verdicts are
shown beside rows and hide nothing. Tools that write make a new snapshot, and say which. Errors of a call are results
that are marked so; errors of the protocol are errors of the message.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import load_dictionary
from .operators import clinical, commit, ingest, overlay, registryops, render, search
from .plans import catalog as snapshots
from .sources import decoders
from .specs import FIELDS

PROTOCOL = "2024-11-05"


class CallError(ValueError):
    """A call that can't be done as asked."""


@dataclass(frozen=True)
class Tool:
    run: Callable
    says: str
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    writes: bool = False

    def schema(self, name: str) -> dict:
        flags = {"active", "force", "all", "adopt_source", "include_self_reported", "allow_large"}
        kinds = {"document_id": "integer", "resolve": "integer", "appointment": "integer", "records": "object", "fields": "object"}
        properties = {n: {"type": "boolean" if n in flags else kinds.get(n, "string")} for n in (*self.required, *self.optional)}
        return {"name": name, "description": self.says, "inputSchema": {"type": "object", "properties": properties, "required": list(self.required)}, "annotations": {"readOnlyHint": not self.writes}}


def rows(df: DataFrame) -> list[dict]:
    return [json.loads(line) for line in df.toJSON().collect()]  # one person's listing


class Server:
    def __init__(self, spark: SparkSession, load: Callable, store: Callable, dictionary: str | None = None, today: dt.date | str | None = None):
        """load() gives the catalog, store(catalog) keeps a new one and names it."""
        self.spark, self.load, self.store = spark, load, store
        self.words, self.today = load_dictionary(dictionary), str(today or dt.date.today())
        self.tools = {
            "query": Tool(self.query, "Labs, medications or the timeline of a person.", ("kind", "person"), ("test", "since", "active")),
            "find": Tool(self.find, "Full-text search.", ("query_text",), ("person",)),
            "trends": Tool(self.trends, "Statistics of one measurement of a person.", ("person", "test")),
            "person_list": Tool(self.person_list, "All active persons."),
            "person_show": Tool(self.person_show, "One person.", ("slug",)),
            "render_summary": Tool(self.render_summary, "The summary of a person.", ("person",)),
            "render_brief": Tool(self.render_brief, "The brief of an appointment.", ("appointment",), ("include_self_reported",)),
            "render_journal": Tool(self.render_journal, "The journal of a person.", ("person",), ("since", "include_self_reported")),
            "render_curation": Tool(self.render_curation, "The curation record of a person.", ("person",)),
            "person_add": Tool(self.person_add, "Add a person.", ("slug", "full_name"), ("dob", "sex", "blood_type", "notes"), True),
            "person_edit": Tool(self.person_edit, "Change a person.", ("slug",), ("full_name", "dob", "sex", "blood_type", "notes"), True),
            "ingest_document": Tool(self.ingest_document, "Admit a file or a folder of files.", ("file", "person"), ("doc_date", "category", "provider", "force"), True),
            "document_set_text": Tool(self.document_set_text, "Give a document without text one.", ("document_id", "text"), (), True),
            "commit_extraction": Tool(self.commit_extraction, "Admit extracted records of a document.", ("document_id", "records"), (), True),
            "review_conflicts": Tool(self.review_conflicts, "List open conflicts, or settle one with a sign-off.", (), ("resolve", "keep", "signoff", "note", "fields", "adopt_source", "all"), True),
        }

    # --- reading

    def query(self, cat, kind: str, person: str, test: str | None = None, since: str | None = None, active: bool = False) -> list[dict]:
        d = self.words["synonyms"]
        if kind == "labs":
            df = overlay.with_verdict(clinical.labs(cat, person, test, since, d), cat, "lab_result")
        elif kind == "meds":
            df = overlay.with_verdict(clinical.medications(cat, person, active, self.today), cat, "medication")
        elif kind == "timeline":
            df = overlay.with_verdict(clinical.timeline(cat, person, since), cat).drop("src", "record_id")
        else:
            raise CallError(f"kind is labs, meds or timeline, not {kind!r}")
        return rows(clinical.public(df))

    def find(self, cat, query_text: str, person: str | None = None) -> list[dict]:
        return rows(search.find(cat, query_text, person).drop("text"))

    def trends(self, cat, person: str, test: str) -> dict:
        return rows(clinical.trends(cat, test, person, self.words["synonyms"]))[0]

    def person_list(self, cat) -> list[dict]:
        return rows(registryops.people(cat))

    def person_show(self, cat, slug: str) -> dict:
        return rows(registryops.person_detail(cat, slug))[0]

    def _text(self, cat, frame: DataFrame, person: str) -> dict:
        return {"markdown": render.person_text(frame, cat, person)}

    def render_summary(self, cat, person: str) -> dict:
        w = self.words
        return self._text(cat, render.summaries(cat, self.today, self.today, w["synonyms"], w["routine"], w["medication_display"]), person)

    def render_journal(self, cat, person: str, since: str | None = None, include_self_reported: bool = False) -> dict:
        return self._text(cat, render.journals(cat, self.today, since, include_self_reported), person)

    def render_curation(self, cat, person: str) -> dict:
        return self._text(cat, render.curations(cat, self.today), person)

    def render_brief(self, cat, appointment: int, include_self_reported: bool = False) -> dict:
        w = self.words
        found = render.briefs(cat, self.today, self.today, w["synonyms"], int(appointment), overrides=w["medication_display"], self_reported=include_self_reported)
        row = found.head()
        if row is None:
            raise CallError(f"no appointment {appointment}")
        return {"markdown": row["text"]}

    # --- writing: (new catalog or None, answer)

    def person_add(self, cat, slug: str, full_name: str, **more):
        new = registryops.add_person(cat, slug, full_name, **more)
        return new, rows(new["person"].where(F.col("slug") == slug.strip().lower()))[0]

    def person_edit(self, cat, slug: str, **changes):
        new = registryops.edit_person(cat, slug, **changes)
        return new, rows(new["person"].where(F.lower("slug") == slug.strip().lower()))[0]

    def ingest_document(self, cat, file: str, person: str, force: bool = False, doc_date: str | None = None, **more):
        found = decoders.with_text(decoders.files(self.spark, file))
        new, report = ingest.ingest(cat, found, person, force=force, doc_date=doc_date, **more)
        said = rows(report)
        return new if any(r["status"] == "new" for r in said) else None, said

    def document_set_text(self, cat, document_id: int, text: str):
        return registryops.set_text(cat, int(document_id), text), {"document_id": int(document_id), "chars": len(text)}

    def commit_extraction(self, cat, document_id: int, records: dict):
        who = cat["document"].where(F.col("document_id") == int(document_id)).select("person_id").head()
        if who is None or who[0] is None:
            raise CallError(f"document {document_id} is not there or belongs to nobody")
        answer = {}
        for record_type, given in sorted(records.items()):
            if record_type not in FIELDS:
                raise CallError(f"unknown record type {record_type!r}")
            raw = self.spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(given)], "pos long, json string")
            parsed = commit.parsed(raw, record_type)
            if bad := parsed.where(F.size("errors") > 0).select("pos", "errors").orderBy("pos").head():
                raise CallError(f"row {bad['pos']}: {bad['errors'][0]}")
            payload = parsed.select("pos", F.lit(who[0]).cast("long").alias("person_id"), F.lit(int(document_id)).cast("long").alias("document_id"), *FIELDS[record_type])
            cat, found = commit.commit(cat, record_type, payload, self.words["synonyms"])
            answer[record_type] = {k: v for k, v in commit.outcome_counts(found).first().asDict().items() if k != "promoted"}
        return cat, answer

    def review_conflicts(self, cat, resolve: int | None = None, keep: str | None = None, signoff: str | None = None, note: str | None = None, fields: dict | None = None, adopt_source: bool = False, all: bool = False):
        if resolve is None:
            df = cat["conflict"] if all else cat["conflict"].where("status = 'open'")
            return None, rows(df.orderBy("conflict_id"))
        if not (signoff or "").strip():
            raise CallError("a resolution needs the words of whoever signs it off")
        text = f"{note}; signed off: {signoff.strip()}" if note else f"signed off: {signoff.strip()}"
        return commit.resolve(cat, int(resolve), keep or "", text, self.words["synonyms"], fields, adopt_source)

    # --- protocol

    def call(self, name: str, arguments: dict) -> dict:
        tool = self.tools.get(name)
        try:
            if tool is None:
                raise CallError(f"unknown tool {name!r}")
            if missing := [n for n in tool.required if n not in arguments]:
                raise CallError(f"missing: {', '.join(missing)}")
            if unknown := sorted(set(arguments) - {*tool.required, *tool.optional}):
                raise CallError(f"unknown: {', '.join(unknown)}")
            found = tool.run(self.load(), **{k: v for k, v in arguments.items() if v is not None})
            if tool.writes:
                new, found = found
                if new is not None:
                    found = {"result": found, "snapshot": self.store(new)}
        except (LookupError, ValueError) as error:
            return {"content": [{"type": "text", "text": f"{type(error).__name__}: {error}"}], "isError": True}
        return {"content": [{"type": "text", "text": json.dumps(found, ensure_ascii=False, default=str)}], "isError": False}

    def answer(self, message: dict) -> dict | None:
        """The reply to a message; none to notifications."""
        if "id" not in message:
            return None
        method, params = message.get("method"), message.get("params") or {}
        if method == "initialize":
            result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "anamnex", "version": "1"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [t.schema(n) for n, t in self.tools.items()]}
        elif method == "tools/call" and isinstance(params.get("name"), str):
            result = self.call(params["name"], params.get("arguments") or {})
        else:
            return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32601, "message": f"unknown method {method!r}"}}
        return {"jsonrpc": "2.0", "id": message["id"], "result": result}

    def serve(self, lines, out) -> None:
        for line in lines:
            if not line.strip():
                continue
            try:
                message = json.loads(line)
                reply = self.answer(message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a message"}}
            except json.JSONDecodeError as error:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(error)}}
            if reply is not None:
                out.write(json.dumps(reply, ensure_ascii=False) + "\n")
                out.flush()


def over_store(spark: SparkSession, root: str, dictionary: str | None = None, today=None) -> Server:
    def keep(cat) -> str:
        name = snapshots.snapshot_name(dt.datetime.now())
        snapshots.snapshot(cat, root, name)
        return name

    return Server(spark, lambda: snapshots.load(spark, root), keep, dictionary, today)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="anamnex-server")
    p.add_argument("--store", required=True)
    p.add_argument("--dictionary")
    a = p.parse_args(argv)
    over_store(SparkSession.builder.appName("anamnex").getOrCreate(), a.store, a.dictionary).serve(sys.stdin, sys.stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main())
