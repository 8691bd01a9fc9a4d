import io
import json

import pytest

from anamnex.plans import catalog as snapshots
from anamnex.plans.catalog import Catalog
from anamnex.server import Server
from anamnex.specs import TABLES, TYPES, schema_of


@pytest.fixture
def server(spark):
    held = {"cat": Catalog(spark, {n: spark.createDataFrame([], schema_of(n)) for n in (*TYPES, *TABLES)}), "n": 0}

    def keep(cat):
        held["cat"] = Catalog(spark, {n: spark.createDataFrame(df.collect(), df.schema) for n, df in cat.tables.items()})
        held["n"] += 1
        return f"s{held['n']}"

    return Server(spark, lambda: held["cat"], keep, today="2024-02-01")


def ask(server, name, **arguments):
    r = server.answer({"jsonrpc": "2.0", "id": 7, "method": "tools/call", "params": {"name": name, "arguments": arguments}})["result"]
    return r["isError"], (r["content"][0]["text"] if r["isError"] else json.loads(r["content"][0]["text"]))


def test_protocol(server):
    lines = ['{"jsonrpc":"2.0","id":1,"method":"initialize"}', "", '{"jsonrpc":"2.0","method":"notifications/initialized"}', '{"jsonrpc":"2.0","id":2,"method":"tools/list"}', "not json", "[]", '{"jsonrpc":"2.0","id":3,"method":"odd"}', '{"jsonrpc":"2.0","id":4,"method":"ping"}']
    out = io.StringIO()
    server.serve(lines, out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r.get("id") for r in replies] == [1, 2, None, None, 3, 4]
    tools = {t["name"]: t for t in replies[1]["result"]["tools"]}
    assert len(tools) == 15 and sum(t["annotations"]["readOnlyHint"] for t in tools.values()) == 9
    assert tools["trends"]["inputSchema"]["required"] == ["person", "test"]
    assert [r["error"]["code"] for r in replies if "error" in r] == [-32700, -32600, -32601]


def test_tools(server, tmp_path):
    assert ask(server, "person_add", slug="Jane", full_name="Jane Doe") == (False, {"result": {"person_id": 1, "slug": "jane", "full_name": "Jane Doe"}, "snapshot": "s1"})
    assert ask(server, "person_add", slug="jane", full_name="x")[0] and ask(server, "person_show", slug="nobody")[0] and ask(server, "trends", person="jane")[0] and ask(server, "odd")[0]
    assert ask(server, "person_edit", slug="jane", notes="n")[1]["result"]["notes"] == "n"
    (tmp_path / "a.txt").write_text("Jane Doe was seen")
    error, found = ask(server, "ingest_document", file=str(tmp_path / "a.txt"), person="jane")
    assert not error and [r["status"] for r in found["result"]] == ["new"]
    assert ask(server, "ingest_document", file=str(tmp_path / "a.txt"), person="jane")[1][0]["status"] == "duplicate"
    lab = {"test_name": "Glucose", "value_num": 90, "unit": "mg/dL", "collected_at": "2024-01-01"}
    error, found = ask(server, "commit_extraction", document_id=1, records={"lab_result": [lab]})
    assert not error and found["result"]["lab_result"] == {"new": 1, "duplicate": 0, "enriched": 0, "conflict": 0}
    error, found = ask(server, "commit_extraction", document_id=1, records={"lab_result": [lab | {"value_num": 95}]})
    assert found["result"]["lab_result"]["conflict"] == 1
    assert ask(server, "commit_extraction", document_id=1, records={"lab_result": [{"value_num": 1}]})[0] and ask(server, "commit_extraction", document_id=9, records={})[0]
    conflict = ask(server, "review_conflicts")[1][0]["conflict_id"]
    assert ask(server, "review_conflicts", resolve=conflict, keep="merge", fields={"value_num": "incoming"})[0]  # no sign-off
    error, found = ask(server, "review_conflicts", resolve=conflict, keep="merge", signoff="me", fields={"value_num": "incoming"})
    assert not error and found["result"]["kept"] == "merge"
    assert ask(server, "review_conflicts")[1] == [] and len(ask(server, "review_conflicts", all=True)[1]) == 1
    assert [r["value_num"] for r in ask(server, "query", kind="labs", person="jane")[1]] == [95.0] and ask(server, "query", kind="odd", person="jane")[0]
    assert ask(server, "trends", person="jane", test="glucose")[1]["latest"] == 95.0
    assert ask(server, "find", query_text="seen")[1][0]["source_table"] == "document"
    assert ask(server, "document_set_text", document_id=1, text="x")[0]  # has a text
    assert "Jane Doe" in ask(server, "render_summary", person="jane")[1]["markdown"] and ask(server, "render_brief", appointment=1)[0]
    assert ask(server, "render_curation", person="jane")[1] == {"markdown": ""} and "Glucose" in ask(server, "render_journal", person="jane")[1]["markdown"]
    assert snapshots.SCHEMA_VERSION
