"""Readers and writers on small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyhawk.sources import readers as R
from tallyhawk.sources import sinks


def put(tmp_path, name: str, text: str) -> str:
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_jsonl_and_completeness(spark, tmp_path):
    df = R.read_jsonl(spark, put(tmp_path, "a.jsonl", '{"a":1}\nnope\n\n{"b":2}\n'))
    assert [r["bad"] for r in df.collect()] == [False, True, False]
    s = R.input_completeness(df).first()
    assert (s["examined"], s["malformed"], s["status"]) == (3, 1, "incomplete")


@pytest.mark.parametrize("text,n,partial", [('[{"a":1},{"a":2}]', 2, False), ('{"value":[{"a":1}],"@odata.nextLink":"x"}', 1, True), ('{"a":1}\n{"a":2}', 2, False), ('{"a":1}', 1, False)])
def test_envelopes(spark, tmp_path, text, n, partial):
    got = R.read_json_envelope(spark, put(tmp_path, "a.json", text)).collect()
    assert len(got) == n and got[0]["partial"] is partial


def test_csv(spark, tmp_path):
    df = R.read_csv(spark, put(tmp_path, "a.csv", 'a,b\n1,"x, y"\n,\n3\n'))
    assert [tuple(r) for r in df.collect()][0] == ("1", "x, y")


def test_access_log(spark, tmp_path):
    line = '1.2.3.4 - bob [01/May/2024:10:00:00 +0000] "POST /v1/x HTTP/1.1" 200 12 "-" "curl/8 host=evil" host=api.openai.com'
    a, b = R.read_access_log(spark, put(tmp_path, "a.log", line + "\njunk\n")).collect()
    assert (a["user"], a["method"], a["host"], a["status"], a["bad"]) == ("bob", "POST", "api.openai.com", "200", False) and b["bad"]


def test_logfmt(spark, tmp_path):
    got = R.read_logfmt(spark, put(tmp_path, "a.log", 'a=1 b="x y"\na=1 a=2\na="open\n')).collect()
    assert got[0]["fields"] == {"a": "1", "b": "x y"} and [r["bad"] for r in got] == [False, True, True]


def test_zeek(spark, tmp_path):
    got = R.read_zeek(spark, put(tmp_path, "dns.log", "#separator \\x09\n#path\tdns\n#fields\tts\tquery\n1.0\ta.b\n2.0\t-\nbad\n")).collect()
    assert [r["fields"] for r in got] == [{"ts": "1.0", "query": "a.b"}, {"ts": "2.0", "query": None}, None] and got[0]["log"] == "dns"


def test_vpc_flow(spark, tmp_path):
    row = "2 1 eni 10.0.0.1 1.1.1.1 1 443 6 1 99 1714557600 1714557660 {} {}"
    ok, stats = R.read_vpc_flow(spark, put(tmp_path, "f.log", "\n".join([row.format("ACCEPT", "OK"), row.format("REJECT", "OK"), row.format("-", "SKIPDATA")])))
    assert ok.count() == 1 and ok.first()["bytes"] == 99 and stats.first()["skipped"] == 1


def test_otlp(spark, tmp_path):
    doc = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}, {"key": "x", "value": {"stringValue": "r"}}]}, "scopeSpans": [{"spans": [{"name": "n", "attributes": [{"key": "x", "value": {"stringValue": "s"}}]}]}]}]}
    assert R.read_otlp(spark, put(tmp_path, "s.json", json.dumps(doc))).first()["attributes"] == {"service.name": "svc", "x": "s"}


def test_packs_refuse_doubles(spark, tmp_path):
    row = json.dumps({"signature_id": "a", "category": "framework", "type": "domain", "match": "exact", "values": ["x", "y"], "weight": 0.5})
    a, b = put(tmp_path, "a.jsonl", row), put(tmp_path, "b.jsonl", row.replace('"x", "y"', '"z"'))
    assert R.read_signature_pack(spark, [a]).count() == 2
    with pytest.raises(ValueError):
        R.read_signature_pack(spark, [a, b])
    assert [r["value"] for r in R.read_signature_pack(spark, [a, b], override=True).collect()] == ["z"]


def test_inventory(spark, tmp_path):
    df = R.read_inventory(spark, put(tmp_path, "i.csv", "agent_id,resources,surfaces\nA,x|y*,web\n"))
    assert [(r["agent_id"], r["pattern"], r["surfaces"]) for r in df.collect()] == [("A", "x", ["web"]), ("A", "y*", ["web"])]
    with pytest.raises(ValueError):
        R.read_inventory(spark, put(tmp_path, "j.csv", "agent_id,resources\n,x\n"))


def test_reports_and_tree(spark, tmp_path):
    head, found = R.read_reports(spark, put(tmp_path, "r.json", json.dumps({"started_at": "2024-05-01T00:00:00Z", "summary": {"complete": True, "total": 2}, "findings": [{"id": "a"}, {"id": "b"}]})))
    assert head.first()["rows"] == 2 and found.count() == 2
    (tmp_path / "t" / "node_modules").mkdir(parents=True)
    (tmp_path / "t" / "a.py").write_text("import x")
    (tmp_path / "t" / "node_modules" / "b.py").write_text("y")
    assert [r["text"] for r in R.read_file_tree(spark, str(tmp_path / "t")).collect()] == ["import x"]


def test_expand_envelopes(spark):
    raw = [json.dumps({"logEvents": [{"message": json.dumps({"a": 1})}, {"message": json.dumps({"a": 2})}]}), json.dumps({"jsonPayload": {"b": 1}}), json.dumps({"c": 1})]
    got = sorted(r["raw"] for r in R.expand_envelopes(spark.createDataFrame([(x,) for x in raw], "raw string")).collect())
    assert [json.loads(x) for x in got] == [{"a": 1}, {"a": 2}, {"b": 1}, {"c": 1}]


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([("ss-123456789", "Bad =App", "saas", "agent", "r*", ["=x"], 80, "critical", True, None)], "id string, title string, surface string, kind string, resource string, tags array<string>, score int, level string, shadow boolean, owner string")
    f = f.withColumns({"first_seen": F.lit("2024-01-01").cast("timestamp"), "last_seen": F.lit("2024-01-02").cast("timestamp")})
    assert sinks.flat_cells(f).first()["tags"] == "'=x"
    assert sinks.ocsf_events(f).first()["severity_id"] == 5
    assert sinks.registration_stubs(f).first()["resources"] == "r[*]"
    sinks.write_findings(f, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o/findings")).count() == 1
    sinks.write_record_export(spark.createDataFrame([("c", "token = abcdefghijklmnop1")], "connector string, raw string"), str(tmp_path / "e"))
    assert "abcdefghijklmnop1" not in spark.read.json(str(tmp_path / "e/records")).first()["raw"]
