"""Work and memory that must not grow with the product of two inputs, or with the square of one."""

from __future__ import annotations

import re
import time

from pyspark.sql import functions as F

from tallyhawk.functions import scalars
from tallyhawk.operators import correlate, findings, literals, matching, merging, reconcile
from tallyhawk.plans import session
from tallyhawk.plans.queries_texts import SIGNAL_SCHEMA


def most_rows(df) -> int:
    """The most rows that a step of the plan puts out."""
    df.collect()
    spark = df.sparkSession
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    last = max(runs.apply(i).executionId() for i in range(runs.size()))
    values, nodes, most = store.executionMetrics(last), store.planGraph(last).allNodes(), 0
    for i in range(nodes.size()):
        metrics = nodes.apply(i).metrics()
        for k in range(metrics.size()):
            m = metrics.apply(k)
            if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_lines_are_copied_for_known_grams_only(spark):
    """A line of 5,000 different grams is one row for each pattern that it may hold, with one pattern and with many."""
    line = "".join(chr(0x4E00 + i) for i in range(5000)) + "needle7"
    texts = spark.createDataFrame([("a", line), ("b", None)], "doc string, text string")
    for n in (1, 300):
        rows = [(f"s{i}", "framework", "code", "any", None, "regex", "needle[0-9]" if i == 0 else f"q{i:04x}w", 0.5, "needle" if i == 0 else None, False) for i in range(n)]
        got = matching.match_lines(texts, spark.createDataFrame(rows, SIGNAL_SCHEMA), "code")
        assert most_rows(got) <= 300
        assert [(r["doc"], r["signature_id"], r["value"]) for r in got.collect()] == [("a", "s0", "needle7")]


def test_findings_are_not_multiplied_by_grams(spark):
    rows = spark.range(500).select("id", F.concat(F.lit("a long title with many pieces "), F.hex("id"), F.when(F.col("id") == 7, " gear").otherwise("")).alias("title"))
    got = reconcile.suggest_by_name(rows, spark.createDataFrame([("widget",), ("gear",)], "name string"))
    assert most_rows(got) <= 500
    assert [tuple(r) for r in got.collect()] == [(7, "gear")]
    inventory = spark.createDataFrame([("one", "*gear")], "agent_id string, pattern string").select("*", *[F.array().cast("array<string>").alias(f"{s}s") for s in reconcile.SCOPES])
    out = reconcile.reconcile_inventory(rows.withColumnRenamed("title", "resource").withColumns({s: F.lit("x") for s in reconcile.SCOPES}), inventory)
    assert most_rows(out) <= 500
    assert [r["id"] for r in out.where("reason = 'approved'").collect()] == [7]


def test_many_patterns_meet_texts_in_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(literals, "BROADCAST_PATTERNS", 3)
    p = spark.range(50).select(F.concat(F.lit("key"), F.hex("id"), F.lit("z")).alias("p"))
    texts = spark.range(50).select(F.concat(F.lit("x key"), F.hex("id"), F.lit("z y")).alias("t"))
    got = literals.candidates(texts, F.col("t"), literals.index_patterns(p, F.col("p"))).where(F.col("t").contains(F.col("p")))
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 50


def test_runtime_observations_meet_alike_findings_once(spark):
    n = 300
    code = spark.range(n).select("id", F.lit("r").alias("resource"), F.when(F.col("id") % 3 > 0, F.array(F.concat(F.lit("f"), (F.col("id") % 3).cast("string")))).alias("frameworks"))
    code = code.union(spark.createDataFrame([(900, "other", ["f1"]), (901, None, ["f1"]), (3, "r", None)], "id long, resource string, frameworks array<string>"))
    k = F.col("id")
    seen = spark.range(n).select(F.array(F.lit("r")).alias("code_resources"), F.when(k % 3 > 0, F.array(F.concat(F.lit("f"), (k % 3).cast("string")))).alias("frameworks"), F.concat(F.lit("e"), (k % 2).cast("string")).alias("environment"), k.alias("events"), k.alias("first_seen"), k.alias("last_seen"), F.lit(True).alias("complete"))
    got = correlate.attribute_runtime(code, seen)
    assert most_rows(got) <= 4 * n
    rows = {r["id"]: r for r in got.collect()}
    any_, one = sum(range(0, n, 3)), sum(range(1, n, 3))
    assert (rows[0]["events"], rows[1]["events"], rows[3]["events"]) == (any_, any_ + one, 2 * any_)
    assert (rows[1]["first_seen"], rows[1]["last_seen"], rows[1]["environments"], rows[900]["status"], rows[901]["environments"]) == (0, n - 2, ["e0", "e1"], "unobserved", [])


def test_versions_of_an_entry_are_no_list(spark):
    servers = spark.createDataFrame([("a", "pkg", "2", None, "x"), ("b", "pkg", "9", None, "x"), ("c", "pkg", "3", None, "x"), ("d", "pkg", None, None, "x"), ("e", None, "2", None, "x")], "server_id string, package string, version string, url string, name string")
    registry = spark.range(4).select(F.lit("io/e").alias("name"), F.col("id").cast("string").alias("version"), F.lit("active").alias("status"), F.col("id").alias("published_at"), F.array(F.lit("pkg")).alias("packages"), F.array().cast("array<string>").alias("remotes"))
    got = reconcile.match_mcp_registry(servers, registry)
    assert "collect_" not in got._jdf.queryExecution().optimizedPlan().toString()
    tag = "mcp-registry-"
    assert {r["server_id"]: r["tags"] for r in got.collect()} == {"a": [f"{tag}published", f"{tag}outdated"], "b": [f"{tag}published", f"{tag}version-unpublished"], "c": [f"{tag}published"], "d": [f"{tag}published"], "e": [f"{tag}unidentified"]}


def test_the_factor_of_weights_is_found_once(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: i / 3001).alias("w"))
    start = time.perf_counter()
    got = df.select(findings.cap_confidence(F.col("w"), 0.6).alias("c")).first()["c"]
    assert time.perf_counter() - start < 10
    joint = 1.0
    for x in got:
        joint *= 1 - max(x - 1e-4, 0)
    assert len(got) == 3000 and 1 - joint <= 0.6


def test_values_are_taken_apart_once(spark):
    value = F.col("v")
    assert str(scalars.shannon_entropy(value)).count("split(") == 1
    assert str(scalars.placeholder_reason(value)).count("split(") <= 8
    assert str(scalars.host_of(value)).count("regexp_extract(") == 1
    rows = spark.createDataFrame([("aab",), ("",), (None,), ("\U0001f600a",)], "v string").select(F.round(scalars.shannon_entropy(value), 4).alias("e")).collect()
    assert [r["e"] for r in rows] == [0.9183, 0.0, 0.0, 1.0]


def test_records_are_read_once_for_each_field(spark):
    assert str(scalars.parse_timestamp(F.get_json_object("raw", "$.ts"))).count("get_json_object") == 1
    from tallyhawk.sources import readers

    assert str(readers._carried("raw")).count("get_json_object") <= 9


def test_bounded_confidence_reads_evidence_once(spark):
    """One aggregation gives what bounding each row of evidence before it gives, in as many tasks as the rows need."""
    none = F.array().cast("array<string>")
    k = F.col("id") % 9
    f = spark.range(60).select("id", F.when(k != 1, k != 2).alias("app_assessment"), F.when(k == 3, F.array(F.lit("x"))).otherwise(none).alias("frameworks"), F.when(k == 4, F.array(F.lit("registry-record"))).when(k == 5, none).alias("tags"))
    f = f.union(spark.createDataFrame([(3, True, [], []), (None, True, [], None)], "id long, app_assessment boolean, frameworks array<string>, tags array<string>"))
    i = F.col("id")
    e = spark.range(700).select(
        F.when(i != 13, i % 67).alias("id"), F.when(i % 4 == 0, "signature:name-a").when(i % 4 == 1, "name").when(i % 4 == 2, "saas:x").alias("signal"), F.when(i % 11 == 0, "registry-record").when(i % 5 == 0, "ambiguous-name").when(i % 7 == 0, "unattributed-app").when(i % 3 == 0, "g").alias("confidence_group"),
        F.when(i % 13 == 1, F.lit(None)).when(i % 13 == 2, 1.7).when(i % 13 == 3, -1.0).otherwise(i % 10 / 11).alias("weight"), F.when(i % 6 == 0, "code").otherwise("cloud").alias("surface"))
    for evidence in (e, e.drop("surface")):
        plain = f.join(findings.noisy_or_confidence(findings.bound_unattributed(f, evidence, "id"), "id"), "id", "left").select("id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
        for n in (None, 7):
            got = findings.finalize_findings(f, evidence, partitions=n).select("id", "confidence")
            assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    plan = findings.finalize_findings(f, e)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 700") == 1
    assert session.parts_for(spark.range(100), 9) == 12 and session.parts_for(spark.range(100)) == 4


def test_evidence_is_dealt_by_its_rows(spark):
    """A merge of merges in so many partitions, each row dealt once, with the rows of one merge."""
    k = F.col("id")
    e = spark.range(3000).select((k % 50).alias("finding_id"), F.when(k % 3 > 0, "s").alias("signal"), (k % 2).cast("string").alias("location"), F.concat(F.lit("d"), (k % 4).cast("string")).alias("description"), (k % 7 / 7).alias("weight"), (k % 11).alias("ord"), (k % 5).cast("string").alias("source"))
    got = merging.merge_evidence(merging.merge_evidence(e.where("ord < 5"), partitions=37), merging.merge_evidence(e.where("ord >= 5"), partitions=37))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Exchange"), plan.count(", 37)")) == (2, 2)
    assert sorted(map(str, got.collect())) == sorted(map(str, merging.merge_evidence(e).collect()))


def test_facts_of_a_fleet_are_not_shuffled(spark):
    """Rows are dealt by id, twice at most; facts, of which a row has several, stay where they are."""
    k = F.col("id")
    rows = spark.range(900).select(
        (k % 40).alias("id"), k.alias("ord"), (k % 7).cast("string").alias("source"), F.when(k % 3 > 0, F.concat(F.lit("o"), k % 5)).alias("owner"), F.array((k % 4).cast("string"), F.when(k % 2 > 0, "c")).alias("tags"), F.create_map((k % 6).cast("string"), F.when(k % 5 > 0, (k % 9).cast("string"))).alias("metadata"),
        (k % 11).alias("score"), (k % 3).alias("danger_score"), k.alias("first_seen"), k.alias("last_seen"), F.when(k % 8 > 2, k % 8 > 5).alias("shadow"), F.when(k % 4 > 1, (k % 4).cast("string")).alias("registry_match"), F.when(k % 40 < 9, k % 3).alias("region"), F.when(k % 2 > 0, "agent").otherwise("token").alias("kind"))
    parts = (("owner",), ("tags",), ("metadata",))
    got, plain = merging.merge_fleet(rows, *parts, partitions=37), merging.merge_fleet(rows, *parts)
    exchanges = re.findall(r"(?<!Broadcast)Exchange (\w+\([^)]*\))", got._jdf.queryExecution().executedPlan().toString())
    assert len(exchanges) == 2 and all(re.fullmatch(r"hashpartitioning\(id#\d+L, 37\)", x) for x in exchanges)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    conflicts = {r["id"] for r in merging.identity_conflicts(rows).collect()}
    assert conflicts and {r["id"] for r in got.where("not identity_agrees").collect()} == conflicts
