"""Lineage, report histories, scoped links and merges on small rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyhawk.operators import correlate, merging, reports


def test_long_chains_and_hot_parents(spark):
    chain = [(i, i + 1) for i in range(1000)] + [(5000 + i, 5000 + (i + 1) % 7) for i in range(7)] + [(6000, 5000), (7000, 7000), (None, 1), (1, None)]
    hot = [(10_000 + i, 500) for i in range(2000)]
    several = [(8000, 1), (8000, 2), (8001, 8000), (8002, 8001), (8000, 1)]
    got = {r["child"]: tuple(r)[1:] for r in correlate.lineage(spark.createDataFrame(chain + hot + several, "child long, parent long")).collect()}
    assert len(got) == 1000 + 7 + 2 + 2000 + 3
    assert got[0] == (1000, 1000, "root") and got[999] == (1000, 1, "root") and got[10_000] == (1000, 501, "root")
    assert all(got[k] == (None, None, "cycle") for k in (*range(5000, 5007), 6000, 7000))
    assert got[8000] == (8000, 0, "ambiguous") and got[8002] == (8000, 2, "ambiguous")
    short = {r["child"]: r["status"] for r in correlate.lineage(spark.createDataFrame(chain, "child long, parent long"), hops=5).collect()}
    assert short[994] == "depth" and short[995] == "root" and short[5000] == "cycle"
    assert correlate.lineage(spark.createDataFrame([], "child long, parent long")).count() == 0


def test_history(spark):
    heads = spark.createDataFrame([("r1", 1, True, "x"), ("r2", 2, True, "x"), ("r3", 3, False, "x"), ("r4", 4, True, "y"), ("r5", 5, True, "y"), ("r6", 6, True, None)], "report string, started_at int, complete boolean, scope string")
    rows = [("r1", "a", "1", False), ("r2", "a", "2", False), ("r3", "b", "1", False), ("r4", "a", "2", False), ("r4", "l", "1", True), ("r5", "a", None, False), ("r6", "a", None, False), ("r1", "gone", "1", False)]
    got = {(r["report"], r["previous"], r["change"]): r["findings"] for r in reports.report_history(heads, spark.createDataFrame(rows, "report string, id string, state string, scan_local boolean")).collect()}
    assert got == {
        ("r2", "r1", "changed"): 1, ("r2", "r1", "resolved"): 1, ("r3", "r2", "unknown"): 1, ("r3", "r2", "new"): 1, ("r4", "r3", "unknown"): 1, ("r4", "r3", "returned"): 1, ("r4", "r3", "not_comparable"): 1,
        ("r5", "r4", "changed"): 1, ("r5", "r4", "not_comparable"): 1, ("r6", "r5", "same"): 1,
    }


def test_history_equals_pairs(spark):
    rng = random.Random(4)
    rows = [(f"r{n:02d}", i, rng.choice("ab"), False) for n in range(9) for i in range(40) if rng.random() < 0.6]
    heads = spark.createDataFrame([(f"r{n:02d}", n, True, "x") for n in range(9)], "report string, started_at int, complete boolean, scope string")
    df = spark.createDataFrame(rows, "report string, id int, state string, scan_local boolean")
    got = reports.report_history(heads, df).groupBy("report").pivot("change", ["new", "returned", "same", "changed", "resolved"]).sum("findings").fillna(0)
    for r in got.collect():
        n = int(r["report"][1:])
        side = lambda k: df.where(F.col("report") == f"r{k:02d}")  # noqa: B023, E731
        pair = {x["change"]: x["count"] for x in reports.diff_reports(side(n - 1), side(n), ["state"]).groupBy("change").count().collect()}
        assert (r["new"] + r["returned"], r["same"], r["changed"], r["resolved"]) == tuple(pair.get(c, 0) for c in ("new", "same", "changed", "resolved"))


def identifiers(spark, rows):
    return spark.createDataFrame(rows, "finding_id string, connector string, surface string, kind string, key string, field string, scope map<string,string>, is_global boolean")


def test_scopes(spark):
    rows = [
        ("a", "c1", "s", "label", "same", "f", {"tenant": "1"}, False), ("b", "c2", "s", "label", "same", "g", {"tenant": "1", "account": "9"}, False),  # one shared scope
        ("c", "c3", "s", "label", "same", "f", {"tenant": "2"}, False),  # conflicts with both
        ("d", "c4", "s", "label", "same", "f", None, False),  # nothing proved
        ("e", "c1", "s", "arn", "arn:x", "f", {}, True), ("f", "c2", "s", "arn", "arn:x", "f", {}, True), ("e", "c1", "s", "arn", "arn:x", "g", {}, True),
        ("g", "c1", "s", "client-id", "id", "f", {"account": "1"}, False), ("h", "c2", "s", "client-id", "id", "f", {"account": "1"}, False),  # the kind wants a tenant
        ("i", "c1", "s", "label", "own", "f", {}, True), ("j", "c1", "s", "label", "own", "f", {}, True),  # same connector and surface
        ("a", "c1", "s", "label", "other", "f", {}, False), ("b", "c2", "s", "label", "other", "f", {}, False),  # a candidate of an exact pair
    ]
    got = {(r["src"], r["dst"]): (r["assurance"], [(m["kind"], m["source_fields"], m["target_fields"], [tuple(e) for e in m["scope"]]) for m in r["matches"]]) for r in correlate.scoped_links(identifiers(spark, rows)).collect()}
    assert {k: v[0] for k, v in got.items()} == {("a", "b"): "exact", ("a", "d"): "candidate", ("b", "d"): "candidate", ("c", "d"): "candidate", ("e", "f"): "exact", ("g", "h"): "candidate"}
    assert got["a", "b"][1] == [("label", ["f"], ["g"], [("account", "9"), ("tenant", "1")])] and got["e", "f"][1][0][1] == ["f", "g"]


def test_peers_are_bounded(spark):
    rows = [("hub", "h", "s", "k", f"key{i}", "f", {}, True) for i in range(40)] + [(f"p{i:02d}", "c", "s", "k", f"key{i}", "f", {}, True) for i in range(40)]
    rows += [(f"m{i}", f"c{i}", "s", "k", "crowd", "f", {}, True) for i in range(26)]
    got = correlate.scoped_links(identifiers(spark, rows)).collect()
    assert len(got) == 24 and {r["src"] for r in got} == {"hub"}


SCALARS, LISTS, MAPS = ("owner", "title"), ("tags",), ("metadata",)


def finding_rows(spark):
    rng = random.Random(8)
    pick = lambda *xs: rng.choice(xs)
    rows = [(f"id{rng.randint(0, 5)}", n, f"r{n % 4}", pick("o1", "o2", None, ""), pick("t", None), pick(["x"], ["y", "x"], [], None, [None, "z"]), pick({"m": "1"}, {"m": "2", "n": None}, {}, None, {"k": "v"}), pick("agent", "token", "bot"), pick("ty", None)) for n in range(60)]
    return spark.createDataFrame(rows, "id string, ord int, source string, owner string, title string, tags array<string>, metadata map<string,string>, kind string, resource_type string")


@pytest.mark.parametrize("seed", range(3))
def test_merging_in_any_grouping(spark, seed):
    rows = finding_rows(spark)
    facts = merging.finding_facts(rows, SCALARS, LISTS, MAPS)
    once = sorted(map(str, merging.merge_facts(facts).collect()))
    part = F.abs(F.xxhash64("ord", F.lit(seed))) % 3
    parts = [merging.merge_facts(merging.finding_facts(rows.where(part == k), SCALARS, LISTS, MAPS)) for k in range(3)]
    assert sorted(map(str, merging.merge_facts(parts[2], merging.merge_facts(parts[0], parts[1])).collect())) == once
    assert sorted(map(str, merging.merge_facts(*parts, parts[1]).collect())) == once


def test_merged_values_and_origins(spark):
    rows = spark.createDataFrame(
        [("a", 2, "late", "o2", ["y"], {"k": "2", "n": "3"}, "agent", "T", "res"), ("a", 1, "early", None, ["x", "y"], {"k": "1"}, "token", "U", "res"), ("b", 3, "late", "", None, None, "bot", None, "r1"), ("b", 4, "last", None, [], {}, "bot", None, "r2"), ("b", 5, "last", None, [], {}, "bot", None, None)],
        "id string, ord int, source string, owner string, tags array<string>, metadata map<string,string>, kind string, resource_type string, resource string",
    )
    got = {r["id"]: r for r in merging.assemble(merging.merge_facts(merging.finding_facts(rows, ("owner",), LISTS, MAPS)), ("owner",), LISTS, MAPS).collect()}
    a, b = got["a"], got["b"]
    assert (a["owner"], a["tags"], a["metadata"], a["kind"], a["resource_type"], a["observed_kinds"]) == ("o2", ["x", "y"], {"k": "1", "n": "3"}, "agent", "T", ["agent", "token"])
    assert a["came_from"] == {"owner": "late", "metadata.k": "early", "metadata.n": "late"}
    assert (b["owner"], b["tags"], b["metadata"], b["kind"], b["resource_type"], b["observed_kinds"]) == (None, [], {}, "bot", None, None)
    assert [tuple(r) for r in merging.identity_conflicts(rows).collect()] == [("b", ["resource"])]


def test_evidence_in_any_grouping(spark):
    rng = random.Random(1)
    e = spark.createDataFrame([(f"f{rng.randint(0, 2)}", rng.choice("st"), rng.choice(["l", None]), "d", rng.random(), n, f"r{n % 3}") for n in range(40)], "finding_id string, signal string, location string, description string, weight double, ord int, source string")
    whole = sorted(map(str, merging.merge_evidence(e).collect()))
    assert sorted(map(str, merging.merge_evidence(merging.merge_evidence(e.where("ord < 13")), merging.merge_evidence(e.where("ord >= 9"))).collect())) == whole
