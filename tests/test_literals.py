"""The literal index against trying every pattern on every text."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyhawk.functions.scalars import glob_to_regex
from tallyhawk.operators import literals, matching, reconcile
from tallyhawk.plans.queries_texts import SIGNAL_SCHEMA


def tried_one_by_one(df) -> list[str]:
    """Nested loops of the physical plan that have a condition (one-row tables are joined without)."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [j for j in re.findall(r"(?:NestedLoopJoin|CartesianProduct)[^\n]*", plan) if j.count(",") > 1 or "Cartesian" in j]


def signals(spark, n: int):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        name = "".join(rng.choice("abcdefghij") for _ in range(7))
        kind, value, required = rng.choice([("exact", name, None), ("prefix", name[:4], None), ("regex", f"{name}[0-9]+", name), ("regex", f"(?i){name[:5]}x?", None), ("regex", f"^{name[0]}{{2}}$", None)])
        rows.append((f"sig{i}", "framework", "name", "any", None, kind, value, 0.5, required, False))
    return spark.createDataFrame(rows, SIGNAL_SCHEMA), rows


def test_values_with_ten_thousand_patterns(spark):
    table, rows = signals(spark, 10_000)
    rng = random.Random(3)
    values = [r[6].replace("[0-9]+", "77").replace("(?i)", "").replace("x?", "X") for r in rng.sample(rows, 60)] + ["aa", "bb", "none of these", "", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")
    got = matching.match_values(df, table, "v", "name")
    assert not tried_one_by_one(got)

    def fits(v: str, r: tuple) -> bool:
        kind, value, required = r[5], r[6], r[8]
        if kind == "exact":
            return v.lower() == value
        if kind == "prefix":
            return v.lower().startswith(value)
        return (required is None or required in v.lower()) and re.search(value, v) is not None

    expected = {(i, r[0]) for i, v in enumerate(values) if v is not None for r in rows if fits(v, r)}
    assert {(x["id"], x["signature_id"]) for x in got.collect()} == expected and len(expected) > 60


def test_lines_with_many_patterns(spark):
    rows = [(f"s{i}", "framework", "code", "any", None, "regex", f"use {i:03d}lib\\b", 0.5, f"{i:03d}lib", False) for i in range(400)] + [("any", "framework", "code", "any", None, "regex", "q[0-9]z", 0.1, None, False)]
    table = spark.createDataFrame(rows, SIGNAL_SCHEMA)
    texts = spark.createDataFrame([("a", "x\nuse 007lib here\nq1z"), ("b", "USE 008LIB\nuse 0081lib"), ("c", None), ("d", ""), ("e", "\n".join(["use 399lib"] * 9))], "doc string, text string")
    got = matching.match_lines(texts, table, "code")
    assert not tried_one_by_one(got)
    assert sorted((r["doc"], r["signature_id"], r["line"]) for r in got.collect()) == [("a", "any", 3), ("a", "s7", 2), ("e", "s399", 1), ("e", "s399", 2), ("e", "s399", 3)]


@pytest.mark.parametrize(("pattern", "literal"), [("abc", "abc"), ("(?i)ABC", "abc"), ("ab?cde", "cde"), ("abc*", "ab"), ("abc+d", "abc"), ("a|b", ""), ("(abc)?", ""), ("[abc]d", ""), (r"foo\.barbaz", "barbaz"), (r"\dabc", "abc"), ("^ab.cd$", "cd"), ("a{2}b", "")])
def test_literals_of_patterns(spark, pattern, literal):
    assert spark.createDataFrame([(pattern,)], "p string").select(literals.regex_literal(F.col("p"))).first()[0] == literal


def test_globs(spark):
    rng = random.Random(5)
    globs = [rng.choice(["*{}", "{}*", "a/{}/*", "*/{}?", "{}[0-9]", "*", "?{}*"]).format("".join(rng.choice("xyzuv") for _ in range(rng.randint(1, 5)))) for _ in range(300)]
    paths = ["".join(rng.choice("xyzuv/a1") for _ in range(rng.randint(0, 9))) for _ in range(200)] + ["a/xyz/b", "xyz1"]
    g = spark.createDataFrame([(x,) for x in sorted(set(globs))], "g string")
    p = spark.createDataFrame([(x,) for x in sorted(set(paths))], "p string")
    every = p.crossJoin(g).where(F.regexp_like("p", glob_to_regex("g")))
    found = literals.candidates(p, F.col("p"), literals.index_patterns(g, literals.glob_literal(F.col("g")))).where(F.regexp_like("p", glob_to_regex("g"))).select("p", "g")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, every.collect()))


def test_a_hundred_thousand_approvals(spark):
    n = 100_000
    approvals = spark.range(n).select(
        F.concat(F.lit("agent"), "id").alias("agent_id"), F.concat(F.lit("arn:aws:bedrock:eu-west-1:123456789012:agent/"), F.hex(F.col("id") * 7919), F.lit("-*")).alias("pattern"),
        *[F.array().cast("array<string>").alias(f"{s}s") for s in reconcile.SCOPES],
    )
    findings = spark.range(50).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("arn:aws:bedrock:eu-west-1:123456789012:agent/"), F.hex(F.col("id") * 2 * 7919), F.lit("-live")).alias("resource"), *[F.lit("x").alias(s) for s in reconcile.SCOPES])
    got = reconcile.reconcile_inventory(findings, approvals)
    assert not tried_one_by_one(got)
    assert {r["id"]: r["match_now"] for r in got.collect()} == {str(i): f"agent{2 * i}" for i in range(50)}
