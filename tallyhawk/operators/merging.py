"""Findings of several sources or reports as one: facts with their origin, merged in any grouping."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhawk.operators.findings import KIND_PRIORITY

#: What tells findings apart; rows of one id that differ here are not the same thing.
IDENTITY = ("surface", "connector", "resource", "provider", "account", "region")


def finding_facts(rows: DataFrame, scalars: Sequence[str], lists: Sequence[str] = (), maps: Sequence[str] = (), order: str = "ord", source: str = "source") -> DataFrame:
    """``id, field, key, value, ord, source``: one row for each known scalar, list item and map entry of a finding.

    ``rows`` has an ``id``, an order (first known wins) and the source or report that a row comes from. A null or
    empty scalar, a null item and a null entry are not known. Kinds and types go as a pair.
    """
    text = lambda c: F.col(c).cast("string")
    one = lambda field, key, value: F.struct(F.lit(field).alias("field"), key.alias("key"), value.alias("value"))
    none = F.lit("")
    parts = [F.array(one(c, none, text(c))) for c in scalars]
    parts += [_items(c, one) for c in lists]
    parts += [_entries(c, one) for c in maps]
    if "kind" in rows.columns:
        kind = F.to_json(F.struct(F.col("kind").alias("kind"), (F.coalesce("resource_type", none) if "resource_type" in rows.columns else none).alias("type")))
        parts.append(F.array(one("kind", F.when(F.col("kind").isNotNull(), kind), F.col("kind"))))
    facts = rows.select("id", F.col(order).alias("ord"), F.col(source).alias("source"), F.explode(F.concat(*parts)).alias("f"))
    return facts.select("id", "f.field", "f.key", "f.value", "ord", "source").where("key is not null and value is not null and (value <> '' or key <> '')")


def _items(column: str, one: Callable[[str, Column, Column], Column]) -> Column:
    return F.transform(F.coalesce(F.col(column).cast("array<string>"), F.array().cast("array<string>")), lambda x: one(column, x, x))


def _entries(column: str, one: Callable[[str, Column, Column], Column]) -> Column:
    entries = F.map_entries(F.coalesce(F.col(column).cast("map<string,string>"), F.create_map().cast("map<string,string>")))
    return F.transform(entries, lambda e: one(column, e["key"], e["value"]))


def merge_facts(*facts: DataFrame) -> DataFrame:
    """The first known value of each fact. Merging merged facts again, in any grouping, gives the same rows.

    The key is finding, field and key, so a finding that every report has is many groups, and partial results are made
    before the shuffle.
    """
    every = facts[0]
    for f in facts[1:]:
        every = every.unionByName(f)
    first = F.min(F.struct("ord", "source", "value"))
    return every.groupBy("id", "field", "key").agg(first.alias("w")).select("id", "field", "key", "w.value", "w.ord", "w.source")


def assemble(facts: DataFrame, scalars: Sequence[str], lists: Sequence[str] = (), maps: Sequence[str] = ()) -> DataFrame:
    """One row per finding of merged facts: scalars, sorted lists, maps, and ``came_from`` (field or field.key to source).

    The kind is the one of highest priority, then of greatest name, with its type; ``observed_kinds`` has all kinds
    where they differ.
    """
    of = lambda c: F.col("field") == c
    aggs = [F.max(F.when(of(c), F.col("value"))).alias(c) for c in scalars]
    aggs += [F.array_sort(F.collect_list(F.when(of(c), F.col("key")))).alias(c) for c in lists]
    aggs += [F.map_from_entries(F.array_sort(F.collect_list(F.when(of(c), F.struct("key", "value"))))).alias(c) for c in maps]
    named = F.when(F.col("field").isin(*scalars), F.col("field")).when(F.col("field").isin(*maps), F.concat_ws(".", "field", "key")) if scalars or maps else F.lit(None)
    aggs.append(F.map_from_entries(F.array_sort(F.collect_list(F.when(named.isNotNull(), F.struct(named.alias("key"), F.col("source").alias("value")))))).alias("came_from"))
    pair = F.from_json("key", "kind string, type string")
    priority = F.coalesce(F.create_map(*[F.lit(x) for kv in KIND_PRIORITY.items() for x in kv])[F.col("value")], F.lit(0))
    aggs.append(F.max(F.when(of("kind"), F.struct(priority.alias("p"), pair["kind"].alias("kind"), pair["type"].alias("type")))).alias("_pair"))
    aggs.append(F.array_sort(F.collect_set(F.when(of("kind"), F.col("value")))).alias("_kinds"))
    out = facts.groupBy("id").agg(*aggs)
    out = out.withColumns({"kind": F.col("_pair.kind"), "resource_type": F.nullif(F.col("_pair.type"), F.lit("")), "observed_kinds": F.when(F.size("_kinds") > 1, F.col("_kinds"))})
    return out.drop("_pair", "_kinds")


def merge_evidence(*evidence: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per (finding, signal, location, description), of the greatest weight; its source and order are the first that had it.

    Associative as well: weights by their maximum, origins by their minimum. With ``partitions`` (see
    ``session.parts_for``) the evidence is dealt into so many; merging what is dealt alike deals nothing anew.
    """
    same = ("finding_id", "signal", "location", "description")
    every = evidence[0]
    for e in evidence[1:]:
        every = every.unionByName(e)
    every = every.repartition(partitions, *same) if partitions else every
    return every.groupBy(*same).agg(F.max("weight").alias("weight"), F.min(F.struct("ord", "source")).alias("w")).select("finding_id", "signal", "location", "description", "weight", "w.ord", "w.source")


def identity_conflicts(rows: DataFrame, fields: Sequence[str] = IDENTITY) -> DataFrame:
    """``id, fields``: findings whose rows disagree on what they are, with the fields that do; nulls are a value."""
    here = [c for c in fields if c in rows.columns]
    different = rows.groupBy("id").agg(*[_differ(c).alias(c) for c in here])
    out = different.select("id", F.array_compact(F.array(*[F.when(F.col(c), c) for c in here])).alias("fields"))
    return out.where(F.size("fields") > 0)


def _differ(field: str) -> Column:
    text = F.coalesce(F.to_json(F.array(F.col(field).cast("string"))), F.lit(""))
    return F.min(text) != F.max(text)


def merge_fleet(rows: DataFrame, scalars: Sequence[str], lists: Sequence[str] = (), maps: Sequence[str] = (), order: str = "ord", source: str = "source", partitions: int | None = None) -> DataFrame:
    """Findings of N reports as one row each.

    Facts are merged as above; the risk is the greatest (score, then danger), ``shadow`` is unregistered if any
    report says so, differing registry matches are ``ambiguous``, autonomy is the widest, times the outermost;
    ``sources`` are the reports that have it. ``identity_agrees`` is false where the reports disagree on what it is.

    With ``partitions`` (see ``session.parts_for``) rows are dealt by id into so many before they become facts, so that
    facts are sorted in small tasks and never shuffled; a report has a finding once, so no id has many rows.
    """
    rows = rows.repartition(partitions, "id") if partitions else rows
    has = set(rows.columns)
    risk = F.max(F.struct("score", "danger_score"))
    aggs = [risk.alias("_risk"), F.array_sort(F.collect_set(source)).alias("sources"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")]
    if "shadow" in has:
        aggs += [F.bool_or("shadow").alias("shadow"), F.when(F.min("registry_match") != F.max("registry_match"), "ambiguous").otherwise(F.max("registry_match")).alias("registry_match")]
    if "floor" in has:
        aggs += [F.max("floor").alias("floor"), F.max("ceiling").alias("ceiling")]
    aggs.append((~reduce(or_, [_differ(c) for c in IDENTITY if c in has], F.lit(False))).alias("identity_agrees"))
    whole = rows.groupBy("id").agg(*aggs).withColumns({"score": F.col("_risk.score"), "danger_score": F.col("_risk.danger_score")}).drop("_risk")
    facts = assemble(merge_facts(finding_facts(rows, scalars, lists, maps, order, source)), scalars, lists, maps)
    return whole.join(facts, "id", "left").select(*[c for c in whole.columns if c != "identity_agrees"], *[c for c in facts.columns if c != "id"], "identity_agrees")
