"""The whole scan over findings tables: merge, correlate, reconcile, classify, score, filter, order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhawk.operators import correlate, findings, governance, reconcile
from tallyhawk.plans.session import cut

#: Detectors by name: functions of a session and parameters that give finding rows. Only names that a caller allows run.
DETECTORS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {}


def register_detector(name: str) -> Callable[[Callable[[SparkSession, dict], DataFrame]], Callable[[SparkSession, dict], DataFrame]]:
    """Add a detector; a name that is taken is refused."""

    def register(f: Callable[[SparkSession, dict], DataFrame]) -> Callable[[SparkSession, dict], DataFrame]:
        if name in DETECTORS:
            raise ValueError(f"detector {name} is registered already")
        DETECTORS[name] = f
        return f

    return register


def run_detectors(spark: SparkSession, params: dict[str, dict], allowed: tuple[str, ...]) -> DataFrame:
    """All allowed detectors' rows, one after the other."""
    return findings.union_findings(*[DETECTORS[n](spark, params.get(n, {})) for n in allowed])


@dataclass
class Result:
    findings: DataFrame
    links: DataFrame
    evidence: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Context:
    """What a scan may know beside its findings; a stage without its tables is left out.

    ``observed``: gateway observations (see ``attribute_runtime``). ``configs, processes``: endpoint rows (see
    ``correlate_lifecycle``). ``servers``: configured MCP servers with ``finding_id``; ``mcp_registry``: a snapshot;
    ``mcp_approved``: names. ``records``: registry records; those with a trusted ``trusted_statuses`` approve.
    """

    observed: DataFrame | None = None
    configs: DataFrame | None = None
    processes: DataFrame | None = None
    servers: DataFrame | None = None
    mcp_registry: DataFrame | None = None
    mcp_approved: DataFrame | None = None
    records: DataFrame | None = None
    trusted_statuses: tuple[str, ...] = ()


def _mcp_stage(known: DataFrame, context: Context) -> DataFrame:
    """Registry tags and the number of unapproved servers of each finding."""
    if context.servers is None:
        return known
    if context.mcp_registry is not None:
        tags = reconcile.match_mcp_registry(context.servers, context.mcp_registry).join(context.servers.select("server_id", "finding_id").distinct(), "server_id")
        tags = tags.select(F.col("finding_id").alias("id"), F.explode("tags").alias("t")).groupBy("id").agg(F.array_sort(F.collect_set("t")).alias("_mcp"))
        known = known.join(tags, "id", "left").withColumn("tags", F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("_mcp", F.array().cast("array<string>")))).drop("_mcp")
    if context.mcp_approved is not None:
        known = known.join(reconcile.mcp_approval_gap(context.servers, context.mcp_approved).withColumnRenamed("finding_id", "id"), "id", "left")
    return known


def run_pipeline(
    spark: SparkSession, rows: DataFrame, evidence: DataFrame, inventory: DataFrame, least_confidence: float = 0.0,
    policy: DataFrame | None = None, basis: str = "combined", context: Context | None = None,
) -> Result:
    """From raw findings (with ``ord``) and evidence to scored findings, links and the stages' tables.

    The order is fixed: merge, confidence, correlation, runtime, lifecycle, MCP registry, registry, inventory,
    autonomy, declared governance, risk, filter, prune, sort. ``tables`` holds ``candidates`` (links by name) and,
    where ``context`` has their inputs, ``runtime, lifecycle, bindings, unregistered``; all are of findings that
    are kept. The shuffles are those of the merge, of evidence per finding and of shared identifiers. What several
    stages read is written to the checkpoint folder once: merged, reconciled and kept findings.
    """
    context = context or Context()
    lists = tuple(c for c in ("capabilities", "tags", "frameworks", "model_providers") if c in rows.columns)
    firsts = tuple(c for c in ("owner", "title", "surface", "connector", "resource", "resource_type", "provider", "account", "region") if c in rows.columns)
    merged = findings.merge_findings(rows, lists, firsts)
    once = evidence
    if {"signal", "location", "description"} <= set(evidence.columns):
        once = findings.dedupe_evidence(evidence)
    known = findings.finalize_findings(merged, once.withColumnRenamed("finding_id", "id")).drop("shadow")
    for c in ("provider", "account", "region"):
        if c not in known.columns:
            known = known.withColumn(c, F.lit(None).cast("string"))
    known = cut(known)  # several stages read it
    seen = rows.select("id", "connector", "surface", "resource").distinct()
    links = correlate.key_pairs(seen, "resource", "id")
    named = rows.select(F.col("title").alias("name"), F.col("id").alias("finding_id"), "connector", "surface").distinct()
    tables = {"candidates": correlate.correlate_candidates(named, links)}
    if context.observed is not None and "frameworks" in known.columns:
        tables["runtime"] = correlate.attribute_runtime(known.where("surface = 'code'"), context.observed)
    if context.configs is not None and context.processes is not None:
        tables["lifecycle"] = correlate.correlate_lifecycle(context.configs, context.processes)
    known = cut(_mcp_stage(known, context)) if context.servers is not None else known
    if context.records is not None:
        tables["bindings"], tables["unregistered"] = reconcile.reconcile_registry(context.records, known)
        if context.trusted_statuses:
            inventory = inventory.unionByName(reconcile.trusted_approvals(context.records, context.trusted_statuses), allowMissingColumns=True)
    known = reconcile.reconcile_inventory(known, inventory).withColumnsRenamed({"shadow_now": "shadow", "match_now": "registry_match", "reason": "registry_reason", "suggestions": "registry_suggestions", "assurance": "registry_assurance"})
    known = cut(known)
    known = governance.classify_autonomy(known)
    declared = tuple(c for c in ("owner_team", "autonomy_level") if c in inventory.columns)
    if declared:
        known = governance.declared_governance(known, inventory, declared)
    risked = governance.score_risk(known, governance.weight_table(spark, policy), inventory_present=True, basis=basis)
    kept = cut(findings.min_confidence(risked, least_confidence))
    for name in ("candidates", "lifecycle"):
        if name in tables:
            tables[name] = findings.prune_links(tables[name], kept)
    for name in ("runtime", "unregistered"):
        if name in tables:
            tables[name] = tables[name].join(kept.select("id"), "id", "left_semi")
    return Result(findings.order_findings(kept), findings.prune_links(links, kept), once, tables)
