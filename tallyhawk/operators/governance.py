"""Risk scores, autonomy intervals, votes on registration."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhawk.functions import weights as W
from tallyhawk.functions.scalars import risk_level


def weight_table(spark: SparkSession, override: DataFrame | None = None) -> DataFrame:
    """``grp, id, weight``; rows of ``override`` (same columns) replace built-in ones."""
    groups = {"kind": W.KIND_BASE, "capability": W.CAPABILITY, "tag": W.TAG, "provider": W.PROVIDER, "governance": W.GOVERNANCE}
    base = spark.createDataFrame([(g, k, w) for g, t in groups.items() for k, w in t.items()], "grp string, id string, weight int")
    if override is None:
        return base
    own = override.select("grp", "id", F.col("weight").cast("int").alias("own"))
    return base.join(own, ["grp", "id"], "full_outer").select("grp", "id", F.coalesce("own", "weight").alias("weight"))


def scaled(total: Column, confidence: Column) -> Column:
    """``total * (0.6 + 0.4 confidence)``, halves to even, on exact decimals."""
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    scale = F.lit("0.6").cast("decimal(4,2)") + F.lit("0.4").cast("decimal(4,2)") * F.round(bounded, 6).cast("decimal(10,6)")
    return F.bround(total.cast("decimal(10,0)") * scale, 0).cast("int")


def metadata_factors(findings: DataFrame) -> Column:
    """Array of ``(grp, id, weight)`` from typed metadata columns; columns that are not there add nothing."""
    has = set(findings.columns)
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in has else F.lit(0)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in has else F.lit(False)
    kind = F.col("kind")
    rules = [
        ("multiple-secrets", (kind == "secret") & (n("secret_count") > 1), F.lit(5)),
        ("mcp-stdio", (kind == "mcp-server") & flag("mcp_stdio"), F.lit(5)),
        ("mcp-auto-approve", (kind == "mcp-server") & flag("mcp_auto_approve"), F.lit(10)),
        ("mcp-plain-http", (kind == "mcp-server") & flag("mcp_plain_http"), F.lit(10)),
        ("sub-agents", (kind == "agent-config") & (n("sub_agents") > 0), F.least(F.lit(10), 3 * n("sub_agents"))),
        ("volume", (kind == "gateway-caller") & (n("events") >= 1000), F.when(n("events") >= 10_000, 10).otherwise(5)),
        ("blast-radius", kind.isin("oauth-grant", "bot-app") & (n("user_count") >= 10), F.when(n("user_count") >= 100, 10).otherwise(5)),
    ]
    return F.array_compact(F.array(*[F.when(test, F.struct(F.lit("metadata").alias("grp"), F.lit(i).alias("id"), w.cast("int").alias("weight"))) for i, test, w in rules]))


def with_factors(findings: DataFrame, table: DataFrame, inventory_present: bool = True, basis: str = "combined") -> DataFrame:
    """``findings`` with ``_factors``, an array of ``(grp, factor, weight)``, without a shuffle of the findings.

    Reads ``id, kind, capabilities, tags, model_providers, owner, shadow`` and what ``metadata_factors`` reads.
    ``table`` (a row per rule, hundreds at most) travels as one row that holds a map. Under the basis ``danger``
    governance weighs nothing. Null lists are empty; what the table does not name weighs nothing, but a kind 5.
    """
    key = lambda g, x: F.concat(F.lit(f"{g}\u0000"), x)
    weights = table.where("weight is not null").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0000", "grp", "id"), F.col("weight").cast("int")))).alias("_weights"))
    entry = lambda g, x, default=None: F.struct(
        F.lit(g).alias("grp"), x.alias("factor"), F.coalesce(F.element_at(F.col("_weights"), key(g, x)), F.lit(default).cast("int")).alias("weight")
    )
    has = set(findings.columns)
    governance = [F.when(F.coalesce(F.col("owner"), F.lit("")) == "", F.lit("no-owner"))]
    if inventory_present:
        governance += [F.when(F.col("shadow"), F.lit("shadow")), F.when(~F.col("shadow"), F.lit("registered"))]
    if "mcp_unapproved" in has:
        governance.append(F.when(F.col("mcp_unapproved") > 0, F.lit("mcp-not-in-approved-registry")))
    each = lambda c, g: F.transform(F.array_compact(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))), lambda x: entry(g, x))
    lists = [each(F.col(c), g) for c, g in (("capabilities", "capability"), ("tags", "tag"), ("model_providers", "provider")) if c in has]
    named = F.filter(F.concat(*lists, *([each(F.array(*governance), "governance")] if basis != "danger" else [F.array().cast("array<struct<grp:string,factor:string,weight:int>>")])), lambda f: f["weight"] != 0)
    extra = F.transform(metadata_factors(findings), lambda m: F.struct(m["grp"].alias("grp"), m["id"].alias("factor"), m["weight"].alias("weight")))
    one = findings.crossJoin(F.broadcast(weights))  # one row
    return one.withColumn("_factors", F.concat(F.array(entry("kind", F.col("kind"), 5)), named, extra)).drop("_weights")


def risk_factors(findings: DataFrame, table: DataFrame, inventory_present: bool = True, basis: str = "combined") -> DataFrame:
    """One row per finding and factor: ``finding_id, grp, factor, weight``; as ``with_factors`` finds them."""
    each = with_factors(findings, table, inventory_present, basis).select(F.col("id").alias("finding_id"), F.explode("_factors").alias("f"))
    return each.select("finding_id", "f.grp", "f.factor", "f.weight")


def score_risk(findings: DataFrame, table: DataFrame, inventory_present: bool = True, basis: str = "combined") -> DataFrame:
    """``findings`` with ``score, danger_score, level`` and ``factors``, which sum to the score.

    The subtotal of all factors is scaled by confidence, rounded half to even and kept within 0 to 100; what
    scaling and bounds take is listed as factors too. Row by row: no shuffle.
    """
    total = lambda fs: F.aggregate(fs, F.lit(0), lambda a, f: a + f["weight"])
    clamp = lambda x: F.greatest(F.lit(0), F.least(F.lit(100), x))
    out = with_factors(findings, table, inventory_present, basis)
    out = out.withColumns({"_total": total(F.col("_factors")), "_danger": total(F.filter("_factors", lambda f: f["grp"] != "governance"))})
    out = out.withColumns({"_scaled": scaled(F.col("_total"), F.col("confidence")), "danger_score": clamp(scaled(F.col("_danger"), F.col("confidence")))})
    out = out.withColumns({"score": clamp(F.col("_scaled")), "_adj": F.when(F.col("confidence") < 1, F.least(F.lit(0), F.col("_scaled") - F.col("_total"))).otherwise(0).cast("int")})
    more = lambda i, d, w, test: F.when(test, F.struct(F.lit(i).alias("id"), F.lit(d).alias("description"), w.cast("int").alias("weight")))
    rest = F.col("score") - F.col("_total") - F.col("_adj")
    listed = F.array_sort(F.transform("_factors", lambda f: F.struct(f["factor"].alias("id"), f["grp"].alias("description"), f["weight"].alias("weight"))))
    added = F.array_compact(F.array(more("confidence-scaling", "confidence", F.col("_adj"), F.col("confidence") < 1), more("bounds", "bounds", rest, rest != 0)))
    own = [c for c in findings.columns if c not in ("score", "danger_score", "level", "factors")]
    return out.select(*own, "score", "danger_score", risk_level("score").alias("level"), F.concat(listed, added).alias("factors"))


# What evidence raises the least level of autonomy.
APPLICABLE = ("agent", "framework-usage", "agent-config", "mcp-server", "workflow", "bot-app", "gateway-caller", "ai-app", "runtime-process", "cloud-resource")
TOOL_ACCESS = ("tool-use", "rag", "browsing", "data-access", "memory")
SIDE_EFFECTS = ("saas-actions", "code-exec", "delegated-identity")
BYPASS_TAGS = ("posture-permissions-bypassed", "mcp-auto-approve")
OVERSIGHT = {"gated": 0, "unknown": 1, "bypassed": 2}
INITIATION = {"human": 0, "unknown": 1, "event": 2, "schedule": 3}


def _any(col: str, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(F.col(col), F.array(*[F.lit(v) for v in values])), F.lit(False))


def classify_autonomy(findings: DataFrame) -> DataFrame:
    """``findings`` with ``floor, ceiling, oversight, initiation`` and ``basis`` (rules that apply).

    Reads ``kind, capabilities, tags`` and, where there, ``approval_scope`` (every-action, some-actions) and
    ``always_on_corroborated``. Kinds that do not act have nulls.
    """
    has = set(findings.columns)
    scope = F.col("approval_scope") if "approval_scope" in has else F.lit(None).cast("string")
    cadence = _any("tags", ("always-on",)) & (F.coalesce(F.col("always_on_corroborated"), F.lit(False)) if "always_on_corroborated" in has else F.lit(False))
    trigger = F.when(_any("tags", ("scheduled",)) | cadence, "schedule").when(_any("tags", ("event-triggered",)), "event")
    autonomous = _any("capabilities", ("autonomous",)) & (F.col("kind") != "workflow") & trigger.isNull() & ~_any("tags", ("always-on",))
    bypassed = _any("tags", BYPASS_TAGS) | autonomous
    every = F.coalesce(scope == "every-action", F.lit(False)) & ~bypassed
    interactive = F.col("resource_type").isin("ide-extension", "browser-extension", "cli-usage") & (F.col("surface") == "endpoint") if {"resource_type", "surface"} <= has else F.lit(False)
    initiation = F.coalesce(trigger, F.when(interactive, "human"), F.lit("unknown"))
    loop = (F.col("kind") == "agent") & _any("capabilities", ("tool-use",)) & ~every
    rules = [
        ("ai-system", 0, F.lit(True)),
        ("tool-access", 1, _any("capabilities", TOOL_ACCESS)),
        ("side-effect-tools", 2, _any("capabilities", SIDE_EFFECTS) | _any("tags", ("write-access",))),
        ("agentic-execution", 3, (F.col("kind") == "workflow") | _any("capabilities", ("multi-agent",)) | loop),
        ("unapproved-side-effects", 4, bypassed & _any("capabilities", (*SIDE_EFFECTS, "data-access"))),
        ("self-initiated", 5, bypassed & _any("capabilities", (*SIDE_EFFECTS, "data-access")) & initiation.isin("schedule", "event")),
    ]
    floor = F.greatest(*[F.when(test, level).otherwise(0) for _, level, test in rules])
    ceiling = F.greatest(F.when(every, 2).otherwise(5), floor)
    oversight = F.when(bypassed, "bypassed").when(scope.isNotNull() | _any("tags", ("asks-user",)), "gated").otherwise("unknown")
    acts = F.col("kind").isin(*APPLICABLE)
    return findings.withColumns({
        "floor": F.when(acts, floor), "ceiling": F.when(acts, ceiling), "oversight": F.when(acts, oversight), "initiation": F.when(acts, initiation),
        "basis": F.when(acts, F.array_compact(F.array(*[F.when(test, name) for name, _, test in rules]))),
    })


def merge_autonomy(rows: DataFrame, key: str = "id") -> DataFrame:
    """The widest interval over all sources of a key; the oversight and initiation that admit most."""
    worst = lambda c, order: F.max_by(c, F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col(c)])
    return rows.where("floor is not null").groupBy(key).agg(F.max("floor").alias("floor"), F.max("ceiling").alias("ceiling"), worst("oversight", OVERSIGHT).alias("oversight"), worst("initiation", INITIATION).alias("initiation"))


def compare_declared(findings: DataFrame, declared: str = "declared_level") -> DataFrame:
    """Adds the tag ``autonomy-understated`` where the declared level is below the observed floor."""
    low = F.coalesce(F.col(declared) < F.col("floor"), F.lit(False))
    return findings.withColumn("tags", F.when(low, F.array_union("tags", F.array(F.lit("autonomy-understated")))).otherwise(F.col("tags")))


def registration_vote(rows: DataFrame, key: str = "id") -> DataFrame:
    """Shadow if any source says so, approved if all that know agree on one match; differing matches are ambiguous."""
    return rows.groupBy(key).agg(
        F.bool_or("shadow").alias("shadow"),
        F.when(F.count_distinct("registry_match") > 1, "ambiguous").otherwise(F.max("registry_match")).alias("registry_match"),
    )


def declared_governance(findings: DataFrame, inventory: DataFrame, columns: tuple[str, ...] = ("owner_team", "autonomy_level")) -> DataFrame:
    """Facts of the approving inventory row only (the least of an agent's rows); findings without one have nulls."""
    facts = inventory.groupBy(F.col("agent_id").alias("registry_match")).agg(F.min(F.struct(*columns)).alias("_f"))
    facts = facts.select("registry_match", *[F.col(f"_f.{c}").alias(f"declared_{c}") for c in columns])
    return findings.join(facts, "registry_match", "left")


def weights_of(policy: Mapping[str, Mapping[str, int]], spark: SparkSession) -> DataFrame:
    """A user's risk policy as a weight table that overrides the built-in one."""
    return spark.createDataFrame([(g, k, int(w)) for g, t in policy.items() for k, w in t.items()], "grp string, id string, weight int")
