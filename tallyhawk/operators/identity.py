"""Apps, grants and tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhawk.functions.scalars import decode_jwt, issuer_family


def join_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, collect: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Parents with what their children have (``n_children`` and sorted sets), and the children without a parent.

    One operator for clients and grants, apps and tokens, bots and versions, agents and tools: children are
    aggregated before the join, so a parent with very many of them is one row on either side.
    """
    sets = children.where(F.col(child_key).isNotNull()).groupBy(child_key).agg(F.count("*").alias("n_children"), *[F.array_sort(F.collect_set(c)).alias(f"{c}_set") for c in collect])
    joined = parents.join(sets, F.col(key) == F.col(child_key), "left").drop(child_key).withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return joined, children.join(parents.select(F.col(key).alias("_p")).distinct(), F.col(child_key) == F.col("_p"), "left_anti")


def join_directory(principals: DataFrame, grants: DataFrame, assignments: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Service principals with delegated scopes and application roles; evidence whose principal is missing.

    ``principals``: ``id, app_id, name, snapshot``; ``grants``: ``client_id, consent_type, scope``; ``assignments``: ``principal_id, role_id``; ``roles``: ``role_id, role``.
    Principals that snapshots describe differently are marked, not merged.
    """
    scopes = grants.select("client_id", "consent_type", F.explode(F.split(F.trim("scope"), r"\s+")).alias("scope")).groupBy("client_id").agg(F.array_sort(F.collect_set("scope")).alias("scopes"), F.bool_or(F.col("consent_type") == "AllPrincipals").alias("tenant_wide"))
    named = assignments.join(roles, "role_id", "left").groupBy("principal_id").agg(F.array_sort(F.collect_set(F.coalesce("role", "role_id"))).alias("app_roles"))
    state = principals.groupBy("id").agg(F.count_distinct(F.sha2(F.concat_ws("\x1f", "app_id", "name"), 256)).alias("_states"), F.min_by("app_id", "snapshot").alias("app_id"), F.min_by("name", "snapshot").alias("name"))
    out = state.join(scopes, F.col("id") == F.col("client_id"), "left").join(named, F.col("id") == F.col("principal_id"), "left")
    out = out.select("id", "app_id", "name", (F.col("_states") > 1).alias("conflicting"), "scopes", F.coalesce("tenant_wide", F.lit(False)).alias("tenant_wide"), "app_roles")
    refs = grants.select(F.col("client_id").alias("id"), F.lit("grant").alias("evidence")).union(assignments.select("principal_id", F.lit("assignment")))
    return out, refs.join(principals.select("id").distinct(), "id", "left_anti").distinct()


def rollup_oauth_clients(tokens: DataFrame, sample: int = 10) -> DataFrame:
    """Per client over all users: scopes, how many users, a sample of them, first known name (by ``ord``)."""
    users = tokens.where("user is not null").groupBy("client").agg(F.count_distinct("user").alias("users"), F.slice(F.array_sort(F.collect_set("user")), 1, sample).alias("user_sample"))
    rest = tokens.select("client", "name", "ord", F.explode_outer("scopes").alias("scope")).groupBy("client").agg(F.array_sort(F.collect_set("scope")).alias("scopes"), F.min_by("name", F.when(F.col("name").isNotNull(), F.col("ord"))).alias("name"))
    return rest.join(users, "client", "left").withColumn("users", F.coalesce("users", F.lit(0)))


def classify_jwt(tokens: DataFrame, token: str = "token", max_hours: int = 24) -> DataFrame:
    """Tokens with ``issuer_family, kind, actors, scopes, hygiene``; texts that are no token are dropped."""
    t = tokens.withColumn("_j", decode_jwt(token)).where(F.json_object_keys("_j.claims").isNotNull())
    claim = lambda *names: F.coalesce(*[F.get_json_object("_j.claims", f"$['{n}']") for n in names])
    actor = F.coalesce(F.get_json_object("_j.claims", "$.act.sub"), F.get_json_object("_j.claims", "$.act.client_id"))
    outer = F.get_json_object("_j.claims", "$.act.act.sub")
    agent = F.lower(F.coalesce(claim("agent_id", "agent", "gpt_id", "ai_agent"), F.lit(""))) != ""
    agentish = agent | F.lower(F.coalesce(actor, F.lit(""))).rlike(r"\bagent\b|assistant|copilot")
    workload = claim("sub").rlike(r"^(spiffe://|system:serviceaccount:|repo:|project_path:)")
    service = claim("idtyp").eqNullSafe(F.lit("app")) | claim("gty").eqNullSafe(F.lit("client-credentials")) | (claim("azp", "client_id", "appid") == claim("sub")) | claim("sub").endswith("@clients")
    yes = lambda c: F.coalesce(c, F.lit(False))
    kind = F.when(actor.isNotNull() & yes(agentish), "delegated-agent").when(yes(agentish), "agent").when(actor.isNotNull(), "delegated").when(yes(workload), "workload").when(yes(service), "service").otherwise("human")
    life = (claim("exp").try_cast("double") - claim("iat").try_cast("double")) / 3600
    hygiene = F.array_compact(F.array(F.when(F.lower(F.get_json_object("_j.header", "$.alg")) == "none", "unsigned"), F.when(claim("exp").isNull(), "no-expiry"), F.when(life > max_hours, "long-lived"), F.when(claim("aud").isNull(), "no-audience")))
    scopes = F.filter(F.split(F.coalesce(claim("scope", "scp"), F.lit("")), r"[\s,]+"), lambda s: s != "")
    return t.select(*tokens.columns, claim("sub").alias("subject"), claim("iss").alias("issuer"), issuer_family(claim("iss")).alias("issuer_family"), kind.alias("kind"), F.array_compact(F.array(actor, outer)).alias("actors"), scopes.alias("scopes"), hygiene.alias("hygiene"))


def app_findings(apps: DataFrame, connector: str) -> DataFrame:
    """App rows (``app_id, name, owner, tags, frameworks, users``) as findings of the application surface."""
    from tallyhawk.functions.scalars import finding_id

    none = F.lit(None).cast("string")
    return apps.select(finding_id(F.lit("2"), F.lit("saas"), F.lit(connector), none, none, none, F.col("app_id"), none).alias("id"), F.lit("saas").alias("surface"), F.lit(connector).alias("connector"), F.lit("oauth-grant").alias("kind"), F.col("name").alias("title"), F.col("app_id").cast("string").alias("resource"), "owner", "tags", "frameworks", F.col("users").alias("user_count"))
