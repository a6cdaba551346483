"""Findings against inventories, vendor registries and tool registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhawk.functions.scalars import glob_to_regex, normalise_remote_url, usable_identity
from tallyhawk.operators.literals import candidates, glob_literal, index_patterns

SCOPES = ("surface", "provider", "account", "region")


def _in_scope(approval: str) -> Column:
    """Every scope list of the approval that is not empty holds the finding's value."""
    test = F.lit(True)
    for s in SCOPES:
        allowed = F.col(f"{approval}.{s}s")
        test = test & (allowed.isNull() | (F.size(allowed) == 0) | F.coalesce(F.array_contains(allowed, F.col(s)), F.lit(False)))
    return test


# What the source of a gateway caller's name may vouch for, weakest last.
CALLER_ASSURANCE = ("provider-authenticated-field", "operator-asserted")


def caller_assurance(findings: DataFrame) -> Column:
    """``unverified`` or ``operator-asserted`` for a gateway finding whose caller no provider authenticated, else null.

    ``assurances`` lists what each of the finding's observations says; none, or one that is not known, is unverified.
    Without that column nothing is said.
    """
    if "assurances" not in findings.columns:
        return F.lit(None).cast("string")
    said = F.coalesce("assurances", F.array().cast("array<string>"))
    known = F.forall(said, lambda a: F.coalesce(a.isin(*CALLER_ASSURANCE), F.lit(False)))
    weakest = F.when((F.size(said) == 0) | ~known, "unverified").when(F.array_contains(said, CALLER_ASSURANCE[1]), CALLER_ASSURANCE[1])
    return F.when(F.col("surface") == "gateway", weakest)


def reconcile_inventory(findings: DataFrame, inventory: DataFrame, pattern: str = "pattern", ident: str = "agent_id") -> DataFrame:
    """``findings`` with ``shadow_now, match_now, reason, suggestions, assurance``.

    ``inventory`` has one row per approval and pattern, and lists ``surfaces, providers, accounts, regions`` (empty: any).
    Literal patterns are an equi-join; patterns with wild cards are met by their rarest literal piece. Exactly one
    approval approves; several are ambiguous, and are suggested; what fits a gateway caller that no provider has
    authenticated is for review only (see ``caller_assurance``), as callers write their own names; an identity that is
    redacted or padded is not compared; an empty inventory leaves ``shadow_now`` null.
    """
    wild = F.col(pattern).rlike(r"[*?\[]")
    inv = inventory.select(F.struct(ident, pattern, *[f"{s}s" for s in SCOPES]).alias("inv"), F.col(pattern).alias("_pattern"), wild.alias("_wild"))
    usable = findings.where(usable_identity("resource"))
    literal = usable.join(inv.where("not _wild"), F.col("resource") == F.col("_pattern")).where(_in_scope("inv"))
    globs = index_patterns(inv.where("_wild").withColumn("_regex", glob_to_regex("_pattern")), glob_literal(F.col("_pattern")))
    matched = candidates(usable, F.col("resource"), globs).where(F.regexp_like(F.col("resource"), F.col("_regex"))).where(_in_scope("inv"))
    hits = literal.select("id", f"inv.{ident}").union(matched.select("id", f"inv.{ident}")).groupBy("id").agg(F.array_sort(F.collect_set(ident)).alias("_fits"))
    known = inventory.limit(1).agg(F.count("*").alias("_known"))
    out = findings.withColumn("_assurance", caller_assurance(findings)).join(hits, "id", "left").crossJoin(F.broadcast(known))  # one row
    assessed, n = F.col("_known") > 0, F.coalesce(F.size("_fits"), F.lit(0))
    reason = (
        F.when(~assessed, "no-inventory").when(~usable_identity("resource"), "unusable-identity").when((n > 0) & F.col("_assurance").isNotNull(), "unverified-gateway-caller-identity")
        .when(n > 1, "ambiguous-resource-approval").when(n == 1, "approved").otherwise("unregistered")
    )
    review = reason.isin("unverified-gateway-caller-identity", "ambiguous-resource-approval")
    return out.select(
        *findings.columns, F.when(assessed, reason != "approved").alias("shadow_now"), F.when(reason == "approved", F.col("_fits")[0]).alias("match_now"), reason.alias("reason"),
        F.when(review, F.col("_fits")).alias("suggestions"), F.when(reason == "unverified-gateway-caller-identity", F.col("_assurance")).alias("assurance"),
    )


def suggest_by_name(findings: DataFrame, names: DataFrame, text: str = "title", least: int = 4) -> DataFrame:
    """``id, name``: names (of ``least`` characters at least) that stand as words in a finding's text; a hint only."""
    n = names.where(F.length("name") >= least).select(F.lower("name").alias("name")).distinct()
    escaped = F.regexp_replace("name", r"([.+^$(){}|\\\[\]*?])", r"\\$1")
    n = n.withColumn("_re", F.concat(F.lit("(?<![a-z0-9])"), escaped, F.lit("(?![a-z0-9])")))
    low = F.lower(F.col(text))
    found = candidates(findings.select("id", low.alias("_low")), F.col("_low"), index_patterns(n, F.col("name")))
    return found.where(F.col("_low").contains(F.col("name")) & F.regexp_like(F.col("_low"), F.col("_re"))).select("id", "name")


def inventory_warnings(inventory: DataFrame, probes: DataFrame, pattern: str = "pattern", many: int = 2) -> DataFrame:
    """Approvals whose pattern is universal or takes in several unrelated probe names."""
    p = inventory.select("agent_id", pattern, glob_to_regex(pattern).alias("_re"))
    met = candidates(probes.select("probe"), F.col("probe"), index_patterns(p, glob_literal(F.col(pattern)))).where(F.regexp_like(F.col("probe"), F.col("_re")))
    met = met.groupBy(F.col("agent_id").alias("_a"), F.col(pattern).alias("_p")).agg(F.count("*").alias("_n"))
    mine = p.groupBy("agent_id", pattern).agg(F.count("*").alias("_copies"))
    hits = mine.join(met, mine["agent_id"].eqNullSafe(met["_a"]) & mine[pattern].eqNullSafe(met["_p"]), "left").select("agent_id", pattern, F.coalesce("_n", F.lit(0)).alias("probes"))
    return hits.withColumn("warning", F.when(F.col(pattern).rlike(r"^[*?/:]*$"), "universal").when(F.col("probes") >= many, "broad")).where("warning is not null")


def reconcile_registry(records: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per binding a status, and per finding whether it may be called unregistered.

    ``records``: ``registry, record_id, bindings ARRAY<STRUCT<resource, provider, account, region>>, listing_complete``.
    """
    b = records.select("registry", "record_id", "listing_complete", F.explode_outer("bindings").alias("b")).select("registry", "record_id", "listing_complete", "b.*")
    f = findings.select("id", F.col("resource").alias("_r"), *[F.col(c).alias(f"_{c}") for c in ("provider", "account", "region")])
    on = F.col("resource") == F.col("_r")
    for c in ("provider", "account", "region"):
        on = on & F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(True))
    j = b.join(f, on, "left")
    status = F.when(F.col("resource").isNull(), "unbindable").when(F.col("_n") == 1, "observed").when(F.col("_n") > 1, "ambiguous").otherwise("not-observed")
    bindings = j.groupBy("registry", "record_id", "resource").agg(F.count("id").alias("_n")).select("registry", "record_id", "resource", status.alias("status"))
    absent = findings.join(j.where("id is not null").select("id").distinct(), "id", "left_anti")
    complete = records.agg(F.coalesce(F.bool_and("listing_complete"), F.lit(False)).alias("_all"))
    return bindings, absent.crossJoin(F.broadcast(complete)).select("id", F.when(F.col("_all"), "not-in-registry").otherwise("unknown").alias("status"))  # one row


def trusted_approvals(records: DataFrame, statuses: tuple[str, ...] = ("approved",), allow_auto: bool = False) -> DataFrame:
    """Registry records that a trust policy turns into approvals, in the inventory's form."""
    keep = F.col("status").isin(*statuses) & (F.lit(allow_auto) | (F.coalesce(F.col("approval_mode"), F.lit("manual")) != "auto"))
    b = records.where(keep).select("record_id", F.explode("bindings").alias("b"))
    one = lambda c: F.array_compact(F.array(F.col(f"b.{c}")))
    return b.select(F.col("record_id").alias("agent_id"), F.col("b.resource").alias("pattern"), F.array().cast("array<string>").alias("surfaces"), one("provider").alias("providers"), one("account").alias("accounts"), one("region").alias("regions"))


def latest_versions(rows: DataFrame, keys: list[str], version: str, published: str) -> DataFrame:
    """Version of each key that was published last; ties go to the greater version."""
    return rows.groupBy(*keys).agg(F.max_by(version, F.struct(F.col(published), F.col(version))).alias("latest"), F.count("*").alias("versions"))


def match_mcp_registry(servers: DataFrame, registry: DataFrame) -> DataFrame:
    """Tags of each configured server (``server_id, package, version, url, name``) against a registry snapshot.

    ``registry``: ``name, version, status, published_at, packages ARRAY<STRING>, remotes ARRAY<STRING>``. Package identity goes before
    endpoint, endpoint before declared name.
    """
    pk = registry.select(F.explode("packages").alias("_k"), "name").distinct()
    rm = registry.select(F.explode("remotes").alias("_u"), "name").select(normalise_remote_url("_u").alias("_k"), "name").distinct()
    s = servers.withColumn("_url", normalise_remote_url("url"))
    by = s.join(pk, s.package == F.col("_k")).select("server_id", pk["name"].alias("entry"), F.lit(0).alias("way"))
    by = by.union(s.join(rm, s["_url"] == F.col("_k")).select("server_id", rm["name"].alias("entry"), F.lit(1).alias("way")))
    by = by.union(s.join(registry.select(F.col("name").alias("entry")).distinct(), s["name"] == F.col("entry")).select("server_id", "entry", F.lit(2).alias("way")))
    best = by.withColumn("_k", F.row_number().over(Window.partitionBy("server_id").orderBy("way", "entry"))).where("_k = 1").select("server_id", "entry", "way")
    latest = registry.groupBy(F.col("name").alias("entry")).agg(F.max_by("version", F.struct("published_at", "version")).alias("latest"), F.max_by("status", F.struct("published_at", "version")).alias("status"))
    published = registry.where("version is not null").select(F.col("name").alias("entry"), "version").distinct().withColumn("_published", F.lit(True))
    j = servers.join(best, "server_id", "left").join(latest, "entry", "left").join(published, ["entry", "version"], "left")
    known = F.col("package").isNotNull() | F.col("url").isNotNull()
    tags = F.array_compact(F.array(
        F.when(F.col("entry").isNotNull(), "mcp-registry-published"), F.when(F.col("entry").isNull() & known, "mcp-unpublished"), F.when(F.col("entry").isNull() & ~known, "mcp-registry-unidentified"),
        F.when(F.col("status") == "deprecated", "mcp-registry-deprecated"), F.when(F.col("status") == "deleted", "mcp-registry-deleted"),
        F.when(F.col("entry").isNotNull() & F.col("version").isNotNull() & F.col("_published").isNull(), "mcp-registry-version-unpublished"),
        F.when(F.col("_published") & (F.col("version") != F.col("latest")), "mcp-registry-outdated"),
    ))
    return j.select("server_id", "entry", "latest", tags.alias("tags"))


def mcp_approval_gap(servers: DataFrame, approved: DataFrame, key: str = "finding_id") -> DataFrame:
    """Enabled servers of each finding that no approved catalogue names."""
    return servers.where("not coalesce(disabled, false)").join(approved.select(F.col("name").alias("name")).distinct(), "name", "left_anti").groupBy(key).agg(F.count("*").alias("mcp_unapproved"))


def assign_owner(paths: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """Owners of each path by the last rule that fits it (``line_no, pattern, owners``).

    A pattern with a slash before its end is anchored at the root; ``**`` crosses folders, ``*`` doesn't; a
    pattern that ends in a slash, or names a folder, takes in all below. Rules are met by their rarest literal piece.
    """
    p = F.regexp_replace(F.col("pattern"), r"^/", "")
    anchored = F.col("pattern").rlike(r"/.")
    rx = F.regexp_replace(p, r"([.+^$(){}|\\])", r"\\$1")
    rx = F.regexp_replace(F.regexp_replace(rx, r"/$", "/**"), r"\*\*/", "\u0001")
    rx = F.regexp_replace(F.regexp_replace(F.regexp_replace(rx, r"\*\*", "\u0002"), r"\*", "[^/]*"), r"\?", "[^/]")
    rx = F.regexp_replace(F.regexp_replace(rx, "\u0001", "(?:.*/)?"), "\u0002", ".*")
    r = rules.select("line_no", "owners", F.regexp_replace(p, "/$", "").alias("_p"), F.concat(F.when(anchored, r"\A").otherwise(r"\A(?:.*/)?"), rx, F.lit(r"(?:/.*)?\z")).alias("_re"))
    indexed = index_patterns(r, glob_literal(F.col("_p")))
    hit = candidates(paths.select(path).distinct(), F.col(path), indexed).where(F.regexp_like(F.col(path), F.col("_re"))).groupBy(path).agg(F.max_by("owners", "line_no").alias("owners"))
    return paths.join(hit, path, "left")
