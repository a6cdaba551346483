"""Matching values and texts against signature tables.

``signals`` has one row per literal or pattern: ``signature_id, category, type, ecosystem, language, match (exact,
prefix, suffix, regex), value, weight, required`` (a literal every match must hold, lower case, or null) and
``agent_indicator``. Literals and prefixes are met by equi-joins, patterns by the literal they require (``literals``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhawk.functions.scalars import glob_to_regex, host_of, normalise_package, placeholder_reason, shannon_entropy
from tallyhawk.operators.literals import by_prefix, candidates, glob_literal, index_patterns, regex_literal

def of_type(signals: DataFrame, *types: str) -> DataFrame:
    return signals.where(F.col("type").isin(*types))


def _literal(pattern: str) -> Column:
    return F.coalesce("required", regex_literal(F.col(pattern)))


def match_values(rows: DataFrame, signals: DataFrame, column: str, *types: str, fold: bool = True) -> DataFrame:
    """Distinct values against literals and prefixes (equi-joins) and indexed patterns, joined back to all rows.

    Serves user agents, names, models, images, environment names, client ids, scopes and resource types.
    """
    s = of_type(signals, *types)
    own = F.lower(F.col(column)) if fold else F.col(column)
    values = rows.select(F.col(column)).where(F.col(column).isNotNull()).distinct()
    pick = ["signature_id", "category", "type", "weight", "agent_indicator"]
    exact = s.where("match = 'exact'").select(*pick, (F.lower("value") if fold else F.col("value")).alias("_v"))
    hits = values.join(exact, own == F.col("_v")).select(column, *pick)
    prefix = s.where("match = 'prefix'").select(*pick, F.lower("value").alias("_v"))
    hits = hits.union(by_prefix(values, F.lower(F.col(column)), prefix, "_v").select(column, *pick))
    regex = index_patterns(s.where("match = 'regex'").select(*pick, "value", "required"), _literal("value"))
    test = (F.col("required").isNull() | F.lower(F.col(column)).contains(F.col("required"))) & F.regexp_like(F.col(column), F.col("_re"))
    hits = hits.union(candidates(values, F.col(column), regex.withColumnRenamed("value", "_re")).where(test).select(column, *pick))
    return rows.join(hits.dropDuplicates([column, "signature_id", "type"]), column)


def match_dependency(deps: DataFrame, signals: DataFrame, subject: str = "subject") -> DataFrame:
    """Dependencies (``subject, ecosystem, name``) by exact normalised name, then by prefix without exclusions.

    A signature of ecosystem ``any`` fits all; one hit per subject and signature.
    """
    d = deps.withColumn("_n", normalise_package("name"))
    s = of_type(signals, "dependency").withColumn("_v", normalise_package("value"))
    eco = (F.col("s.ecosystem") == "any") | (F.col("s.ecosystem") == F.col("d.ecosystem"))
    out = [F.col(f"d.{subject}"), F.col("d.name"), F.col("s.signature_id"), F.col("s.category"), F.col("s.weight")]
    exact = d.alias("d").join(s.where("match = 'exact'").alias("s"), (F.col("d._n") == F.col("s._v")) & eco).select(*out, F.lit(0).alias("_way"))
    starts = s.where("match = 'prefix'").select(F.col("_v").alias("_start"), F.col("ecosystem").alias("_eco"), "signature_id", "category", "weight")
    prefix = by_prefix(d.withColumnRenamed("_n", "_norm"), F.col("_norm"), starts, "_start").withColumnRenamed("_norm", "_n").where((F.col("_eco") == "any") | (F.col("_eco") == F.col("ecosystem"))).select(subject, "name", "signature_id", "category", "weight", F.lit(1).alias("_way"), "_n")
    banned = s.where("match = 'exclude'").select("signature_id", F.col("_v").alias("_n"))
    prefix = prefix.join(banned, ["signature_id", "_n"], "left_anti").select(subject, "name", "signature_id", "category", "weight", "_way")
    order = Window.partitionBy(subject, "signature_id").orderBy("_way", "name", "category", "weight")
    return exact.union(prefix).withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "_way")


def match_lines(texts: DataFrame, signals: DataFrame, *types: str, key: str = "doc", text: str = "text", language: str | None = None, most: int = 3) -> DataFrame:
    """Pattern hits in texts with line numbers, at most ``most`` of a signal in a text (a limit of the feature)."""
    s = of_type(signals, *types).where("match = 'regex'").select("signature_id", "category", "type", "weight", F.col("value").alias("_re"), "required", F.col("language").alias("_language"))
    lines = texts.select(key, *([language] if language else []), F.posexplode(F.split(text, "\n")).alias("line", "_l"))
    test = (F.col("required").isNull() | F.lower("_l").contains(F.col("required"))) & F.regexp_like(F.col("_l"), F.col("_re"))
    if language:
        test = test & (F.col("_language").isNull() | (F.col("_language") == F.col(language)))
    hit = candidates(lines, F.col("_l"), index_patterns(s, _literal("_re"))).where(test)
    found = hit.select(key, "signature_id", "category", "type", "weight", (F.col("line") + 1).alias("line"), F.expr("regexp_extract(_l, _re, 0)").alias("value"), F.sha2("_re", 256).alias("_of"))
    order = Window.partitionBy(key, "signature_id", "type").orderBy("line", "value", "_of", "category", "weight")
    return found.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k", "_of")


def match_file(files: DataFrame, signals: DataFrame, path: str = "path") -> DataFrame:
    """Path globs against the whole path, its tail or its last part."""
    s = of_type(signals, "file").select("signature_id", "category", "weight", "value", glob_to_regex(F.col("value")).alias("_re"), F.concat(F.lit("**/"), "value").alias("_v"))
    s = s.withColumn("_tail", glob_to_regex(F.regexp_replace("_v", r"^\*\*/", "*/")))
    base = F.element_at(F.split(F.col(path), "/"), -1)
    indexed = index_patterns(s, glob_literal(F.col("value"))).drop("value")
    fits = F.regexp_like(F.col(path), F.col("_re")) | F.regexp_like(F.col(path), F.col("_tail")) | F.regexp_like(base, F.col("_re"))
    return candidates(files, F.col(path), indexed).where(fits).drop("_re", "_tail", "_v")


def keep_file_matches(matches: DataFrame, path: str = "path") -> DataFrame:
    """Where a coding agent owns a file, other signatures of its vendor don't."""
    vendor = F.split("signature_id", r"[.-]")[1]
    m = matches.withColumn("_vendor", vendor)
    owned = F.max(F.col("category") == "coding-agent").over(Window.partitionBy(path, "_vendor"))
    return m.withColumn("_owned", owned).where("not _owned or category = 'coding-agent'").drop("_vendor", "_owned")


def parent_domains(host: Column) -> Column:
    """The host and all its parents: a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def match_domain(hosts: DataFrame, signals: DataFrame, column: str = "host") -> DataFrame:
    """Hosts by exact name, declared suffix (an equi-join on parent domains) or pattern."""
    s = of_type(signals, "domain")
    pick = ["signature_id", "category", "weight", "agent_indicator"]
    own = hosts.select(F.col(column)).distinct().withColumn("_h", host_of(column)).where("_h is not null")
    up = own.select(column, "_h", F.explode(parent_domains(F.col("_h"))).alias("_p"))
    literal = s.where("match in ('exact', 'suffix')").select(*pick, "match", F.lower("value").alias("_p"))
    hits = up.join(literal, "_p").where("match = 'suffix' or _p = _h").select(column, *pick)
    regex = index_patterns(s.where("match = 'regex'").select(*pick, F.col("value").alias("_re"), "required"), _literal("_re"))
    hits = hits.union(candidates(own, F.col("_h"), regex).where(F.regexp_like(F.col("_h"), F.col("_re"))).select(column, *pick))
    return hosts.join(hits.dropDuplicates([column, "signature_id"]), column)


HOSTS = r"(?i)\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}\b"


def hosts_in_text(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, host``: different host names that stand in a text."""
    return texts.select(key, F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(HOSTS), F.lit(0)), F.lower))).alias("host"))


def match_domains_in_text(texts: DataFrame, signals: DataFrame, key: str, text: str) -> DataFrame:
    return match_domain(hosts_in_text(texts, key, text), signals)


def match_envs_in_text(texts: DataFrame, signals: DataFrame, key: str, text: str) -> DataFrame:
    """Environment-style names in a text against environment signatures."""
    names = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b"), F.lit(0)))).alias("name"))
    return match_values(names, signals, "name", "env")


def host_service(matches: DataFrame, categories: dict[str, int], host: str = "host") -> DataFrame:
    """The one signature of a host: greatest weight, then category order, then id."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])[F.col("category")], F.lit(99))
    order = Window.partitionBy(host).orderBy(F.desc("weight"), rank, "signature_id")
    return matches.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def keep_secret_matches(matches: DataFrame, key: str = "doc") -> DataFrame:
    """Secret hits that hold up: long and random enough, no placeholder, and no generic hit inside a specific one.

    ``matches``: ``key, line, value, generic``.
    """
    good = matches.where((F.length("value") >= 16) & (shannon_entropy("value") >= 3.0) & placeholder_reason("value").isNull())
    specific = good.where("not generic").select(F.col(key).alias("_k"), F.col("line").alias("_l"), F.col("value").alias("_v"))
    inside = (F.col(key) == F.col("_k")) & (F.col("line") == F.col("_l")) & F.col("value").contains(F.col("_v")) & F.col("generic")
    return good.join(specific, inside, "left_anti")


def apply_matches(matches: DataFrame, key: str = "subject", most: int = 12, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Evidence rows (at most ``most`` of a signature and type, ambiguous names as one weak hint) and per subject the
    frameworks, providers, capabilities and how many indicators there are.

    Weights are multiplied by ``scale`` and kept within 0 and 1; a weak hint weighs 0.2 at most after that.
    """
    matches = matches.withColumn("weight", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("weight") * scale)))
    order = Window.partitionBy(key, "signature_id", "type").orderBy(F.desc("weight"), "value", *sorted(set(matches.columns) - {key, "signature_id", "type", "weight", "value"}))
    ambiguous = F.coalesce(F.col("ambiguous"), F.lit(False)) if "ambiguous" in matches.columns else F.lit(False)
    e = matches.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most)
    e = e.select(F.col(key).alias("finding_id"), F.concat(F.lit("signature:"), "type").alias("signal"), F.col("signature_id").alias("signature"), "value", F.when(ambiguous, F.least("weight", F.lit(0.2))).otherwise(F.col("weight")).alias("weight"), F.when(ambiguous, "ambiguous-name").alias("confidence_group"))
    sets = lambda c: F.array_sort(F.collect_set(F.when(F.col("category") == c, F.col("signature_id"))))
    summary = matches.groupBy(F.col(key).alias("id")).agg(sets("framework").alias("frameworks"), sets("provider").alias("model_providers"), F.array_sort(F.collect_set("category")).alias("categories"), F.count_distinct(F.when(F.col("agent_indicator"), F.col("signature_id"))).alias("agent_indicators"))
    return e, summary


def classify_permissions(grants: DataFrame, policies: DataFrame, key: str = "app_id", scopes: str = "scopes") -> DataFrame:
    """``key, tags``: policy tags of an app's scopes (``scope, tag`` in ``policies``), compared in lower case."""
    s = grants.select(key, F.explode(F.array_distinct(F.transform(F.col(scopes), F.lower))).alias("scope"))
    return s.join(policies.select(F.lower("scope").alias("scope"), "tag"), "scope").groupBy(key).agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def assess_app(apps: DataFrame, signals: DataFrame, policies: DataFrame) -> DataFrame:
    """Apps (``app_id, name, urls, client_id, scopes``) with what their hosts, client id, name and scopes say."""
    hosts = match_domain(apps.select("app_id", F.explode("urls").alias("url")).withColumn("host", host_of("url")), signals).select("app_id", "signature_id", "category", "weight")
    ids = match_values(apps.select("app_id", "client_id"), signals, "client_id", "client_id").select("app_id", "signature_id", "category", "weight")
    names = match_values(apps.select("app_id", "name"), signals, "name", "name").select("app_id", "signature_id", "category", F.least("weight", F.lit(0.2)).alias("weight"))
    hits = hosts.union(ids).union(names).groupBy("app_id").agg(F.array_sort(F.collect_set("signature_id")).alias("frameworks"), F.max("weight").alias("best"))
    return apps.join(hits, "app_id", "left").join(classify_permissions(apps, policies), "app_id", "left")


def interesting_app(apps: DataFrame) -> DataFrame:
    """Apps that a signature or policy says something about."""
    return apps.where((F.coalesce(F.size("frameworks"), F.lit(0)) > 0) | (F.coalesce(F.size("tags"), F.lit(0)) > 0))


SECRET_NAME = r"(?i)(?:^|_)(?:api_?key|secret|token|password|passwd|credential|private_key)(?:_|$)"


def scan_env(rows: DataFrame, signals: DataFrame, key: str = "resource", env: str = "env") -> DataFrame:
    """Environment maps: provider of each name, plain values that look like credentials, secret-like names."""
    e = rows.select(key, F.explode(env).alias("name", "value"))
    tagged = e.withColumn("tag", F.when((F.length("value") >= 16) & (shannon_entropy("value") >= 3.0) & F.col("name").rlike(SECRET_NAME) & placeholder_reason("value").isNull(), "plaintext-credential").when(F.col("name").rlike(SECRET_NAME), "secret-in-env"))
    return tagged.join(match_values(e.select("name").distinct(), signals, "name", "env").select("name", "signature_id"), "name", "left").drop("value")


def scan_blob(rows: DataFrame, signals: DataFrame, key: str, blob: Column) -> DataFrame:
    """Any column written as JSON, searched for hosts and environment names."""
    t = rows.select(key, F.to_json(blob).alias("_t"))
    return match_domains_in_text(t, signals, key, "_t").select(key, "signature_id", F.col("host").alias("value")).union(match_envs_in_text(t, signals, key, "_t").select(key, "signature_id", F.col("name").alias("value")))
