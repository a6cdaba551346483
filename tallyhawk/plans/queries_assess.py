"""Driver queries on evidence, finished findings, applications, resources and the whole scan; each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhawk.operators import findings, identity, matching, normalise, reports
from tallyhawk.plans import pipeline
from tallyhawk.plans.registry import query
from tallyhawk.plans.session import parts_for, table


def _t(c: str) -> F.Column:
    return F.col(c).cast("string")


# ---------------------------------------------------------------- evidence

_MATCHES = """
WITH m AS (SELECT l_orderkey AS subject, 'sig' || (l_suppkey % 5) AS signature_id, l_returnflag AS type, 'v' || l_partkey AS value, CAST(l_quantity AS DOUBLE) / 60 AS w, l_linestatus = 'O' AS ambiguous, l_suppkey % 5 AS s, l_linenumber % 2 = 0 AS indicator FROM lineitem)"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_suppkey") % 5
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("subject"), F.concat(F.lit("sig"), s.cast("string")).alias("signature_id"), F.col("l_returnflag").alias("type"), F.concat(F.lit("v"), _t("l_partkey")).alias("value"), (F.col("l_quantity") / 60).alias("weight"),
        (F.col("l_linestatus") == "O").alias("ambiguous"), F.when(s < 2, "framework").when(s < 4, "provider").otherwise("tool").alias("category"), (F.col("l_linenumber") % 2 == 0).alias("agent_indicator"),
    )


@query(_MATCHES + """,
k AS (SELECT *, row_number() OVER (PARTITION BY subject, signature_id, type ORDER BY least(1, w * 0.75) DESC, value) AS place FROM m)
SELECT subject AS finding_id, 'signature:' || type AS signal, signature_id AS signature, count(*) AS n, round(sum(CASE WHEN ambiguous THEN least(0.2, w * 0.75) ELSE least(1, w * 0.75) END), 9) AS weight, count(*) FILTER (ambiguous) AS weak FROM k WHERE place <= 1 GROUP BY 1, 2, 3""")
def matched_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = matching.apply_matches(_matches(spark, sf_dir), most=1, scale=0.75)
    return e.groupBy("finding_id", "signal", "signature").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 9).alias("weight"), F.count_if(F.col("confidence_group") == "ambiguous-name").alias("weak"))


@query(_MATCHES + """
SELECT subject AS id, coalesce(string_agg(DISTINCT signature_id, '|' ORDER BY signature_id) FILTER (s < 2), '') AS frameworks, coalesce(string_agg(DISTINCT signature_id, '|' ORDER BY signature_id) FILTER (s IN (2, 3)), '') AS providers,
       count(DISTINCT signature_id) FILTER (indicator) AS agent_indicators FROM m GROUP BY subject""")
def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s = matching.apply_matches(_matches(spark, sf_dir))
    return s.select("id", F.array_join("frameworks", "|").alias("frameworks"), F.array_join("model_providers", "|").alias("providers"), "agent_indicators")


_APPS = """
WITH f AS (SELECT o_orderkey AS id, o_custkey % 3 <> 0 AS app, CASE WHEN o_custkey % 4 = 0 THEN ['sig' || o_custkey % 5] ELSE [] END AS fw, CASE WHEN o_custkey % 7 = 0 THEN 'registry-record' END AS tag, o_custkey % 2 AS ind, CASE WHEN o_custkey % 5 = 1 THEN 'framework-usage' ELSE 'oauth-grant' END AS kind FROM orders),
e AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'A' THEN 'signature:name' ELSE 'saas:' || l_linestatus END AS signal, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'ambiguous-name' WHEN l_partkey % 97 = 0 THEN 'registry-record' END AS g, CAST(l_quantity AS DOUBLE) / 64 AS w FROM lineitem),
o AS (SELECT f.*, app AND len(fw) = 0 AND tag IS NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.id = f.id AND g = 'registry-record') AS open FROM f),
b AS (SELECT e.id, CASE WHEN open AND (signal <> 'signature:name' OR coalesce(g, '') = 'ambiguous-name') THEN 'group:unattributed-app' ELSE coalesce('group:' || g, 'signal:' || signal) END AS g,
             CASE WHEN open AND (signal <> 'signature:name' OR coalesce(g, '') = 'ambiguous-name') THEN least(w, 0.35) ELSE w END AS w FROM e JOIN o USING (id)),
c AS (SELECT id, round(1 - product(1 - w), 3) AS confidence FROM (SELECT id, g, max(w) AS w FROM b GROUP BY id, g) GROUP BY id)"""


@query(_APPS + """
SELECT o.id, CASE WHEN kind = 'framework-usage' AND ind > 0 THEN 'agent' ELSE kind END AS kind, coalesce(confidence, 0) AS confidence,
       CASE WHEN confidence >= 0.85 THEN 'strong' WHEN confidence >= 0.6 THEN 'likely' WHEN confidence >= 0.3 THEN 'possible' ELSE 'weak' END AS likelihood, CASE WHEN len(fw) > 0 AND fw[1] <> 'sig4' THEN fw[1] || ':Sig ' || fw[1][4:] END AS technologies
FROM o LEFT JOIN c USING (id)""")
def finished_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications that nothing attributes to AI stay below a bound, whatever is known of them."""
    k = F.col("o_custkey")
    none = F.array().cast("array<string>")
    f = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (k % 3 != 0).alias("app_assessment"), F.when(k % 4 == 0, F.array(F.concat(F.lit("sig"), (k % 5).cast("string")))).otherwise(none).alias("frameworks"), none.alias("model_providers"),
        F.when(k % 7 == 0, F.array(F.lit("registry-record"))).otherwise(none).alias("tags"), (k % 2).alias("agent_indicators"), F.when(k % 5 == 1, "framework-usage").otherwise("oauth-grant").alias("kind"),
    )
    name = F.col("l_returnflag") == "A"
    e = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.when(name, "signature:name").otherwise(F.concat(F.lit("saas:"), "l_linestatus")).alias("signal"),
        F.when(name & (F.col("l_linestatus") == "O"), "ambiguous-name").when(F.col("l_partkey") % 97 == 0, "registry-record").alias("confidence_group"), (F.col("l_quantity") / 64).alias("weight"),
    )
    known = spark.createDataFrame([(f"sig{i}", f"Sig {i}", "framework", "v") for i in range(4)], "signature_id string, name string, category string, vendor string")
    out = findings.finalize_findings(f, e, known, partitions=parts_for(table(spark, sf_dir, "lineitem")))
    return out.select("id", "kind", "confidence", "likelihood", F.array_join(F.transform("technologies", lambda t: F.concat(t["id"], F.lit(":"), t["name"])), "|").alias("technologies"))


@query("""
WITH w AS (SELECT l_orderkey AS id, least(CAST(l_quantity AS DOUBLE) / 55, 0.95) AS w FROM lineitem), j AS (SELECT id, 1 - product(1 - w) AS joint FROM w GROUP BY id)
SELECT id, joint <= 0.6 AS free, CASE WHEN joint <= 0.6 THEN round(joint, 4) ELSE 0.6 END AS joint FROM j""")
def capped_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a finding scaled down until their joint confidence is within the cap, and no further."""
    w = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.least(F.col("l_quantity") / 55, F.lit(0.95))).alias("w"))
    capped = w.withColumn("c", findings.cap_confidence(F.col("w"), 0.6))
    joint = lambda c: 1 - F.aggregate(c, F.lit(1.0), lambda a, x: a * (1 - x))
    return capped.select("id", (joint("w") <= 0.6).alias("free"), F.round(joint("c"), 4).alias("joint"))


@query("""
WITH v AS (SELECT doc_id, l.line, l.value, l.generic FROM (SELECT doc_id, source, unnest([{'line': 1, 'value': 'k9Qz7mX2Lp8vT4' || md5(CAST(doc_id AS VARCHAR)), 'generic': false}, {'line': 1, 'value': 'key-k9Qz7mX2Lp8vT4' || md5(CAST(doc_id AS VARCHAR)), 'generic': true},
          {'line': 2, 'value': 'key-k9Qz7mX2Lp8vT4' || md5(CAST(doc_id AS VARCHAR)), 'generic': true}, {'line': 3, 'value': 'short1', 'generic': false}, {'line': 4, 'value': 'your-' || md5(CAST(doc_id AS VARCHAR)), 'generic': false}]) AS l FROM documents))
SELECT doc_id AS doc, line, generic FROM v WHERE (line = 1 AND NOT generic) OR line = 2""")
def kept_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the hits in every document, those that hold up: a generic hit that holds a specific one of its line doesn't."""
    body = F.concat(F.lit("k9Qz7mX2Lp8vT4"), F.md5(_t("doc_id")))
    hit = lambda line, value, generic: F.struct(F.lit(line).alias("line"), value.alias("value"), F.lit(generic).alias("generic"))
    hits = F.array(hit(1, body, False), hit(1, F.concat(F.lit("key-"), body), True), hit(2, F.concat(F.lit("key-"), body), True), hit(3, F.lit("short1"), False), hit(4, F.concat(F.lit("your-"), F.md5(_t("doc_id"))), False))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.explode(hits).alias("h")).select("doc", "h.*")
    return matching.keep_secret_matches(rows).select("doc", "line", "generic")


# ---------------------------------------------------------------- normal forms


@query("""
SELECT event_type, count(*) FILTER (value < 5 OR value > 90) AS discarded, round(sum(CASE WHEN value BETWEEN 5 AND 90 THEN value - 5 ELSE 0 END), 2) AS cost FROM events GROUP BY 1""")
def usable_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.lit(None).cast("double").alias("tokens_in"), (90 - F.col("value")).alias("tokens_out"), (F.col("value") - 5).alias("cost"))
    u = normalise.discard_unusable_usage(e)
    return u.groupBy("event_type").agg(F.count_if("usage_discarded").alias("discarded"), F.round(F.sum(F.when(F.col("usage_discarded"), 0).otherwise(F.col("cost"))), 2).alias("cost"))


@query("""
SELECT coalesce(CASE WHEN lower(trim(n)) = 'gpt co' THEN 'provider.gpt' WHEN lower(trim(n)) = 'mach' THEN 'provider.machinery' END, CASE WHEN lower(trim(n)) IN ('automobile', 'machinery') THEN 'provider.' || lower(trim(n)) END) AS provider_id, count(*) AS n
FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN 'GPT Co ' WHEN 1 THEN c_mktsegment WHEN 2 THEN 'Mach' ELSE 'nobody' END AS n FROM customer) GROUP BY 1""")
def provider_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("GPT Co", "provider.gpt"), ("mach", "provider.machinery"), ("auto", "provider.automobile")], "alias string, provider_id string")
    k = F.col("c_custkey") % 4
    c = table(spark, sf_dir, "customer").select(F.when(k == 0, "GPT Co ").when(k == 1, F.col("c_mktsegment")).when(k == 2, "Mach").otherwise("nobody").alias("provider"))
    return normalise.provider_alias(c, aliases).groupBy("provider_id").agg(F.count("*").alias("n"))


@query("""
WITH b AS (SELECT c_custkey AS caller, CASE WHEN c_custkey % 3 = 0 THEN 'click' END AS env, 'repo/' || c_custkey AS code FROM customer WHERE c_custkey % 2 = 0)
SELECT event_id, code FROM events LEFT JOIN b ON caller = user_id AND (env IS NULL OR env = event_type)""")
def bound_workloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("caller"), F.when(F.col("c_custkey") % 3 == 0, "click").alias("environment"), F.array(F.concat(F.lit("repo/"), _t("c_custkey"))).alias("code_resources"), F.lit("operator").alias("assurance"))
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("caller"), F.col("event_type").alias("environment"))
    return normalise.bind_workloads(e, b).select("event_id", F.col("code_resources")[0].alias("code"))


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS app_id, c_name AS name, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END AS owner FROM customer WHERE NOT (c_custkey % 5 = 0 AND c_nationkey % 2 = 0)""")
def mapped_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An app export with columns under other names; rows whose aliases disagree are left out."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("Client ID"), F.col("c_name").alias("App Name"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).otherwise(" ").alias("Owner"), F.when((k % 5 == 0) & (F.col("c_nationkey") % 2 == 0), "other").alias("owner-team"), F.lit("z").alias("Kept By"))
    return normalise.map_columns(c, {"app_id": ("client_id", "app_id"), "name": ("app_name", "name"), "owner": ("owner", "owner_team")})


@query("""
SELECT CASE event_id % 3 WHEN 0 THEN 'tls' WHEN 1 THEN 'dns' ELSE 'flow' END AS kind, 'u' || user_id AS client, count(*) AS n, count(*) FILTER (event_id % 3 = 1) AS queries, CAST(sum(CASE WHEN event_id % 3 = 2 THEN event_id ELSE 0 END) AS BIGINT) AS bytes, count(*) FILTER (event_id % 4 = 0) AS fingerprints FROM events GROUP BY 1, 2""")
def network_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    none = F.lit(None).cast("string")
    e = table(spark, sf_dir, "events").select(
        F.when(n % 3 == 0, "tls").when(n % 3 == 1, "dns").otherwise("flow").alias("kind"), "ts", F.concat(F.lit(" U"), _t("user_id"), F.lit(" ")).alias("client"), F.when(n % 3 == 1, F.lit("Q.Example.")).alias("query"), F.array(F.lit("1.1.1.1")).alias("answers"), F.array(F.lit(60), F.lit(5)).alias("ttls"),
        none.alias("sni"), n.alias("uid"), none.alias("server"), F.lit("443").alias("port"), F.when(n % 3 == 2, n).alias("bytes"), F.when(n % 4 == 0, "t13d1516h2_8daaf6152771_b0da82dd1658").otherwise("no print").alias("ja4"), none.alias("sensor"), none.alias("network"), none.alias("resolver"),
    )
    return normalise.network_event(e).groupBy("kind", "client").agg(F.count("*").alias("n"), F.count_if((F.col("query") == "q.example") & (F.col("ttl") == 5)).alias("queries"), F.sum("bytes").alias("bytes"), F.count("ja4").alias("fingerprints"))


@query("""
SELECT 'e' || event_id AS event_id, event_type AS event_name, 'arn:u/' || user_id AS principal, epoch_us(date_trunc('second', ts)) AS us FROM events WHERE event_id % 11 <> 0""")
def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit records as flat events; those with over-long values are dropped."""
    name = F.when(F.col("event_id") % 11 == 0, F.repeat(F.lit("x"), F.lit(3000))).otherwise(F.col("event_type"))
    raw = F.to_json(F.struct(F.concat(F.lit("e"), _t("event_id")).alias("eventID"), name.alias("eventName"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"), F.struct(F.concat(F.lit("arn:u/"), _t("user_id")).alias("arn")).alias("userIdentity")))
    return normalise.audit_event(table(spark, sf_dir, "events").select(raw.alias("raw"))).select("event_id", "event_name", "principal", F.unix_micros("event_time").alias("us"))


# ---------------------------------------------------------------- applications and resources


@query("""
WITH a AS (SELECT c_custkey AS id, 'https://' || CASE c_nationkey % 3 WHEN 0 THEN 'api.agents.example' WHEN 1 THEN 'x.' || lower(c_mktsegment) || '.org' ELSE 'plain.org' END || '/x' AS url, c_nationkey % 3 AS h, 'cid-' || c_custkey % 50 AS cid, c_custkey % 50 = 7 AS known, c_custkey % 4 AS s FROM customer),
f AS (SELECT id, list_sort(list_filter([CASE WHEN h = 0 THEN 'sig.agents' END, CASE WHEN known THEN 'sig.cid' END], lambda x: x IS NOT NULL)) AS fw, CASE s WHEN 0 THEN ['data-access'] WHEN 1 THEN ['data-access', 'privileged'] END AS tags FROM a)
SELECT id, array_to_string(fw, '|') AS frameworks, array_to_string(tags, '|') AS tags FROM f WHERE len(fw) > 0 OR tags IS NOT NULL""")
def assessed_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications by their hosts, client ids and scopes; those that nothing is known of are left out."""
    from tallyhawk.plans.queries_texts import SIGNAL_SCHEMA

    signals = spark.createDataFrame([("sig.agents", "framework", "domain", "any", None, "suffix", "agents.example", 0.9, None, True), ("sig.cid", "framework", "client_id", "any", None, "exact", "cid-7", 0.9, None, True)], SIGNAL_SCHEMA)
    policies = spark.createDataFrame([("Files.Read", "data-access"), ("Directory.All", "privileged")], "scope string, tag string")
    n, k = F.col("c_nationkey") % 3, F.col("c_custkey")
    host = F.when(n == 0, "api.agents.example").when(n == 1, F.concat(F.lit("x."), F.lower("c_mktsegment"), F.lit(".org"))).otherwise("plain.org")
    apps = table(spark, sf_dir, "customer").select(
        k.alias("app_id"), F.lower("c_name").alias("name"), F.array(F.concat(F.lit("https://"), host, F.lit("/x"))).alias("urls"), F.concat(F.lit("cid-"), (k % 50).cast("string")).alias("client_id"),
        F.when(k % 4 == 0, F.array(F.lit("files.read"))).when(k % 4 == 1, F.array(F.lit("Files.Read"), F.lit("directory.all"))).otherwise(F.array(F.lit("openid"))).alias("scopes"),
    )
    out = matching.interesting_app(matching.assess_app(apps, signals, policies))
    return out.select(F.col("app_id").alias("id"), F.coalesce(F.array_join("frameworks", "|"), F.lit("")).alias("frameworks"), F.array_join("tags", "|").alias("tags"))


@query("""
WITH r AS (SELECT p_partkey AS k, ['bedrock-agent', 'lambda', 'secret-name', 'iam-principal', 'other'][p_size % 5 + 1] AS kind FROM part)
SELECT 'arn:' || k AS resource, CASE kind WHEN 'bedrock-agent' THEN 'bedrock-agent' WHEN 'lambda' THEN 'lambda-function' WHEN 'secret-name' THEN 'secret' ELSE 'iam-principal' END AS resource_type,
       CASE kind WHEN 'bedrock-agent' THEN 'agent' WHEN 'lambda' THEN 'cloud-resource' WHEN 'secret-name' THEN 'secret' ELSE 'iam-grant' END AS kind, CASE WHEN kind = 'bedrock-agent' THEN 'tool-use' ELSE '' END AS capabilities,
       CAST(CASE kind WHEN 'bedrock-agent' THEN 0.95 WHEN 'iam-principal' THEN 0.5 ELSE 0.4 END AS DOUBLE) AS weight FROM r WHERE kind <> 'other'""")
def cloud_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyhawk.operators.cloud import cloud_resource_findings

    k = F.col("p_size") % 5
    arn = F.concat(F.lit("arn:"), _t("p_partkey"))
    form = lambda kind, field: F.to_json(F.struct(F.lit(kind).alias("_kind"), arn.alias(field)))
    raw = F.when(k == 0, form("bedrock-agent", "agentArn")).when(k == 1, form("lambda", "FunctionArn")).when(k == 2, form("secret-name", "ARN")).when(k == 3, form("iam-principal", "Arn")).otherwise(form("other", "id"))
    f, e = cloud_resource_findings(table(spark, sf_dir, "part").select(raw.alias("raw")), "aws")
    return f.join(e.select(F.col("finding_id").alias("id"), "weight"), "id").select("resource", "resource_type", "kind", F.array_join("capabilities", "|").alias("capabilities"), "weight")


@query("""
SELECT 'oauth-grant' AS kind, CAST(c_custkey AS VARCHAR) AS resource, c_name AS title, count(o_orderkey) AS users FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""")
def saas_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_custkey").alias("app_id"), F.col("c_name").alias("name")).agg(F.count("o_orderkey").alias("users"))
    rows = c.withColumns({"owner": F.lit(None).cast("string"), "tags": F.array().cast("array<string>"), "frameworks": F.array().cast("array<string>")})
    return identity.app_findings(rows, "saas.export").select("kind", "resource", "title", F.col("user_count").alias("users"))


@query("""
WITH r AS (SELECT s_nationkey AS n, count(*) AS total, count(*) + CASE WHEN s_nationkey % 5 = 0 THEN 1 ELSE 0 END AS rows, s_nationkey % 3 <> 0 AS complete, 's' || s_nationkey % 2 AS scope, date '2024-01-01' + CAST(s_nationkey * 3 AS INT) AS started FROM supplier GROUP BY s_nationkey),
b AS (FROM r ORDER BY n LIMIT 1), c AS (FROM r ORDER BY n DESC LIMIT 1)
SELECT concat_ws('|', CASE WHEN c.started - b.started > 30 THEN 'baseline-too-old' END, CASE WHEN b.scope <> c.scope THEN 'scope-differs' END, CASE WHEN NOT c.complete THEN 'current-incomplete' END, CASE WHEN NOT b.complete THEN 'baseline-incomplete' END,
       CASE WHEN b.total <> b.rows OR c.total <> c.rows THEN 'summary-differs-from-rows' END) AS reasons FROM b, c""")
def comparable_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the first and the last report, by their suppliers' nations, don't compare."""
    n = F.col("s_nationkey")
    r = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("total")).select(
        "s_nationkey", "total", (F.col("total") + F.when(n % 5 == 0, 1).otherwise(0)).alias("rows"), (n % 3 != 0).alias("complete"), F.concat(F.lit("s"), (n % 2).cast("string")).alias("scope"), F.lit(1).alias("identity_schema"),
        F.date_add(F.to_date(F.lit("2024-01-01")), (n * 3).cast("int")).cast("timestamp").alias("started_at"),
    )
    ends = r.agg(F.min("s_nationkey").alias("lo"), F.max("s_nationkey").alias("hi"))
    one = lambda end: r.join(ends, F.col("s_nationkey") == F.col(end), "left_semi")
    return reports.baseline_gate(one("lo"), one("hi")).select(F.array_join("reasons", "|").alias("reasons"))


@query("""
WITH c AS (SELECT o_orderpriority < '3' AS truth, o_totalprice < 150000 AS a, o_custkey % 40 < 17 AS b FROM orders),
k AS (SELECT count(*) FILTER (a = truth AND b = truth) AS both_, count(*) FILTER (a = truth AND b <> truth) AS x, count(*) FILTER (a <> truth AND b = truth) AS y FROM c),
p AS (SELECT least(1, 2 * sum(exp(lgamma(x + y + 1) - lgamma(i + 1) - lgamma(x + y - i + 1) - (x + y) * ln(2)))) AS p FROM k, range(least(x, y) + 1) r(i))
SELECT both_ AS "both", x AS only_first, y AS only_second, round(greatest(abs(x - y) - 1, 0) ** 2 / (x + y), 6) AS statistic, round(p, 6) AS p_value FROM k, p""")
def paired_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return reports.paired_metrics(o.select((F.col("o_orderpriority") < "3").alias("truth"), (F.col("o_totalprice") < 150_000).alias("first"), (F.col("o_custkey") % 40 < 17).alias("second")))


# ---------------------------------------------------------------- gateways


@query("""
SELECT 'gcp:u' || user_id AS caller, 'models/m-' || event_type AS model, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS tools, count(*) FILTER (event_id % 5 = 0) AS failed, min(epoch_us(date_trunc('second', ts))) AS first_us FROM events GROUP BY 1, 2""")
def vertex_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit records of a cloud's model service; a request that lists tools declares them."""
    n = F.col("event_id")
    request = F.struct(F.when(n % 3 == 0, F.array(F.struct(F.lit("f").alias("name")))).when(n % 3 == 1, F.array().cast("array<struct<name: string>>")).alias("tools"))
    body = F.struct(
        F.lit("aiplatform.googleapis.com").alias("serviceName"), F.lit("google.cloud.aiplatform.v1.PredictionService.GenerateContent").alias("methodName"), F.struct(F.concat(F.lit("u"), _t("user_id")).alias("principalEmail")).alias("authenticationInfo"),
        F.concat(F.lit("projects/p/locations/l/models/m-"), "event_type").alias("resourceName"), request.alias("request"), F.when(n % 5 == 0, F.struct(F.lit(7).alias("code"))).alias("status"),
    )
    raw = F.to_json(F.struct(body.alias("protoPayload"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")))
    r = normalise.normalise_all(table(spark, sf_dir, "events").select(raw.alias("raw"))).where("schema = 'vertex'")
    return r.groupBy("caller", "model").agg(F.count("*").alias("n"), F.count_if("tools").alias("tools"), F.count_if(F.col("status") != "ok").alias("failed"), F.unix_micros(F.min("ts")).alias("first_us"))


@query("""
WITH e AS (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN 'p' || (event_id % 4) END AS person, CASE WHEN event_id % 5 = 0 THEN 't' || (event_id % 2) END AS team, event_type, ts FROM events),
p AS (SELECT user_id, first(person ORDER BY n DESC, f, person) AS person FROM (SELECT user_id, person, count(*) AS n, min(ts) AS f FROM e WHERE person IS NOT NULL GROUP BY ALL) GROUP BY user_id),
t AS (SELECT user_id, first(team ORDER BY n DESC, f, team) AS team FROM (SELECT user_id, team, count(*) AS n, min(ts) AS f FROM e WHERE team IS NOT NULL GROUP BY ALL) GROUP BY user_id),
c AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, count(*) FILTER (event_type IN ('purchase', 'signup')) AS tool, count(DISTINCT event_type) AS m, count(*) FILTER (event_type = 'purchase') AS declared FROM e GROUP BY user_id)
SELECT 'u' || user_id AS resource, coalesce(person, team) AS owner, n AS events, tool > 0 AS tool_use, bad / n > 0.2 AS high_error_rate,
       concat_ws('|', 'gateway:caller', CASE WHEN m >= 4 THEN 'gateway:multi-model' END, CASE WHEN declared > 0 THEN 'gateway:tool-use' ELSE CASE WHEN tool > 0 THEN 'gateway:tool-calls' END END, CASE WHEN n >= 1000 THEN 'gateway:volume' END) AS signals
FROM c LEFT JOIN p USING (user_id) LEFT JOIN t USING (user_id)""")
def gateway_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of gateway callers with their owners, tags and signals (temporal and loop signals have their own queries)."""
    from tallyhawk.operators.callers import caller_findings

    n = F.col("event_id")
    caller = F.concat(F.lit("u"), _t("user_id"))
    full = table(spark, sf_dir, "events").select(
        caller.alias("caller"), F.lit("user").alias("caller_kind"), caller.alias("caller_label"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.lit(1).alias("request_count"),
        F.lit(None).cast("long").alias("tokens_in"), F.lit(None).cast("long").alias("tokens_out"), F.col("value").alias("cost"), (F.col("event_type") == "purchase").alias("tools"), (F.col("event_type") == "signup").alias("tool_calls"), F.lit("events").alias("schema"),
        F.when(n % 3 == 0, F.concat(F.lit("p"), (n % 4).cast("string"))).alias("user"), F.when(n % 5 == 0, F.concat(F.lit("t"), (n % 2).cast("string"))).alias("team"),
        *[F.lit(None).cast("string").alias(c) for c in ("path", "method", "host", "user_agent")],
    )
    f, evidence = caller_findings(full)
    kinds = evidence.where("signal in ('gateway:caller', 'gateway:multi-model', 'gateway:tool-use', 'gateway:tool-calls', 'gateway:volume')").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("signal")), "|").alias("signals"))
    return f.join(kinds, "id").select("resource", "owner", "events", F.array_contains("capabilities", "tool-use").alias("tool_use"), F.array_contains("tags", "high-error-rate").alias("high_error_rate"), "signals")


# ---------------------------------------------------------------- the whole scan


@query("""
WITH r AS (SELECT 'f' || o_custkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'cloud' WHEN 1 THEN 'saas' ELSE 'code' END AS surface, o_orderkey AS ord, CASE WHEN o_orderkey % 4 = 0 THEN 'team' || (o_orderkey % 7) END AS owner, 'app/' || o_custkey AS resource,
                  ['agent', 'token', 'service-identity'][o_orderkey % 3 + 1] AS kind, o_orderstatus AS tag FROM orders),
e AS (SELECT 'f' || o_custkey AS id, o_custkey % 3 = 2 AS code, o_orderstatus AS signal, o_orderpriority AS location, max(o_totalprice) / 600000 AS w FROM orders GROUP BY ALL),
g AS (SELECT id, CASE WHEN code THEN signal || '/' || location ELSE signal END AS g, max(w) AS w FROM e GROUP BY 1, 2),
c AS (SELECT id, round(1 - product(1 - w), 3) AS confidence FROM g GROUP BY id),
p AS (SELECT *, CASE kind WHEN 'agent' THEN 3 WHEN 'service-identity' THEN 2 ELSE 0 END AS p FROM r),
m AS (SELECT id, any_value(surface) AS surface, arg_min(owner, ord) FILTER (owner IS NOT NULL) AS owner, any_value(resource) AS resource, first(kind ORDER BY p DESC, kind DESC) AS kind FROM p GROUP BY id)
SELECT m.id, m.surface, m.owner, m.kind, confidence, CASE WHEN confidence >= 0.85 THEN 'strong' WHEN confidence >= 0.6 THEN 'likely' WHEN confidence >= 0.3 THEN 'possible' ELSE 'weak' END AS likelihood,
       n <> 1 AS shadow, CASE WHEN n = 1 THEN one END AS registry_match, true AS factors_sum
FROM m JOIN c USING (id), LATERAL (SELECT CAST(resource LIKE 'app/1%' AS INT) + CAST(resource LIKE '%7' AS INT) AS n, CASE WHEN resource LIKE 'app/1%' THEN 'A' ELSE 'B' END AS one) WHERE confidence >= 0.5""")
def whole_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of a scan over findings made of the orders: merged, scored, reconciled, classified, filtered."""
    k, o = F.col("o_custkey"), table(spark, sf_dir, "orders")
    ident, surface = F.concat(F.lit("f"), k.cast("string")), F.when(k % 3 == 0, "cloud").when(k % 3 == 1, "saas").otherwise("code")
    none = F.array().cast("array<string>")
    rows = o.select(
        ident.alias("id"), surface.alias("surface"), F.lit("c").alias("connector"), F.element_at(F.array(F.lit("agent"), F.lit("token"), F.lit("service-identity")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("kind"), F.concat(F.lit("Order of "), k.cast("string")).alias("title"),
        F.concat(F.lit("app/"), k.cast("string")).alias("resource"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("team"), (F.col("o_orderkey") % 7).cast("string"))).alias("owner"), none.alias("capabilities"), F.array("o_orderstatus").alias("tags"), F.col("o_orderkey").alias("ord"),
        F.col("o_orderdate").cast("timestamp").alias("first_seen"), F.col("o_orderdate").cast("timestamp").alias("last_seen"),
    )
    evidence = o.select(ident.alias("finding_id"), surface.alias("surface"), F.col("o_orderstatus").alias("signal"), F.col("o_orderpriority").alias("location"), F.lit("d").alias("description"), F.lit(None).cast("string").alias("confidence_group"), (F.col("o_totalprice") / 600_000).alias("weight"))
    inventory = spark.createDataFrame([("A", "app/1*"), ("B", "*7")], "agent_id string, pattern string").select("*", *[none.alias(f"{s}s") for s in ("surface", "provider", "account", "region")])
    out = pipeline.run_pipeline(spark, rows, evidence, inventory, least_confidence=0.5).findings
    total = F.aggregate("factors", F.lit(0), lambda a, f: a + f["weight"])
    return out.select("id", "surface", "owner", "kind", "confidence", "likelihood", "shadow", "registry_match", (total == F.col("score")).alias("factors_sum"))
