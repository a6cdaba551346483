"""Driver queries on requests, file scans and repositories, built from the given tables; each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhawk.functions import scalars
from tallyhawk.operators import callers, lowcode, matching, network, text_audit
from tallyhawk.plans.queries_estate import _cases, _joined, _sql_cases
from tallyhawk.plans.queries_texts import SIGNAL_SCHEMA
from tallyhawk.plans.registry import query
from tallyhawk.plans.session import table
from tallyhawk.sources import readers

# ---------------------------------------------------------------- requests

_PATHS = [
    "/v1/chat/completions", "/v1/messages/?beta=1", "/openai/deployments/embed-small/completions", "/v1/embeddings", "/healthz", "/mcp/", "/static/app.js", "/v1/threads/t1/runs", "/model/m1/converse", "/v1/messages",
    "/openai/deployments/agents-prod/chat/completions", "/v1/models",
]
_AGENTS = ["Mozilla/5.0 (X11) Firefox/1", "Mozilla/5.0 (compatible; Somebot/2)", "python-requests/2", None, "Mozilla/5.0 (X11) HeadlessChrome/1"]


def _sql_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", _cases(n % 12, _PATHS).alias("path"), F.when(n % 7 != 0, "POST").otherwise("GET").alias("method"), _cases(n % 5, _AGENTS).alias("user_agent"),
        F.when(n % 3 == 0, F.when(n % 2 == 0, "gpt").otherwise("text-embedding")).alias("model"), F.when(n % 12 == 7, "api.openai.com").otherwise("h.example").alias("host"), F.col("ts").cast("timestamp").alias("ts"),
    )


_REQUESTS_SQL = f"""
WITH q AS (SELECT event_id, user_id, {_sql_list(_PATHS)}[event_id % 12 + 1] AS path, CASE WHEN event_id % 7 <> 0 THEN 'POST' ELSE 'GET' END AS method, {_sql_list(_AGENTS)}[event_id % 5 + 1] AS agent,
                  CASE WHEN event_id % 6 = 0 THEN 'gpt' WHEN event_id % 3 = 0 THEN 'text-embedding' END AS model, CASE WHEN event_id % 12 = 7 THEN 'api.openai.com' ELSE 'h.example' END AS host FROM events),
b AS (SELECT *, rtrim(split_part(path, '?', 1), '/') AS bare FROM q)"""


@query(_REQUESTS_SQL + r"""
SELECT event_id, method = 'POST' AND NOT coalesce(regexp_matches(model, 'embed'), false) AND NOT regexp_matches(bare, 'embed')
           AND regexp_matches(bare, '^((/v1|/openai/deployments/[^/]+)?/(chat/completions|completions|messages|responses)|/model/[^/]+/(invoke|converse)(-with-response-stream|-stream)?)$') AS generation,
       coalesce(agent LIKE 'Mozilla/5.0 (%' AND regexp_matches(agent, '[) ](Firefox|Chrome|Safari)/') AND NOT regexp_matches(agent, 'compatible;|Headless'), false) AS browser,
       regexp_matches(bare, '(^|/)mcp$') AS mcp, bare IN ('/healthz', '/static/app.js') AS static,
       CASE WHEN method = 'POST' AND host = 'api.openai.com' AND regexp_matches(bare, '^/v1/threads/[^/]+/runs$') THEN 'Assistants API run' END AS operation FROM b""")
def request_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _requests(spark, sf_dir)
    return r.select(
        "event_id", scalars.is_generation("path", "model", "method").alias("generation"), scalars.is_browser_ua("user_agent").alias("browser"), scalars.is_mcp_request("path", F.lit(False)).alias("mcp"),
        callers.is_static_or_probe(F.col("path")).alias("static"), scalars.agent_operation("path", "method", "host").alias("operation"),
    )


@query("""
SELECT event_id FROM events WHERE event_id % 12 NOT IN (4, 6) AND (event_id % 3 = 0 OR event_id % 12 IN (0, 1, 2, 3, 5, 7, 8, 9, 10) OR user_id % 10 = 0)""")
def llm_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callers.is_llm_traffic(_requests(spark, sf_dir), F.col("user_id") % 10 == 0).select("event_id")


@query("""
SELECT count(*) FILTER (user_id % 10 = 0 AND user_id % 20 <> 0 AND event_id % 12 IN (4, 6, 11)) AS rows_by_untrusted_host, count(*) AS rows FROM events""")
def untrusted_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callers.untrusted_host_report(_requests(spark, sf_dir), F.col("user_id") % 20 == 0, F.col("user_id") % 10 == 0)


@query("""
SELECT user_id AS caller, count(*) FILTER (event_id % 7 <> 0 AND event_id % 12 = 7) AS agent_operations, count(*) FILTER (event_id % 12 = 5) AS mcp_requests, round(avg(CASE WHEN event_id % 5 = 0 THEN 1.0 ELSE 0 END), 9) AS browser_share
FROM events GROUP BY 1""")
def caller_behaviours(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = callers.caller_behaviour(_requests(spark, sf_dir).withColumnRenamed("user_id", "caller"))
    return b.select("caller", "agent_operations", "mcp_requests", F.round("browser_share", 9).alias("browser_share"))


@query("""
SELECT user_id AS caller, array_to_string([x.u || ':' || x.n || ':' || x.m FOR x IN list_sort(list({'u': epoch_us(ts), 'n': event_id, 'm': event_type}))], '|') AS intervals FROM events WHERE event_id % 3 = 0 GROUP BY 1""")
def aggregated_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("caller"), F.col("ts").cast("timestamp").alias("ts"), F.col("ts").cast("timestamp").alias("interval_end"), F.col("event_id").alias("request_count"), F.col("event_type").alias("model"),
        (F.col("event_id") % 3 == 0).alias("aggregated"),
    )
    text = F.transform("intervals", lambda i: F.concat_ws(":", F.unix_micros(i["start"]).cast("string"), i["requests"].cast("string"), i["model"]))
    return callers.usage_intervals(e).select("caller", F.array_join(text, "|").alias("intervals"))


@query("""
SELECT 'u' || user_id AS client, 'h' || (user_id % 5) AS server, epoch_us(date_trunc('hour', ts)) AS bucket_us, count(*) AS flows, CAST(sum(event_id) AS BIGINT) AS bytes FROM events GROUP BY 1, 2, 3""")
def flow_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("client"), F.concat(F.lit("h"), (F.col("user_id") % 5).cast("string")).alias("server"), "ts", F.col("event_id").alias("bytes"))
    return network.rollup_flow_groups(e, ("client", "server")).select("client", "server", F.unix_micros("bucket_start").alias("bucket_us"), "flows", "bytes")


@query("""
SELECT c_custkey AS client, s AS signal, CAST(w AS DOUBLE) AS weight FROM (
  SELECT c_custkey, 'network:dns' AS s, 0.5 AS w FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT c_custkey, 'network:tls', 0.7 FROM customer WHERE c_custkey % 3 > 0
  UNION ALL SELECT c_custkey, 'network:flow', 0.6 FROM customer WHERE c_custkey % 5 > 0 UNION ALL SELECT c_custkey, 'network:cadence', 0.4 FROM customer WHERE c_custkey % 7 > 0)""")
def contact_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("client"), F.lit("s").alias("service"), (k % 2).alias("dns_queries"), (k % 3).alias("tls_connections"), (k % 5).alias("flows"), (k % 7).alias("loops"))
    return network.contact_evidence(c).select("client", "signal", "weight")


# ---------------------------------------------------------------- records of readers


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'tls' WHEN event_id % 3 = 1 THEN 'dns' ELSE 'flow' END AS kind, 'u' || user_id AS client, CASE WHEN event_id % 3 = 1 THEN 'q' || event_type END AS query, CASE WHEN event_id % 3 = 0 THEN 's' || event_type END AS sni,
       CASE WHEN event_id % 3 = 1 THEN '10.0.0.1|10.0.0.2' ELSE '' END AS answers, CASE WHEN event_id % 3 = 2 THEN 443 END AS port, epoch_us(date_trunc('second', ts)) AS us FROM events""")
def network_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, ts = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    who = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    raw = (
        F.when(n % 3 == 0, F.to_json(F.struct(ts.alias("@timestamp"), who.alias("src_ip"), F.concat(F.lit("S"), "event_type").alias("server_name"), n.cast("string").alias("uid"))))
        .when(n % 3 == 1, F.to_json(F.struct(ts.alias("time"), who.alias("client"), F.concat(F.lit("q"), "event_type").alias("qname"), F.lit("10.0.0.1, 10.0.0.2").alias("answer"), n.cast("string").alias("uid"))))
        .otherwise(F.to_json(F.struct(ts.alias("ts"), who.alias("srcaddr"), F.lit("10.9.9.9").alias("dstaddr"), F.lit("443").alias("dstport"), n.cast("string").alias("uid"))))
    )
    r = readers.read_network_generic(table(spark, sf_dir, "events").select(raw.alias("raw")))
    return r.select(F.col("uid").cast("long").alias("event_id"), "kind", "client", "query", "sni", F.coalesce(F.array_join("answers", "|"), F.lit("")).alias("answers"), "port", F.unix_micros("ts").alias("us"))


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority || ' x' END AS priority, o_orderkey % 10 = 0 AS bad FROM orders""")
def logfmt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("status="), "o_orderstatus", F.lit(' priority="'), "o_orderpriority", F.lit(" x"), F.when(F.col("o_orderkey") % 10 != 0, '"').otherwise(""))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), readers.logfmt(line).alias("f"))
    return o.select("id", F.col("f")["status"].alias("status"), F.col("f")["priority"].alias("priority"), F.col("f").isNull().alias("bad"))


@query("""
SELECT 'm' || event_id || CASE WHEN event_id % 4 = 0 THEN '-' || i ELSE '' END AS id, count(*) AS n FROM events, (VALUES (0), (1)) v(i) WHERE event_id % 4 = 0 OR i = 0 GROUP BY 1""")
def unwrapped_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    inner = lambda tail: F.concat(F.lit('{"id":"m'), n.cast("string"), F.lit(tail + '"}'))
    quoted = lambda tail: F.concat(F.lit('"{\\"id\\":\\"m'), n.cast("string"), F.lit(tail + '\\"}"'))
    raw = (
        F.when(n % 4 == 0, F.concat(F.lit('{"logEvents":[{"message":'), quoted("-0"), F.lit('},{"message":'), quoted("-1"), F.lit("}]}")))
        .when(n % 4 == 1, F.concat(F.lit('{"jsonPayload":'), inner(""), F.lit("}")))
        .when(n % 4 == 2, F.concat(F.lit('{"log":"{\\"message\\":{\\"jsonPayload\\":{\\"id\\":\\"m'), n.cast("string"), F.lit('\\"}}}"}')))
        .otherwise(inner(""))
    )
    out = readers.expand_envelopes(table(spark, sf_dir, "events").select(raw.alias("raw")))
    return out.groupBy(F.get_json_object("raw", "$.id").alias("id")).agg(F.count("*").alias("n"))


@query("""
SELECT n_name AS source, count(*) AS examined, count(*) FILTER (c_custkey % 9 = 0) AS malformed, CASE WHEN count(*) FILTER (c_custkey % 9 = 0) > 0 THEN 'incomplete' ELSE 'complete' END AS status FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def source_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return readers.input_completeness(c.select(F.col("n_name").alias("source"), (F.col("c_custkey") % 9 == 0).alias("bad"))).select("source", "examined", "malformed", "status")


# ---------------------------------------------------------------- scalar functions

_URLS = ["HTTPS://H.Example:443/a/?q=1", "http://127.0.0.1:80/", "ws://h.example/x#f", "no url"]


@query(f"""
SELECT p_partkey AS id, {_sql_cases('p_partkey % 4', ['https://h.example/a', 'http://127.0.0.1', 'ws://h.example/x', None])} AS url, p_partkey % 4 = 2 AS plaintext FROM part""")
def endpoint_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _cases(F.col("p_partkey") % 4, _URLS).alias("u"))
    return p.select("id", scalars.normalise_remote_url("u").alias("url"), scalars.plaintext_remote("u").alias("plaintext"))


_RESOURCES = ["arn:aws:lambda:eu:1234:function:f", "/Subscriptions/AB/groups/g", "projects/p1/x/y", "Bot@proj.iam.gserviceaccount.com", "plain"]


@query(f"""
SELECT s_suppkey AS id, {_sql_cases('s_suppkey % 5', ['arn', 'azure', 'gcp', 'service-account', None])} AS type, {_sql_cases('s_suppkey % 5', ['1234', 'ab', 'p1', 'proj', None])} AS scope,
       {_sql_cases('s_suppkey % 5', [_RESOURCES[0], '/subscriptions/ab/groups/g', _RESOURCES[2], 'bot@proj.iam.gserviceaccount.com', None])} AS key,
       'cred-' || substr(sha256('k|' || sha256('k:' || s_name)), 1, 12) AS credential FROM supplier""")
def resource_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_name", scalars.global_resource(_cases(F.col("s_suppkey") % 5, _RESOURCES)).alias("r"))
    return s.select("id", "r.type", "r.scope", "r.key", scalars.credential_id("s_name", "k").alias("credential"))


_PINS = ["pkg@1.2.3", "pkg@latest", "pkg==1.0", "img:v2.1-rc1", "pkg^1.2", "img:stable"]


@query("SELECT p_partkey AS id, p_partkey % 6 IN (0, 2, 3) AS pinned, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag, CAST(CASE p_partkey % 3 WHEN 0 THEN p_size + 0.5 ELSE 0 END AS DOUBLE) AS number FROM part")
def package_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, words = F.col("p_partkey"), ["Yes", " off ", "maybe"]
    number = F.when(k % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".5"))).when(k % 3 == 1, "NaN").otherwise("x")
    p = table(spark, sf_dir, "part")
    return p.select(k.alias("id"), scalars.version_pinned(_cases(k % 6, _PINS)).alias("pinned"), scalars.coerce_bool(_cases(k % 3, words)).alias("flag"), scalars.coerce_double(number).alias("number"))


_SCOPES = [("aws", "123456789012"), ("aws", "1234"), ("azure", "01234567-89ab-cdef-0123-456789abcdef"), ("google", "my-project"), ("google", "X"), ("other", "")]


@query(f"SELECT c_custkey AS id, {_sql_cases('c_custkey % 6', ['true', 'false', 'true', 'true', 'false', 'false'])} = 'true' AS valid FROM customer")
def account_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 6
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), scalars.account_scope_valid(_cases(k, [p for p, _ in _SCOPES]), _cases(k, [a for _, a in _SCOPES])).alias("valid"))


# ---------------------------------------------------------------- repositories


def _tests_or_lib(number: Column) -> Column:
    return F.when(number % 3 == 0, "tests/a").otherwise("lib/a")


@query("""
WITH m AS (SELECT 'p' || (l_orderkey % 50) AS project, l_returnflag AS s, (['dependency', 'import', 'name'])[CAST(l_linenumber % 3 AS INT) + 1] AS type, l_suppkey % 2 = 0 AS amb, CASE WHEN l_partkey % 3 = 0 THEN 'tests/a' ELSE 'lib/a' END || l_partkey || '.py' AS path, CASE WHEN l_partkey % 3 = 0 THEN 0.4 ELSE 0.8 END AS w FROM lineitem),
k AS (SELECT *, bool_or(type <> 'name' AND NOT amb) OVER (PARTITION BY project, s) AS lib FROM m)
SELECT project, s AS signature_id, count(*) AS hits, count(DISTINCT path) AS files, CAST(max(w) AS DOUBLE) AS weight, array_to_string(list_sort(list(DISTINCT type)), '|') AS types FROM k WHERE NOT amb OR lib GROUP BY 1, 2""")
def project_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), (F.col("l_orderkey") % 50).cast("string")).alias("project"), F.col("l_returnflag").alias("signature_id"), _cases(F.col("l_linenumber") % 3, ["dependency", "import", "name"]).alias("type"),
        (F.col("l_suppkey") % 2 == 0).alias("ambiguous"), F.concat(_tests_or_lib(F.col("l_partkey")), F.col("l_partkey").cast("string"), F.lit(".py")).alias("path"), F.lit(0.8).alias("weight"),
    )
    return text_audit.rollup_projects(m).select("project", "signature_id", "hits", "files", "weight", _joined("types"))


@query("""
WITH m AS (SELECT 'f' || (l_orderkey % 400) AS path, 's' || (l_partkey % 40) AS s, CASE WHEN l_suppkey % 10 = 0 AND l_orderkey % 3 = 0 THEN 'env' ELSE 'name' END AS type FROM lineitem),
d AS (SELECT path FROM m GROUP BY path HAVING count(DISTINCT s) >= 15 AND bool_and(type = 'name'))
SELECT path, s AS signature_id, count(*) AS n FROM m WHERE path NOT IN (SELECT path FROM d) GROUP BY 1, 2""")
def catalog_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("f"), (F.col("l_orderkey") % 400).cast("string")).alias("path"), F.concat(F.lit("s"), (F.col("l_partkey") % 40).cast("string")).alias("signature_id"),
        F.when((F.col("l_suppkey") % 10 == 0) & (F.col("l_orderkey") % 3 == 0), "env").otherwise("name").alias("type"),
    )
    return text_audit.catalog_discount(m).groupBy("path", "signature_id").agg(F.count("*").alias("n"))


@query("""
SELECT p_partkey AS id, 'pypi' AS ecosystem, 'lib_' || p_size AS name, CASE WHEN p_size % 2 = 0 THEN '1.' || p_size END AS version FROM part WHERE p_size % 5 <> 0
UNION ALL SELECT p_partkey, 'npm', '@s/' || p_size, '^1.0' FROM part UNION ALL SELECT p_partkey, 'npm', 'dev', '2' FROM part""")
def manifest_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    p = table(spark, sf_dir, "part")
    line = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("# lib_"), size)).when(F.col("p_size") % 2 == 0, F.concat(F.lit("lib_"), size, F.lit("[x] == 1."), size, F.lit(" ; python_version > '3'"))).otherwise(F.concat(F.lit("lib_"), size))
    listed = text_audit.requirements(p.select(F.col("p_partkey").alias("id"), line.alias("value"))).select("id", "ecosystem", "name", "version")
    text = F.concat(F.lit('{"dependencies":{"@s/'), size, F.lit('":"^1.0"},"devDependencies":{"dev":"2"}}'))
    return listed.union(text_audit.package_json(p.select(F.col("p_partkey").alias("id"), text.alias("text"))).select("id", "ecosystem", "name", "version"))


_STEPS = ["claude-sonnet-4 and GPT-4o-mini, gpt-4o-mini", "gpt-none", "uses o3-mini now", "Gemini-1.5-pro|llama3.1"]


@query("""
SELECT c_custkey AS id, m AS model FROM customer, (VALUES (0, 'claude-sonnet-4'), (0, 'gpt-4o-mini'), (2, 'o3-mini'), (3, 'gemini-1.5-pro'), (3, 'llama3.1')) v(k, m) WHERE c_custkey % 4 = k""")
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), _cases(F.col("c_custkey") % 4, _STEPS).alias("text"))
    return text_audit.model_id_literals(c, "id", "text")


_INFRA = 'FROM --platform=x base:1\n  image: "reg/app:2"\n  - name: OPENAI_API_KEY\nresource "aws_x" "y" {'


@query("""
SELECT p AS path, a AS artifact, v AS value FROM (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'deploy/' ELSE '.github/' END || s_suppkey AS p FROM supplier),
  (VALUES ('image', 'base:1', false), ('image', 'reg/app:2', true), ('env', 'OPENAI_API_KEY', false), ('iac', 'aws_x', false)) v(a, v, ci) WHERE NOT ci OR k % 2 = 0""")
def infrastructure_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    files = table(spark, sf_dir, "supplier").select(F.concat(F.when(k % 2 == 0, "deploy/").otherwise(".github/"), k.cast("string")).alias("path"), F.lit(_INFRA).alias("text"))
    return text_audit.artifact_lines(files)


_HOST_LINES = ["0.0.0.0 ads.example", "||ads.example^$x", "DOMAIN-SUFFIX,ads.example", "import openai", None]


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 >= 3")
def lines_of_no_rule_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _cases(F.col("o_orderkey") % 5, _HOST_LINES).alias("line"))
    return text_audit.drop_rule_lists(o, "line").select("id")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 'n' || o_custkey AS p, 'n' || (o_custkey * 3 % 200) AS r FROM orders),
w(p, d) AS (SELECT DISTINCT 'n' || n_nationkey, 0 FROM nation UNION SELECT e.r, w.d + 1 FROM w JOIN e ON e.p = w.p WHERE w.d < 200)
SELECT p AS package, CASE WHEN min(d) = 0 THEN 'direct' ELSE 'transitive' END AS relation, CAST(min(d) AS INT) AS depth FROM w GROUP BY p""")
def package_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    edges = table(spark, sf_dir, "orders").select(name(F.col("o_custkey")).alias("package"), name(F.col("o_custkey") * 3 % 200).alias("requires")).distinct()
    return text_audit.locked_packages(edges, table(spark, sf_dir, "nation").select(name(F.col("n_nationkey")).alias("package")))


@query("""
WITH d AS (SELECT doc_id, text, lang FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 'domain' AS type, 'sig.mail' AS signature_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([lower(h) FOR h IN regexp_extract_all(text, '(?i)\\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\\.)+[a-z]{2,24}\\b')]) AS h FROM d) WHERE h = 'example.com' OR h LIKE '%.example.com' GROUP BY 1
UNION ALL SELECT doc_id, 'file', 'sig.en', 1 FROM d WHERE lang = 'en'
UNION ALL SELECT doc_id, 'code', 'sig.the', least(3, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\\+[0-9]+ \\([0-9]{3}\\)')))) FROM d WHERE regexp_matches(text, '\\+[0-9]+ \\([0-9]{3}\\)')""")
def file_scan_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = spark.createDataFrame([
        ("sig.mail", "platform", "domain", None, None, "suffix", "example.com", 0.5, None, False), ("sig.en", "framework", "file", None, None, "glob", "*.en", 0.5, None, False),
        ("sig.the", "framework", "code", None, None, "regex", r"\+[0-9]+ \([0-9]{3}\)", 0.5, "+", False),
    ], SIGNAL_SCHEMA)
    files = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"), "text").where("text is not null")
    hits = text_audit.file_scan(files, signals)
    return hits.groupBy(F.split("path", r"\.")[0].cast("long").alias("doc_id"), "type", "signature_id").agg(F.count("*").alias("n"))


@query("""
SELECT 'w' || o_custkey AS workflow, count(*) AS steps, count(*) FILTER (o_orderkey % 4 = 1) AS ai_steps, CASE max(CASE WHEN o_orderkey = f THEN o_orderkey % 4 END) WHEN 0 THEN 'schedule' WHEN 2 THEN 'event' END AS trigger
FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS f FROM orders) GROUP BY o_custkey HAVING count(*) FILTER (o_orderkey % 4 = 1) > 0""")
def ai_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    o = table(spark, sf_dir, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    steps = o.select(
        F.concat(F.lit("w"), F.col("o_custkey").cast("string")).alias("workflow"), F.lit("n").alias("name"), F.lit("o").alias("owner"), F.lit(True).alias("active"),
        _cases(F.col("o_orderkey") % 4, ["cron", "OpenAI chat", "webhook", "set"]).alias("step_type"), place.alias("ord"),
    )
    return lowcode.lowcode_ai_workflows(steps).select("workflow", "steps", "ai_steps", "trigger")


@query("""
SELECT doc_id, n AS name FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text || CASE WHEN doc_id % 3 = 0 THEN ' set OPENAI_API_KEY=1 and MY_VAR' ELSE '' END, '\\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\\b')) AS n FROM documents WHERE text IS NOT NULL) WHERE n = 'OPENAI_API_KEY'""")
def environment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 3 == 0, " set OPENAI_API_KEY=1 and MY_VAR").otherwise("")).alias("text"))
    signals = spark.createDataFrame([("e.key", "provider", "env", None, None, "exact", "OPENAI_API_KEY", 0.6, None, False)], SIGNAL_SCHEMA)
    return matching.match_envs_in_text(d, signals, "doc_id", "text").select("doc_id", "name")
