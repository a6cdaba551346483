"""Driver queries on log exports, signatures and findings built from the given tables; each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhawk.operators import findings, matching, network, normalise, reconcile, reports
from tallyhawk.plans.queries_texts import SIGNAL_SCHEMA
from tallyhawk.plans.registry import query
from tallyhawk.plans.session import table
from tallyhawk.streaming import callers as streaming

#: How one event looks in each export: text with places for user, event type, id and time.
EXPORTS = (
    ("litellm", '{"api_key":"u%U","call_type":"completion","spend":0.5,"model":"m-%E","custom_llm_provider":"p%T","startTime":"%S","prompt_tokens":%I}'),
    ("portkey", '{"trace_id":"t%I","virtual_key":"u%U","created_at":"%S","ai_model":"m-%E","ai_provider":"p%T"}'),
    ("kong", '{"consumer":{"username":"u%U"},"started_at":"%S","ai":{"proxy":{"meta":{"response_model":"m-%E","provider_name":"p%T"}}},"note":"ai.proxy"}'),
    ("cloudflare", '{"gateway_id":"g","api_key_id":"u%U","created_at":"%S","model":"m-%E","provider":"p%T"}'),
    ("helicone", '{"request_user_id":"u%U","request_created_at":"%S","request_model":"m-%E","provider":"p%T","source":"helicone"}'),
    ("langfuse", '{"observation_id":"o%I","userId":"u%U","startTime":"%S","model":"m-%E"}'),
    ("bedrock", '{"schemaType":"ModelInvocationLog","identity":{"arn":"u%U"},"timestamp":"%S","modelId":"m-%E","input":{"inputTokenCount":%I}}'),
    ("azure-openai", '{"category":"RequestResponse","callerIpAddress":"10.0.0.%T","resourceId":"/r","time":"%S","identity":{"claims":{"oid":"u%U"}},"properties":"{\\"modelName\\":\\"m-%E\\",\\"more\\":{\\"deep\\":{\\"n\\":%I}}}"}'),
    ("openai-usage", '{"object":"organization.usage.completions.result","api_key_id":"u%U","start_time":"%S","model":"m-%E","input_tokens":%I}'),
    ("anthropic-usage", '{"uncached_input_tokens":%I,"workspace_id":"u%U","starting_at":"%S","model":"m-%E"}'),
    ("access-log", '{"remote_user":"u%U","remote_addr":"10.0.0.1","request":"POST /v1/messages HTTP/1.1","time":"%S"}'),
    ("generic", '{"user_id":"u%U","timestamp":"%S","model":"m-%E"}'),
)
_PREFIX = {"azure-openai": "azure", "bedrock": "aws", "openai-usage": "openai", "anthropic-usage": "anthropic", "access-log": "proxy", "generic": "log"}


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a record of one of the exports, by its id."""
    e = table(spark, sf_dir, "events").where("event_id is not null")
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw = None
    for k, (_, form) in enumerate(EXPORTS):
        text = F.lit(form)
        for place, value in (("%U", F.col("user_id")), ("%E", F.col("event_type")), ("%T", F.col("event_id") % 7), ("%I", F.col("event_id")), ("%S", when)):
            text = F.replace(text, F.lit(place), value.cast("string"))
        mine = F.col("event_id") % len(EXPORTS) == k
        raw = F.when(mine, text) if raw is None else raw.when(mine, text)
    return e.select("event_id", raw.alias("raw"))


_NAMES = "[" + ", ".join(f"'{n}'" for n, _ in EXPORTS) + "]"
_PREFIXES = "[" + ", ".join(f"'{_PREFIX.get(n, n)}'" for n, _ in EXPORTS) + "]"


@query(f"SELECT event_id, {_NAMES}[CAST(event_id % {len(EXPORTS)} AS INT) + 1] AS schema FROM events WHERE event_id IS NOT NULL")
def schema_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise.detect_log_schema(exports(spark, sf_dir)).select("event_id", "schema")


@query(f"""
WITH r AS (SELECT *, {_NAMES}[CAST(event_id % {len(EXPORTS)} AS INT) + 1] AS schema, {_PREFIXES}[CAST(event_id % {len(EXPORTS)} AS INT) + 1] AS prefix FROM events WHERE event_id IS NOT NULL)
SELECT schema, prefix || ':u' || user_id AS caller,
       CASE WHEN schema IN ('litellm', 'portkey', 'cloudflare', 'openai-usage') THEN 'api-key' WHEN schema IN ('kong', 'bedrock', 'azure-openai', 'anthropic-usage') THEN 'principal' ELSE 'user' END AS caller_kind,
       CASE WHEN schema <> 'access-log' THEN 'm-' || event_type END AS model,
       CASE WHEN schema IN ('litellm', 'portkey', 'kong', 'cloudflare', 'helicone') THEN 'p' || (event_id % 7) WHEN schema = 'bedrock' THEN 'aws-bedrock' WHEN schema = 'azure-openai' THEN 'azure-openai'
            WHEN schema = 'openai-usage' THEN 'openai' WHEN schema = 'anthropic-usage' THEN 'anthropic' END AS provider,
       epoch_us(date_trunc('second', ts)) AS us, CAST(CASE WHEN schema IN ('litellm', 'bedrock', 'openai-usage', 'anthropic-usage') THEN event_id ELSE 0 END AS BIGINT) AS tokens_in
FROM r""")
def normalised_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = normalise.normalise_all(exports(spark, sf_dir).select("raw"))
    return n.select("schema", "caller", "caller_kind", "model", "provider", F.unix_micros("ts").alias("us"), F.coalesce(F.col("tokens_in"), F.lit(0)).cast("long").alias("tokens_in"))


@query("""
WITH part_ AS (SELECT * REPLACE (lower(replace(p_brand, '#', '-')) AS p_brand) FROM part),
s AS (SELECT 'srv' || p_partkey AS server_id, CASE WHEN p_partkey % 3 = 0 THEN 'pkg-' || p_brand END AS package, CASE WHEN p_partkey % 3 = 1 THEN 'https://h.example/' || p_brand END AS url, 'own' || p_partkey AS name, CAST(p_partkey AS VARCHAR) AS version FROM part_),
r AS (SELECT 'io/' || p_brand AS entry, CAST(arg_max(CAST(p_partkey AS VARCHAR), p_retailprice * 1e9 + p_partkey) AS VARCHAR) AS latest, list(CAST(p_partkey AS VARCHAR)) AS all_versions, p_brand FROM part_ WHERE p_brand <> 'brand-11' GROUP BY p_brand),
j AS (SELECT s.*, r.* FROM s LEFT JOIN r ON s.package = 'pkg-' || r.p_brand OR s.url = 'https://h.example/' || r.p_brand)
SELECT server_id, entry, latest,
       array_to_string([x FOR x IN [CASE WHEN entry IS NOT NULL THEN 'mcp-registry-published' END, CASE WHEN entry IS NULL AND (package IS NOT NULL OR url IS NOT NULL) THEN 'mcp-unpublished' END,
         CASE WHEN entry IS NULL AND package IS NULL AND url IS NULL THEN 'mcp-registry-unidentified' END,
         CASE WHEN entry IS NOT NULL AND NOT list_contains(all_versions, version) THEN 'mcp-registry-version-unpublished' END,
         CASE WHEN entry IS NOT NULL AND list_contains(all_versions, version) AND version <> latest THEN 'mcp-registry-outdated' END] IF x IS NOT NULL], '|') AS tags FROM j""")
def mcp_registry_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("p_brand", F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))))
    third, version = F.col("p_partkey") % 3, F.col("p_partkey").cast("string")
    servers = p.select(
        F.concat(F.lit("srv"), "p_partkey").alias("server_id"), F.when(third == 0, F.concat(F.lit("pkg-"), "p_brand")).alias("package"), version.alias("version"),
        F.when(third == 1, F.concat(F.lit("https://h.example/"), "p_brand")).alias("url"), F.concat(F.lit("own"), "p_partkey").alias("name"),
    )
    registry = p.where("p_brand <> 'brand-11'").select(
        F.concat(F.lit("io/"), "p_brand").alias("name"), version.alias("version"), F.lit("active").alias("status"), (F.col("p_retailprice") * 1e9 + F.col("p_partkey")).alias("published_at"),
        F.array(F.concat(F.lit("pkg-"), "p_brand")).alias("packages"), F.array(F.concat(F.lit("https://h.example/"), "p_brand")).alias("remotes"),
    )
    return reconcile.match_mcp_registry(servers, registry).select("server_id", "entry", "latest", F.array_join("tags", "|").alias("tags"))


_VALUES = (
    ("v.steel", "platform", "name", "regex", "STEEL$", 0.5), ("v.promo", "framework", "name", "prefix", "promo", 0.6), ("v.brass", "provider", "name", "exact", "large brushed brass", 0.9),
)


def _value_signals(spark: SparkSession, of: str) -> DataFrame:
    rows = [(i, c, of, None, None, m, v, w, None, c == "framework") for i, c, _, m, v, w in _VALUES]
    return spark.createDataFrame(rows, SIGNAL_SCHEMA)


def _values_sql(of: str) -> str:
    return f"""
SELECT p_partkey, '{of}' AS type, s AS signature_id, CAST(w AS DOUBLE) AS weight FROM (
  SELECT p_partkey, 'v.steel' AS s, 0.5 AS w FROM part WHERE regexp_matches(p_type, 'STEEL$')
  UNION ALL SELECT p_partkey, 'v.promo', 0.6 FROM part WHERE starts_with(lower(p_type), 'promo')
  UNION ALL SELECT p_partkey, 'v.brass', 0.9 FROM part WHERE lower(p_type) = 'large brushed brass')"""


#: User agents, names, models, images, environment names, client ids, scopes and resource types are matched alike.
VALUE_TYPES = ("user_agent", "name", "model", "image", "env", "client_id", "scope", "iac")


@query(" UNION ALL ".join(_values_sql(t) for t in VALUE_TYPES))
def value_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    found = [matching.match_values(p, _value_signals(spark, t), "p_type", t).select("p_partkey", "type", "signature_id", "weight") for t in VALUE_TYPES]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, 'l.mail' AS signature_id, line, regexp_extract(x, '[a-z.0-9]+@mail[0-9]', 0) AS value FROM l WHERE regexp_matches(x, '[a-z.0-9]+@mail[0-9]')
      UNION ALL SELECT doc_id, 'l.phone', line, regexp_extract(x, '\+[0-9]+ \([0-9]{3}\)', 0) FROM l WHERE regexp_matches(x, '\+[0-9]+ \([0-9]{3}\)'))
SELECT doc_id, signature_id, CAST(line AS BIGINT) AS line, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, signature_id ORDER BY line, value) AS k FROM h) WHERE k <= 3""")
def line_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("l.mail", "framework", "code", None, None, "regex", r"[a-z.0-9]+@mail[0-9]", 0.5, "@mail", False), ("l.phone", "framework", "code", None, None, "regex", r"\+[0-9]+ \([0-9]{3}\)", 0.5, "+", False)]
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return matching.match_lines(d, spark.createDataFrame(rows, SIGNAL_SCHEMA), "code", key="doc_id").select("doc_id", "signature_id", F.col("line").cast("long").alias("line"), "value")


@query("""
SELECT doc_id, s AS signature_id FROM (
  SELECT doc_id, 'f.en' AS s FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'f.src1' FROM documents WHERE regexp_matches(source, '^src1[^/]*$'))""")
def file_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("f.en", "framework", "file", None, None, "glob", "en.txt", 0.5, None, False), ("f.src1", "framework", "file", None, None, "glob", "src1*/*.txt", 0.5, None, False)]
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("data/"), "source", F.lit("/"), "lang", F.lit(".txt")).alias("path"))
    return matching.match_file(d, spark.createDataFrame(rows, SIGNAL_SCHEMA)).select("doc_id", "signature_id")


@query("""
WITH s AS (SELECT o_custkey AS app_id, lower(o_orderpriority) AS scope FROM orders)
SELECT app_id, string_agg(DISTINCT CASE WHEN scope IN ('1-urgent', '2-high') THEN 'privileged' ELSE 'data-access' END, '|' ORDER BY CASE WHEN scope IN ('1-urgent', '2-high') THEN 'privileged' ELSE 'data-access' END) AS tags
FROM s WHERE scope IN ('1-urgent', '2-high', '5-low') GROUP BY app_id""")
def permission_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = spark.createDataFrame([("1-Urgent", "privileged"), ("2-HIGH", "privileged"), ("5-low", "data-access")], "scope string, tag string")
    grants = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("app_id")).agg(F.collect_set("o_orderpriority").alias("scopes"))
    return matching.classify_permissions(grants, policies).select("app_id", F.array_join("tags", "|").alias("tags"))


_KINDS = "['agent', 'token', 'agent-config', 'service-identity', 'oauth-grant', 'secret', 'mcp-server']"


@query(f"""
WITH r AS (SELECT l_orderkey AS id, {_KINDS}[CAST(l_partkey % 7 AS INT) + 1] AS kind, 'type' || (l_suppkey % 3) AS t FROM lineitem),
p AS (SELECT *, CASE kind WHEN 'agent' THEN 3 WHEN 'service-identity' THEN 2 WHEN 'oauth-grant' THEN 1 ELSE 0 END AS p FROM r)
SELECT id, first(kind ORDER BY p DESC, kind DESC, t DESC) AS kind, first(t ORDER BY p DESC, kind DESC, t DESC) AS resource_type,
       CASE WHEN count(DISTINCT kind) > 1 THEN string_agg(DISTINCT kind, '|' ORDER BY kind) END AS observed_kinds, count(*) AS observations FROM p GROUP BY id""")
def merge_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k.strip("' ")) for k in _KINDS.strip("[]").split(",")])
    f = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.element_at(kinds, (F.col("l_partkey") % 7).cast("int") + 1).alias("kind"), F.concat(F.lit("type"), (F.col("l_suppkey") % 3).cast("string")).alias("resource_type"),
        F.lit(0).alias("first_seen"), F.lit(0).alias("last_seen"), F.lit(0).alias("ord"),
    )
    return findings.merge_findings(f, lists=(), firsts=()).select("id", "kind", "resource_type", F.array_join("observed_kinds", "|").alias("observed_kinds"), "observations")


@query("""
WITH e AS (SELECT l_orderkey AS id, l_orderkey % 2 = 0 AS code, l_linestatus AS s, CASE WHEN l_linenumber % 4 = 0 THEN 'g' END AS g, least(greatest((CAST(l_linenumber AS DOUBLE) - 1) / 5, 0), 1) AS w, row_number() OVER () AS n FROM lineitem),
m AS (SELECT id, max(w) AS w FROM e GROUP BY id, CASE WHEN g IS NOT NULL THEN 'group' WHEN code THEN 'row' || n ELSE 'signal' || s END)
SELECT id, round(1 - product(1 - w), 3) AS confidence FROM m GROUP BY id""")
def confidence_by_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.when(F.col("l_orderkey") % 2 == 0, "code").otherwise("gateway").alias("surface"), F.col("l_linestatus").alias("signal"),
        F.when(F.col("l_linenumber") % 4 == 0, "g").alias("confidence_group"), ((F.col("l_linenumber").cast("double") - 1) / 5).alias("weight"),
    )
    return findings.noisy_or_confidence(e, "id")


@query("""
WITH x AS (SELECT o_orderkey AS id, o_clerk AS k FROM (SELECT o_orderkey, o_custkey, CASE o_custkey % 4 WHEN 0 THEN 'c' || o_custkey WHEN 1 THEN 'c[' || o_custkey || ']' WHEN 2 THEN 'c*' || o_custkey ELSE ' c' || o_custkey END AS o_clerk FROM orders))
SELECT id, NOT regexp_matches(k, '[*?\\[\\]]') AND trim(k) = k AS usable FROM x""")
def usable_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyhawk.functions.scalars import usable_identity

    c, four = F.col("o_custkey").cast("string"), F.col("o_custkey") % 4
    k = F.when(four == 0, F.concat(F.lit("c"), c)).when(four == 1, F.concat(F.lit("c["), c, F.lit("]"))).when(four == 2, F.concat(F.lit("c*"), c)).otherwise(F.concat(F.lit(" c"), c))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), usable_identity(k).alias("usable"))


@query("""
WITH t AS (SELECT DISTINCT user_id, ts FROM events WHERE ts IS NOT NULL),
n AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT 'u' || user_id AS caller, epoch_us(min(ts)) AS start_us, count(*) AS calls FROM r GROUP BY user_id, run HAVING count(*) >= 3""")
def session_loops_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("caller"), F.col("ts").cast("timestamp").alias("ts"))
    return streaming.session_loops(e, gap="1 hour").select("caller", F.unix_micros("start").alias("start_us"), "calls")


@query("""
SELECT event_id, 'k' || json_extract_string(props, '$.k') AS ip, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + least(coalesce(CAST(floor(value) AS BIGINT) * 5000, 86400), 86400) + 5 AS "end" FROM events""")
def dns_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select(
        "event_id", "ts", F.array(F.concat(F.lit("k"), F.get_json_object("props", "$.k"))).alias("answers"), F.when(F.col("value").isNotNull(), F.array(F.floor("value").cast("long") * 5000)).alias("ttls"),
    )
    return network.dns_validity(d, ["event_id", "ip"])


@query("""
SELECT CAST(o_orderkey AS BIGINT) AS src, CAST(o_custkey AS BIGINT) AS dst FROM orders WHERE o_orderkey % 3 <> 0 AND EXISTS (SELECT 1 FROM orders x WHERE x.o_orderkey = orders.o_custkey AND x.o_orderkey % 3 <> 0)""")
def pruned_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    links = o.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    return findings.prune_links(links, o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"))).select("src", "dst")


@query("""
SELECT id, surface, title, place FROM (
  SELECT o_orderkey AS id, o_orderpriority AS surface, o_orderstatus AS title, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 10""")
def top_of_each_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("surface"), F.col("o_orderstatus").alias("title"), F.col("o_totalprice").alias("price"))
    top = findings.cap_per_group(o, ["surface"], [F.desc("price"), F.asc("id")], 10)
    from pyspark.sql.window import Window

    return top.withColumn("place", F.row_number().over(Window.partitionBy("surface").orderBy(F.desc("price"), "id")).cast("long")).select("id", "surface", "title", "place")


@query("""
SELECT l_orderkey AS finding_id, l_returnflag AS signal, l_linestatus AS location, max(l_quantity) AS weight FROM lineitem GROUP BY 1, 2, 3""")
def distinct_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding_id"), F.col("l_returnflag").alias("signal"), F.col("l_linestatus").alias("location"), F.lit("d").alias("description"), F.col("l_quantity").alias("weight"))
    return findings.dedupe_evidence(e).select("finding_id", "signal", "location", "weight")


@query("""
SELECT c_mktsegment AS registry, count(*) AS records, count(*) FILTER (c_nationkey % 2 = 0) AS approved, count(*) FILTER (c_nationkey % 5 = 0) AS automatic, bool_and(c_acctbal > -999.5) AS listing_complete FROM customer GROUP BY 1""")
def registry_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("registry"), F.when(F.col("c_nationkey") % 2 == 0, "approved").otherwise("draft").alias("status"),
        F.when(F.col("c_nationkey") % 5 == 0, "auto").otherwise("manual").alias("approval_mode"), (F.col("c_acctbal") > -999.5).alias("listing_complete"),
    )
    return reports.registry_rollup(c)


@query("""
SELECT n_name AS ref, count(DISTINCT c_custkey) AS findings, r_name AS title FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 3""")
def control_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    refs = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("ref"))
    titles = n.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("ref"), F.col("r_name").alias("title"))
    return reports.reference_counts(refs, titles)


_FINDINGS = """
WITH f AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice / 5000) AS BIGINT) AS score, CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS shadow, o_orderpriority AS level,
                  CASE o_custkey % 5 WHEN 0 THEN 'secret' WHEN 1 THEN 'token' ELSE 'agent' END AS kind, CASE WHEN o_custkey % 3 <> 0 THEN 'team' || (o_custkey % 11) END AS owner FROM orders)"""


@query(_FINDINGS + """
SELECT 'level' AS part, level AS name, count(*) AS n, count(*) FILTER (owner IS NULL) AS unowned, count(*) FILTER (shadow) AS shadow, max(score) AS worst FROM f WHERE kind <> 'secret' GROUP BY level
UNION ALL SELECT 'kind', kind, count(*), count(*) FILTER (owner IS NULL), count(*) FILTER (shadow), max(score) FROM f WHERE kind <> 'secret' GROUP BY kind
UNION ALL SELECT 'owner', coalesce(owner, 'unowned'), count(*), count(*) FILTER (owner IS NULL), count(*) FILTER (shadow), max(score) FROM f WHERE kind <> 'secret' GROUP BY owner
UNION ALL SELECT 'status', CASE WHEN shadow THEN 'shadow' WHEN NOT shadow THEN 'registered' ELSE 'unassessed' END, count(*), count(*) FILTER (owner IS NULL), count(*) FILTER (shadow), max(score) FROM f WHERE kind <> 'secret' GROUP BY 2
UNION ALL SELECT 'total', 'all', count(*), count(*) FILTER (owner IS NULL), count(*) FILTER (shadow), max(score) FROM f WHERE kind <> 'secret'""")
def inventory_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 5000).cast("long").alias("score"), F.when(F.col("o_orderstatus") == "O", True).when(F.col("o_orderstatus") == "F", False).alias("shadow"),
        F.col("o_orderpriority").alias("level"), F.when(F.col("o_custkey") % 5 == 0, "secret").when(F.col("o_custkey") % 5 == 1, "token").otherwise("agent").alias("kind"),
        F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("team"), (F.col("o_custkey") % 11).cast("string"))).alias("owner"),
    )
    return reports.inventory_document(f)


@query(_FINDINGS + """
SELECT place, id FROM (SELECT id, row_number() OVER (ORDER BY CASE WHEN shadow THEN 0 WHEN shadow IS NULL THEN 1 ELSE 2 END, score DESC, id) AS place FROM f) WHERE place <= 100""")
def fleet_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    f = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 5000).alias("score"), F.lit(0).alias("danger_score"), F.lit(1.0).alias("confidence"),
        F.when(F.col("o_orderstatus") == "O", True).when(F.col("o_orderstatus") == "F", False).alias("shadow"),
    )
    top = findings.order_fleet(f).limit(100)  # a top-k report
    rank = F.when(F.col("shadow"), 0).when(F.col("shadow").isNull(), 1).otherwise(2)
    return top.withColumn("place", F.row_number().over(Window.orderBy(rank, F.desc("score"), "id")).cast("long")).select("place", "id")
