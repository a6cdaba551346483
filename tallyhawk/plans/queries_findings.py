"""Driver queries on the order tables: findings, reconciliation, risk, reports; each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhawk.functions import weights as W
from tallyhawk.functions.scalars import finding_id, likelihood
from tallyhawk.operators import correlate, findings, governance, reconcile, reports
from tallyhawk.plans.registry import query
from tallyhawk.plans.session import table


def _values(rows: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


@query("""
SELECT s_suppkey, 'ss-' || left(sha256('["2","cloud","demo",null,"' || s_nationkey || '",null,"' || s_name || '",null]'), 16) AS id FROM supplier""")
def finding_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "supplier").select("s_suppkey", finding_id(F.lit("2"), F.lit("cloud"), F.lit("demo"), none, F.col("s_nationkey"), none, F.col("s_name"), none).alias("id"))


@query("""
WITH l AS (SELECT *, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey AS ord FROM lineitem)
SELECT l_orderkey AS id, list_aggregate(list_sort(list_distinct(list(l_returnflag))), 'string_agg', '|') AS tags, list_aggregate(list_sort(list_distinct(list(l_linestatus))), 'string_agg', '|') AS capabilities,
       arg_min(CAST(l_partkey AS VARCHAR), ord) AS owner, min(epoch_us(l_shipdate)) AS first_us, max(epoch_us(l_shipdate)) AS last_us, count(*) AS observations
FROM l GROUP BY l_orderkey""")
def merge_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    t = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    rows = l.select(F.col("l_orderkey").alias("id"), F.array("l_returnflag").alias("tags"), F.array("l_linestatus").alias("capabilities"), F.col("l_partkey").cast("string").alias("owner"), F.lit("x").alias("title"), F.lit("agent").alias("kind"), t.alias("first_seen"), t.alias("last_seen"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("ord"))
    out = findings.merge_findings(rows, firsts=("owner",))
    return out.select("id", F.array_join("tags", "|").alias("tags"), F.array_join("capabilities", "|").alias("capabilities"), "owner", F.col("first_seen").alias("first_us"), F.col("last_seen").alias("last_us"), "observations")


@query("""
WITH r AS (SELECT o_custkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS report, CAST(floor(o_totalprice / 5000) AS INT) AS score, CAST(o_orderkey % 7 AS INT) AS danger, epoch_us(o_orderdate) AS t,
                  CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS shadow, CASE o_orderstatus WHEN 'F' THEN o_orderpriority END AS m FROM orders)
SELECT id, max(score) AS score, arg_max(danger, score * 10 + danger) AS danger_score, string_agg(DISTINCT report, ',' ORDER BY report) AS sources, min(t) AS first_us, max(t) AS last_us,
       bool_or(shadow) AS shadow, CASE WHEN count(DISTINCT m) > 1 THEN 'ambiguous' ELSE max(m) END AS registry_match FROM r GROUP BY id""")
def fleet_merge_max_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    shadow = F.when(F.col("o_orderstatus") == "O", True).when(F.col("o_orderstatus") == "F", False)
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd").alias("report"), F.floor(F.col("o_totalprice") / 5000).cast("int").alias("score"), (F.col("o_orderkey") % 7).cast("int").alias("danger_score"), t.alias("first_seen"), t.alias("last_seen"), shadow.alias("shadow"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("registry_match"))
    out = reports.fleet_merge(rows)
    return out.select("id", "score", "danger_score", F.array_join("sources", ",").alias("sources"), F.col("first_seen").alias("first_us"), F.col("last_seen").alias("last_us"), "shadow", "registry_match")


_SIDES = """
WITH b AS (SELECT c_custkey AS id, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer WHERE c_custkey % 10 <> 1),
c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'MOVED' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 11 = 0 THEN '99' ELSE CAST(c_nationkey AS VARCHAR) END AS nation FROM customer WHERE c_custkey % 10 <> 2)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    moved = c.where("id % 10 <> 2").select("id", F.when(F.col("id") % 7 == 0, "MOVED").otherwise(F.col("segment")).alias("segment"), F.when(F.col("id") % 11 == 0, "99").otherwise(F.col("nation")).alias("nation"))
    return c.where("id % 10 <> 1"), moved


@query(_SIDES + """
SELECT coalesce(b.id, c.id) AS id, CASE WHEN b.id IS NULL THEN 'new' WHEN c.id IS NULL THEN 'resolved' WHEN b.segment = c.segment AND b.nation = c.nation THEN 'same' ELSE 'changed' END AS change
FROM b FULL OUTER JOIN c ON b.id = c.id""")
def report_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = _sides(spark, sf_dir)
    return reports.diff_reports(b, c, ["segment", "nation"])


@query(_SIDES + """
SELECT b.id, f.field, f.before, f.after FROM b JOIN c ON b.id = c.id,
LATERAL (SELECT 'segment' AS field, b.segment AS before, c.segment AS after UNION ALL SELECT 'nation', b.nation, c.nation) f WHERE f.before <> f.after""")
def field_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = _sides(spark, sf_dir)
    return reports.field_drift(b, c, ["segment", "nation"])


@query(_SIDES + """
SELECT 'governance' AS class, count(DISTINCT b.id) AS findings, bool_or(c.segment = 'MOVED') AS any_adverse FROM b JOIN c ON b.id = c.id WHERE b.segment <> c.segment""")
def drift_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = _sides(spark, sf_dir)
    pairs = b.select("id", F.array("segment").alias("b_tags")).join(c.select("id", F.array("segment").alias("c_tags")), "id")
    return reports.drift_totals(reports.drift(pairs, lists=("tags",), scalars=()))


_PAIRS = """
WITH r AS (SELECT 's-' || s_suppkey AS e, 'supplier' AS c, s_nationkey || ':' || CAST(floor(s_acctbal / 100) AS BIGINT) AS k FROM supplier
           UNION SELECT 'c-' || c_custkey, 'customer', c_nationkey || ':' || CAST(floor(c_acctbal / 100) AS BIGINT) FROM customer),
ok AS (SELECT k FROM r GROUP BY k HAVING count(DISTINCT e) BETWEEN 2 AND 25)
SELECT a.k AS key, a.e AS src, b.e AS dst FROM r a JOIN r b ON a.k = b.k AND a.e < b.e AND a.c <> b.c JOIN ok ON ok.k = a.k"""


@query(_PAIRS)
def correlate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda name, p, e: table(spark, sf_dir, name).select(F.concat(F.lit(e), F.col("s_suppkey" if name == "supplier" else "c_custkey")).alias("e"), F.lit(name).alias("connector"), F.concat(F.col(f"{p}nationkey"), F.lit(":"), F.floor(F.col(f"{p}acctbal") / 100)).alias("k"))
    rows = side("supplier", "s_", "s-").union(side("customer", "c_", "c-"))
    return correlate.key_pairs(rows, "k", "e", 25, ("connector",))


@query("""
WITH r AS (SELECT p_partkey AS e, p_brand AS c, p_type AS s, regexp_replace(lower(p_name || p_size), '[^a-z0-9]+', '', 'g') AS k, p_brand || p_type || p_size AS x FROM part),
okx AS (SELECT x FROM r GROUP BY x HAVING count(DISTINCT e) BETWEEN 2 AND 25),
ex AS (SELECT DISTINCT a.e AS src, b.e AS dst FROM r a JOIN r b ON a.x = b.x AND a.e < b.e JOIN okx ON okx.x = a.x),
okk AS (SELECT k FROM r WHERE length(k) >= 8 GROUP BY k HAVING count(DISTINCT e) BETWEEN 2 AND 25)
SELECT DISTINCT a.k AS key, a.e AS src, b.e AS dst FROM r a JOIN r b ON a.k = b.k AND a.e < b.e AND (a.c <> b.c OR a.s <> b.s) JOIN okk ON okk.k = a.k
WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.src = a.e AND ex.dst = b.e)""")
def correlate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    exact = correlate.key_pairs(p.select(F.col("p_partkey").alias("e"), F.concat("p_brand", "p_type", "p_size").alias("k")), "k", "e", 25, ())
    names = p.select(F.concat("p_name", "p_size").alias("name"), F.col("p_partkey").alias("finding_id"), F.col("p_brand").alias("connector"), F.col("p_type").alias("surface"))
    return correlate.correlate_candidates(names, exact).select("key", "src", "dst")


APPROVALS = [("A1", "red *", None), ("A2", "* bolt", None), ("A3", "blue widget", None), ("A4", "small r?ng", "PROMO"), ("A5", "large*", "LARGE"), ("A6", "green gear", "Q")]


@query(f"""
WITH inv AS (SELECT * FROM {_values([(a, p.replace('*', '%').replace('?', '_'), t) for a, p, t in APPROVALS])} v(agent, pat, typ)),
h AS (SELECT p_partkey, count(DISTINCT agent) AS n, min(agent) AS one FROM part LEFT JOIN inv ON p_name LIKE pat AND (typ IS NULL OR typ = p_type) GROUP BY p_partkey)
SELECT p_partkey AS id, n <> 1 AS shadow, CASE WHEN n = 1 THEN one END AS registry_match, CASE WHEN n > 1 THEN 'ambiguous-resource-approval' WHEN n = 1 THEN 'approved' ELSE 'unregistered' END AS reason FROM h""")
def inventory_glob_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    inv = spark.createDataFrame(APPROVALS, "agent_id string, pattern string, typ string")
    inv = inv.select("agent_id", "pattern", F.when(F.col("typ").isNull(), empty).otherwise(F.array("typ")).alias("surfaces"), empty.alias("providers"), empty.alias("accounts"), empty.alias("regions"))
    f = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("resource"), F.col("p_type").alias("surface"), F.lit("p").alias("provider"), F.lit("a").alias("account"), F.lit("r").alias("region"))
    return reconcile.reconcile_inventory(f, inv).select("id", F.col("shadow_now").alias("shadow"), F.col("match_now").alias("registry_match"), "reason")


@query("""
WITH f AS (SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 0 THEN 'identity' ELSE 'gateway' END AS surface, 'principal:' || c_mktsegment || '-' || c_custkey AS resource,
                  CASE c_custkey % 5 WHEN 0 THEN [] WHEN 1 THEN ['provider-authenticated-field'] WHEN 2 THEN ['provider-authenticated-field', 'operator-asserted'] WHEN 3 THEN ['operator-asserted', 'hearsay'] END AS said FROM customer),
i AS (SELECT 'seg-' || s AS agent, 'principal:' || s || '-%' AS pat FROM (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_mktsegment < 'H') UNION ALL SELECT 'all-9', 'principal:%9'),
w AS (SELECT *, CASE WHEN surface = 'gateway' THEN CASE WHEN coalesce(len(said), 0) = 0 OR len(list_filter(said, lambda x: x NOT IN ('provider-authenticated-field', 'operator-asserted'))) > 0 THEN 'unverified'
                     WHEN list_contains(said, 'operator-asserted') THEN 'operator-asserted' END END AS weak FROM f),
h AS (SELECT id, any_value(weak) AS weak, count(agent) AS n, min(agent) AS one, string_agg(agent, '|' ORDER BY agent) AS fits FROM w LEFT JOIN i ON resource LIKE pat GROUP BY id)
SELECT id, n <> 1 OR weak IS NOT NULL AS shadow, CASE WHEN n = 1 AND weak IS NULL THEN one END AS registry_match, CASE WHEN n > 0 AND weak IS NOT NULL THEN 'unverified-gateway-caller-identity' WHEN n > 1 THEN 'ambiguous-resource-approval' WHEN n = 1 THEN 'approved' ELSE 'unregistered' END AS reason,
       CASE WHEN n > 1 OR n > 0 AND weak IS NOT NULL THEN fits END AS suggestions, CASE WHEN n > 0 THEN weak END AS assurance FROM h""")
def gateway_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    none = F.array().cast("array<string>")
    segments = c.where("c_mktsegment < 'H'").select("c_mktsegment").distinct().select(F.concat(F.lit("seg-"), "c_mktsegment").alias("agent_id"), F.concat(F.lit("principal:"), "c_mktsegment", F.lit("-*")).alias("pattern"))
    inventory = segments.unionByName(spark.createDataFrame([("all-9", "principal:*9")], "agent_id string, pattern string")).select("*", *[none.alias(f"{s}s") for s in reconcile.SCOPES])
    authenticated, asserted = F.lit(reconcile.CALLER_ASSURANCE[0]), F.lit(reconcile.CALLER_ASSURANCE[1])
    k = F.col("c_custkey") % 5
    f = c.select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 3 == 0, "identity").otherwise("gateway").alias("surface"), F.concat(F.lit("principal:"), "c_mktsegment", F.lit("-"), F.col("c_custkey").cast("string")).alias("resource"),
        F.when(k == 0, none).when(k == 1, F.array(authenticated)).when(k == 2, F.array(authenticated, asserted)).when(k == 3, F.array(asserted, F.lit("hearsay"))).alias("assurances"), *[F.lit("x").alias(s) for s in ("provider", "account", "region")],
    )
    return reconcile.reconcile_inventory(f, inventory).select("id", F.col("shadow_now").alias("shadow"), F.col("match_now").alias("registry_match"), "reason", F.array_join("suggestions", "|").alias("suggestions"), "assurance")


@query("""
SELECT p_partkey AS id, n AS name FROM part, (VALUES ('widget'), ('bolt'), ('ring'), ('gear')) v(n)
WHERE length(n) >= 4 AND regexp_matches(lower(p_name), '(^|[^a-z0-9])' || n || '($|[^a-z0-9])')""")
def name_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("widget",), ("bolt",), ("ring",), ("gear",)], "name string")
    return reconcile.suggest_by_name(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), names)


@query(f"""
SELECT agent AS agent_id, pat AS pattern, probes, CASE WHEN probes >= 2 THEN 'broad' END AS warning FROM (
  SELECT agent, pat, count(DISTINCT p_name) AS probes FROM {_values([(a, p) for a, p, _ in APPROVALS])} v(agent, pat) LEFT JOIN part ON p_name LIKE replace(replace(pat, '*', '%'), '?', '_') GROUP BY 1, 2) WHERE probes >= 2""")
def inventory_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = spark.createDataFrame(APPROVALS, "agent_id string, pattern string, typ string")
    return reconcile.inventory_warnings(inv, table(spark, sf_dir, "part").select(F.col("p_name").alias("probe")).distinct())


@query("""
SELECT c_mktsegment AS registry, CASE WHEN n = 0 THEN 'not-observed' WHEN n = 1 THEN 'observed' ELSE 'ambiguous' END AS status, count(*) AS records FROM (
  SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1, 2""")
def registry_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    b = F.struct(F.col("c_custkey").cast("string").alias("resource"), none.alias("provider"), none.alias("account"), none.alias("region"))
    rec = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("registry"), F.col("c_custkey").alias("record_id"), F.lit(True).alias("listing_complete"), F.array(b).alias("bindings"))
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("resource"), none.alias("provider"), none.alias("account"), none.alias("region"))
    return reconcile.reconcile_registry(rec, f)[0].groupBy("registry", "status").agg(F.count("*").alias("records"))


@query("""
SELECT p_brand, p_type, arg_max(p_name, struct_pack(a := p_retailprice, b := p_name)) AS latest, count(*) AS versions FROM part GROUP BY 1, 2""")
def latest_part_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.latest_versions(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_name", "p_retailprice")


OWNERS = [(1, "*", "@all"), (2, "/data/", "@data"), (3, "*.md", "@docs"), (4, "/data/src1*/", "@team1"), (5, "en.txt", "@english"), (6, "/data/src7/**/*.txt", "@seven")]


@query("""
SELECT doc_id, CASE WHEN source = 'src7' THEN '@seven' WHEN lang = 'en' THEN '@english' WHEN source LIKE 'src1%' THEN '@team1' ELSE '@data' END AS owners FROM documents""")
def owner_last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(OWNERS, "line_no int, pattern string, owners string")
    paths = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("data/"), "source", F.lit("/"), "lang", F.lit(".txt")).alias("path"))
    return reconcile.assign_owner(paths, rules).select("doc_id", "owners")


SEGMENT_KIND = {"AUTOMOBILE": "agent", "BUILDING": "mcp-server", "FURNITURE": "secret", "HOUSEHOLD": "oauth-grant", "MACHINERY": "token"}


def as_findings(customer: DataFrame) -> DataFrame:
    """``customer`` seen as findings: kind by segment, tags and capabilities by balance and nation."""
    kind = F.create_map(*[F.lit(x) for kv in SEGMENT_KIND.items() for x in kv])[F.col("c_mktsegment")]
    some = lambda *rules: F.array_compact(F.array(*[F.when(test, v) for v, test in rules]))
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    return customer.select(
        k.alias("id"), kind.alias("kind"), F.lit("saas").alias("surface"), F.col("c_name").alias("title"), F.when(k % 3 != 0, F.col("c_name")).alias("owner"), F.when(k % 4 == 0, True).when(k % 4 == 1, False).alias("shadow"),
        some(("tool-use", n % 2 == 0), ("code-exec", n % 5 == 0), ("autonomous", n % 7 == 0), ("rag", n % 3 == 0)).alias("capabilities"),
        some(("policy.privileged-scopes", F.col("c_acctbal") > 8000), ("disabled", F.col("c_acctbal") < 0), ("scheduled", k % 6 == 0), ("mcp-auto-approve", k % 9 == 0)).alias("tags"),
        F.array().cast("array<string>").alias("model_providers"), F.when(k % 5 == 0, 150).when(k % 5 == 1, 20).otherwise(1).alias("user_count"), ((k % 101) / 100).alias("confidence"), F.lit("x").alias("connector"),
    )


_W = _values([("kind", k, w) for k, w in W.KIND_BASE.items()] + [("capability", k, w) for k, w in W.CAPABILITY.items()] + [("tag", k, w) for k, w in W.TAG.items()])
_FACTORS = f"""
WITH w AS (SELECT * FROM {_W} v(g, i, x)),
c AS (SELECT c_custkey AS id, CASE c_mktsegment {' '.join(f"WHEN '{s}' THEN '{k}'" for s, k in SEGMENT_KIND.items())} END AS kind, c_nationkey AS n, c_acctbal AS bal, c_custkey AS k, (c_custkey % 101) / 100 AS conf FROM customer),
f AS (SELECT id, 'kind' AS grp, kind AS factor FROM c
  UNION ALL SELECT id, 'capability', 'tool-use' FROM c WHERE n % 2 = 0 UNION ALL SELECT id, 'capability', 'code-exec' FROM c WHERE n % 5 = 0
  UNION ALL SELECT id, 'capability', 'autonomous' FROM c WHERE n % 7 = 0 UNION ALL SELECT id, 'capability', 'rag' FROM c WHERE n % 3 = 0
  UNION ALL SELECT id, 'tag', 'policy.privileged-scopes' FROM c WHERE bal > 8000 UNION ALL SELECT id, 'tag', 'disabled' FROM c WHERE bal < 0
  UNION ALL SELECT id, 'tag', 'scheduled' FROM c WHERE k % 6 = 0 UNION ALL SELECT id, 'tag', 'mcp-auto-approve' FROM c WHERE k % 9 = 0),
a AS (SELECT f.id, f.grp, f.factor, w.x AS weight FROM f JOIN w ON w.g = f.grp AND w.i = f.factor WHERE w.x <> 0
  UNION ALL SELECT id, 'governance', 'no-owner', 10 FROM c WHERE k % 3 = 0 UNION ALL SELECT id, 'governance', 'shadow', 25 FROM c WHERE k % 4 = 0 UNION ALL SELECT id, 'governance', 'registered', -10 FROM c WHERE k % 4 = 1
  UNION ALL SELECT id, 'metadata', 'blast-radius', CASE WHEN k % 5 = 0 THEN 10 ELSE 5 END FROM c WHERE kind = 'oauth-grant' AND k % 5 < 2)"""


@query(_FACTORS + " SELECT id AS finding_id, grp, factor, weight FROM a")
def risk_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.risk_factors(as_findings(table(spark, sf_dir, "customer")), governance.weight_table(spark))


_SCORED = _FACTORS + """,
t AS (SELECT id, sum(weight) AS total, coalesce(sum(weight) FILTER (grp <> 'governance'), 0) AS danger FROM a GROUP BY id),
s AS (SELECT t.id, greatest(0, least(100, CAST(round_even(CAST(total AS DECIMAL(18, 6)) * (60 + 40 * CAST(conf AS DECIMAL(18, 6))) / 100, 0) AS INT))) AS score,
             greatest(0, least(100, CAST(round_even(CAST(danger AS DECIMAL(18, 6)) * (60 + 40 * CAST(conf AS DECIMAL(18, 6))) / 100, 0) AS INT))) AS danger_score, c.conf FROM t JOIN c ON c.id = t.id),
l AS (SELECT *, CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'info' END AS level FROM s)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.score_risk(as_findings(table(spark, sf_dir, "customer")), governance.weight_table(spark))


@query(_SCORED + " SELECT id, score, danger_score, level, score AS explained FROM l")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    explained = F.aggregate("factors", F.lit(0), lambda a, f: a + f["weight"])
    return scored(spark, sf_dir).select("id", "score", "danger_score", "level", explained.alias("explained"))


@query(_SCORED + " SELECT id, score, round(conf, 6) AS confidence FROM l WHERE score >= 25 ORDER BY score DESC, conf DESC, id LIMIT 25")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.review_queue(scored(spark, sf_dir)).select("id", "score", F.round("confidence", 6).alias("confidence"))


@query(_SCORED + " SELECT CASE WHEN max(score) >= 50 THEN 2 ELSE 0 END AS verdict FROM l")
def fail_on_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.gate(scored(spark, sf_dir), F.lit(True), 50)


@query(_SCORED + """
SELECT dim, value, count(*) AS n FROM l JOIN c USING (id),
LATERAL (SELECT 'total' AS dim, 'all' AS value UNION ALL SELECT 'shadow', 'shadow' WHERE k % 4 = 0 UNION ALL SELECT 'surface', 'saas' UNION ALL SELECT 'kind', kind UNION ALL SELECT 'level', level) GROUP BY 1, 2""")
def summarise_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.summarise_findings(scored(spark, sf_dir))


@query("""
WITH p AS (SELECT p_partkey AS id, CASE WHEN p_type = 'PROMO' THEN 'workflow' WHEN p_type = 'LARGE' THEN 'secret' ELSE 'agent' END AS kind,
  p_size % 2 = 0 AS tool, p_size % 3 = 0 AS code, p_size % 5 = 0 AS bypass, p_size % 7 = 0 AS sched, p_size % 11 = 0 AS every FROM part),
q AS (SELECT *, every AND NOT bypass AS ea FROM p),
f AS (SELECT *, greatest(CASE WHEN tool THEN 1 ELSE 0 END, CASE WHEN code THEN 2 ELSE 0 END, CASE WHEN kind = 'workflow' OR (kind = 'agent' AND tool AND NOT ea) THEN 3 ELSE 0 END,
  CASE WHEN bypass AND code THEN 4 ELSE 0 END, CASE WHEN bypass AND code AND sched THEN 5 ELSE 0 END) AS fl FROM q)
SELECT id, CASE WHEN kind <> 'secret' THEN fl END AS floor, CASE WHEN kind <> 'secret' THEN greatest(CASE WHEN ea THEN 2 ELSE 5 END, fl) END AS ceiling,
  CASE WHEN kind <> 'secret' THEN CASE WHEN bypass THEN 'bypassed' WHEN every THEN 'gated' ELSE 'unknown' END END AS oversight,
  CASE WHEN kind <> 'secret' THEN CASE WHEN sched THEN 'schedule' ELSE 'unknown' END END AS initiation FROM f""")
def autonomy_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda *rules: F.array_compact(F.array(*[F.when(F.col("p_size") % m == 0, v) for v, m in rules]))
    kind = F.when(F.col("p_type") == "PROMO", "workflow").when(F.col("p_type") == "LARGE", "secret").otherwise("agent")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind"), some(("tool-use", 2), ("code-exec", 3)).alias("capabilities"), some(("mcp-auto-approve", 5), ("scheduled", 7)).alias("tags"), F.when(F.col("p_size") % 11 == 0, "every-action").alias("approval_scope"))
    return governance.classify_autonomy(p).select("id", "floor", "ceiling", "oversight", "initiation")


_SEGMENTS = list(SEGMENT_KIND)


@query("SELECT 'T' || c_nationkey % 5 AS tier, " + ", ".join(f"count(*) FILTER (c_mktsegment = '{s}') AS {s}" for s in _SEGMENTS) + " FROM customer GROUP BY 1")
def autonomy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("tier", F.concat(F.lit("T"), F.col("c_nationkey") % 5))
    return reports.autonomy_matrix(c, "tier", "c_mktsegment", _SEGMENTS)


@query(_SCORED + """
SELECT v.level, count(l.id) AS n, count(l.id) FILTER (k % 3 = 0) AS unowned FROM (VALUES ('critical'), ('high'), ('medium'), ('low'), ('info')) v(level)
LEFT JOIN (SELECT l.*, c.k FROM l JOIN c USING (id) WHERE kind <> 'secret') l ON l.level = v.level GROUP BY v.level""")
def inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = spark.createDataFrame([(v,) for v in ("critical", "high", "medium", "low", "info")], "level string")
    return reports.inventory_counts(scored(spark, sf_dir), levels)


@query("""
SELECT value, n, row_number() OVER (ORDER BY n DESC, value NULLS LAST) AS place FROM (SELECT n_name AS value, count(*) AS n FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)""")
def ranked_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return reports.ranked_counts(c, "n_name").withColumn("place", F.col("place").cast("long"))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _rank() -> Column:
    return F.when(F.col("o_totalprice") > 450_000, 3).when(F.col("o_totalprice") > 300_000, 2).when(F.col("o_totalprice") > 100_000, 1).otherwise(0)


@query("""
WITH r AS (SELECT o_custkey % 50 AS source, o_orderpriority AS p, CASE WHEN o_totalprice > 450000 THEN 3 WHEN o_totalprice > 300000 THEN 2 WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS x FROM orders)
SELECT source, """ + ", ".join(f"max(x) FILTER (p = '{p}') AS \"{p}\"" for p in _PRIORITIES) + " FROM r GROUP BY source")
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.coverage_matrix(table(spark, sf_dir, "orders").withColumn("source", F.col("o_custkey") % 50), "source", "o_orderpriority", _rank(), _PRIORITIES)


RULES = [("C-01", ["O"], None), ("C-02", ["F", "P"], "1-URGENT"), ("C-03", None, "5-LOW"), ("C-04", ["X"], None)]


@query("""
WITH f AS (SELECT o_orderkey AS id, o_orderstatus AS kind, o_orderpriority AS tag, CAST(floor(o_totalprice / 5000) AS INT) AS score, CAST(o_orderkey % 7 AS INT) AS danger FROM orders),
x AS (SELECT 'C-01' AS ref, * FROM f WHERE kind = 'O' UNION ALL SELECT 'C-02', * FROM f WHERE kind IN ('F', 'P') AND tag = '1-URGENT' UNION ALL SELECT 'C-03', * FROM f WHERE tag = '5-LOW'),
k AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY score DESC, danger DESC, id) AS place FROM x)
SELECT v.ref, count(id) AS findings, count(id) FILTER (score >= 75) AS critical, count(id) FILTER (score BETWEEN 50 AND 74) AS high, string_agg(CAST(id AS VARCHAR), ',' ORDER BY place) FILTER (place <= 3) AS examples,
       CASE WHEN count(id) > 0 THEN 'referenced' ELSE 'not-observed' END AS status
FROM (VALUES ('C-01'), ('C-02'), ('C-03'), ('C-04')) v(ref) LEFT JOIN k ON k.ref = v.ref GROUP BY v.ref""")
def control_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyhawk.functions.scalars import risk_level

    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), F.array("o_orderpriority").alias("tags"), F.array().cast("array<string>").alias("capabilities"), F.lit(0).alias("floor"), F.lit(None).cast("boolean").alias("shadow"), F.floor(F.col("o_totalprice") / 5000).cast("int").alias("score"), (F.col("o_orderkey") % 7).cast("int").alias("danger_score"))
    f = f.withColumn("level", risk_level("score"))
    rules = spark.createDataFrame([(r, k, [t] if t else None, None, None, None) for r, k, t in RULES], "ref string, kinds array<string>, tags array<string>, capabilities array<string>, min_floor int, shadow boolean")
    out = reports.control_evidence(reports.map_controls(f, rules), rules.select("ref"), f, complete=True)
    return out.select("ref", "findings", "critical", "high", "examples", "status")


@query("""
SELECT month, previous, orders, orders - lag(orders) OVER (ORDER BY month) AS delta FROM (
  SELECT *, lag(month) OVER (ORDER BY month) AS previous FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders FROM orders GROUP BY 1))""")
def history_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("orders"))
    p = reports.history_pairs(m, "month", "month")
    before = m.select(F.col("month").alias("previous"), F.col("orders").alias("_before"))
    return p.join(before, "previous", "left").select("month", "previous", "orders", (F.col("orders") - F.col("_before")).alias("delta"))


@query("""
SELECT l_partkey AS client, count(DISTINCT l_suppkey) AS users, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS scopes, arg_min(l_linestatus, l_orderkey * 1000000 + CAST(l_linenumber AS BIGINT) * 10000 + l_suppkey) AS name FROM lineitem GROUP BY 1""")
def oauth_client_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyhawk.operators.identity import rollup_oauth_clients

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("client"), F.col("l_suppkey").cast("string").alias("user"), F.array("l_returnflag").alias("scopes"), F.col("l_linestatus").alias("name"), (F.col("l_orderkey") * 1_000_000 + F.col("l_linenumber") * 10_000 + F.col("l_suppkey")).alias("ord"))
    return rollup_oauth_clients(rows).select("client", "users", F.array_join("scopes", "|").alias("scopes"), "name")


@query("""
SELECT o_orderkey AS parent, count(l_partkey) AS children, count(l_partkey) = 0 AS orphan FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
UNION ALL SELECT DISTINCT -1 - l_orderkey, 0, true FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def grant_join_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyhawk.operators.identity import join_children

    parents, children = join_children(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", ["l_partkey"])
    own = parents.select(F.col("o_orderkey").alias("parent"), F.col("n_children").alias("children"), (F.col("n_children") == 0).alias("orphan"))
    lost = children.select((-1 - F.col("l_orderkey")).alias("parent")).distinct().select("parent", F.lit(0).cast("long").alias("children"), F.lit(True).alias("orphan"))
    return own.union(lost)


@query("""
SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)""")
def egress_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyhawk.operators.cloud import egress_policy_gap

    w = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("c").alias("cluster"), F.col("s_nationkey").alias("namespace"))
    p = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.lit("c").alias("cluster"), F.col("c_nationkey").alias("namespace"), F.lit(True).alias("egress"))
    return egress_policy_gap(w, p).select("s_suppkey")


@query("""
SELECT p_partkey, p_name AS tool, n > 1 AS shadowed FROM (SELECT p_partkey, p_name, p_type || p_size AS x, p_brand FROM part) a
JOIN (SELECT lower(p_name) || p_size AS k, count(DISTINCT p_brand) AS n FROM part GROUP BY 1) b ON lower(a.p_name) || substr(a.x, length(a.x) - length(regexp_replace(a.x, '^[A-Z]+', '')) + 1) = b.k""")
def tool_shadowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyhawk.operators.endpoint import tool_name_shadowing

    t = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("tool"), F.concat("p_name", "p_size").alias("name"), F.col("p_brand").alias("server"))
    return tool_name_shadowing(t).select("p_partkey", "tool", "shadowed")


@query("""
SELECT p_partkey, sha256('{"name":"' || p_name || '","brand":"' || p_brand || '","type":"' || p_type || '"}') AS digest FROM part""")
def tool_definition_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyhawk.operators.endpoint import definition_digest

    return table(spark, sf_dir, "part").select("p_partkey", definition_digest(F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))).alias("digest"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 'c' || (c_custkey % 40) AS a, 'n' || c_nationkey AS b FROM customer WHERE c_acctbal > 5000 UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT DISTINCT 'r' || (s_nationkey % 5), 's' || s_suppkey FROM supplier WHERE s_acctbal > 5000),
w AS (SELECT DISTINCT a AS node, false AS ai FROM e WHERE a LIKE 'c%' UNION SELECT e.b, w.ai OR e.b LIKE 'n1%' FROM w JOIN e ON e.a = w.node)
SELECT DISTINCT node FROM w WHERE ai AND node LIKE 's%'""")
def workflow_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyhawk.operators.lowcode import reachable_egress

    t = lambda n: table(spark, sf_dir, n)
    pre = lambda p, c: F.concat(F.lit(p), c)
    edges = t("customer").where("c_acctbal > 5000").select(pre("c", F.col("c_custkey") % 40).alias("src"), pre("n", F.col("c_nationkey")).alias("dst")).distinct()
    edges = edges.union(t("nation").select(pre("n", F.col("n_nationkey")), pre("r", F.col("n_regionkey")))).union(t("supplier").where("s_acctbal > 5000").select(pre("r", F.col("s_nationkey") % 5), pre("s", F.col("s_suppkey"))).distinct())
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    role = F.when(F.col("node").startswith("c"), "input").when(F.col("node").startswith("n1"), "ai").when(F.col("node").startswith("s"), "egress")
    flow = F.lit("w").alias("workflow")
    return reachable_egress(edges.select(flow, "src", "dst"), nodes.select(flow, "node", role.alias("role"))).select("node")


@query("""
SELECT count(*) FILTER (severe) AS high, CAST(round(avg(c_acctbal), 2) AS DOUBLE) AS mean FROM (SELECT c_acctbal, c_acctbal > 9000 AS severe FROM customer)""")
def balance_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").agg(F.count_if(F.col("c_acctbal") > 9000).alias("high"), F.round(F.avg("c_acctbal"), 2).alias("mean"))


@query(_SCORED + " SELECT id, round(conf, 6) AS confidence, CASE WHEN conf >= 0.85 THEN 'strong' WHEN conf >= 0.6 THEN 'likely' WHEN conf >= 0.3 THEN 'possible' ELSE 'weak' END AS likelihood FROM c WHERE conf >= 0.3")
def min_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings.min_confidence(as_findings(table(spark, sf_dir, "customer")), 0.3)
    return f.select("id", F.round("confidence", 6).alias("confidence"), likelihood("confidence").alias("likelihood"))
