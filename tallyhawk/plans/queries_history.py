"""Driver queries on chains, report histories, scoped links and merges; each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhawk.operators import correlate, merging, reports
from tallyhawk.plans.registry import query
from tallyhawk.plans.session import parts_for, table

# ---------------------------------------------------------------- lineage


@query("""
WITH RECURSIVE e AS (
  SELECT p_partkey AS child, CASE WHEN p_partkey % 50 = 40 THEN p_partkey + 9 ELSE p_partkey - 1 END AS parent FROM part WHERE p_partkey % 50 <> 0
  UNION SELECT p_partkey, p_partkey - 2 FROM part WHERE p_partkey % 50 = 25 AND p_size > 20),
n AS (SELECT child, count(*) AS c, min(parent) AS p FROM e GROUP BY child),
walk AS (SELECT child, child AS node, 0 AS hops FROM n UNION ALL SELECT w.child, n.p, w.hops + 1 FROM walk w JOIN n ON n.child = w.node WHERE n.c = 1 AND w.hops < 100),
last AS (SELECT child, arg_max(node, hops) AS node, max(hops) AS hops FROM walk GROUP BY child),
s AS (SELECT last.*, CASE WHEN n.child IS NULL THEN 'root' WHEN n.c > 1 THEN 'ambiguous' ELSE 'cycle' END AS status FROM last LEFT JOIN n ON n.child = last.node)
SELECT child, CASE WHEN status <> 'cycle' THEN node END AS origin, CASE WHEN status <> 'cycle' THEN hops END AS hops, status FROM s""")
def origin_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    links = p.where(k % 50 != 0).select(k.alias("child"), F.when(k % 50 == 40, k + 9).otherwise(k - 1).alias("parent"))
    return correlate.lineage(links.unionByName(p.where((k % 50 == 25) & (F.col("p_size") > 20)).select(k.alias("child"), (k - 2).alias("parent"))))


# ---------------------------------------------------------------- history

_REPORTS = """
WITH rows AS (SELECT strftime(o_orderdate, '%Y-%m') AS report, o_custkey AS id, max(o_orderpriority) AS state, o_custkey % 17 = 0 AS scan_local FROM orders GROUP BY ALL),
reports AS (SELECT report, row_number() OVER (ORDER BY report) AS at, CAST(report[6:7] AS INT) % 5 <> 0 AS complete, CASE WHEN report < '1996' THEN 'a' ELSE 'b' END AS scope FROM (SELECT DISTINCT report FROM rows)),
firsts AS (SELECT id, min(report) AS since FROM rows GROUP BY id),
pairs AS (SELECT b.report AS previous, c.report AS report, b.complete AND c.complete AND b.scope = c.scope AS compares FROM reports b JOIN reports c ON c.at = b.at + 1)"""


@query(_REPORTS + """,
kept AS (SELECT p.report, p.previous, CASE WHEN b.state = c.state THEN 'same' ELSE 'changed' END AS change FROM pairs p JOIN rows b ON b.report = p.previous JOIN rows c ON c.report = p.report AND c.id = b.id),
here AS (SELECT p.report, p.previous, CASE WHEN c.scan_local THEN 'not_comparable' WHEN f.since = c.report THEN 'new' ELSE 'returned' END AS change
         FROM pairs p JOIN rows c ON c.report = p.report JOIN firsts f USING (id) WHERE NOT EXISTS (SELECT 1 FROM rows b WHERE b.report = p.previous AND b.id = c.id)),
gone AS (SELECT p.report, p.previous, CASE WHEN b.scan_local THEN 'not_comparable' WHEN p.compares THEN 'resolved' ELSE 'unknown' END AS change
         FROM pairs p JOIN rows b ON b.report = p.previous WHERE NOT EXISTS (SELECT 1 FROM rows c WHERE c.report = p.report AND c.id = b.id))
SELECT report, previous, change, count(*) AS findings FROM (FROM kept UNION ALL FROM here UNION ALL FROM gone) GROUP BY ALL""")
def report_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_format("o_orderdate", "yyyy-MM")
    rows = table(spark, sf_dir, "orders").groupBy(month.alias("report"), F.col("o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("state"), (F.first("o_custkey") % 17 == 0).alias("scan_local"))
    heads = rows.select("report").distinct().select("report", F.col("report").alias("started_at"), (F.substring("report", 6, 2).cast("int") % 5 != 0).alias("complete"), F.when(F.col("report") < "1996", "a").otherwise("b").alias("scope"))
    return reports.report_history(heads, rows)


_INVENTORY = _REPORTS + """,
f AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice / 5000) AS BIGINT) AS score, CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS shadow, o_orderpriority AS level,
             CASE o_custkey % 5 WHEN 0 THEN 'secret' WHEN 1 THEN 'token' ELSE 'agent' END AS kind, CASE WHEN o_custkey % 3 <> 0 THEN 'team' || (o_custkey % 11) END AS owner FROM orders),
v AS (SELECT *, CASE WHEN shadow THEN 'shadow' WHEN NOT shadow THEN 'registered' ELSE 'unassessed' END AS status FROM f WHERE kind <> 'secret'),
g AS (SELECT section, name, count(*) AS n, count(*) FILTER (owner IS NULL) AS unowned, count(*) FILTER (shadow) AS shadow, max(score) AS worst
      FROM v, LATERAL (VALUES ('level', level), ('kind', kind), ('owner', coalesce(owner, 'unowned')), ('status', status), ('total', 'all')) s(section, name) GROUP BY ALL),
w AS (SELECT coalesce(owner, 'unowned') AS name, id, score, row_number() OVER (PARTITION BY coalesce(owner, 'unowned') ORDER BY score DESC, id) AS place FROM v),
c AS (SELECT n_name AS name, max(CASE s_suppkey % 7 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END) AS r, count(DISTINCT s_suppkey % 4) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name),
b AS (SELECT p.report, CASE WHEN b.state = c.state THEN 'same' ELSE 'changed' END AS change FROM pairs p JOIN rows b ON b.report = p.previous JOIN rows c ON c.report = p.report AND c.id = b.id),
h AS (SELECT p.report, CASE WHEN c.scan_local THEN 'not_comparable' WHEN f.since = c.report THEN 'new' ELSE 'returned' END AS change FROM pairs p JOIN rows c ON c.report = p.report JOIN firsts f USING (id) WHERE NOT EXISTS (SELECT 1 FROM rows b WHERE b.report = p.previous AND b.id = c.id)),
x AS (SELECT p.report, CASE WHEN b.scan_local THEN 'not_comparable' WHEN p.compares THEN 'resolved' ELSE 'unknown' END AS change FROM pairs p JOIN rows b ON b.report = p.previous WHERE NOT EXISTS (SELECT 1 FROM rows c WHERE c.report = p.report AND c.id = b.id))"""


@query(_INVENTORY + """
SELECT section, name, NULL AS item, n, unowned, shadow, worst, NULL AS place FROM g
UNION ALL SELECT 'owner-worst', name, CAST(id AS VARCHAR), NULL, NULL, NULL, score, place FROM w WHERE place <= 3
UNION ALL SELECT 'coverage', name, ['complete', 'skipped', 'incomplete', 'failed'][r + 1], n, NULL, NULL, NULL, NULL FROM c
UNION ALL SELECT 'history', report, change, count(*), NULL, NULL, NULL, NULL FROM (FROM b UNION ALL FROM h UNION ALL FROM x) GROUP BY report, change
UNION ALL SELECT 'control', 'C' || (o_orderkey % 6), NULL, count(DISTINCT o_custkey), NULL, NULL, NULL, NULL FROM orders GROUP BY 2""")
def inventory_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_custkey")
    f = o.select(
        F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 5000).cast("long").alias("score"), F.when(F.col("o_orderstatus") == "O", True).when(F.col("o_orderstatus") == "F", False).alias("shadow"), F.col("o_orderpriority").alias("level"),
        F.when(k % 5 == 0, "secret").when(k % 5 == 1, "token").otherwise("agent").alias("kind"), F.when(k % 3 != 0, F.concat(F.lit("team"), (k % 11).cast("string"))).alias("owner"),
    )
    s = F.col("s_suppkey")
    stats = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("source"), (s % 4).alias("connector"), F.when(s % 7 == 0, "failed").when(s % 7 == 1, "incomplete").when(s % 7 == 2, "skipped").otherwise("complete").alias("status"))
    history = report_history(spark, sf_dir)
    refs = o.select(F.col("o_custkey").alias("id"), F.concat(F.lit("C"), (F.col("o_orderkey") % 6).cast("string")).alias("ref"))
    return reports.inventory_sections(f, stats, history, refs)


# ---------------------------------------------------------------- links

_IDENTIFIERS = """
WITH r AS (SELECT 's-' || s_suppkey AS e, 'supplier' AS c, ['client-id', 'role-name', 'label'][s_nationkey % 3 + 1] AS kind, s_nationkey || ':' || CAST(floor(s_acctbal / 100) AS BIGINT) AS k, CAST(floor(s_acctbal / 100) AS BIGINT) % 7 = 0 AS g,
                  CASE WHEN s_suppkey % 3 <> 0 THEN 't' || s_suppkey % 2 END AS tenant, CASE WHEN s_suppkey % 4 <> 0 THEN 'a' || s_nationkey % 2 END AS account FROM supplier
           UNION ALL SELECT 'c-' || c_custkey, 'customer', ['client-id', 'role-name', 'label'][c_nationkey % 3 + 1], c_nationkey || ':' || CAST(floor(c_acctbal / 100) AS BIGINT), CAST(floor(c_acctbal / 100) AS BIGINT) % 7 = 0,
                  CASE WHEN c_custkey % 3 <> 0 THEN 't' || c_custkey % 2 END, CASE WHEN c_custkey % 4 <> 0 THEN 'a' || c_nationkey % 2 END FROM customer)"""


@query(_IDENTIFIERS + """,
ok AS (SELECT kind, k FROM r GROUP BY kind, k HAVING count(DISTINCT e) BETWEEN 2 AND 25),
m AS (SELECT a.e AS src, b.e AS dst, a.kind, a.k, a.g AND b.g OR CASE a.kind WHEN 'client-id' THEN a.tenant = b.tenant WHEN 'role-name' THEN a.account = b.account ELSE a.tenant = b.tenant OR a.account = b.account END AS exact,
             concat_ws(',', 'account=' || coalesce(a.account, b.account), 'tenant=' || coalesce(a.tenant, b.tenant)) AS scope
      FROM r a JOIN r b ON a.kind = b.kind AND a.k = b.k AND a.e < b.e AND a.c <> b.c SEMI JOIN ok ON ok.kind = a.kind AND ok.k = a.k
      WHERE coalesce(a.tenant = b.tenant, true) AND coalesce(a.account = b.account, true)),
l AS (SELECT src, dst, CASE WHEN coalesce(exact, false) THEN 'exact' ELSE 'candidate' END AS assurance, string_agg(kind || '(' || scope || ')', '|' ORDER BY kind) AS matches, min({'kind': kind, 'k': k}) AS f FROM m GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY src, assurance ORDER BY f, dst) AS x, row_number() OVER (PARTITION BY dst, assurance ORDER BY f, src) AS y FROM l),
q AS (SELECT * FROM p WHERE x <= 5 AND y <= 5)
SELECT src, dst, assurance, matches FROM q WHERE assurance = 'exact' OR NOT EXISTS (SELECT 1 FROM q z WHERE z.src = q.src AND z.dst = q.dst AND z.assurance = 'exact')""")
def scoped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    def side(name: str, p: str, e: str) -> DataFrame:
        key, nation, money = F.col("s_suppkey" if name == "supplier" else "c_custkey"), F.col(f"{p}nationkey"), F.floor(F.col(f"{p}acctbal") / 100)
        pairs = F.array_compact(F.array(F.when(key % 3 != 0, F.struct(F.lit("tenant").alias("k"), F.concat(F.lit("t"), (key % 2).cast("string")).alias("v"))), F.when(key % 4 != 0, F.struct(F.lit("account").alias("k"), F.concat(F.lit("a"), (nation % 2).cast("string")).alias("v")))))
        kind = F.element_at(F.array(F.lit("client-id"), F.lit("role-name"), F.lit("label")), (nation % 3 + 1).cast("int"))
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(e), key.cast("string")).alias("finding_id"), F.lit(name).alias("connector"), F.lit("cloud").alias("surface"), kind.alias("kind"), F.concat_ws(":", nation.cast("string"), money.cast("string")).alias("key"),
            F.lit("resource").alias("field"), F.map_from_entries(pairs).alias("scope"), (money % 7 == 0).alias("is_global"),
        )

    links = correlate.scoped_links(side("supplier", "s_", "s-").unionByName(side("customer", "c_", "c-")), peers=5)
    scope = lambda m: F.array_join(F.transform(m["scope"], lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return links.select("src", "dst", "assurance", F.array_join(F.transform("matches", lambda m: F.concat(m["kind"], F.lit("("), scope(m), F.lit(")"))), "|").alias("matches"))


# ---------------------------------------------------------------- merges

_FLEET = """
WITH v AS (SELECT l_partkey AS id, l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 AS ord, l_returnflag AS source, CASE WHEN l_quantity > 40 THEN 'team' || l_suppkey END AS owner, l_linestatus AS capability, 'k' || (l_linenumber % 3) AS mk,
                  CASE WHEN l_discount > 0.02 THEN CAST(l_suppkey AS VARCHAR) END AS mv, CAST(floor(l_extendedprice / 1000) AS INT) AS score, l_suppkey % 5 AS danger, epoch_us(l_shipdate) AS t,
                  CASE l_linestatus WHEN 'O' THEN true WHEN 'F' THEN false END AS shadow, CASE WHEN l_tax > 0.06 THEN 'reg' || l_suppkey % 2 END AS match, l_suppkey % 4 AS floor, l_suppkey % 4 + 1 AS ceiling,
                  ['agent', 'service-identity', 'token'][l_suppkey % 3 + 1] AS kind, CASE WHEN l_partkey % 13 = 0 THEN l_returnflag ELSE 'r' END AS resource FROM lineitem)"""


@query(_FLEET + """,
d AS (SELECT id, mk, arg_min(mv, (ord, source, mv)) AS mv, arg_min(source, (ord, source, mv)) AS src FROM v WHERE mv IS NOT NULL GROUP BY id, mk),
m AS (SELECT id, string_agg(mk || '=' || mv || '@' || src, ',' ORDER BY mk) AS metadata FROM d GROUP BY id),
p AS (SELECT *, CASE kind WHEN 'agent' THEN 3 WHEN 'service-identity' THEN 2 ELSE 0 END AS p FROM v)
SELECT id, arg_min(owner, (ord, source, owner)) FILTER (owner IS NOT NULL) AS owner, arg_min(source, (ord, source, owner)) FILTER (owner IS NOT NULL) AS owner_from, string_agg(DISTINCT capability, ',' ORDER BY capability) AS capabilities,
       any_value(metadata) AS metadata, max((score, danger))[1] AS score, max((score, danger))[2] AS danger_score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, min(t) AS first_us, max(t) AS last_us, bool_or(shadow) AS shadow,
       CASE WHEN count(DISTINCT match) > 1 THEN 'ambiguous' ELSE max(match) END AS registry_match, max(floor) AS floor, max(ceiling) AS ceiling, first(kind ORDER BY p DESC, kind DESC) AS kind,
       CASE WHEN count(DISTINCT kind) > 1 THEN string_agg(DISTINCT kind, ',' ORDER BY kind) END AS observed_kinds, count(DISTINCT resource) = 1 AS identity_agrees
FROM p LEFT JOIN m USING (id) GROUP BY id""")
def fleet_merge_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col
    v = table(spark, sf_dir, "lineitem").select(
        n("l_partkey").alias("id"), (n("l_orderkey") * 100 + n("l_linenumber") * 10 + n("l_suppkey") % 10).alias("ord"), n("l_returnflag").alias("source"), F.when(n("l_quantity") > 40, F.concat(F.lit("team"), n("l_suppkey").cast("string"))).alias("owner"),
        F.array("l_linestatus").alias("capabilities"), F.create_map(F.concat(F.lit("k"), (n("l_linenumber") % 3).cast("string")), F.when(n("l_discount") > 0.02, n("l_suppkey").cast("string"))).alias("metadata"),
        F.floor(n("l_extendedprice") / 1000).cast("int").alias("score"), (n("l_suppkey") % 5).alias("danger_score"), F.unix_micros(n("l_shipdate").cast("timestamp")).alias("first_seen"), F.unix_micros(n("l_shipdate").cast("timestamp")).alias("last_seen"),
        F.when(n("l_linestatus") == "O", True).when(n("l_linestatus") == "F", False).alias("shadow"), F.when(n("l_tax") > 0.06, F.concat(F.lit("reg"), (n("l_suppkey") % 2).cast("string"))).alias("registry_match"),
        (n("l_suppkey") % 4).alias("floor"), (n("l_suppkey") % 4 + 1).alias("ceiling"), F.element_at(F.array(F.lit("agent"), F.lit("service-identity"), F.lit("token")), (n("l_suppkey") % 3 + 1).cast("int")).alias("kind"),
        F.when(n("l_partkey") % 13 == 0, n("l_returnflag")).otherwise("r").alias("resource"),
    )
    out = merging.merge_fleet(v, ("owner",), ("capabilities",), ("metadata",), partitions=parts_for(v))
    entries = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit("@"), F.col("came_from")[F.concat(F.lit("metadata."), e["key"])]))
    return out.select(
        "id", "owner", F.col("came_from")["owner"].alias("owner_from"), F.array_join("capabilities", ",").alias("capabilities"), F.nullif(F.array_join(entries, ","), F.lit("")).alias("metadata"), "score", "danger_score", F.array_join("sources", ",").alias("sources"),
        F.col("first_seen").alias("first_us"), F.col("last_seen").alias("last_us"), "shadow", "registry_match", "floor", "ceiling", "kind", F.array_join("observed_kinds", ",").alias("observed_kinds"), "identity_agrees",
    )


@query("""
SELECT l_partkey AS finding_id, l_returnflag AS signal, l_linestatus AS location, 'd' || (l_linenumber % 2) AS description, max(l_quantity) AS weight, min(l_orderkey) AS ord, arg_min('s' || l_suppkey, (l_orderkey, 's' || l_suppkey)) AS source FROM lineitem GROUP BY 1, 2, 3, 4""")
def merged_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("finding_id"), F.col("l_returnflag").alias("signal"), F.col("l_linestatus").alias("location"), F.concat(F.lit("d"), (F.col("l_linenumber") % 2).cast("string")).alias("description"), F.col("l_quantity").alias("weight"),
        F.col("l_orderkey").alias("ord"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"),
    )
    half = F.col("ord") % 2 == 0
    n = parts_for(e)
    return merging.merge_evidence(merging.merge_evidence(e.where(half), partitions=n), merging.merge_evidence(e.where(~half), partitions=n))
