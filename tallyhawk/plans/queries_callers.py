"""Driver queries on ``events``: callers, cadence, network attribution; each with its DuckDB equivalent."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhawk.functions.scalars import likelihood
from tallyhawk.operators import callers, correlate, findings, network
from tallyhawk.plans.registry import query
from tallyhawk.plans.session import shared_folder, table


def _us(c: str) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def as_calls(events: DataFrame) -> DataFrame:
    """``events`` seen as model calls: the user calls, an error failed, a purchase declared tools, a signup called them."""
    return events.select(
        F.col("user_id").alias("caller"), F.lit("user").alias("caller_kind"), F.col("user_id").cast("string").alias("caller_label"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("model"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.lit(1).alias("request_count"), F.lit(None).cast("long").alias("tokens_in"),
        F.lit(None).cast("long").alias("tokens_out"), F.col("value").alias("cost"), (F.col("event_type") == "purchase").alias("tools"), (F.col("event_type") == "signup").alias("tool_calls"), F.lit("events").alias("schema"),
    )


@query("""
SELECT user_id AS caller, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 2) AS cost,
       count(*) FILTER (event_type = 'purchase') AS tool_requests, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us
FROM events GROUP BY user_id""")
def caller_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = callers.rollup_callers(as_calls(table(spark, sf_dir, "events")))
    return out.select("caller", F.col("events").cast("long").alias("events"), F.col("errors").cast("long").alias("errors"), F.round("cost", 2).alias("cost"), F.col("tool_requests").cast("long").alias("tool_requests"), _us("first_seen").alias("first_us"), _us("last_seen").alias("last_us"))


@query("""
SELECT user_id, dim, value, n, place FROM (
  SELECT user_id, 'event_type' AS dim, event_type AS value, count(*) AS n,
         row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS place
  FROM events GROUP BY user_id, event_type) WHERE place <= 2""")
def caller_top_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = callers.caller_distributions(table(spark, sf_dir, "events"), ["event_type"], ["user_id"], top=2)
    return out.withColumns({"n": F.col("n").cast("long"), "place": F.col("place").cast("long")})


_RUNS = """
WITH t AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM events WHERE ts IS NOT NULL),
r AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER w <= 3600000000 THEN 0 ELSE 1 END AS fresh FROM t WINDOW w AS (PARTITION BY user_id ORDER BY t)),
g AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM r),
q AS (SELECT user_id, run, count(*) AS c FROM g GROUP BY user_id, run)"""


@query(_RUNS + """
SELECT user_id, CAST(sum(c) AS BIGINT) AS calls, count(*) FILTER (c >= 3) AS loops, CAST(coalesce(max(c) FILTER (c >= 3), 0) AS BIGINT) AS longest,
       CAST(coalesce(sum(c) FILTER (c >= 3), 0) AS BIGINT) AS calls_in_loops, round(coalesce(sum(c) FILTER (c >= 3), 0) / sum(c), 6) AS share
FROM q GROUP BY user_id""")
def agent_loop_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callers.loop_cadence(table(spark, sf_dir, "events"), ["user_id"], gap_seconds=3600)


@query("""
SELECT user_id, timed, active_hours, round(night / timed, 6) AS night_share, round(weekend / timed, 6) AS weekend_share,
       active_hours >= 20 OR (night / timed > 0.25 AND weekend / timed > 0.15) AS always_on
FROM (SELECT user_id, count(*) AS timed, count(DISTINCT hour(ts)) AS active_hours, count(*) FILTER (hour(ts) < 6 OR hour(ts) >= 22) AS night,
             count(*) FILTER (isodow(ts) >= 6) AS weekend FROM events GROUP BY user_id) WHERE timed >= 50""")
def always_on_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callers.temporal_shape(table(spark, sf_dir, "events"), ["user_id"])


@query("""
WITH c AS (SELECT user_id AS caller, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'signup') AS s,
                  count(DISTINCT event_type) AS m FROM events GROUP BY user_id),
e AS (SELECT caller, CASE WHEN p > 0 THEN least(0.9, 0.4 + 0.5 * (p / n)) WHEN s > 0 THEN 0.6 END AS w FROM c
      UNION ALL SELECT caller, 0.2 FROM c WHERE n >= 1000
      UNION ALL SELECT caller, 0.2 FROM c WHERE m >= 4
      UNION ALL SELECT caller, 0.15 FROM c),
j AS (SELECT caller, count(*) AS signals, round(1 - product(1 - CAST(w AS DOUBLE)), 3) AS confidence FROM e WHERE w IS NOT NULL GROUP BY caller)
SELECT caller, signals, confidence, CASE WHEN confidence >= 0.85 THEN 'strong' WHEN confidence >= 0.6 THEN 'likely' WHEN confidence >= 0.3 THEN 'possible' ELSE 'weak' END AS likelihood FROM j""")
def caller_evidence_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = as_calls(table(spark, sf_dir, "events"))
    full = callers.rollup_callers(calls).join(calls.groupBy("caller").agg(F.count_distinct("model").alias("n_models"), F.min("caller_kind").alias("caller_kind")), "caller")
    e = callers.caller_evidence(full)
    scored = findings.noisy_or_confidence(e, "caller", F.col("signal"))
    return e.groupBy("caller").agg(F.count("*").alias("signals")).join(scored, "caller").withColumn("likelihood", likelihood("confidence"))


@query("""
SELECT user_id AS caller, epoch_us(date_trunc('hour', ts)) AS window_us, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 2) AS cost
FROM events GROUP BY 1, 2""")
def stream_callers_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyhawk.streaming.callers import hourly_callers

    out = hourly_callers(as_calls(table(spark, sf_dir, "events")))
    return out.select("caller", _us("window_start").alias("window_us"), "events", "errors", F.round("cost", 2).alias("cost"))


# Events land in four slices by their day. What comes in the last half hour of a slice's days lands with the next one (late, within the
# watermark of an hour); every 97th event of the first half lands with the last (too late).
_SLICES = """
WITH d AS (SELECT *, least(CAST(floor((day(ts) - 1) / 8) AS INT), 3) AS own, epoch_us(ts) AS t FROM events),
e AS (SELECT *, CASE WHEN event_id % 97 = 0 AND own < 2 THEN 3 WHEN least(CAST(floor((day(ts + INTERVAL 30 MINUTE) - 1) / 8) AS INT), 3) > own THEN own + 1 ELSE own END AS s FROM d),
m AS (SELECT s, max(t) // 1000 * 1000 AS top FROM e GROUP BY s),
l AS (SELECT e.*, coalesce((SELECT max(top) FROM m WHERE m.s < e.s) - 3600000000, -1) AS mark FROM e),
z AS (SELECT max(top) - 3600000000 AS done FROM m)"""


def _landing(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    slice_of = lambda t: F.least(F.floor((F.day(t) - 1) / 8).cast("int"), F.lit(3))
    own, soon = slice_of(F.col("ts")), slice_of(F.col("ts") + F.expr("interval 30 minutes"))
    dealt = e.withColumn("_slice", F.when((F.col("event_id") % 97 == 0) & (own < 2), 3).when(soon > own, own + 1).otherwise(own))
    return [as_calls(dealt.where(F.col("_slice") == k)) for k in range(4)]


@query(_SLICES + """
SELECT user_id AS caller, t // 3600000000 * 3600000000 AS window_us, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 2) AS cost
FROM l, z WHERE t // 3600000000 * 3600000000 + 3600000000 > mark GROUP BY 1, 2, done HAVING window_us + 3600000000 <= done""")
def stream_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyhawk.streaming.callers import hourly_callers, replay

    out = replay(_landing(spark, sf_dir), hourly_callers, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")
    return out.select("caller", _us("window_start").alias("window_us"), "events", "errors", F.round("cost", 2).alias("cost"))


@query(_SLICES + """,
t AS (SELECT DISTINCT user_id, t, done FROM l, z WHERE t > mark),
n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 3600000000 THEN 0 ELSE 1 END AS new FROM t),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT user_id AS caller, min(t) AS start_us, max(t) AS last_us, count(*) AS calls FROM r GROUP BY user_id, run, done HAVING count(*) >= 3 AND max(t) + 3600000001 <= done""")
def stream_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyhawk.streaming.callers import replay, session_loops

    out = replay(_landing(spark, sf_dir), lambda e: session_loops(e, gap="1 hour"), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")
    return out.select("caller", _us("start").alias("start_us"), (_us("end") - 3_600_000_001).alias("last_us"), "calls")


def _k() -> F.Column:
    return F.get_json_object("props", "$.k")


def _spans(events: DataFrame) -> DataFrame:
    t = _us("ts")
    return events.where("event_type = 'signup'").select("user_id", F.concat(F.lit("svc"), _k()).alias("service"), t.alias("start"), (t + 3_600_000_000).alias("end"))


@query("""
WITH a AS (SELECT user_id, 'svc' || json_extract_string(props, '$.k') AS service, epoch_us(ts) AS s, epoch_us(ts) + 3600000000 AS e FROM events WHERE event_type = 'signup'),
f AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'),
j AS (SELECT f.event_id, count(DISTINCT a.service) AS n, min(a.service) AS one FROM f LEFT JOIN a ON f.user_id = a.user_id AND f.t >= a.s AND f.t < a.e GROUP BY f.event_id)
SELECT event_id AS flow_id, n AS candidates, CASE WHEN n = 1 THEN one END AS service, CASE WHEN n = 1 THEN 'attributed' WHEN n > 1 THEN 'ambiguous' ELSE 'unattributed' END AS status FROM j""")
def dns_flow_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    flows = events.where("event_type = 'purchase'").select(F.col("event_id").alias("flow_id"), "user_id", _us("ts").alias("ts"))
    return network.attribute_flows(flows, _spans(events), ["user_id"])


@query("""
WITH v AS (SELECT event_id, user_id, event_type, json_extract_string(props, '$.k') AS k, epoch_us(ts) AS t FROM events),
tls AS (SELECT DISTINCT user_id, k FROM v WHERE event_type = 'click'),
dns AS (SELECT user_id, 'svc' || k AS service, t AS s, t + 3600000000 AS e FROM v WHERE event_type = 'signup'),
f AS (SELECT * FROM v WHERE event_type = 'purchase'),
d AS (SELECT f.event_id, count(DISTINCT dns.service) AS n, min(dns.service) AS one FROM f LEFT JOIN dns ON f.user_id = dns.user_id AND f.t >= dns.s AND f.t < dns.e GROUP BY f.event_id),
x AS (SELECT f.event_id, CASE WHEN tls.k IS NOT NULL THEN 'svc' || f.k END AS by_tls, d.n, CASE WHEN d.n = 1 THEN d.one END AS by_dns,
             CASE WHEN CAST(f.k AS INT) < 20 AND f.user_id NOT IN (SELECT user_id FROM dns) THEN 'local-model-server' END AS by_port
      FROM f JOIN d USING (event_id) LEFT JOIN tls ON f.user_id = tls.user_id AND f.k = tls.k)
SELECT event_id AS flow_id, CASE WHEN by_tls IS NOT NULL THEN by_tls WHEN n > 1 THEN NULL ELSE coalesce(by_dns, by_port) END AS service,
       CASE WHEN by_tls IS NOT NULL THEN 'tls' WHEN by_dns IS NOT NULL THEN 'dns' WHEN by_port IS NOT NULL AND n <= 1 THEN 'port' ELSE 'none' END AS way FROM x""")
def tls_priority_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    base = events.select("event_id", "event_type", F.lit("s").alias("sensor"), F.col("user_id").alias("client"), _k().alias("uid"), F.lit(None).cast("string").alias("server"), F.when(_k().cast("int") < 20, 11434).otherwise(443).alias("port"), _us("ts").alias("ts"))
    flows = base.where("event_type = 'purchase'").withColumnRenamed("event_id", "flow_id")
    tls = base.where("event_type = 'click'").withColumn("service", F.concat(F.lit("svc"), "uid"))
    return network.attribute_all(flows, tls, _spans(events).withColumnRenamed("user_id", "client"), ["client"])


@query("""
WITH s AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + 7200000000 AS e FROM events WHERE event_type = 'signup'),
m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, min(s) AS start, max(e) AS "end", count(*) AS spans FROM i GROUP BY user_id, island""")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", _us("ts").alias("start"), (_us("ts") + 7_200_000_000).alias("end"))
    return network.merge_intervals(s, ["user_id"])


@query("""
WITH a AS (SELECT user_id, event_id AS session, ts AS s, ts + INTERVAL 2 HOUR AS e FROM events WHERE event_type = 'signup'),
j AS (SELECT v.event_id, count(a.session) AS n, min(a.session) AS one FROM (SELECT * FROM events WHERE event_type = 'purchase') v
      LEFT JOIN a ON v.user_id = a.user_id AND v.ts BETWEEN a.s AND a.e GROUP BY v.event_id)
SELECT event_id, n AS candidates, CASE WHEN n = 1 THEN one END AS linked, CASE WHEN n = 1 THEN 'linked' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS status FROM j""")
def session_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    a = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("session"), F.col("t").alias("s"), (F.col("t") + F.expr("interval 2 hours")).alias("e"))
    return correlate.link_sessions(e.where("event_type = 'purchase'"), a, "user_id", "event_id", "t", "s", "e", "session")


@query("""
SELECT user_id, count(*) AS copies, count(DISTINCT event_type) > 1 AS conflict FROM events GROUP BY user_id""")
def event_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.dedupe_events(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("""
SELECT user_id, count(*) AS events, count(ts) AS timed_events, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def observation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type <> 'error'").withColumn("request_count", F.lit(1))
    o = callers.rollup_observations(e, ["user_id"])
    return o.select("user_id", "events", "timed_events", _us("first_seen").alias("first_us"), _us("last_seen").alias("last_us"))


@query("""
SELECT user_id, any_value(top) AS top_value FROM (
  SELECT user_id, first_value(event_type) OVER (PARTITION BY user_id ORDER BY n DESC, f, event_type) AS top
  FROM (SELECT user_id, event_type, count(*) AS n, min(epoch_us(ts)) AS f FROM events GROUP BY 1, 2)) GROUP BY user_id""")
def caller_top_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("value")).agg(F.count("*").alias("n"), F.min(_us("ts")).alias("first"))
    return callers.top_value(c, ["user_id"])


@query("""
SELECT user_id AS client, json_extract_string(props, '$.k') AS service, count(*) FILTER (event_type = 'signup') AS dns_queries, count(*) FILTER (event_type = 'click') AS tls_connections,
       count(*) FILTER (event_type = 'purchase') AS flows, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS bytes, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us
FROM events GROUP BY 1, 2""")
def contact_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "dns").when(F.col("event_type") == "click", "tls").when(F.col("event_type") == "purchase", "flow")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), _k().alias("service"), kind.alias("kind"), F.col("event_type").alias("host"), F.floor(F.col("value") * 100).cast("long").alias("bytes"), _us("ts").alias("ts"), F.lit("s").alias("sensor"))
    return network.rollup_contacts(rows).select("client", "service", "dns_queries", "tls_connections", "flows", "bytes", F.col("first_seen").alias("first_us"), F.col("last_seen").alias("last_us"))
