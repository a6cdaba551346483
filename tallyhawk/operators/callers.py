"""Gateway callers: rollups, cadence, temporal shape and evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhawk.functions.scalars import agent_operation, is_browser_ua, is_generation, is_mcp_request
from tallyhawk.operators.islands import union_spans

STATIC = r"(?i)\.(?:js|css|png|jpe?g|gif|svg|ico|woff2?|ttf|map|html?)$|^/(?:healthz?|livez|readyz|metrics|ping|status|favicon\.ico|robots\.txt)/?$"
INFERENCE = r"(?i)/(?:chat/completions|completions|responses|messages|embeddings|generate|converse|invoke)(?:[/?:-]|$)|:(?:streamG|g)enerateContent|/(?:threads|runs|assistants|agents|runtimes|reasoningEngines)(?:/|$)|/mcp/?$"


def is_static_or_probe(path: Column) -> Column:
    """Assets and health probes, unless the path names an inference operation."""
    bare = F.split(path, r"\?")[0]
    return F.coalesce(bare.rlike(STATIC) & ~bare.rlike(INFERENCE), F.lit(False))


def is_llm_traffic(events: DataFrame, host_known: Column) -> DataFrame:
    """Rows of a model, of an inference path, or to a host known for models; self-hosted paths need such a host."""
    self_hosted = F.col("path").rlike(r"^/api/(?:chat|generate|tags)")
    wanted = F.col("model").isNotNull() | host_known | (F.col("path").rlike(INFERENCE) & ~self_hosted)
    return events.where(F.coalesce(wanted, F.lit(False)) & ~is_static_or_probe(F.col("path")))


def untrusted_host_report(events: DataFrame, trusted: Column, claimed: Column) -> DataFrame:
    """How many rows would be model traffic only by a host that the client wrote."""
    return events.agg(F.count_if(claimed & ~trusted & ~F.coalesce(F.col("path").rlike(INFERENCE), F.lit(False))).alias("rows_by_untrusted_host"), F.count("*").alias("rows"))


def rollup_callers(events: DataFrame, keys: Sequence[str] = ("caller",)) -> DataFrame:
    """One row per caller (and scope columns): requests, records, tokens, cost, errors, tools, first and last time.

    Rows that stand for no request are left out; a row without a count is one request. Null numbers add 0.
    Partial sums are made before the only shuffle.
    """
    n = F.coalesce(F.col("request_count"), F.lit(1))
    error = F.coalesce(~F.lower("status").rlike(r"^(ok|success|true|2\d\d|)$"), F.lit(False))
    return (
        events.where(n > 0)
        .groupBy(*keys)
        .agg(
            F.sum(n).alias("events"),
            F.count("*").alias("records"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
            F.sum(F.coalesce("tokens_in", F.lit(0))).alias("tokens_in"),
            F.sum(F.coalesce("tokens_out", F.lit(0))).alias("tokens_out"),
            F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"),
            F.sum(F.when(error, n).otherwise(0)).alias("errors"),
            F.sum(F.when(F.col("tools"), n).otherwise(0)).alias("tool_requests"),
            F.sum(F.when(F.col("tools").isNotNull(), n).otherwise(0)).alias("tool_known"),
            F.sum(F.when(F.col("tool_calls"), n).otherwise(0)).alias("tool_call_responses"),
            F.array_sort(F.collect_set("schema")).alias("schemas"),
        )
    )


def caller_distributions(events: DataFrame, dims: Sequence[str], keys: Sequence[str] = ("caller",), top: int = 10) -> DataFrame:
    """``keys, dim, value, n, place``: the ``top`` most frequent values of each dimension, ties by value."""
    n = F.coalesce(F.col("request_count"), F.lit(1)) if "request_count" in events.columns else F.lit(1)
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims]))
    counts = events.select(*keys, n.alias("_n"), pairs.alias("p")).where("p.value is not null and p.value <> ''").groupBy(*keys, "p.dim", "p.value").agg(F.sum("_n").alias("n"))
    order = Window.partitionBy(*keys, "dim").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def top_value(counts: DataFrame, keys: Sequence[str], value: str = "value", n: str = "n", first: str = "first") -> DataFrame:
    """The most frequent value of each key; ties go to the one seen first, then to the lesser value."""
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col(n), F.col(first), F.col(value))).alias("top_value"))


def rollup_observations(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events, timed events, first and last time for each key."""
    n = F.coalesce(F.col("request_count"), F.lit(1))
    return events.groupBy(*keys).agg(F.sum(n).alias("events"), F.count("ts").alias("timed_events"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def usage_intervals(events: DataFrame, key: str = "caller") -> DataFrame:
    """Aggregate rows kept per caller as (start, end, requests, model), in order."""
    fields = F.struct(F.col("ts").alias("start"), F.col("interval_end").alias("end"), F.col("request_count").alias("requests"), "model")
    return events.where("aggregated").groupBy(key).agg(F.array_sort(F.collect_list(fields)).alias("intervals"))


def loop_cadence(events: DataFrame, keys: Sequence[str], ts: str = "ts", gap_seconds: float = 30.0, least: int = 3) -> DataFrame:
    """Runs of calls at most ``gap_seconds`` apart; a run of ``least`` different times or more is a loop.

    Columns: ``calls`` (different times), ``loops``, ``longest`` (0 without a loop), ``calls_in_loops``, ``share``.
    Rows without a time don't count. A busy caller is many tasks: see ``union_spans``.
    """
    times = events.where(F.col(ts).isNotNull()).select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t")).distinct()
    runs = union_spans(times.withColumn("_u", F.col("_t")), keys, "_t", "_u", gap=int(gap_seconds * 1_000_000)).withColumnRenamed("spans", "_n")
    loop = F.col("_n") >= least
    out = runs.groupBy(*keys).agg(
        F.sum("_n").alias("calls"), F.count_if(loop).alias("loops"), F.coalesce(F.max(F.when(loop, F.col("_n"))), F.lit(0)).alias("longest"),
        F.coalesce(F.sum(F.when(loop, F.col("_n"))), F.lit(0)).alias("calls_in_loops"),
    )
    return out.withColumn("share", F.round(F.col("calls_in_loops") / F.col("calls"), 6))


def temporal_shape(events: DataFrame, keys: Sequence[str], ts: str = "ts", least: int = 50) -> DataFrame:
    """Active hours, night (22-06 UTC) and weekend shares of keys with ``least`` timed calls; ``always_on``."""
    t = F.col(ts).cast("timestamp")
    out = (
        events.where(F.col(ts).isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("timed"), F.count_distinct(F.hour(t)).alias("active_hours"),
            F.count_if((F.hour(t) < 6) | (F.hour(t) >= 22)).alias("_night"), F.count_if(F.weekday(t) >= 5).alias("_weekend"),
        )
        .where(F.col("timed") >= least)
    )
    night, weekend = F.col("_night") / F.col("timed"), F.col("_weekend") / F.col("timed")
    return out.select(
        *keys, "timed", "active_hours", F.round(night, 6).alias("night_share"), F.round(weekend, 6).alias("weekend_share"),
        ((F.col("active_hours") >= 20) | ((night > 0.25) & (weekend > 0.15))).alias("always_on"),
    )


# Weight of what a caller is known by.
CALLER_KIND = {"api-key": 0.35, "principal": 0.35, "service": 0.45, "user": 0.15, "user-agent": 0.2, "ip": 0.15}


def caller_evidence(callers: DataFrame, key: str = "caller") -> DataFrame:
    """Evidence rows ``(key, signal, weight)`` of rolled-up callers.

    Reads the columns of ``rollup_callers`` and, where there, ``caller_kind, n_models, always_on, corroborated,
    agent_operations, mcp_requests, loops, browser_share``.
    """
    has = set(callers.columns)
    ratio = F.col("tool_requests") / F.col("tool_known")
    signals = [
        ("gateway:tool-use", F.when(ratio > 0, F.least(F.lit(0.9), 0.4 + 0.5 * ratio))),
        ("gateway:tool-calls", F.when((F.col("tool_call_responses") > 0) & ~F.coalesce(ratio > 0, F.lit(False)), F.lit(0.6))),
        ("gateway:volume", F.when(F.col("events") >= 1000, F.lit(0.2))),
    ]
    if "n_models" in has:
        signals.append(("gateway:multi-model", F.when(F.col("n_models") >= 4, F.lit(0.2))))
    if "caller_kind" in has:
        kinds = F.create_map(*[F.lit(x) for kv in CALLER_KIND.items() for x in kv])
        signals.append(("gateway:caller", F.coalesce(kinds[F.col("caller_kind")], F.lit(0.15))))
    if "always_on" in has:
        signals.append(("gateway:always-on", F.when(F.col("always_on"), F.when(F.col("corroborated"), 0.5).otherwise(0.3))))
    if "agent_operations" in has:
        signals.append(("gateway:agent-invocation", F.when(F.col("agent_operations") > 0, F.lit(0.7))))
    if "mcp_requests" in has:
        signals.append(("gateway:mcp-client", F.when(F.col("mcp_requests") > 0, F.lit(0.6))))
    if "loops" in has:
        browser = F.coalesce(F.col("browser_share"), F.lit(0.0)) if "browser_share" in has else F.lit(0.0)
        signals.append(("gateway:agent-loop", F.when((F.col("loops") > 0) & (browser < 0.5), F.lit(0.45))))
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), w.cast("double").alias("weight")) for s, w in signals]))
    return callers.select(key, rows.alias("e")).select(key, "e.signal", "e.weight").where("weight is not null")


def caller_behaviour(events: DataFrame, key: str = "caller", gap_seconds: float = 30.0) -> DataFrame:
    """Per caller: hosted-agent operations, MCP requests, loops of generation steps, share of browser requests."""
    flags = events.select(
        key, "ts", agent_operation("path", "method", "host").isNotNull().alias("_op"), is_mcp_request("path", F.lit(False)).alias("_mcp"),
        is_generation("path", "model", "method").alias("_gen"), is_browser_ua("user_agent").alias("_browser"),
    )
    counts = flags.groupBy(key).agg(F.count_if("_op").alias("agent_operations"), F.count_if("_mcp").alias("mcp_requests"), F.avg(F.col("_browser").cast("double")).alias("browser_share"))
    loops = loop_cadence(flags.where("_gen"), [key], gap_seconds=gap_seconds).select(key, "loops", "longest", "share")
    return counts.join(loops, key, "left").withColumn("loops", F.coalesce("loops", F.lit(0)))


def caller_findings(events: DataFrame, least_events: int = 1) -> tuple[DataFrame, DataFrame]:
    """Findings and evidence of gateway callers: rollup, shape, behaviour and owner put together."""
    from tallyhawk.functions.scalars import finding_id

    base = rollup_callers(events).where(F.col("events") >= least_events)
    kinds = events.groupBy("caller").agg(F.min("caller_kind").alias("caller_kind"), F.min_by("caller_label", "ts").alias("label"), F.count_distinct("model").alias("n_models"), F.count_distinct("user").alias("n_users"))
    users = events.where("user is not null").groupBy("caller", F.col("user").alias("value")).agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    teams = events.where("team is not null").groupBy("caller", F.col("team").alias("value")).agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    full = (
        base.join(kinds, "caller")
        .join(caller_behaviour(events), "caller", "left")
        .join(temporal_shape(events, ["caller"]).select("caller", "always_on", "night_share", "weekend_share"), "caller", "left")
        .join(top_value(users, ["caller"]).withColumnRenamed("top_value", "_user"), "caller", "left")
        .join(top_value(teams, ["caller"]).withColumnRenamed("top_value", "_team"), "caller", "left")
    )
    unattended = F.col("caller_kind").isin("service", "principal") | ((F.col("caller_kind") == "api-key") & (F.col("n_users") == 0))
    full = full.withColumn("corroborated", F.col("always_on") & (unattended | (F.col("tool_requests") > 0) | (F.col("tool_call_responses") > 0)))
    full = full.withColumn("id", finding_id(F.lit("2"), F.lit("gateway"), F.lit("gateway.logs"), F.lit(None), F.lit(None), F.lit(None), F.col("caller"), F.lit(None)))
    evidence = caller_evidence(full, "id").withColumn("confidence_group", F.lit(None).cast("string"))
    tool = (F.col("tool_requests") > 0) | (F.col("tool_call_responses") > 0)
    tags = F.array_compact(F.array(
        F.when(F.col("always_on"), "always-on"), F.when(unattended & (F.col("n_users") == 0), "no-end-user-attribution"), F.when(F.col("errors") / F.col("events") > 0.2, "high-error-rate"),
    ))
    findings = full.select(
        "id", F.lit("gateway").alias("surface"), F.lit("gateway.logs").alias("connector"), F.lit("gateway-caller").alias("kind"), F.col("label").alias("title"), F.col("caller").alias("resource"),
        F.coalesce("_user", "_team").alias("owner"), F.array_compact(F.array(F.when(tool, "tool-use"), F.when(F.col("corroborated"), "autonomous"))).alias("capabilities"), tags.alias("tags"),
        F.lit(None).cast("boolean").alias("shadow"), "first_seen", "last_seen", "events",
    )
    return findings, evidence
