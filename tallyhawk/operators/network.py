"""Flows, DNS and TLS: interval union, attribution joins and contact rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhawk.operators.islands import join_spans, union_spans


def merge_intervals(spans: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of overlapping and touching spans of each key, with how many they were; see ``union_spans``."""
    return union_spans(spans, keys, start, end)


def dns_validity(dns: DataFrame, keys: Sequence[str], max_ttl: int = 86_400, skew: int = 5) -> DataFrame:
    """One span per answered address: from the answer until its shortest time to live (bounded) and some skew."""
    rows = dns.select(*[k for k in keys if k != "ip"], "ts", F.explode("answers").alias("ip"), F.least(F.coalesce(F.array_min("ttls"), F.lit(max_ttl)), F.lit(max_ttl)).alias("_ttl"))
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    return rows.select(*keys, start.alias("start"), (start + F.col("_ttl") + skew).alias("end"))


def attribute_flows(flows: DataFrame, spans: DataFrame, keys: Sequence[str], service: str = "service", flow_id: str = "flow_id", ts: str = "ts") -> DataFrame:
    """``flow_id, candidates, service, status`` for every flow.

    A flow meets the spans of its keys that hold its time; exactly one service attributes it, several make it
    ambiguous, none leaves it unattributed. Spans are merged first, so a service meets a flow once per island at
    most. Times are whole numbers of any unit, and spans of any length: see ``join_spans``. A null time or key is
    unattributed.
    """
    merged = merge_intervals(spans, [*keys, service]).select(*keys, F.col(service).alias("_service"), "start", "end")
    f = flows.select(F.col(flow_id).alias("_flow"), *keys, F.col(ts).cast("long").alias("_t"))
    joined = join_spans(f, merged, keys, "_t").groupBy(F.col("_flow").alias(flow_id)).agg(F.count_distinct("_service").alias("candidates"), F.min("_service").alias("_one"))
    status = F.when(F.col("candidates") == 1, "attributed").when(F.col("candidates") > 1, "ambiguous").otherwise("unattributed")
    return joined.select(flow_id, "candidates", F.when(F.col("candidates") == 1, F.col("_one")).alias("service"), status.alias("status"))


def attribute_by_tls(flows: DataFrame, tls: DataFrame, keys: Sequence[str] = ("sensor", "client", "uid")) -> DataFrame:
    """``flow_id, tls_service, tls_status`` by connection id; a server or port that differs makes it ambiguous."""
    t = tls.select(*keys, F.col("server").alias("_server"), F.col("port").alias("_port"), F.col("service").alias("_service"))
    fits = F.coalesce(F.col("server") == F.col("_server"), F.lit(True)) & F.coalesce(F.col("port") == F.col("_port"), F.lit(True))
    j = flows.select("flow_id", *keys, "server", "port").join(t, list(keys)).groupBy("flow_id").agg(F.bool_and(fits).alias("_fits"), F.count_distinct("_service").alias("_n"), F.min("_service").alias("_one"))
    status = F.when(~F.col("_fits") | (F.col("_n") > 1), "ambiguous").when(F.col("_n") == 1, "attributed").otherwise("not-ai")
    return flows.select("flow_id").join(j.select("flow_id", F.when(status == "attributed", F.col("_one")).alias("tls_service"), status.alias("tls_status")), "flow_id", "left")


def attribute_by_port(flows: DataFrame, spans: DataFrame, keys: Sequence[str], port: int = 11434, service: str = "local-model-server") -> DataFrame:
    """Flows to a local model server's port whose address no DNS answer named."""
    return flows.where(F.col("port") == port).join(spans.select(*keys).distinct(), list(keys), "left_anti").select("flow_id", F.lit(service).alias("port_service"))


def attribute_all(flows: DataFrame, tls: DataFrame, spans: DataFrame, dns_keys: Sequence[str]) -> DataFrame:
    """TLS first, then DNS, then port; a known connection to something else blocks the later ways."""
    by_tls, by_dns, by_port = attribute_by_tls(flows, tls), attribute_flows(flows, spans, dns_keys), attribute_by_port(flows, spans, dns_keys)
    out = by_tls.join(by_dns.select("flow_id", F.col("service").alias("dns_service"), F.col("status").alias("dns_status")), "flow_id", "left").join(by_port, "flow_id", "left")
    service = F.when(F.col("tls_status").isNotNull(), F.col("tls_service")).when(F.col("dns_status") == "ambiguous", F.lit(None)).otherwise(F.coalesce("dns_service", "port_service"))
    way = F.when(F.col("tls_status").isNotNull(), "tls").when(F.col("dns_service").isNotNull(), "dns").when(F.col("port_service").isNotNull() & (F.col("dns_status") != "ambiguous"), "port").otherwise("none")
    return out.select("flow_id", service.alias("service"), way.alias("way"))


def rollup_flow_groups(flows: DataFrame, keys: Sequence[str] = ("sensor", "client", "server", "port", "uid"), bucket: str = "1 hour") -> DataFrame:
    """Flows and bytes per connection key and time bucket."""
    return flows.groupBy(*keys, F.window(F.col("ts").cast("timestamp"), bucket).alias("w")).agg(F.count("*").alias("flows"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes")).select(*keys, F.col("w.start").alias("bucket_start"), "flows", "bytes")


def rollup_contacts(contacts: DataFrame) -> DataFrame:
    """Per (client, service): queries, connections, flows, bytes, hosts, first and last time, mixed contexts.

    ``contacts`` has ``client, service, kind (dns, tls, flow), host, bytes, ts, sensor``.
    """
    return contacts.where("service is not null").groupBy("client", "service").agg(
        F.count_if(F.col("kind") == "dns").alias("dns_queries"), F.count_if(F.col("kind") == "tls").alias("tls_connections"), F.count_if(F.col("kind") == "flow").alias("flows"),
        F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"), F.array_sort(F.collect_set("host")).alias("hosts"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        (F.count_distinct("sensor") > 1).alias("mixed_context"),
    )


def contact_evidence(contacts: DataFrame) -> DataFrame:
    """Evidence rows of contact rollups: dns .5, tls .7, flow .6, cadence .4 where ``loops`` is known."""
    signals = [("network:dns", F.when(F.col("dns_queries") > 0, 0.5)), ("network:tls", F.when(F.col("tls_connections") > 0, 0.7)), ("network:flow", F.when(F.col("flows") > 0, 0.6))]
    if "loops" in contacts.columns:
        signals.append(("network:cadence", F.when(F.col("loops") > 0, 0.4)))
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), w.alias("weight")) for s, w in signals]))
    return contacts.select("client", "service", rows.alias("e")).select("client", "service", "e.*").where("weight is not null")
