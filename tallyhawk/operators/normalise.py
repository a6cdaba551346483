"""Schema detection and normalisation of log exports into one event table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhawk.functions.scalars import called_tools, coerce_double, coerce_int, declared_tools, first_truthy, get_path, host_of, parse_timestamp
from tallyhawk.plans.session import cut

RAW = "raw"


def _has(*keys: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.array_contains(F.col("_keys"), k)
    return out


def _any(*keys: str) -> Column:
    return F.arrays_overlap(F.col("_keys"), F.array(*[F.lit(k) for k in keys]))


def _v(path: str) -> Column:
    return get_path(RAW, path)


def detect(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, else ``generic``."""
    out = None
    for name, test in rules:
        test = F.coalesce(test, F.lit(False))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("generic")


def log_rules() -> tuple[tuple[str, Column], ...]:
    """The known exports, in the order in which they are tried (fixed: it decides between exports with common fields)."""
    low, access = F.lower(F.col(RAW)), _v("request").rlike(r"^[^{\[]") | (_any("http_user_agent", "user_agent", "userAgent", "http.user_agent") & ~_has("model")) | _any("remote_addr", "request_uri", "clientIp", "requestUri", "c-ip", "elb")
    not_access = ~F.coalesce(access, F.lit(False))
    return (
        ("bedrock", (_v("schemaType") == "ModelInvocationLog") | _has("modelId", "identity", "input")),
        ("vertex", _has("protoPayload") & (_v("protoPayload.serviceName").contains("aiplatform") | _v("protoPayload.methodName").startswith("google.cloud.aiplatform."))),
        ("azure-openai", _v("category").isin("RequestResponse", "Audit", "Trace") & _any("properties", "callerIpAddress") & _any("resourceId", "ResourceId")),
        ("litellm", _has("spend") & _any("api_key", "call_type", "request_id")),
        ("kong", F.substring(RAW, 1, 2000).contains("ai.proxy") | _v("ai.proxy").isNotNull()),
        ("cloudflare", _has("gateway_id") | _has("provider", "request_type", "tokens_in") | _has("ai_gateway")),
        ("portkey", _has("trace_id", "virtual_key") | (not_access & F.substring(low, 1, 500).contains("portkey"))),
        ("helicone", (not_access & F.substring(low, 1, 1000).contains("helicone")) | (_has("request_properties") & F.substring(low, 1, 5000).contains("helicone-request-id"))),
        ("langfuse", _has("observation_id") | _has("traceId", "usageDetails") | ((_v("type") == "GENERATION") & _has("model")) | _has("project_id", "trace_id", "model")),
        ("openai-usage", _has("n_context_tokens_total") | _v("object").startswith("organization.usage") | _has("api_key_id", "input_tokens") | _has("actor", "effective_at")),
        ("anthropic-usage", _has("uncached_input_tokens") & _any("workspace_id", "model")),
        ("access-log", access),
    )


def detect_log_schema(rows: DataFrame) -> DataFrame:
    """``rows`` (JSON texts in ``raw``) with ``schema``; texts that are no object are ``generic``."""
    return rows.withColumn("_keys", F.coalesce(F.json_object_keys(RAW), F.array().cast("array<string>"))).withColumn("schema", detect(log_rules())).drop("_keys")


# Where each export keeps a field; the first path with a value counts. ``caller`` is a ladder of
# (kind, paths); the prefix names the caller's system.
FIELDS: dict[str, dict] = {
    "litellm": {"prefix": "litellm", "caller": (("api-key", ("api_key", "hashed_api_key", "key_hash")), ("service", ("api_key_alias", "key_alias", "metadata.user_api_key_alias"))), "ts": ("startTime", "start_time", "endTime", "timestamp"), "model": ("model", "model_group"), "provider": ("custom_llm_provider", "provider"), "host": ("api_base",), "user_agent": ("metadata.user_agent", "metadata.headers.user-agent", "request_tags.user_agent"), "ip": ("metadata.requester_ip_address", "requester_ip_address"), "user": ("user", "end_user", "metadata.user_api_key_user_id", "metadata.user_api_key_user_email"), "team": ("team_id", "metadata.user_api_key_team_id", "metadata.user_api_key_team_alias"), "request": ("proxy_server_request", "request", "metadata.proxy_server_request.body"), "response": ("response",), "tokens_in": ("prompt_tokens",), "tokens_out": ("completion_tokens",), "cost": ("spend",), "status": ("status",), "path": ("call_type",)},
    "portkey": {"prefix": "portkey", "caller": (("api-key", ("virtual_key", "config.virtual_key", "metadata.virtual_key", "api_key", "metadata._user", "metadata.user")),), "ts": ("created_at", "timestamp", "time"), "model": ("ai_model", "model", "response.body.model", "request.body.model"), "provider": ("ai_provider", "provider"), "user_agent": ("request.headers.user-agent", "metadata.user_agent", "headers.user-agent"), "user": ("metadata._user", "metadata.user"), "request": ("request.body", "request"), "response": ("response.body", "response"), "tokens_in": ("prompt_tokens", "response.body.usage.prompt_tokens"), "tokens_out": ("completion_tokens", "response.body.usage.completion_tokens"), "cost": ("cost",), "status": ("status", "response_status"), "path": ("endpoint", "request.url")},
    "kong": {"prefix": "kong", "caller": (("principal", ("consumer.username", "consumer.id", "authenticated_entity.consumer_id")), ("ip", ("client_ip",))), "ts": ("started_at", "timestamp"), "model": ("ai.proxy.meta.response_model", "ai.proxy.meta.request_model"), "provider": ("ai.proxy.meta.provider_name",), "host": ("upstream_uri", "request.url"), "user_agent": ("request.headers.user-agent",), "ip": ("client_ip",), "tokens_in": ("ai.proxy.usage.prompt_tokens",), "tokens_out": ("ai.proxy.usage.completion_tokens",), "cost": ("ai.proxy.usage.cost",), "status": ("response.status",), "path": ("request.uri", "route.paths.0")},
    "cloudflare": {"prefix": "cloudflare", "caller": (("api-key", ("api_key_id",)), ("user", ("metadata.user", "metadata.user_id", "metadata.userId")), ("service", ("gateway_id",))), "ts": ("created_at", "timestamp"), "model": ("model",), "provider": ("provider",), "user_agent": ("request_head.headers.user-agent", "request_headers.user-agent"), "request": ("request_head", "request_body"), "response": ("response_head", "response_body"), "tokens_in": ("tokens_in",), "tokens_out": ("tokens_out",), "cost": ("cost",), "status": ("status_code", "success"), "path": ("path", "request_type")},
    "helicone": {"prefix": "helicone", "caller": (("user", ("request_user_id", "user_id", "request_properties.Helicone-User-Id", "properties.Helicone-User-Id")), ("principal", ("request_properties.Helicone-Property-App", "properties.Helicone-Property-App"))), "ts": ("request_created_at", "created_at"), "model": ("request_model", "response_model", "model"), "provider": ("provider",), "host": ("request_path", "target_url"), "request": ("request_body",), "response": ("response_body",), "tokens_in": ("prompt_tokens",), "tokens_out": ("completion_tokens",), "cost": ("cost", "costUSD"), "status": ("response_status",), "path": ("request_path",)},
    "langfuse": {"prefix": "langfuse", "caller": (("user", ("userId", "user_id", "trace.userId")), ("service", ("name", "trace.name", "traceName", "projectId", "project_id"))), "ts": ("startTime", "start_time", "timestamp", "createdAt"), "model": ("model", "modelParameters.model"), "request": ("input",), "response": ("output",), "tokens_in": ("usage.input", "usageDetails.input", "usage.promptTokens", "promptTokens"), "tokens_out": ("usage.output", "usageDetails.output", "usage.completionTokens", "completionTokens"), "cost": ("calculatedTotalCost", "totalCost", "costDetails.total"), "status": ("level",), "path": ("name", "trace.name", "traceName")},
    "bedrock": {"prefix": "aws", "caller": (("principal", ("identity.arn", "identity")),), "ts": ("timestamp",), "model": ("modelId",), "ip": ("sourceIp", "requestMetadata.sourceIp"), "request": ("input.inputBodyJson",), "response": ("output.outputBodyJson",), "tokens_in": ("input.inputTokenCount",), "tokens_out": ("output.outputTokenCount",), "status": ("errorCode",), "path": ("operation",), "fixed": {"provider": "aws-bedrock"}},
    "azure-openai": {"prefix": "azure", "caller": (("principal", ("identity.claims.oid", "identity.authorization.objectId", "properties.identity.claims.oid", "identity.claims.appid", "identity.claims.upn")), ("ip", ("callerIpAddress", "CallerIPAddress"))), "ts": ("time", "TimeGenerated", "timestamp"), "model": ("properties.modelName", "properties.modelDeploymentName", "properties.deploymentName", "properties.model"), "host": ("resourceId", "ResourceId"), "user_agent": ("properties.userAgent", "properties.headers.user-agent"), "ip": ("callerIpAddress", "CallerIPAddress"), "user": ("identity.claims.upn", "identity.claims.name", "identity.claims.email"), "request": ("properties.requestBody", "properties.request"), "response": ("properties.responseBody", "properties.response"), "tokens_in": ("properties.promptTokens", "properties.usage.prompt_tokens"), "tokens_out": ("properties.completionTokens", "properties.usage.completion_tokens"), "status": ("resultSignature", "ResultSignature", "properties.statusCode"), "path": ("operationName", "OperationName", "properties.apiName"), "fixed": {"provider": "azure-openai"}},
    "vertex": {"prefix": "gcp", "caller": (("principal", ("protoPayload.authenticationInfo.principalEmail", "protoPayload.authenticationInfo.principalSubject")),), "ts": ("timestamp", "receiveTimestamp"), "model": ("protoPayload.resourceName",), "host": ("protoPayload.serviceName",), "user_agent": ("protoPayload.requestMetadata.callerSuppliedUserAgent",), "ip": ("protoPayload.requestMetadata.callerIp",), "request": ("protoPayload.request",), "response": ("protoPayload.response",), "status": ("protoPayload.status.code",), "path": ("protoPayload.methodName",), "fixed": {"provider": "google-vertex-ai"}},
    "openai-usage": {"prefix": "openai", "caller": (("api-key", ("api_key_id", "api_key")), ("user", ("user_id", "actor.id")), ("principal", ("project_id", "organization_id"))), "ts": ("start_time", "aggregation_timestamp", "timestamp", "effective_at"), "end": ("end_time",), "model": ("model", "snapshot_id"), "user": ("user_id",), "tokens_in": ("input_tokens", "n_context_tokens_total"), "tokens_out": ("output_tokens", "n_generated_tokens_total"), "count": ("num_model_requests", "n_requests"), "path": ("operation", "object"), "fixed": {"provider": "openai"}},
    "anthropic-usage": {"prefix": "anthropic", "caller": (("api-key", ("api_key_id",)), ("principal", ("workspace_id",))), "ts": ("starting_at", "start_time", "timestamp"), "end": ("ending_at", "end_time"), "model": ("model",), "tokens_in": ("uncached_input_tokens",), "tokens_out": ("output_tokens",), "fixed": {"provider": "anthropic"}},
    "access-log": {"prefix": "proxy", "caller": (("user", ("remote_user", "user", "http_user")), ("user-agent", ("http_user_agent", "user_agent", "userAgent", "http.user_agent")), ("ip", ("remote_addr", "client_ip", "clientIp", "c-ip"))), "ts": ("time", "timestamp", "@timestamp", "time_local", "time_iso8601", "date"), "host": ("host", "http_host", "server_name", "upstream_host", "requestUri"), "user_agent": ("http_user_agent", "user_agent", "userAgent", "http.user_agent"), "ip": ("remote_addr", "client_ip", "clientIp", "c-ip"), "user": ("remote_user", "user"), "status": ("status", "sc-status", "elb_status_code"), "method": ("request_method", "method", "requestMethod"), "path": ("request_uri", "path", "uri", "requestUri", "request")},
    "generic": {"prefix": "log", "caller": (("api-key", ("api_key", "apiKey", "api_key_id", "key", "key_id", "key_alias", "virtual_key", "token_id", "client_id", "clientId")), ("principal", ("principal", "principal_id", "identity.arn", "identity", "caller", "service", "service_name", "app", "application", "app_name", "source", "team", "team_id", "org", "project")), ("user", ("user", "user_id", "userId", "username", "email", "end_user", "sub", "actor")), ("user-agent", ("user_agent", "userAgent", "http_user_agent", "headers.user-agent", "request.headers.user-agent")), ("ip", ("ip", "client_ip", "source_ip", "remote_addr", "callerIp"))), "ts": ("timestamp", "time", "@timestamp", "ts", "created_at", "createdAt", "start_time", "startTime", "date", "datetime", "event_time"), "model": ("model", "model_id", "modelId", "model_name", "request.model", "response.model"), "provider": ("provider", "vendor", "llm_provider"), "host": ("host", "hostname", "api_base", "base_url", "url", "endpoint"), "user_agent": ("user_agent", "userAgent", "http_user_agent", "headers.user-agent", "request.headers.user-agent", "metadata.user_agent"), "ip": ("ip", "client_ip", "source_ip", "remote_addr", "callerIp"), "user": ("user", "user_id", "userId", "username", "email", "end_user", "sub", "actor"), "team": ("team", "team_id"), "request": ("request", "body", "request_body"), "response": ("response", "response_body"), "tokens_in": ("tokens_in", "prompt_tokens", "input_tokens", "usage.prompt_tokens", "usage.input_tokens"), "tokens_out": ("tokens_out", "completion_tokens", "output_tokens", "usage.completion_tokens", "usage.output_tokens"), "cost": ("cost", "spend", "total_cost"), "status": ("status", "status_code", "response_status"), "method": ("method", "http_method", "request_method"), "path": ("path", "endpoint", "operation", "request_uri", "uri")},
}


def _whole_body() -> Column:
    """The record; an object that ``properties`` holds as a text becomes the object (of equal keys the first counts)."""
    inner = F.get_json_object(RAW, "$.properties")
    return F.when(F.json_object_keys(inner).isNotNull(), F.concat(F.lit('{"properties":'), inner, F.lit(","), F.substring(F.trim(RAW), 2, 1 << 30))).otherwise(F.col(RAW))


def _fields(schema: str) -> list[Column]:
    """The ``llm_event`` columns of one export's JSON text in ``raw``."""
    spec = FIELDS[schema]

    def field(name: str) -> Column:
        if name in spec.get("fixed", {}):
            return F.lit(spec["fixed"][name])
        return first_truthy(*[_v(p) for p in spec.get(name, ())]) if spec.get(name) else F.lit(None).cast("string")

    who = [(kind, first_truthy(*[_v(p) for p in paths])) for kind, paths in spec["caller"]]
    name = F.coalesce(*[v for _, v in who])
    kind = None
    for k, v in who:
        kind = F.when(v.isNotNull(), k) if kind is None else kind.when(v.isNotNull(), k)
    kind = kind.otherwise("service")
    model = F.nullif(F.regexp_extract(field("model"), r"(publishers/[^/]+/models/[^/:\s]+|endpoints/[^/:\s]+|reasoningEngines/[^/:\s]+|models/[^/:\s]+)", 1), F.lit("")) if schema == "vertex" else field("model")
    status = F.coalesce(field("status"), F.lit("ok")) if schema in ("bedrock", "vertex") else field("status")
    counted = field("count")
    tokens_in = coerce_int(field("tokens_in"))
    if schema == "anthropic-usage":
        cached = [coerce_int(_v(p)) for p in ("cache_read_input_tokens", "cache_creation.ephemeral_5m_input_tokens", "cache_creation.ephemeral_1h_input_tokens", "cache_creation_input_tokens")]
        for c in cached:
            tokens_in = tokens_in + c
    path, method = field("path"), field("method")
    if schema == "access-log":
        line = F.regexp_extract(_v("request"), r"^([A-Z]+)\s+(\S+)", 1)
        method = F.coalesce(method, F.nullif(line, F.lit("")))
        path = F.coalesce(first_truthy(*[_v(p) for p in spec["path"][:-1]]), F.nullif(F.regexp_extract(_v("request"), r"^[A-Z]+\s+(\S+)", 1), F.lit("")))
    return [
        F.concat(F.lit(spec["prefix"] + ":"), F.coalesce(name, F.lit("unknown"))).alias("caller"), kind.alias("caller_kind"), F.coalesce(name, F.lit("unknown")).alias("caller_label"),
        parse_timestamp(field("ts")).alias("ts"), parse_timestamp(field("end")).alias("interval_end"), F.when(counted.isNotNull(), coerce_int(counted)).otherwise(1).alias("request_count"), counted.isNotNull().alias("aggregated"),
        model.alias("model"), field("provider").alias("provider"), host_of(field("host")).alias("host"), field("user_agent").alias("user_agent"), field("ip").alias("ip"), field("user").alias("user"), field("team").alias("team"),
        declared_tools(field("request")).alias("tools"), called_tools(field("response")).alias("tool_calls"), tokens_in.alias("tokens_in"), coerce_int(field("tokens_out")).alias("tokens_out"), coerce_double(field("cost")).alias("cost"),
        status.alias("status"), path.alias("path"), method.alias("method"), F.lit(schema).alias("schema"), name.isNotNull().alias("_known"),
    ]


def normalise(rows: DataFrame, schema: str) -> DataFrame:
    """JSON texts in ``raw`` of one export as ``llm_event`` columns; rows without any caller of a generic log are dropped."""
    if schema == "azure-openai":
        rows = rows.withColumn(RAW, _whole_body())
    out = rows.select(*_fields(schema))
    return (out.where("_known") if schema == "generic" else out).drop("_known")


def normalise_all(rows: DataFrame) -> DataFrame:
    """Detect each row's export once, write it, and normalise each export's rows; put together."""
    found = cut(detect_log_schema(rows))
    out = None
    for schema in FIELDS:
        branch = normalise(found.where(F.col("schema") == schema).select(RAW), schema)
        out = branch if out is None else out.unionByName(branch)
    return out


def discard_unusable_usage(events: DataFrame, most: float = 1e15) -> DataFrame:
    """Negative and absurd tokens and costs become 0; ``usage_discarded`` says where."""
    cols = ("tokens_in", "tokens_out", "cost")
    bad = F.lit(False)
    for c in cols:
        bad = bad | ~F.coalesce(F.col(c), F.lit(0)).between(0, most)
    return events.withColumns({"usage_discarded": bad} | {c: F.when(F.col(c).between(0, most), F.col(c)).otherwise(0) for c in cols})


def provider_alias(events: DataFrame, aliases: DataFrame, column: str = "provider") -> DataFrame:
    """``provider_id`` by alias, else by the provider's slug among the known ids."""
    own = F.lower(F.trim(F.col(column)))
    a = aliases.select(F.lower("alias").alias("_alias"), "provider_id")
    slug = F.concat(F.lit("provider."), F.regexp_replace(own, r"[^a-z0-9]+", "-"))
    ids = aliases.select(F.col("provider_id").alias("_id")).distinct()
    return events.join(a, own == F.col("_alias"), "left").join(ids, slug == F.col("_id"), "left").withColumn("provider_id", F.coalesce("provider_id", "_id")).drop("_alias", "_id")


def bind_workloads(events: DataFrame, bindings: DataFrame) -> DataFrame:
    """Operator-declared code resources of exact callers (and environment, where the binding names one)."""
    b = bindings.select(F.col("caller").alias("_c"), F.col("environment").alias("_env"), "code_resources", "assurance")
    return events.join(b, (F.col("caller") == F.col("_c")) & F.coalesce(F.col("_env") == F.col("environment"), F.col("_env").isNull()), "left").drop("_c", "_env")


def map_columns(rows: DataFrame, aliases: dict[str, Sequence[str]], own: dict[str, str] | None = None) -> DataFrame:
    """Logical columns of an app export by alias; a user's map goes first; rows whose aliases disagree are dropped."""
    norm = {c.lower().replace(" ", "_").replace("-", "_"): c for c in rows.columns}
    out, bad = [], F.lit(False)
    for logical, names in aliases.items():
        found = [own[logical]] if own and logical in own else [norm[n] for n in names if n in norm]
        values = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in found]
        out.append((F.coalesce(*values) if values else F.lit(None).cast("string")).alias(logical))
        if len(values) > 1:
            bad = bad | (F.size(F.array_distinct(F.array_compact(F.array(*values)))) > 1)
    return rows.where(~bad).select(*out)


def network_event(rows: DataFrame) -> DataFrame:
    """DNS, TLS and flow rows in one form: context, lower-case names, canonical addresses, least time to live, valid fingerprints."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    return rows.select(
        "kind", "ts", F.lower(text("client")).alias("client"), F.regexp_replace(F.lower(text("query")), r"\.$", "").alias("query"), "answers", F.array_min("ttls").alias("ttl"),
        F.lower(text("sni")).alias("sni"), text("uid").alias("uid"), F.lower(text("server")).alias("server"), F.col("port").cast("int").alias("port"), F.coalesce(F.col("bytes").cast("long"), F.lit(0)).alias("bytes"),
        F.when(F.col("ja4").rlike(r"^[tqd][0-9sd]{2}[di][0-9]{4}[a-z0-9]{2}_[0-9a-f]{12}_[0-9a-f]{12}$"), F.col("ja4")).alias("ja4"),
        F.struct("sensor", F.col("network").alias("network_id"), "resolver").alias("context"),
    )


def audit_event(rows: DataFrame, most: int = 2048) -> DataFrame:
    """Cloud audit records as flat events; rows with over-long values are dropped and no credential is copied."""
    names = {"event_id": ("eventID",), "event_name": ("eventName",), "event_source": ("eventSource",), "event_time": ("eventTime",), "region": ("awsRegion",), "account": ("recipientAccountId",), "identity_type": ("userIdentity.type",), "principal": ("userIdentity.arn",), "issuer": ("userIdentity.sessionContext.sessionIssuer.arn",), "role": ("requestParameters.roleArn",), "session": ("responseElements.assumedRoleUser.arn",), "expires": ("responseElements.credentials.expiration",), "source_identity": ("requestParameters.sourceIdentity",), "ip": ("sourceIPAddress",), "error": ("errorCode",)}
    out = rows.select(*[get_path(RAW, *p).alias(n) for n, p in names.items()])
    fits = F.lit(True)
    for n in names:
        fits = fits & F.coalesce(F.length(n) <= most, F.lit(True))
    return out.where(fits).withColumns({"event_time": parse_timestamp("event_time"), "expires": parse_timestamp("expires")})
