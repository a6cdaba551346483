"""Cloud audit logs, resources, policies and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhawk.functions.scalars import finding_id, get_path, glob_to_regex
from tallyhawk.operators.literals import candidates, index_patterns, regex_literal


def egress_policy_gap(workloads: DataFrame, policies: DataFrame) -> DataFrame:
    """Workloads in namespaces without an egress policy."""
    return workloads.join(policies.where("egress").select("cluster", "namespace").distinct(), ["cluster", "namespace"], "left_anti")


def rollup_audit_callers(events: DataFrame) -> DataFrame:
    """Per principal: calls, operations, models, addresses, regions, errors, first and last time."""
    sets = lambda c: F.array_sort(F.collect_set(c)).alias(f"{c}s")
    return events.where("principal is not null").groupBy("principal").agg(F.count("*").alias("calls"), sets("event_name"), sets("model"), sets("ip"), sets("region"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"))


AI_ACTIONS = ("bedrock:InvokeModel", "bedrock:InvokeModelWithResponseStream", "bedrock:InvokeAgent", "bedrock:CreateAgent", "bedrock-agentcore:InvokeAgentRuntime", "sagemaker:InvokeEndpoint", "sagemaker:CreateEndpoint", "qbusiness:ChatSync", "lambda:InvokeFunction")


def iam_policy_signals(policies: DataFrame, text: str = "policy") -> DataFrame:
    """``policy_id, actions, ai_actions, wildcard, not_action`` of the Allow statements of policy texts."""
    one_or_many = lambda j, f: F.coalesce(F.from_json(F.get_json_object(j, f"$.{f}"), "array<string>"), F.array_compact(F.array(F.get_json_object(j, f"$.{f}"))))
    body = F.get_json_object(text, "$.Statement")
    statements = F.when(body.startswith("["), F.from_json(body, "array<string>")).otherwise(F.array(body))
    s = policies.select("policy_id", F.explode(statements).alias("_s")).where(F.get_json_object("_s", "$.Effect") == "Allow")
    s = s.select("policy_id", one_or_many("_s", "Action").alias("a"), one_or_many("_s", "Resource").alias("r"), F.get_json_object("_s", "$.NotAction").isNotNull().alias("_not"))
    acts = F.array(*[F.lit(a) for a in AI_ACTIONS])
    x = s.select("policy_id", "_not", F.explode_outer("a").alias("action"), F.array_contains("r", "*").alias("_any"))
    hit = F.when(F.col("action").isNotNull(), F.filter(acts, lambda k: F.regexp_like(k, F.concat(F.lit("(?i)"), glob_to_regex("action")))))
    x = x.withColumn("_hit", F.when(F.col("action").contains("*") | F.col("action").contains("?"), hit).otherwise(F.filter(acts, lambda k: F.lower(k) == F.lower(F.col("action")))))
    return x.groupBy("policy_id").agg(F.array_sort(F.collect_set("action")).alias("actions"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_hit")))).alias("ai_actions"), F.bool_or(F.coalesce(F.col("action") == "*", F.lit(False)) & F.coalesce(F.col("_any"), F.lit(False))).alias("wildcard"), F.bool_or("_not").alias("not_action"))


# Record kind -> (path of the resource, resource type, kind of finding, weight, capability).
RESOURCES = {
    "bedrock-agent": ("agentArn", "bedrock-agent", "agent", 0.95, "tool-use"), "agentcore-runtime": ("agentRuntimeArn", "agentcore-runtime", "agent", 0.95, "tool-use"),
    "agentcore-gateway": ("gatewayArn", "agentcore-gateway", "mcp-server", 0.9, "mcp-server"), "sagemaker-endpoint": ("EndpointArn", "sagemaker-endpoint", "cloud-resource", 0.6, None),
    "lambda": ("FunctionArn", "lambda-function", "cloud-resource", 0.4, None), "state-machine": ("stateMachineArn", "state-machine", "workflow", 0.5, None),
    "qbusiness-application": ("applicationArn", "qbusiness-application", "ai-app", 0.9, "rag"), "secret-name": ("ARN", "secret", "secret", 0.4, None), "iam-principal": ("Arn", "iam-principal", "iam-grant", 0.5, None),
    "reasoning-engine": ("name", "reasoning-engine", "agent", 0.95, "tool-use"), "dialogflow-agent": ("name", "dialogflow-agent", "agent", 0.9, "tool-use"), "cloud-run-service": ("name", "cloud-run-service", "cloud-resource", 0.4, None),
    "service-account": ("email", "service-account", "service-identity", 0.4, None), "api-key": ("name", "api-key", "secret", 0.4, None),
    "foundry-agent": ("id", "foundry-agent", "agent", 0.95, "tool-use"), "deployment": ("id", "model-deployment", "cloud-resource", 0.7, None), "logicapp-definition": ("id", "logic-app", "workflow", 0.5, None),
    "genai-agent": ("id", "genai-agent", "agent", 0.95, "tool-use"), "oda-instance": ("id", "digital-assistant", "agent", 0.8, "tool-use"), "endpoint": ("id", "genai-endpoint", "cloud-resource", 0.7, None),
}


def cloud_resource_findings(records: DataFrame, provider: str) -> tuple[DataFrame, DataFrame]:
    """Findings and evidence of resource records (JSON texts in ``raw`` with ``_kind``) by the table above."""
    kind = F.get_json_object("raw", "$._kind")
    pick = lambda i: F.create_map(*[x for k, v in RESOURCES.items() for x in (F.lit(k), F.lit(v[i]).cast("double" if i == 3 else "string"))])[kind]
    resource = None
    for k, v in RESOURCES.items():
        value = get_path("raw", v[0], f"properties.{v[0]}")
        resource = F.when(kind == k, value) if resource is None else resource.when(kind == k, value)
    r = records.where(kind.isin(*RESOURCES)).select(resource.alias("resource"), pick(1).alias("resource_type"), pick(2).alias("kind"), pick(3).alias("weight"), pick(4).alias("capability"), get_path("raw", "displayName", "name", "agentName").alias("title"), get_path("raw", "account", "accountId", "project", "subscriptionId").alias("account"), get_path("raw", "region", "location").alias("region"), "raw").where("resource is not null")
    none = F.lit(None).cast("string")
    r = r.withColumn("id", finding_id(F.lit("2"), F.lit("cloud"), F.lit(f"cloud.{provider}"), F.lit(provider), F.col("account"), F.col("region"), F.col("resource"), none))
    f = r.select("id", F.lit("cloud").alias("surface"), F.lit(f"cloud.{provider}").alias("connector"), "kind", "title", "resource", "resource_type", F.lit(provider).alias("provider"), "account", "region", F.array_compact(F.array("capability")).alias("capabilities"))
    return f, r.select(F.col("id").alias("finding_id"), F.concat(F.lit("cloud:"), "resource_type").alias("signal"), "weight", none.alias("confidence_group"))


def k8s_workloads(containers: DataFrame, images: DataFrame, bindings: DataFrame, policies: DataFrame) -> DataFrame:
    """Container rows (``cluster, namespace, workload, service_account, image, env ARRAY<STRING>, gpu, privileged, exposed``) as workloads with tags."""
    patterns = index_patterns(images.select(F.col("pattern").alias("_p"), "signature_id"), regex_literal(F.col("_p")))
    known = candidates(containers.select("image").distinct(), F.col("image"), patterns).where(F.regexp_like(F.col("image"), F.col("_p"))).select("image", "signature_id").distinct()
    ai = containers.join(known, "image", "left")
    w = ai.groupBy("cluster", "namespace", "workload").agg(F.first("service_account").alias("service_account"), F.array_sort(F.collect_set("signature_id")).alias("frameworks"), F.bool_or("gpu").alias("gpu"), F.bool_or("privileged").alias("privileged"), F.bool_or("exposed").alias("exposed"), F.bool_or(F.exists("env", lambda e: e.rlike(r"^(OPENAI|ANTHROPIC|AZURE_OPENAI|GOOGLE|GEMINI|MISTRAL|COHERE)_.*KEY"))).alias("provider_env"))
    w = w.where((F.size("frameworks") > 0) | F.col("gpu") | F.col("provider_env"))
    gap = egress_policy_gap(w, policies).select("cluster", "namespace", "workload", F.lit(True).alias("_gap"))
    admin = bindings.where("role = 'cluster-admin'").select("cluster", "namespace", F.col("subject").alias("service_account"), F.lit(True).alias("_admin")).distinct()
    j = w.join(gap, ["cluster", "namespace", "workload"], "left").join(admin, ["cluster", "namespace", "service_account"], "left")
    tags = F.array_compact(F.array(F.when(F.col("gpu"), "gpu-workload"), F.when(F.col("privileged"), "privileged-pod"), F.when(F.col("exposed"), "exposed-llm-server"), F.when(F.col("_admin"), "cluster-admin"), F.when(F.col("_gap"), "no-egress-policy")))
    return j.select("cluster", "namespace", "workload", "frameworks", tags.alias("tags"))


PROVIDER_NAMES = r"(?:^|_)(OPENAI|ANTHROPIC|CLAUDE|GEMINI|MISTRAL|COHERE|HUGGINGFACE|HF|GROQ|DEEPSEEK|OPENROUTER|PERPLEXITY|TOGETHER|REPLICATE)(?:_|$)"


def stored_secret_names(rows: DataFrame, name: str = "name") -> DataFrame:
    """Stored secrets whose name suggests a model provider's credential; values are never read."""
    norm = F.upper(F.regexp_replace(F.col(name), r"[^A-Za-z0-9]+", "_"))
    return rows.where(norm.rlike(PROVIDER_NAMES)).withColumn("provider", F.concat(F.lit("provider."), F.lower(F.regexp_extract(norm, PROVIDER_NAMES, 1)))).withColumn("tags", F.array(F.lit("managed-secret")))


def ci_credentials(variables: DataFrame) -> DataFrame:
    """CI variables (``project, name, masked``) named like provider credentials; unmasked ones are tagged."""
    v = stored_secret_names(variables.where(F.upper("name").rlike(r"KEY|TOKEN|SECRET")))
    return v.withColumn("tags", F.array_compact(F.array(F.lit("ci-credentials"), F.when(~F.coalesce(F.col("masked"), F.lit(False)), "unmasked-ci-variable"))))


STATUS = {"APPROVED": "approved", "ACTIVE": "approved", "READY": "approved", "PENDING_APPROVAL": "pending", "PENDING": "pending", "DRAFT": "pending", "REJECTED": "rejected", "DEPRECATED": "deprecated", "DISABLED": "disabled"}


def vendor_registry_records(rows: DataFrame, registry: str) -> DataFrame:
    """Vendor registry rows (JSON in ``raw``) as records with status, approval mode, bindings and listing completeness."""
    status = F.coalesce(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.upper(get_path("raw", "status", "state"))], F.lit("unknown"))
    resources = F.coalesce(F.from_json(F.get_json_object("raw", "$.resources"), "array<string>"), F.array_compact(F.array(get_path("raw", "resourceArn", "resource", "servicePrincipalId"))))
    bind = F.transform(resources, lambda r: F.struct(r.alias("resource"), get_path("raw", "provider").alias("provider"), get_path("raw", "accountId", "account").alias("account"), get_path("raw", "region").alias("region")))
    return rows.select(F.lit(registry).alias("registry"), get_path("raw", "recordId", "id", "name").alias("record_id"), status.alias("status"), F.lower(F.coalesce(get_path("raw", "approvalMode", "provenance"), F.lit("manual"))).alias("approval_mode"), bind.alias("bindings"), F.coalesce(get_path("raw", "listingComplete", "coverage.complete").try_cast("boolean"), F.lit(False)).alias("listing_complete"))
