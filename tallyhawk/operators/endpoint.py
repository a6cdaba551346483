"""Processes, tool servers, local models and agent settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhawk.functions.scalars import plaintext_remote, version_pinned


def tool_name_shadowing(tools: DataFrame, name: str = "name", server: str = "server") -> DataFrame:
    """Tools whose name (case folded) another server has too."""
    n = tools.groupBy(F.lower(name).alias("_k")).agg((F.count_distinct(server) > 1).alias("shadowed"))
    return tools.join(n, F.lower(F.col(name)) == F.col("_k"), "left").drop("_k")


def definition_digest(definition: Column) -> Column:
    """SHA-256 of a definition's JSON."""
    return F.sha2(F.to_json(definition), 256)


POISON = r"(?i)\b(?:ignore|disregard)\b.{0,40}\b(?:previous|prior|all)\b.{0,30}\binstructions?\b|<(?:important|system|secret)>|do not (?:tell|inform|mention).{0,30}\buser\b|\b(?:read|send|include|append)\b.{0,60}(?:~/\.ssh|id_rsa|\.env\b|credentials?|api[_ -]?keys?)"
HIDDEN = r"[​‌‍⁠‪-‮⁦-⁩﻿]|\x1b\["


def mcp_tool_audit(tools: DataFrame) -> DataFrame:
    """Tool rows (``server, auth_mode, name, description``) with tags and a digest of the definition."""
    t = tool_name_shadowing(tools)
    d = F.coalesce("description", F.lit(""))
    words = F.when(d.rlike(r"(?i)\b(?:shell|exec|run command|subprocess)\b"), "code-exec")
    data = F.when(d.rlike(r"(?i)\b(?:file|database|sql|read|write)\b"), "data-access")
    tags = F.array_compact(F.array(F.when(d.rlike(POISON), "tool-poisoning"), F.when(d.rlike(HIDDEN), "invisible-text"), F.when(F.col("shadowed"), "tool-name-shadowing"), F.when(F.coalesce(F.col("auth_mode"), F.lit("none")).isin("", "none"), "unauthenticated-mcp")))
    return t.select("server", "name", tags.alias("tags"), F.array_compact(F.array(words, data)).alias("capabilities"), definition_digest(F.struct("name", "description")).alias("digest"))


def mcp_server_risk(servers: DataFrame) -> DataFrame:
    """Server records (``server_id, package, url, command, args, auto_approve, disabled``) with risk tags."""
    line = F.concat_ws(" ", "command", F.array_join(F.coalesce("args", F.array().cast("array<string>")), " "))
    wide = F.exists(F.coalesce("args", F.array().cast("array<string>")), lambda a: a.rlike(r"^(/|~/?|/home/?|/Users/?|/root/?|[A-Z]:\\?|\$HOME)$"))
    tags = F.array_compact(F.array(
        F.when(F.col("package").isNotNull() & ~F.coalesce(version_pinned("package"), F.lit(False)), "mcp-unpinned-package"), F.when(plaintext_remote(F.coalesce("url", F.lit(""))), "mcp-insecure-transport"),
        F.when(F.coalesce(F.col("auto_approve"), F.lit(False)), "mcp-auto-approve"), F.when(line.rlike(r"(?i)filesystem") & wide, "mcp-broad-filesystem"), F.when(line.rlike(r"(?i)^(?:\S*/)?(?:ba|z|da)?sh\s+-\w*c\b|^(?:cmd|powershell)(?:\.exe)?\b"), "mcp-shell-command"),
    ))
    return servers.where("not coalesce(disabled, false)").select("server_id", tags.alias("tags"))


def mcp_config_servers(files: DataFrame, text: str = "text") -> DataFrame:
    """``path, server_id, ...``: the servers of configuration texts."""
    spec = "map<string, struct<command:string, args:array<string>, url:string, env:map<string,string>, disabled:boolean, autoApprove:array<string>, type:string>>"
    body = F.coalesce(F.get_json_object(text, "$.mcpServers"), F.get_json_object(text, "$.servers"))
    s = files.select("path", F.explode(F.from_json(body, spec)).alias("server_id", "s")).select("path", "server_id", "s.*")
    launched = F.filter(F.col("args"), lambda a: ~a.startswith("-"))[0]
    package = F.when(F.col("command").rlike(r"(?:^|/)(?:npx|uvx|bunx|pipx)$"), launched)
    return s.select("path", "server_id", "command", "args", "url", package.alias("package"), (F.size("autoApprove") > 0).alias("auto_approve"), "disabled", F.coalesce("type", F.when(F.col("url").isNotNull(), "http").otherwise("stdio")).alias("transport"), F.coalesce(F.exists(F.map_values("env"), lambda v: F.length(v) >= 16), F.lit(False)).alias("inline_secret"))


def mcp_config_findings(files: DataFrame, text: str = "text") -> DataFrame:
    """One row per configuration file: enabled servers, transports, inline secrets, risk tags."""
    s = mcp_config_servers(files, text)
    risk = mcp_server_risk(s.withColumn("server_id", F.concat_ws("\x1f", "path", "server_id"))).select(F.split("server_id", "\x1f")[0].alias("path"), F.explode_outer("tags").alias("tag")).groupBy("path").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    per = s.groupBy("path").agg(F.count_if(~F.coalesce(F.col("disabled"), F.lit(False))).alias("enabled"), F.array_sort(F.collect_set("transport")).alias("transports"), F.bool_or("inline_secret").alias("inline_secrets"))
    return per.join(risk, "path", "left")


def agent_posture(settings: DataFrame, text: str = "settings") -> DataFrame:
    """``key, tags, approval_scope`` of agent settings (JSON texts)."""
    j = lambda p: F.get_json_object(text, p)
    bypass = (j("$.permissions.defaultMode") == "bypassPermissions") | (j("$.approval_policy") == "never") | (j("$.GOOSE_MODE") == "auto")
    shell = F.coalesce(j("$.permissions.allow"), F.lit("")).rlike(r'"Bash(\(\*\)|\(:\*\))?"')
    unboxed = (j("$.sandbox_mode") == "danger-full-access") | (j("$.sandbox.enabled") == "false")
    host = j("$.gateway.bind")
    exposed = host.isNotNull() & ~host.isin("127.0.0.1", "localhost", "::1", "loopback")
    open_ = exposed & j("$.gateway.auth.token").isNull()
    yes = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v)
    tags = F.array_compact(F.array(yes(bypass, "posture-permissions-bypassed"), yes(shell, "posture-unrestricted-shell"), yes(unboxed, "posture-unsandboxed"), yes(exposed, "posture-exposed-gateway"), yes(open_, "posture-unauthenticated-gateway")))
    scope = F.when(j("$.approval_policy").isin("untrusted", "always"), "every-action").when((j("$.approval_policy") == "on-request") | (j("$.permissions.defaultMode") == "default"), "some-actions")
    return settings.select("*", tags.alias("tags"), scope.alias("approval_scope"))


def normalise_process(rows: DataFrame) -> DataFrame:
    """Process rows (``host, pid, name, path, cmdline, username, start_time``) with program, arguments and start; bad identities dropped."""
    argv = F.filter(F.split(F.trim(F.coalesce("cmdline", F.lit(""))), r"\s+"), lambda a: a != "")
    exe = F.lower(F.element_at(F.split(F.coalesce(F.nullif("path", F.lit("")), F.col("name")), r"[/\\]"), -1))
    ok = (F.col("pid").cast("long") > 0) & (F.coalesce("host", F.lit("")) != "") & (F.coalesce(exe, F.lit("")) != "")
    return rows.where(ok).select(F.lower("host").alias("host"), F.col("pid").cast("long").alias("pid"), F.regexp_replace(exe, r"\.exe$", "").alias("exe"), argv.alias("argv"), F.col("username").alias("user"), F.timestamp_seconds(F.col("start_time").cast("long")).alias("started"))


def classify_process(processes: DataFrame, rules: DataFrame) -> DataFrame:
    """Processes by program, else by what a launcher starts (npx, uvx, python -m, node), against ``match, tool`` rows."""
    word = lambda i: F.element_at(F.filter("argv", lambda a: ~a.startswith("-")), i)
    target = F.when(F.col("exe").rlike(r"^(npx|uvx|bunx|pipx)$"), F.try_element_at(F.filter("argv", lambda a: ~a.startswith("-")), F.lit(2))).when(F.col("exe").rlike(r"^python[0-9.]*$"), F.nullif(F.regexp_extract(F.array_join("argv", " "), r"\s-m\s+(\S+)", 1), F.lit(""))).when(F.col("exe").rlike(r"^(node|deno|bun)$"), F.nullif(F.regexp_extract(F.array_join("argv", " "), r"node_modules/((?:@[^/\s]+/)?[^/\s]+)", 1), F.lit("")))
    p = processes.withColumn("_t", F.regexp_replace(F.coalesce(target, F.lit("")), r"(?<=.)@[^/]*$", ""))
    names = p.withColumn("_m", F.explode(F.array_distinct(F.array("exe", "_t"))))
    return names.join(rules.select(F.col("match").alias("_m"), "tool"), "_m").drop("_m").withColumnRenamed("_t", "target")


def rollup_processes(processes: DataFrame, sample: int = 10) -> DataFrame:
    """Per (host, user, tool): processes, sample of pids, programs, packages, first and last start."""
    return processes.groupBy("host", "user", "tool").agg(F.count("*").alias("processes"), F.slice(F.array_sort(F.collect_set("pid")), 1, sample).alias("pids"), F.array_sort(F.collect_set("exe")).alias("programs"), F.array_sort(F.collect_set(F.nullif("target", F.lit("")))).alias("packages"), F.min("started").alias("first_seen"), F.max("started").alias("last_seen"))


def rollup_endpoint_items(items: DataFrame) -> DataFrame:
    """Per (device, home, product): locations, greatest version, posture."""
    return items.groupBy("device", "home", "product").agg(F.array_sort(F.collect_set("location")).alias("locations"), F.max_by("version", F.transform(F.split("version", r"\."), lambda v: F.coalesce(v.try_cast("int"), F.lit(0)))).alias("version"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("posture")))).alias("posture"))


def rollup_genai_spans(spans: DataFrame) -> DataFrame:
    """Per (service, agent, system): models, operations, spans. Attributes are a map; contents are never read."""
    a = lambda *names: F.coalesce(*[F.col("attributes")[n] for n in names])
    s = spans.select(a("service.name").alias("service"), a("gen_ai.agent.name", "gen_ai.agent.id").alias("agent"), a("gen_ai.system", "gen_ai.provider.name").alias("system"), a("gen_ai.request.model", "gen_ai.response.model").alias("model"), a("gen_ai.operation.name").alias("operation"))
    return s.where("system is not null or model is not null").groupBy("service", "agent", "system").agg(F.array_sort(F.collect_set("model")).alias("models"), F.array_sort(F.collect_set("operation")).alias("operations"), F.count("*").alias("spans"))


LOCAL_PORTS = (11434, 1234, 8080, 8000)


def ebpf_egress(events: DataFrame, ai_hosts: DataFrame) -> DataFrame:
    """Connections to known hosts or local model ports, per process and destination."""
    known = events.join(ai_hosts.select(F.col("host").alias("destination"), F.lit(True).alias("_ai")), "destination", "left")
    return known.where(F.col("_ai") | F.col("destination_port").isin(*LOCAL_PORTS)).groupBy("process_name", "destination", "destination_port", "namespace", "pod").agg(F.count("*").alias("connections"))


def local_models(endpoints: DataFrame) -> DataFrame:
    """One row per model of an endpoint; exposed when it listens beyond loopback."""
    exposed = ~F.col("endpoint").rlike(r"^(?:https?://)?(?:localhost|127\.[0-9.]+|\[::1\])(?::|/|$)")
    return endpoints.select("endpoint", exposed.alias("exposed"), F.explode("models").alias("m")).select("endpoint", "exposed", F.col("m.name").alias("model"), F.col("m.size").alias("size"))


def model_artifacts(files: DataFrame) -> DataFrame:
    """Stored model files; formats that run code when loaded are unsafe."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.where(kind.isin("pt", "pth", "bin", "pkl", "pickle", "ckpt", "safetensors", "gguf", "onnx", "h5")).select("path", "size", kind.alias("format"), F.when(kind.isin("pt", "pth", "bin", "pkl", "pickle", "ckpt"), F.array(F.lit("unsafe-serialization"))).otherwise(F.array().cast("array<string>")).alias("tags"))


def host_runtimes(rows: DataFrame) -> DataFrame:
    return rows.select(F.trim("name").alias("name"), F.lower("type").alias("type"), "source").where("name <> ''").distinct()


def agent_cards(cards: DataFrame, text: str = "card", supported: tuple[str, ...] = ("0.2", "0.3", "1.0")) -> DataFrame:
    """Agent Card texts: plain-text interfaces, no declared security, unsupported version."""
    j = lambda p: F.get_json_object(text, p)
    urls = F.concat(F.array_compact(F.array(j("$.url"))), F.coalesce(F.from_json(j("$.supportedInterfaces[*].url"), "array<string>"), F.array_compact(F.array(j("$.supportedInterfaces[0].url")))))
    version = F.regexp_extract(F.coalesce(j("$.protocolVersion"), F.lit("")), r"^(\d+\.\d+)", 1)
    tags = F.array_compact(F.array(F.when(F.exists(urls, plaintext_remote), "a2a-plaintext-interface"), F.when(j("$.securitySchemes").isNull() & j("$.security").isNull(), "no-auth-declared"), F.when((version != "") & ~version.isin(*supported), "a2a-unsupported-version")))
    return cards.select("*", j("$.name").alias("name"), urls.alias("urls"), tags.alias("tags"))


def coding_agents(files: DataFrame) -> DataFrame:
    """Per project and agent (``project, signature_id, role, path``): settings and instruction files, sub-agents."""
    paths = lambda r: F.array_sort(F.collect_set(F.when(F.col("role") == r, F.col("path"))))
    return files.groupBy("project", "signature_id").agg(paths("settings").alias("settings"), paths("instruction").alias("instructions"), F.count_distinct(F.when(F.col("role") == "sub-agent", F.col("path"))).alias("sub_agents"))
