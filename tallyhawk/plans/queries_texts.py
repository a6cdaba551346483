"""Driver queries on texts and pages; each with its DuckDB equivalent (whose patterns avoid look-around)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhawk.functions.scalars import csv_safe, host_of, normalise_package
from tallyhawk.operators import matching, reports, text_audit
from tallyhawk.plans.registry import query
from tallyhawk.plans.session import table

SIGNALS = [
    ("site.com", "platform", "domain", None, None, "suffix", "example.com", 0.6, None, True),
    ("site.net", "provider", "domain", None, None, "suffix", "example.net", 0.7, None, False),
    ("site.mobile", "framework", "domain", None, None, "regex", r"^m\.", 0.9, None, True),
    ("site.org", "provider", "domain", None, None, "suffix", "example.org", 0.7, None, False),
]
SIGNAL_SCHEMA = "signature_id string, category string, type string, ecosystem string, language string, match string, value string, weight double, required string, agent_indicator boolean"
CATEGORY = {"framework": 0, "provider": 1, "platform": 2}


def signals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SIGNALS, SIGNAL_SCHEMA)


_HOST = r"nullif(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '')"
_HITS = f"""
WITH h AS (SELECT page_id, {_HOST} AS host FROM pages),
m AS (SELECT page_id, host, 'site.com' AS s, 'platform' AS c, 0.6 AS w FROM h WHERE host LIKE '%.example.com' OR host = 'example.com'
  UNION ALL SELECT page_id, host, 'site.net', 'provider', 0.7 FROM h WHERE host LIKE '%.example.net' OR host = 'example.net'
  UNION ALL SELECT page_id, host, 'site.org', 'provider', 0.7 FROM h WHERE host LIKE '%.example.org' OR host = 'example.org'
  UNION ALL SELECT page_id, host, 'site.mobile', 'framework', 0.9 FROM h WHERE host LIKE 'm.%')"""


@query(_HITS + " SELECT page_id, host, s AS signature_id, CAST(w AS DOUBLE) AS weight FROM m")
def signature_domain_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select("page_id", host_of("url").alias("host"))
    return matching.match_domain(hosts, signals(spark)).select("page_id", "host", "signature_id", "weight")


@query(_HITS + " SELECT DISTINCT host, s AS signature_id FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY w DESC, CASE c WHEN 'framework' THEN 0 WHEN 'provider' THEN 1 ELSE 2 END, s) AS k FROM (SELECT DISTINCT host, s, c, w FROM m)) WHERE k = 1")
def host_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select(host_of("url").alias("host")).distinct()
    return matching.host_service(matching.match_domain(hosts, signals(spark)), CATEGORY).select("host", "signature_id")


@query(r"""
SELECT page_id, list_aggregate(list_sort(list_distinct([lower(h) FOR h IN regexp_extract_all(html, '(?i)\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}\b')])), 'string_agg', '|') AS hosts FROM pages""")
def hosts_in_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    found = matching.hosts_in_text(p, "page_id", "html").groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("host")), "|").alias("hosts"))
    return p.select("page_id").join(found, "page_id", "left")


_RX = r"""(?i)(?:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]{12,})"""
_ENTROPY = "(SELECT -sum((n / t) * log2(n / t)) FROM (SELECT count(*) AS n, length(value) AS t FROM (SELECT unnest(string_split(value, '')) AS ch) GROUP BY ch))"
_SECRETS = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, line, unnest(regexp_extract_all(x, '{_RX}', 1)) AS value FROM l),
e AS (SELECT doc_id, line, value, {_ENTROPY} AS bits FROM v WHERE length(value) >= 16),
p AS (SELECT doc_id, line, value, bits, list_max([{{'n': length(x), 'x': x}} FOR x IN string_split_regex(value, '[^A-Za-z0-9]+')]).x AS body FROM e),
s AS (SELECT doc_id, line, value FROM p WHERE bits >= 3.0
  AND NOT regexp_matches(lower(value), '(^|[^a-z])(replaceme|replace|placeholder|changeme|example|sample|dummy|fake|test|insert|paste|here|todo|your|redacted|mock|demo)([^a-z]|$)')
  AND NOT regexp_matches(value, '[*#?]{4}|(^|[^A-Za-z])(x{4,}|X{4,})([^A-Za-z]|$)')
  AND NOT (length(body) >= 8 AND 2 * len([1 FOR i IN range(1, length(body)) IF abs(ord(body[i + 1]) - ord(body[i])) <= 1]) >= length(body) - 1))"""


@query(_SECRETS + " SELECT doc_id, CAST(line AS BIGINT) AS line, sha256(value) AS digest FROM s")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text_audit.assigned_secrets(table(spark, sf_dir, "documents"))
    return s.select("doc_id", F.col("line").cast("long").alias("line"), F.sha2("value", 256).alias("digest"))


@query(_SECRETS + " SELECT source AS path, count(*) AS secrets, count(DISTINCT value) AS different, CAST(min(line) AS BIGINT) AS first_line FROM (SELECT DISTINCT source, value, line FROM s JOIN documents USING (doc_id)) GROUP BY 1")
def secret_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    s = text_audit.assigned_secrets(d).join(d.select("doc_id", F.col("source").alias("path")), "doc_id")
    return text_audit.rollup_secrets(s, "path").select("path", "secrets", "different", F.col("first_line").cast("long").alias("first_line"))


# The rules of redaction as DuckDB's patterns, written apart from the operator's.
_WITHHELD = (
    (r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----(.|\n)*?(-----END ([A-Z ]*)PRIVATE KEY-----|\z)", "[REDACTED:private-key]"),
    (r"eyJ[\w-]{8,}[.][\w-]{8,}([.][\w-]*)+", "[REDACTED:jwt]"),
    (r"AKIA[0-9A-Z]{14,}|\bASIA[0-9A-Z]{16}\b", "[REDACTED:access-key]"),
    (r"\b(sk-[\w-]{8,}|[pr]k-[\w-]{16,}|[sr]k_(live|test)_[[:alnum:]]{16,}|whsec_[[:alnum:]]{24,}|gh[pousr]_[[:alnum:]]{8,}|github_pat_\w{8,}|gl(pat|rt|dt|ptt)-[\w-]{8,}"
     r"|(xox[abeprs]|xapp)-[[:alnum:]-]{8,}|AIza[\w-]{16,}|ya29[.][\w-]{20,}|GOCSPX-[\w-]{20,}|hf_[[:alnum:]]{8,}|gsk_[[:alnum:]]{40,}|pcsk_\w{20,}|tgp_v1_[\w-]{30,}|tvly-[\w-]{20,}"
     r"|xai-[[:alnum:]]{60,}|pplx-[[:alnum:]]{40,}|csk-[[:alnum:]]{30,}|nvapi-[\w-]{60,}|r8_[[:alnum:]]{30,}|npm_[[:alnum:]]{30,}|pypi-AgE[\w-]{40,}|dapi[0-9a-f]{32,}|dop_v1_[0-9a-f]{64,}"
     r"|ATATT3[\w=-]{40,}|lin_api_[[:alnum:]]{32,}|ntn_[[:alnum:]]{40,}|sbp_[0-9a-f]{40,}|glc_[[:alnum:]+/]{32,}|shpat_[[:xdigit:]]{32,}|hvs[.][\w-]{24,}|SG[.][\w.-]{60,}|PMAK-[0-9a-f-]{58,}|dp[.](pt|ct|sa)[.][[:alnum:]]{40,}|dp[.]st[.][\w.-]{40,}|glsa_\w{41,}|sntrys_[\w+/=-]{60,}|sntryu_[0-9a-f]{64,}|fw_[[:alnum:]]{22,}|1//0[\w-]{40,}|e2b_[0-9a-f]{40,}"
     r"|lsv2_(pt|sk)_[0-9a-f_]{40,}|fc-[0-9a-f]{32,}|gl(soat|cbt|ft|agent|oas|imt|ffct)-[\w-]{20,}|ABSK[[:alnum:]+/]{60,}|bedrock-api-key-[\w+/-]{40,})",
     "[REDACTED:api-key]"),
    (r"\b[[:alnum:]]{14}[.]atlasv1[.][\w=-]{60,}", "[REDACTED:api-key]"),
    (r"(hooks[.]slack[.]com/(?:services|workflows|triggers)/|discord(?:app)?[.]com/api/webhooks/|outlook[.]office[.]com/webhook/|hooks[.]zapier[.]com/hooks/|mcp[.]zapier[.]com/api/mcp/s/|actions[.]zapier[.]com/mcp/"
     r"""|api[.]telegram[.]org/bot)[^\s"''<>\[\]]+""", r"\1[REDACTED]"),
    (r"(?i)(authorization\s*[=:]\s*(?:basic|bearer)\s+)[\w+/.=-]+", r"\1[REDACTED]"),
    (r"([[:alpha:]][[:alnum:]+.-]*://)[^\s/:@]+:[^\s/@]+@", r"\1[REDACTED]@"),
    (r"(?i)([&?](?:sig|signature|secret|token|key|password)=)[^\s&#]+", r"\1[REDACTED]"),
    (r"""(?i)((?:passwd|password|api_?key|secret|token)["'']?[ ]*[:=][ ]*["'']?)[\w+/.=-]{12,}""", r"\1[REDACTED]"),
    (r"[\w.%+-]+@[[:alnum:].-]+[.][[:alpha:]]{2,}", "[REDACTED:email]"),
    (r"\b\d{1,3}[.]\d{1,3}[.]\d{1,3}[.]\d{1,3}\b", "[REDACTED:ip]"),
)


def _redaction_sql() -> str:
    out = "text"
    for pattern, instead in _WITHHELD:
        out = f"regexp_replace({out}, '{pattern}', '{instead}', 'g')"
    return out


@query(f"SELECT doc_id, sha256({_redaction_sql()}) AS digest, CAST(length({_redaction_sql()}) AS BIGINT) AS n FROM documents")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", text_audit.redact_text(F.col("text")).alias("t"))
    return t.select("doc_id", F.sha2("t", 256).alias("digest"), F.length("t").cast("long").alias("n"))


def _audit_sql() -> str:
    bare = r"""regexp_replace(x, '"[^"\n]*"|`[^`\n]*`|^\s*>.*$', '', 'g')"""
    out = [r"SELECT source, id, turn, 'hidden-comment' AS rule, CAST(line AS BIGINT) AS line FROM l WHERE len(list_filter(regexp_extract_all(x, '<!--(.*?)-->', 1), lambda c: len(regexp_split_to_array(trim(c), '\s+')) >= 2)) > 0"]
    for name, p in text_audit.INSTRUCTION_RULES:
        out.append(f"SELECT source, id, turn, '{name}', CAST(line AS BIGINT) FROM l WHERE regexp_matches({bare if name in ('override', 'data-transfer') else 'x'}, '{p}')")
    return r"""
WITH t AS (SELECT 'documents' AS source, CAST(doc_id AS VARCHAR) AS id, CAST(NULL AS BIGINT) AS turn, text AS x FROM documents
  UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR), CAST(turn AS BIGINT), text FROM conversations
  UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), NULL, html FROM pages),
s AS (SELECT source, id, turn, string_split(regexp_replace(coalesce(x, ''), '```.*?```', '', 'gs'), chr(10)) AS xs FROM t),
l AS (SELECT source, id, turn, unnest(xs) AS x, unnest(range(1, len(xs) + 1)) AS line FROM s)
""" + " UNION ALL ".join(out)


@query(f"SELECT CAST(id AS BIGINT) AS page_id, rule, line FROM ({_audit_sql()}) WHERE source = 'pages'")
def instruction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text_audit.instruction_audit(table(spark, sf_dir, "pages"), "page_id", "html", comment_words=2)
    return found.select("page_id", "rule", F.col("line").cast("long").alias("line"))


@query(_audit_sql())
def instruction_audit_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over documents, conversations and pages."""
    parts = [("documents", "doc_id", None, "text"), ("conversations", "conv_id", "turn", "text"), ("pages", "page_id", None, "html")]
    texts = None
    for name, key, turn, text in parts:
        at = F.struct(F.lit(name).alias("source"), F.col(key).cast("string").alias("id"), (F.col(turn) if turn else F.lit(None)).cast("long").alias("turn"))
        part = table(spark, sf_dir, name).select(at.alias("at"), F.col(text).alias("text"))
        texts = part if texts is None else texts.unionByName(part)
    found = text_audit.instruction_audit(texts, "at", "text", comment_words=2)
    return found.select("at.source", "at.id", "at.turn", "rule", F.col("line").cast("long").alias("line"))


@query("""
WITH c AS (SELECT toxic = 1 AS truth, regexp_matches(lower(text), 'idiot|clown|worthless|pathetic|stupid') AS p FROM labels JOIN documents USING (doc_id)),
n AS (SELECT CAST(count(*) FILTER (truth AND p) AS DOUBLE) AS tp, CAST(count(*) FILTER (NOT truth AND p) AS DOUBLE) AS fp, CAST(count(*) FILTER (truth AND NOT p) AS DOUBLE) AS fn, CAST(count(*) FILTER (NOT truth AND NOT p) AS DOUBLE) AS tn FROM c)
SELECT tp, fp, fn, tn, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision,
       CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) END AS f1 FROM n""")
def detection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    cases = c.select((F.col("toxic") == 1).alias("truth"), F.lower("text").rlike("idiot|clown|worthless|pathetic|stupid").alias("predicted"))
    return reports.detection_metrics(cases).select("tp", "fp", "fn", "tn", "recall", "precision", "f1")


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '^\s*[=+\-@\t\r]') THEN '''' || text ELSE text END AS cell FROM documents")
def csv_safe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", csv_safe("text").alias("cell"))


_CELL = r"CASE WHEN regexp_matches(text, '^\s*[=+\-@\t\r]') THEN '''' || text ELSE text END"


@query(f"SELECT doc_id, sha256({_CELL}) AS digest, CAST(length({_CELL}) AS BIGINT) AS n FROM documents")
def csv_safe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a cell; null stays null."""
    c = table(spark, sf_dir, "documents").select("doc_id", csv_safe("text").alias("cell"))
    return c.select("doc_id", F.sha2("cell", 256).alias("digest"), F.length("cell").cast("long").alias("n"))


@query(r"SELECT DISTINCT p_partkey AS subject, regexp_replace(lower(p_name), '[-_. ]+', '-', 'g') AS package, 'dep.' || split_part(p_name, ' ', 2) AS signature_id FROM part WHERE p_name LIKE 'red %' OR p_name = 'blue bolt'")
def dependency_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    deps = p.select(F.col("p_partkey").alias("subject"), F.lit("npm").alias("ecosystem"), F.translate("p_name", " ", "_").alias("name"))
    noun, none = F.split("p_name", " ")[1], F.lit(None).cast("string")
    exact = p.select(noun.alias("n")).distinct().select(
        F.concat(F.lit("dep."), "n").alias("signature_id"), F.lit("framework").alias("category"), F.lit("dependency").alias("type"), F.lit("any").alias("ecosystem"), none.alias("language"), F.lit("exact").alias("match"),
        F.concat(F.lit("red-"), "n").alias("value"), F.lit(0.5).alias("weight"), none.alias("required"), F.lit(False).alias("agent_indicator"),
    )
    prefix = spark.createDataFrame([("dep.bolt", "framework", "dependency", "npm", None, "prefix", "blue-bo", 0.5, None, False)], SIGNAL_SCHEMA)
    out = matching.match_dependency(deps, exact.unionByName(prefix))
    return out.select("subject", normalise_package("name").alias("package"), "signature_id")


@query("""
SELECT doc_id, CAST(CASE WHEN source LIKE 'src1%' THEN 0.5 WHEN source IN ('src2', 'src3') THEN 0.6 ELSE 1.0 END AS DOUBLE) AS scale FROM documents""")
def path_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.when(F.col("source").startswith("src1"), "tests/").when(F.col("source").isin("src2", "src3"), "examples/").otherwise("lib/")
    return table(spark, sf_dir, "documents").select("doc_id", text_audit.path_context(F.concat(folder, "source", F.lit(".py")))["scale"].alias("scale"))


@query(r"""
SELECT conv_id, CAST(len(list_distinct(flatten(list([lower(w) FOR w IN regexp_extract_all(coalesce(text, ''), '[A-Za-z]{14,}')])))) AS BIGINT) AS long_words, count(*) AS turns FROM conversations GROUP BY conv_id""")
def conversation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{14,}"), F.lit(0)), F.lower)
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list(words)))).cast("long").alias("long_words"), F.count("*").alias("turns"))
    return c.select("conv_id", "long_words", "turns")
