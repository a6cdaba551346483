"""Readers of exported records; malformed rows are counted, never fatal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhawk.functions.scalars import get_path, named, parse_timestamp
from tallyhawk.plans.session import cut

RECORD = "source string, raw string"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``source, raw, bad``: one JSON record per line; lines that are no object are marked."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("raw")).where(F.trim("raw") != "")
    return t.withColumn("bad", F.json_object_keys("raw").isNull())


ENVELOPES = ("value", "items", "data", "results", "records", "Resources", "entries", "apps", "servers", "resources")
NEXT_PAGE = ("nextLink", "@odata.nextLink", "nextPageToken", "NextToken", "next_cursor")


def read_json_envelope(spark: SparkSession, path: str) -> DataFrame:
    """``source, raw, partial``: records of whole JSON documents, lists and usual envelopes unwrapped; JSON lines otherwise.

    ``partial`` marks documents that point to a next page.
    """
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.trim("value").alias("t"))
    lists = [F.from_json(F.get_json_object("t", f"$['{k}']"), "array<string>") for k in ENVELOPES]
    whole = F.when(F.col("t").startswith("["), F.from_json("t", "array<string>")).otherwise(F.coalesce(*lists))
    lines = F.filter(F.split("t", r"\r?\n"), lambda x: F.trim(x) != "")
    several = (F.size(lines) > 1) & F.json_object_keys(lines[0]).isNotNull() & F.json_object_keys(lines[1]).isNotNull()
    rows = F.when(several, lines).otherwise(F.coalesce(whole, F.array("t")))
    partial = F.coalesce(*[F.get_json_object("t", f"$['{k}']") for k in NEXT_PAGE]).isNotNull()
    return t.select("source", F.explode(rows).alias("raw"), partial.alias("partial"))


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of a header CSV: its columns, ``source``, ``reason`` and ``raw``.

    ``reason`` says why a record is left out: ``malformed`` (of another width than the header; ``raw`` has its text),
    ``empty``, or ``error`` (it only carries a provider's error); null for good ones. Nothing is dropped, so
    ``input_completeness`` counts what a reader leaves out. Files of one call have one header.
    """
    plain = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("recursiveFileLookup", True)
    columns = plain.csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in (*columns, "_raw"))
    df = plain.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_raw").csv(path)
    known = F.lit(False)
    for c in columns:
        known = known | F.col(f"`{c}`").isNotNull()
    reason = F.when(F.col("_raw").isNotNull() & (known | ~known), "malformed").when(~known, "empty")
    if "error" in columns and len(columns) > 1:
        reason = reason.when(F.col("error").isNotNull(), "error")
    return df.select(*[f"`{c}`" for c in columns], F.col("_metadata.file_path").alias("source"), reason.alias("reason"), F.col("_raw").alias("raw"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The good records of a header CSV; see ``read_csv_records`` for what they leave out."""
    return read_csv_records(spark, path).where("reason is null").drop("source", "reason", "raw")


def left_out(records: DataFrame) -> DataFrame:
    """Records with a ``reason`` in the form that ``input_completeness`` counts: too large ones limit a source, others are bad."""
    limited = F.coalesce(F.col("reason").isin("too-large"), F.lit(False))
    return records.withColumn("bad", F.coalesce(F.col("reason").isin("malformed", "binary"), F.lit(False))).withColumn("partial", limited)


COMBINED = r'^(\S+) \S+ (\S+) \[([^\]]+)\] "([A-Z]+) ([^"\s]*)[^"]*" (\d{3}) (\S+)(?: "([^"]*)" "([^"]*)")?(.*)$'


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    """Combined-format lines; a trailing ``host=`` counts only after the last quote. Other lines are marked bad."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("line"))
    g = lambda i: F.nullif(F.nullif(F.regexp_extract("line", COMBINED, i), F.lit("")), F.lit("-"))
    return t.select("source", F.regexp_like("line", F.lit(COMBINED)).alias("ok"), g(1).alias("remote_addr"), g(2).alias("user"), parse_timestamp(g(3)).alias("ts"), g(4).alias("method"), g(5).alias("path"), g(6).alias("status"), g(7).try_cast("long").alias("bytes"), g(9).alias("user_agent"), F.nullif(F.lower(F.regexp_extract(F.regexp_extract("line", COMBINED, 10), r"\bhost=([^\s\"]+)", 1)), F.lit("")).alias("host")).withColumn("bad", ~F.col("ok")).drop("ok")


def logfmt(line: Column) -> Column:
    """``key=value`` pairs of a line as a map; null where a quote is open or a key repeats."""
    pairs = F.regexp_extract_all(line, F.lit(r'([A-Za-z_][\w.-]*)=("(?:[^"\\]|\\.)*"|[^\s"]*)'), F.lit(0))
    keys = F.transform(pairs, lambda p: F.regexp_extract(p, r"^([^=]+)=", 1))
    values = F.transform(pairs, lambda p: F.regexp_replace(F.regexp_extract(p, r"(?s)^[^=]+=(.*)$", 1), r'^"|"$', ""))
    even = F.length(F.regexp_replace(F.regexp_replace(line, r'\\"', ""), r'[^"]', "")) % 2 == 0
    return F.when(even & (F.size(pairs) > 0) & (F.size(F.array_distinct(keys)) == F.size(keys)), F.map_from_arrays(keys, values))


def read_logfmt(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("line")).where(F.trim("line") != "")
    return t.select("source", logfmt(F.col("line")).alias("fields")).withColumn("bad", F.col("fields").isNull())


#: Files up to which their headers are broadcast; beyond, they are joined by a shuffle.
BROADCAST_FILES = 10_000


def read_zeek(spark: SparkSession, path: str) -> DataFrame:
    """``source, log, fields``: rows of tab-separated logs, named by the header of their own file; unset values are null."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("line"))
    head = t.where(F.col("line").startswith("#")).groupBy("source").agg(
        F.max(F.when(F.col("line").startswith("#fields"), F.slice(F.split("line", "\t"), 2, 10_000))).alias("names"), F.max(F.when(F.col("line").startswith("#path"), F.split("line", "\t")[1])).alias("log"))
    few = head.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES
    rows = t.where(~F.col("line").startswith("#") & (F.col("line") != "")).join(F.broadcast(head) if few else head, "source")
    cells = F.transform(F.split("line", "\t"), lambda v: F.nullif(F.nullif(v, F.lit("-")), F.lit("(empty)")))
    return rows.select("source", "log", F.when(F.size(cells) == F.size("names"), F.map_from_arrays("names", cells)).alias("fields")).withColumn("bad", F.col("fields").isNull())


FLOW_FIELDS = ("version", "account-id", "interface-id", "srcaddr", "dstaddr", "srcport", "dstport", "protocol", "packets", "bytes", "start", "end", "action", "log-status")


def read_vpc_flow(spark: SparkSession, path: str, fields: Sequence[str] = FLOW_FIELDS) -> tuple[DataFrame, DataFrame]:
    """Accepted flows, and per file how many records were skipped by the provider. Header lines are left out."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.split(F.trim("value"), r"\s+").alias("c")).where(F.size("c") == len(fields))
    r = t.select("source", *[F.col("c")[i].alias(f.replace("-", "_")) for i, f in enumerate(fields)]).where(F.col("version") != "version")
    stats = r.groupBy("source").agg(F.count("*").alias("records"), F.count_if(F.col("log_status") == "SKIPDATA").alias("skipped"))
    ok = r.where("action = 'ACCEPT' and log_status = 'OK'")
    return ok.select("source", F.col("srcaddr").alias("client"), F.col("dstaddr").alias("server"), F.col("dstport").try_cast("int").alias("port"), F.col("bytes").try_cast("long").alias("bytes"), parse_timestamp("start").alias("ts")), stats


def read_route53(spark: SparkSession, path: str) -> DataFrame:
    """Resolver query logs as DNS events."""
    r = read_jsonl(spark, path).where("not bad")
    answers = F.from_json(F.get_json_object("raw", "$.answers"), "array<struct<Rdata:string,Type:string>>")
    return r.select(get_path("raw", "srcaddr").alias("client"), F.regexp_replace(F.lower(get_path("raw", "query_name")), r"\.$", "").alias("query"), F.transform(answers, lambda a: a["Rdata"]).alias("answers"), F.array().cast("array<int>").alias("ttls"), parse_timestamp(get_path("raw", "query_timestamp")).alias("ts"), get_path("raw", "vpc_id").alias("network"))


# Names under which generic exports keep a column.
NETWORK_ALIASES = {
    "ts": ("ts", "timestamp", "time", "@timestamp", "event_time"), "client": ("client", "client_ip", "src_ip", "srcaddr", "source_ip", "id.orig_h"), "query": ("query", "qname", "query_name", "domain", "dns.question.name"),
    "answers": ("answers", "answer", "resolved_ips", "dns.resolved_ip"), "sni": ("sni", "server_name", "tls.server_name", "ssl_sni"), "server": ("dst_ip", "server", "server_ip", "dstaddr", "destination_ip", "id.resp_h"),
    "port": ("dst_port", "port", "dstport", "id.resp_p"), "bytes": ("bytes", "bytes_out", "orig_bytes", "bytes_sent"), "uid": ("uid", "flow_id", "connection_id"), "sensor": ("sensor", "sensor_id", "host"), "ja4": ("ja4", "tls.ja4"),
}


def read_network_generic(rows: DataFrame) -> DataFrame:
    """JSON records in ``raw`` with aliased names as network columns; which kind is told by the columns that are there."""
    rows = rows.select(*[get_path("raw", *names).alias(k) for k, names in NETWORK_ALIASES.items()])  # each found once
    v = {k: F.col(k) for k in NETWORK_ALIASES}
    listed = F.when(v["answers"].startswith("["), F.from_json(v["answers"], "array<string>")).otherwise(F.filter(F.split(v["answers"], r"[,; ]+"), lambda a: a != ""))
    kind = F.when(v["sni"].isNotNull(), "tls").when(v["query"].isNotNull(), "dns").when(v["server"].isNotNull(), "flow")
    return rows.select(kind.alias("kind"), parse_timestamp(v["ts"]).alias("ts"), v["client"].alias("client"), v["query"].alias("query"), listed.alias("answers"), F.lower(v["sni"]).alias("sni"), v["server"].alias("server"), v["port"].try_cast("int").alias("port"), v["bytes"].try_cast("long").alias("bytes"), v["uid"].alias("uid"), v["sensor"].alias("sensor"), v["ja4"].alias("ja4")).where("kind is not null")


_ATTRIBUTES = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:string,boolValue:string>>>"


def read_otlp(spark: SparkSession, path: str) -> DataFrame:
    """Spans with their resource's attributes overlaid by their own, as one map."""
    t = spark.read.text(path, wholetext=True).select(F.col("value").alias("t"))
    spec = f"array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeSpans:array<struct<spans:array<struct<name:string,startTimeUnixNano:string,attributes:{_ATTRIBUTES}>>>>>>"
    r = t.select(F.explode(F.from_json(F.get_json_object("t", "$.resourceSpans"), spec)).alias("r"))
    s = r.select("r.resource.attributes", F.explode("r.scopeSpans").alias("c")).select(F.col("attributes").alias("ra"), F.explode("c.spans").alias("s"))
    text = lambda a: F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["doubleValue"], a["value"]["boolValue"])
    entries = lambda c: F.transform(F.coalesce(c, F.from_json(F.lit("[]"), _ATTRIBUTES)), lambda a: F.struct(a["key"].alias("key"), text(a).alias("value")))
    own, res = entries(F.col("s.attributes")), entries(F.col("ra"))
    names = F.transform(own, lambda a: a["key"])
    return s.select("s.name", parse_timestamp("s.startTimeUnixNano").alias("ts"), F.map_from_entries(F.concat(F.filter(res, lambda a: ~F.array_contains(names, a["key"])), own)).alias("attributes"))


def read_osquery(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot rows of processes; columns may be nested."""
    r = read_jsonl(spark, path).where("not bad")
    v = lambda n: get_path("raw", f"columns.{n}", n)
    return r.select(get_path("raw", "hostIdentifier", "host").alias("host"), v("pid").alias("pid"), v("name").alias("name"), v("path").alias("path"), v("cmdline").alias("cmdline"), v("username").alias("username"), v("start_time").alias("start_time"))


def read_signature_pack(spark: SparkSession, paths: Sequence[str], override: bool = False) -> DataFrame:
    """Signature packs (JSON lines, one per signal, with lists ``values``) as one row per literal or pattern.

    An id that two packs define is refused unless later packs may override earlier ones.
    """
    spec = "signature_id string, category string, type string, ecosystem string, language string, match string, values array<string>, weight double, required string, agent_indicator boolean"
    packs = None
    for i, p in enumerate(paths):
        own = spark.read.schema(spec).json(p).withColumn("_pack", F.lit(i))
        packs = own if packs is None else packs.unionByName(own)
    twice = packs.groupBy("signature_id").agg(F.count_distinct("_pack").alias("n")).where("n > 1")
    if not override and (found := [r["signature_id"] for r in twice.limit(5).collect()]):
        raise ValueError(f"signatures defined in several packs: {', '.join(found)}")
    last = packs.withColumn("_last", F.max("_pack").over(Window.partitionBy("signature_id"))).where("_pack = _last")
    return last.withColumn("value", F.explode("values")).drop("values", "_pack", "_last")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Approved agents from CSV with lists split at bars, one row per resource pattern; a row without an id is an error."""
    df = read_csv(spark, path)
    col = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    listed = lambda c: F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    ident = F.coalesce(F.nullif(F.trim(col("agent_id")), F.lit("")), F.nullif(F.trim(col("id")), F.lit("")))
    if df.where(ident.isNull()).limit(1).count():
        raise ValueError(f"an approval without agent_id in {path}")
    return df.select(ident.alias("agent_id"), F.coalesce(col("owner_team"), col("owner")).alias("owner_team"), col("autonomy_level").try_cast("int").alias("autonomy_level"), F.explode_outer(listed("resources")).alias("pattern"), *[listed(c).alias(c) for c in ("names", "surfaces", "providers", "accounts", "regions")])


def read_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Report documents as one row each, and their findings with their place."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("report"), F.col("value").alias("t")).where(F.json_object_keys("t").isNotNull())
    head = t.select("report", parse_timestamp(get_path("t", "started_at")).alias("started_at"), parse_timestamp(get_path("t", "finished_at")).alias("finished_at"), get_path("t", "collection_scope").alias("scope"), get_path("t", "finding_identity_schema").alias("identity_schema"), get_path("t", "summary.complete").try_cast("boolean").alias("complete"), get_path("t", "summary.total").try_cast("long").alias("total"))
    rows = t.select("report", F.posexplode(F.from_json(F.get_json_object("t", "$.findings"), "array<string>")).alias("ord", "raw"))
    return head.join(rows.groupBy("report").agg(F.count("*").alias("rows")), "report", "left"), rows


def read_mcp_registry(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """A registry snapshot, one row per server and version; a digest that differs from the pinned one is an error."""
    t = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("digest"), F.decode("content", "UTF-8").alias("t"))
    if sha256 and t.where(F.col("digest") != sha256).limit(1).count():
        raise ValueError("the registry snapshot is not the pinned one")
    s = t.select(F.explode(F.from_json(F.get_json_object("t", "$.servers"), "array<string>")).alias("s"))
    v = lambda p: F.coalesce(F.get_json_object("s", f"$.server.{p}"), F.get_json_object("s", f"$.{p}"))
    listed = lambda p, f: F.transform(F.coalesce(F.from_json(v(p), f"array<struct<{f}:string>>"), F.from_json(F.lit("[]"), f"array<struct<{f}:string>>")), lambda x: x[f])
    return s.select(v("name").alias("name"), v("version").alias("version"), F.coalesce(v("status"), F.lit("active")).alias("status"), parse_timestamp(F.regexp_extract("s", r'"publishedAt"\s*:\s*"([^"]+)"', 1)).alias("published_at"), listed("packages", "identifier").alias("packages"), listed("remotes", "url").alias("remotes"))


def read_mapping_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Control rules (JSON lines) with a column per condition; conditions that are not given are null."""
    return spark.read.schema("ref string, kinds array<string>, tags array<string>, capabilities array<string>, min_floor int, shadow boolean").json(path)


SKIP = r"(^|/)(\.git|node_modules|\.venv|venv|__pycache__|dist|build|\.tox|vendor)(/|$)"


def walk_file_tree(spark: SparkSession, root: str, most_bytes: int = 2_000_000, globs: str = "*") -> DataFrame:
    """Every file of a tree: ``path, size, text, reason``.

    ``reason`` says why a file has no text: ``skipped`` (in a folder of other people's code), ``too-large`` or
    ``binary``; null for the others. The contents of skipped and large files are never read.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", globs).load(root)
    wanted = (F.col("length") <= most_bytes) & ~F.col("path").rlike(SKIP)
    size = F.col("length").alias("size")
    read = f.where(wanted).select("path", size, F.decode("content", "UTF-8").alias("_text"))
    binary = F.col("_text").contains("\x00")
    read = read.select("path", "size", F.when(~binary, F.col("_text")).alias("text"), F.when(binary, "binary").alias("reason"))
    other = f.where(~wanted).select("path", size, F.lit(None).cast("string").alias("text"), F.when(F.col("path").rlike(SKIP), "skipped").otherwise("too-large").alias("reason"))
    return read.unionByName(other)


def read_file_tree(spark: SparkSession, root: str, most_bytes: int = 2_000_000, globs: str = "*") -> DataFrame:
    """``path, size, text`` of the files that are read; ``walk_file_tree`` has the others with their reasons."""
    return walk_file_tree(spark, root, most_bytes, globs).where("reason is null").drop("reason")


def input_completeness(records: DataFrame, by: str = "source") -> DataFrame:
    """Per source: records looked at and malformed; any gap makes it incomplete."""
    partial = F.bool_or("partial") if "partial" in records.columns else F.lit(False)
    bad = F.count_if("bad") if "bad" in records.columns else F.lit(0)
    return records.groupBy(by).agg(F.count("*").alias("examined"), bad.alias("malformed"), partial.alias("limited")).withColumn("status", F.when((F.col("malformed") > 0) | F.col("limited"), "incomplete").otherwise("complete"))


def _carried(raw: str) -> Column:
    """What a record carries: messages of log events, dated usage buckets, one JSON payload; null for a plain record."""
    at = lambda k: F.get_json_object(raw, f"$.{k}")
    events = F.transform(F.from_json(at("logEvents"), "array<struct<message:string,timestamp:string>>"), lambda e: e["message"])
    span = F.concat(F.lit('{"start_time":"'), at("start_time"), F.lit('","end_time":"'), F.coalesce(at("end_time"), F.lit("")), F.lit('",'))
    opened = lambda s: F.transform(F.from_json(at("results"), "array<string>"), lambda b: F.when(s.isNotNull(), F.concat(s, F.substring(b, 2, 2_147_483_647))).otherwise(b))
    dated = F.when(at("results").isNotNull(), named(span, opened))
    payloads = [named(at(k), lambda p: F.when(F.json_object_keys(p).isNotNull(), p)) for k in ("message", "textPayload", "log")]
    inner = named(F.coalesce(at("jsonPayload"), *payloads), lambda i: F.when(i.isNotNull(), F.array(i)))
    return F.coalesce(events, dated, inner)


def expand_envelopes(rows: DataFrame, raw: str = "raw", depth: int = 16) -> DataFrame:
    """Log records out of their carriers, layer by layer; plain records go through untouched.

    Each round opens only what is still a carrier and ends when nothing is. Records nested deeper than ``depth``
    come out as the last carrier, as no log export nests that deep.
    """
    found = rows.withColumn("_carried", _carried(raw))
    plain, packed = found.where("_carried is null").drop("_carried"), found.where("_carried is not null")
    for _ in range(depth):
        opened = cut(packed.withColumn(raw, F.explode("_carried")).withColumn("_carried", _carried(raw)))
        plain, packed = plain.unionByName(opened.where("_carried is null").drop("_carried")), opened.where("_carried is not null")
        if packed.isEmpty():
            return plain
    return plain.unionByName(packed.drop("_carried"))
