"""Driver queries that write the given tables as exports to the shared folder and read them back; each with its DuckDB equivalent."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhawk.plans.registry import query
from tallyhawk.plans.session import shared_folder, table
from tallyhawk.sources import readers, sinks


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"


def _landed(df: DataFrame, line: Column, by: Column | None = None, header: str | None = None) -> str:
    """The folder of a table written as lines; with ``by`` a folder each, ``by=value``, of one file whose first line is ``header``."""
    folder = _folder(df.sparkSession)
    if by is None:
        df.select(line.alias("value")).write.text(folder)
        return folder
    rows = df.select(by.alias("by"), line.alias("value"), F.lit(1).alias("o"))
    if header is not None:
        rows = rows.unionByName(rows.select("by").distinct().select("by", F.lit(header).alias("value"), F.lit(0).alias("o")))
    rows.repartition("by").sortWithinPartitions("by", "o").select("by", "value").write.partitionBy("by").text(folder)
    return folder


def _by(source: str) -> Column:
    return F.regexp_extract(source, "by=([^/]*)/", 1).cast("long")


# ---------------------------------------------------------------- complete accounts


@query("""
WITH c AS (SELECT c_nationkey AS nation, c_custkey % 9 = 0 AS wide, c_custkey % 11 = 0 AS empty, c_custkey % 13 = 0 AS error, c_acctbal FROM customer),
r AS (SELECT nation, CASE WHEN wide THEN 'malformed' WHEN empty THEN 'empty' WHEN error THEN 'error' END AS reason, c_acctbal FROM c)
SELECT nation, count(*) AS examined, count(*) FILTER (reason = 'malformed') AS malformed, count(*) FILTER (reason = 'empty') AS empty, count(*) FILTER (reason = 'error') AS errors, count(*) FILTER (reason IS NULL) AS good,
       round(sum(c_acctbal) FILTER (reason IS NULL), 2) AS balance, CASE WHEN count(*) FILTER (reason = 'malformed') > 0 THEN 'incomplete' ELSE 'complete' END AS status FROM r GROUP BY nation""")
def csv_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV for each nation: rows of another width, empty ones and provider errors are counted, not lost."""
    key = F.col("c_custkey")
    good = F.concat_ws(",", key.cast("string"), F.col("c_acctbal").cast("string"), F.concat(F.lit('"'), "c_mktsegment", F.lit(', x"')))
    line = F.when(key % 9 == 0, F.concat(good, F.lit(",,more"))).when(key % 11 == 0, F.lit(",,,")).when(key % 13 == 0, F.lit(",,,denied")).otherwise(F.concat(good, F.lit(",")))
    records = readers.read_csv_records(spark, _landed(table(spark, sf_dir, "customer"), line, F.col("c_nationkey"), "id,balance,segment,error"))
    status = readers.input_completeness(readers.left_out(records)).select("source", "examined", "malformed", "status")
    n = lambda r: F.count_if(F.col("reason").eqNullSafe(F.lit(r)))
    sums = records.groupBy("source").agg(n("empty").alias("empty"), n("error").alias("errors"), n(None).alias("good"), F.round(F.sum(F.when(F.col("reason").isNull(), F.col("balance").cast("double"))), 2).alias("balance"))
    return status.join(sums, "source").select(_by("source").alias("nation"), "examined", "malformed", "empty", "errors", "good", "balance", "status")


@query("""
WITH f AS (SELECT c_nationkey AS nation, sum(strlen(c_name || ' ' || c_custkey) + 1) + CASE WHEN c_nationkey % 5 = 0 THEN count(*) ELSE 0 END AS size, count(*) AS lines FROM customer GROUP BY c_nationkey),
m AS (SELECT CAST(floor(avg(size)) AS BIGINT) AS most FROM f)
SELECT nation, CAST(size AS BIGINT) AS size, CASE WHEN size > most THEN 'too-large' WHEN nation % 5 = 0 THEN 'binary' END AS reason, CASE WHEN size <= most AND nation % 5 <> 0 THEN lines END AS lines FROM f, m""")
def file_tree_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each nation: large and binary ones have no text, but a row with the reason."""
    c = table(spark, sf_dir, "customer")
    line = F.concat("c_name", F.lit(" "), F.col("c_custkey").cast("string"), F.when(F.col("c_nationkey") % 5 == 0, "\x00").otherwise(""))
    folder = _landed(c, line, F.col("c_nationkey"))
    sizes = c.groupBy("c_nationkey").agg(F.sum(F.octet_length(line) + 1).alias("size"))
    most = int(sizes.agg(F.floor(F.avg("size"))).first()[0])
    files = readers.walk_file_tree(spark, folder, most_bytes=most, globs="*.txt")
    return files.select(_by("path").alias("nation"), "size", "reason", F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n")) - 1).cast("long").alias("lines"))


# ---------------------------------------------------------------- logs

_STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _text(c: str) -> Column:
    return F.col(c).cast("string")


@query("""
SELECT event_type, count(*) AS records, count(*) FILTER (event_id % 10 = 0) AS bad, CAST(sum(CASE WHEN event_id % 10 <> 0 THEN user_id END) AS BIGINT) AS users, CASE WHEN count(*) FILTER (event_id % 10 = 0) > 0 THEN 'incomplete' ELSE 'complete' END AS status FROM events GROUP BY 1""")
def jsonl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit('{"user": '), _text("user_id"))).otherwise(F.to_json(F.struct(F.col("user_id").alias("user"), "props")))
    r = readers.read_jsonl(spark, _landed(table(spark, sf_dir, "events"), line, F.col("event_type")))
    kind = F.regexp_extract("source", "by=([^/]*)/", 1).alias("event_type")
    sums = r.groupBy("source").agg(F.sum(F.get_json_object("raw", "$.user").cast("long")).alias("users"))
    return readers.input_completeness(r).join(sums, "source").select(kind, F.col("examined").alias("records"), F.col("malformed").alias("bad"), "users", "status")


@query("""
SELECT n_nationkey AS nation, count(*) AS records, n_nationkey % 4 = 0 AS partial, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_nationkey""")
def json_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each nation: a list, an envelope with or without a next page, or JSON lines."""
    s = table(spark, sf_dir, "supplier")
    records = s.groupBy("s_nationkey").agg(F.collect_list(F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("b")))).alias("r"))
    listed, k = F.concat(F.lit("["), F.array_join("r", ","), F.lit("]")), F.col("s_nationkey") % 4
    document = F.when(k == 0, F.concat(F.lit('{"value":'), listed, F.lit(',"@odata.nextLink":"x"}'))).when(k == 1, listed).when(k == 2, F.concat(F.lit('{"results":'), listed, F.lit("}"))).otherwise(F.array_join("r", "\n"))
    r = readers.read_json_envelope(spark, _landed(records, document, F.col("s_nationkey")))
    return r.groupBy(_by("source").alias("nation")).agg(F.count("*").alias("records"), F.bool_or("partial").alias("partial"), F.round(F.sum(F.get_json_object("raw", "$.b").cast("double")), 2).alias("balance"))


@query("""
SELECT 'u' || user_id AS user, count(*) FILTER (event_id % 8 <> 0) AS lines, CAST(sum(CASE WHEN event_id % 8 <> 0 THEN event_id END) AS BIGINT) AS bytes, count(*) FILTER (event_id % 8 <> 0 AND event_id % 3 = 0) AS hosts, min(CASE WHEN event_id % 8 <> 0 THEN epoch_us(date_trunc('second', ts)) END) AS first_us
FROM events GROUP BY 1 HAVING lines > 0 UNION ALL SELECT NULL, count(*), NULL, 0, NULL FROM events WHERE event_id % 8 = 0""")
def access_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    stamp = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss '+0000'")
    good = F.concat(F.lit("10.0.0.1 - u"), _text("user_id"), F.lit(" ["), stamp, F.lit('] "POST /v1/messages?x=1 HTTP/1.1" 200 '), _text("event_id"), F.lit(' "-" "agent host=evil"'), F.when(n % 3 == 0, " host=API.example").otherwise(""))
    r = readers.read_access_log(spark, _landed(table(spark, sf_dir, "events"), F.when(n % 8 == 0, F.concat(F.lit("no line "), _text("event_id"))).otherwise(good)))
    return r.groupBy("user").agg(F.count("*").alias("lines"), F.sum("bytes").alias("bytes"), F.count_if(F.col("host") == "api.example").alias("hosts"), F.unix_micros(F.min("ts")).alias("first_us"))


@query("""
SELECT CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority || ' x' END AS priority, count(*) AS lines, CAST(sum(CASE WHEN o_orderkey % 6 <> 0 THEN o_custkey END) AS BIGINT) AS customers FROM orders GROUP BY 1""")
def logfmt_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("cust="), _text("o_custkey"), F.lit(' priority="'), "o_orderpriority", F.lit(" x"), F.when(F.col("o_orderkey") % 6 != 0, '"').otherwise(""))
    r = readers.read_logfmt(spark, _landed(table(spark, sf_dir, "orders"), line))
    return r.groupBy(F.col("fields")["priority"].alias("priority")).agg(F.count("*").alias("lines"), F.sum(F.col("fields")["cust"].cast("long")).alias("customers"))


@query("""
SELECT CASE WHEN event_type IN ('click', 'view') THEN 'dns' ELSE 'conn' END AS log, event_type AS kind, count(*) AS rows, count(*) FILTER (event_id % 9 = 0) AS bad, count(*) FILTER (event_id % 9 <> 0 AND user_id % 2 = 0) AS unset, CAST(sum(CASE WHEN event_id % 9 <> 0 THEN event_id END) AS BIGINT) AS ids FROM events GROUP BY 1, 2""")
def zeek_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each kind of event, with columns named by its own header; rows of another width are bad, ``-`` is unset."""
    e = table(spark, sf_dir, "events")
    rows = F.concat_ws("\t", _text("event_id"), F.when(F.col("user_id") % 2 == 0, "-").otherwise(_text("user_id")), F.when(F.col("event_id") % 9 == 0, F.lit("more")))
    head = e.select("event_type").distinct().select("event_type", F.explode(F.array(F.concat(F.lit("#path\t"), F.when(F.col("event_type").isin("click", "view"), "dns").otherwise("conn")), F.concat(F.lit("#fields\tid\t"), "event_type"))).alias("line"))
    r = readers.read_zeek(spark, _landed(head.unionByName(e.select("event_type", rows.alias("line"))), F.col("line"), F.col("event_type")))
    kind = F.regexp_extract("source", "by=([^/]*)/", 1)
    return r.groupBy("log", kind.alias("kind")).agg(F.count("*").alias("rows"), F.count_if("bad").alias("bad"), F.count_if(~F.col("bad") & F.col("fields")[kind].isNull()).alias("unset"), F.sum(F.col("fields")["id"].cast("long")).alias("ids"))


@query("""
SELECT '10.0.0.' || (l_suppkey % 5) AS client, CAST(l_partkey % 3 + 440 AS INT) AS port, count(*) AS flows, CAST(sum(l_orderkey) AS BIGINT) AS bytes, min(epoch_us(l_shipdate)) AS first_us FROM lineitem WHERE l_returnflag <> 'R' AND l_linenumber <> 4 GROUP BY 1, 2""")
def vpc_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_seconds(F.col("l_shipdate").cast("timestamp")).cast("string")
    status = F.when(F.col("l_linenumber") == 4, "SKIPDATA").otherwise("OK")
    line = F.concat_ws(" ", F.lit("2 1 eni"), F.concat(F.lit("10.0.0."), (F.col("l_suppkey") % 5).cast("string")), F.lit("1.1.1.1 5"), (F.col("l_partkey") % 3 + 440).cast("string"), F.lit("6 1"), _text("l_orderkey"), t, t, F.when(F.col("l_returnflag") == "R", "REJECT").otherwise("ACCEPT"), status)
    flows, _ = readers.read_vpc_flow(spark, _landed(table(spark, sf_dir, "lineitem"), line))
    return flows.groupBy("client", "port").agg(F.count("*").alias("flows"), F.sum("bytes").alias("bytes"), F.unix_micros(F.min("ts")).alias("first_us"))


@query("""
SELECT 'net' || (user_id % 3) AS network, event_type || '.example' AS query, count(*) AS answers, count(DISTINCT '10.1.0.' || (event_id % 7)) AS addresses, max(epoch_us(date_trunc('second', ts))) AS last_us FROM events, (VALUES (0), (1)) v(i) WHERE i = 0 OR event_id % 2 = 0 GROUP BY 1, 2""")
def route53_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    a = F.struct(F.concat(F.lit("10.1.0."), (n % 7).cast("string")).alias("Rdata"), F.lit("A").alias("Type"))
    record = F.to_json(F.struct(F.concat(F.lit("net"), (F.col("user_id") % 3).cast("string")).alias("vpc_id"), F.date_format("ts", _STAMP).alias("query_timestamp"), F.concat(F.upper("event_type"), F.lit(".Example.")).alias("query_name"), F.when(n % 2 == 0, F.array(a, a)).otherwise(F.array(a)).alias("answers"), F.lit("10.0.0.1").alias("srcaddr")))
    r = readers.read_route53(spark, _landed(table(spark, sf_dir, "events"), record)).withColumn("answer", F.explode("answers"))
    return r.groupBy("network", "query").agg(F.count("*").alias("answers"), F.count_distinct("answer").alias("addresses"), F.unix_micros(F.max("ts")).alias("last_us"))


@query("""
SELECT 'svc' || (o_custkey % 25 % 9) AS service, o_orderpriority AS model, count(*) AS spans, count(*) FILTER (o_orderkey % 2 = 0) AS overlaid FROM orders GROUP BY 1, 2""")
def otlp_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each of 25 groups of customers: the resource's attributes, overlaid by the spans' own."""
    attribute = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    span = F.struct(F.lit("call").alias("name"), F.lit("1714557600000000000").alias("startTimeUnixNano"), F.array_compact(F.array(attribute("model", F.col("o_orderpriority")), F.when(F.col("o_orderkey") % 2 == 0, attribute("zone", F.lit("own"))))).alias("attributes"))
    docs = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 25).alias("part")).agg(F.collect_list(span).alias("spans"))
    resource = F.struct(F.array(attribute("service.name", F.concat(F.lit("svc"), (F.col("part") % 9).cast("string"))), attribute("zone", F.lit("resource"))).alias("attributes"))
    body = F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct("spans")).alias("scopeSpans"))).alias("resourceSpans")))
    folder = _folder(spark)
    docs.select(body.alias("value")).repartition(8).write.option("maxRecordsPerFile", 1).text(folder)
    a = F.col("attributes")
    return readers.read_otlp(spark, folder).groupBy(a["service.name"].alias("service"), a["model"].alias("model")).agg(F.count("*").alias("spans"), F.count_if(a["zone"] == "own").alias("overlaid"))


@query("""
SELECT 'host' || c_nationkey AS host, count(*) AS rows, CAST(sum(c_custkey) AS BIGINT) AS pids, count(*) FILTER (c_custkey % 2 = 0) AS nested FROM customer WHERE c_custkey % 12 <> 0 GROUP BY 1""")
def osquery_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    host = F.concat(F.lit("host"), _text("c_nationkey"))
    nested = F.to_json(F.struct(host.alias("hostIdentifier"), F.struct(k.cast("string").alias("pid"), F.lit("nested").alias("name")).alias("columns")))
    line = F.when(k % 12 == 0, "cut off {").when(k % 2 == 0, nested).otherwise(F.to_json(F.struct(host.alias("host"), k.cast("string").alias("pid"), F.lit("plain").alias("name"))))
    r = readers.read_osquery(spark, _landed(table(spark, sf_dir, "customer"), line))
    return r.groupBy("host").agg(F.count("*").alias("rows"), F.sum(F.col("pid").cast("long")).alias("pids"), F.count_if(F.col("name") == "nested").alias("nested"))


# ---------------------------------------------------------------- packs, inventories, reports


@query("""
WITH a AS (SELECT 'sig-' || p_partkey AS id, p_brand AS v, 0.5 AS w FROM part WHERE p_partkey % 3 = 0), b AS (SELECT 'sig-' || p_partkey AS id, p_type AS v, 0.9 AS w FROM part WHERE p_partkey % 5 = 0),
m AS (SELECT * FROM b UNION ALL SELECT * FROM a WHERE id NOT IN (SELECT id FROM b))
SELECT v AS value, count(*) AS signals, CAST(round(sum(w), 1) AS DOUBLE) AS weight FROM (SELECT v, w FROM m UNION ALL SELECT lower(v), w FROM m) GROUP BY v""")
def signature_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two packs, of which the later one overrides what both define."""
    p = table(spark, sf_dir, "part")
    pack = lambda rows, v, w: F.to_json(F.struct(F.concat(F.lit("sig-"), _text("p_partkey")).alias("signature_id"), F.lit("framework").alias("category"), F.lit("name").alias("type"), F.lit("exact").alias("match"), F.array(F.col(v), F.lower(v)).alias("values"), F.lit(w).alias("weight")))  # noqa: E731, ARG005
    first, second = p.where("p_partkey % 3 = 0"), p.where("p_partkey % 5 = 0")
    packs = readers.read_signature_pack(spark, [_landed(first, pack(first, "p_brand", 0.5)), _landed(second, pack(second, "p_type", 0.9))], override=True)
    return packs.groupBy("value").agg(F.count("*").alias("signals"), F.round(F.sum("weight"), 1).alias("weight"))


@query("""
SELECT 'agent-' || c_custkey AS agent_id, p AS pattern, CASE WHEN c_custkey % 2 = 0 THEN 'cloud|web' ELSE '' END AS surfaces, CASE WHEN c_nationkey % 4 <> 0 THEN c_nationkey % 4 END AS autonomy_level
FROM customer, (VALUES (0), (1)) v(i), LATERAL (SELECT CASE i WHEN 0 THEN 'app/' || c_custkey ELSE 'app-' || c_mktsegment || '*' END AS p) WHERE i = 0 OR c_custkey % 3 = 0""")
def inventory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    lists = F.concat(F.lit("app/"), k.cast("string"), F.when(k % 3 == 0, F.concat(F.lit(" | app-"), "c_mktsegment", F.lit("*"))).otherwise(""))
    line = F.concat_ws(",", F.concat(F.lit(" agent-"), k.cast("string")), lists, F.when(k % 2 == 0, "cloud|web").otherwise(""), F.when(F.col("c_nationkey") % 4 != 0, (F.col("c_nationkey") % 4).cast("string")).otherwise(""))
    r = readers.read_inventory(spark, _landed(table(spark, sf_dir, "customer"), line, F.lit(0), "agent_id,resources,surfaces,autonomy_level"))
    return r.select("agent_id", "pattern", F.array_join("surfaces", "|").alias("surfaces"), "autonomy_level")


# ---------------------------------------------------------------- writers

_FINDING_ROWS = """
WITH f AS (SELECT o_orderkey AS k, 'ss-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS id, CASE WHEN o_orderkey % 10 = 0 THEN '=cmd ' ELSE 'Order ' END || o_orderkey AS title, 'app[' || o_custkey || ']' AS resource, CAST(floor(o_totalprice / 5000) AS INT) AS score,
                  CASE WHEN floor(o_totalprice / 5000) >= 75 THEN 'critical' WHEN floor(o_totalprice / 5000) >= 50 THEN 'high' WHEN floor(o_totalprice / 5000) >= 25 THEN 'medium' WHEN floor(o_totalprice / 5000) >= 1 THEN 'low' ELSE 'info' END AS level,
                  CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS shadow, o_orderpriority AS surface, epoch_ms(o_orderdate) AS ms FROM orders)"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyhawk.functions.scalars import risk_level

    score = F.floor(F.col("o_totalprice") / 5000).cast("int")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("ss-"), F.lpad(_text("o_orderkey"), 9, "0")).alias("id"), F.concat(F.when(F.col("o_orderkey") % 10 == 0, "=cmd ").otherwise("Order "), _text("o_orderkey")).alias("title"), F.concat(F.lit("app["), _text("o_custkey"), F.lit("]")).alias("resource"),
        score.alias("score"), risk_level(score).alias("level"), F.when(F.col("o_orderstatus") == "O", True).when(F.col("o_orderstatus") == "F", False).alias("shadow"), F.col("o_orderpriority").alias("surface"), F.lit("agent").alias("kind"), F.lit(None).cast("string").alias("owner"),
        F.array("o_orderstatus", "o_orderpriority").alias("tags"), F.col("o_orderdate").cast("timestamp").alias("first_seen"), F.col("o_orderdate").cast("timestamp").alias("last_seen"),
    )


@query(_FINDING_ROWS + """
SELECT 'findings' AS part, 'rows' AS value, count(*) AS n FROM f UNION ALL SELECT 'total', 'all', count(*) FROM f UNION ALL SELECT 'shadow', 'shadow', count(*) FROM f WHERE shadow UNION ALL SELECT 'surface', surface, count(*) FROM f GROUP BY surface
UNION ALL SELECT 'kind', 'agent', count(*) FROM f UNION ALL SELECT 'level', level, count(*) FROM f GROUP BY level""")
def written_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    sinks.write_findings(_findings(spark, sf_dir), folder)
    rows = spark.read.json(f"{folder}/findings").agg(F.lit("findings").alias("part"), F.lit("rows").alias("value"), F.count("id").alias("n"))
    return rows.unionByName(spark.read.json(f"{folder}/summary").select(F.col("dim").alias("part"), "value", "n"))


@query(_FINDING_ROWS + """
SELECT id, CASE WHEN title LIKE '=%' THEN '''' || title ELSE title END AS title, resource, CAST(score AS VARCHAR) AS score, coalesce(CAST(shadow AS VARCHAR), '') AS shadow, o_orderstatus || '|' || o_orderpriority AS tags FROM f JOIN orders ON k = o_orderkey""")
def written_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    sinks.write_findings_csv(_findings(spark, sf_dir), folder)
    back = spark.read.option("header", True).option("escape", '"').csv(folder)
    return back.select("id", "title", "resource", "score", F.coalesce("shadow", F.lit("")).alias("shadow"), "tags")


@query(_FINDING_ROWS + """
SELECT id, ms AS time, CASE level WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END AS severity_id, score AS risk_score, resource FROM f""")
def written_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    sinks.write_ocsf_events(_findings(spark, sf_dir), folder)
    e = spark.read.json(folder)
    return e.select(F.col("finding_info.uid").alias("id"), "time", "severity_id", "risk_score", F.col("resources")[0]["uid"].alias("resource"))


@query(_FINDING_ROWS + """
SELECT trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') || '-' || substr(id, 4, 6) AS agent_id, title, replace(resource, '[', '[[]') AS resources FROM f WHERE shadow AND score >= 40""")
def registration_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.registration_stubs(_findings(spark, sf_dir), ("agent",), 40).select("agent_id", "title", "resources")


@query("""
SELECT event_type AS connector, count(*) AS records, count(*) FILTER (event_id % 4 = 0) AS redacted, 0 AS leaks FROM events GROUP BY 1""")
def written_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records leave redacted, by connector, with a manifest."""
    token = F.concat(F.lit("AKIA"), F.upper(F.substring(F.sha2(_text("event_id"), 256), 1, 16)))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("connector"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("key "), F.translate(token, "0189", "ABCD"))).otherwise(F.col("props")).alias("raw"))
    folder = _folder(spark)
    sinks.write_record_export(rows, folder)
    back = spark.read.json(f"{folder}/records").groupBy("connector").agg(F.count_if(F.col("raw").startswith("key ") & ~F.col("raw").contains("AKIA")).alias("redacted"), F.count_if(F.col("raw").contains("AKIA")).cast("int").alias("leaks"))
    return spark.read.json(f"{folder}/manifest").select("connector", "records").join(back, "connector")
