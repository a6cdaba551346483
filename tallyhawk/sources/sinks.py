"""Writers of findings, events and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhawk.functions.scalars import csv_safe
from tallyhawk.operators.findings import summarise_findings
from tallyhawk.operators.text_audit import redact_text


def write_findings(findings: DataFrame, path: str) -> None:
    """Full rows as JSON lines, and the summary beside them."""
    findings.write.mode("overwrite").json(f"{path}/findings")
    summarise_findings(findings).write.mode("overwrite").json(f"{path}/summary")


def flat_cells(findings: DataFrame) -> DataFrame:
    """Every column as one safe cell: lists joined with bars, structures as JSON, formulas neutralised."""

    def cell(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        flat = F.array_join(c, "|") if kind == "array<string>" else F.to_json(c) if kind.startswith(("array", "struct", "map")) else c.cast("string")
        return csv_safe(F.coalesce(flat, F.lit(""))).alias(name)

    return findings.select(*[cell(n, k) for n, k in findings.dtypes])


def write_findings_csv(findings: DataFrame, path: str) -> None:
    flat_cells(findings).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


# Severity of the event standard by risk level.
SEVERITY = {"info": 1, "low": 2, "medium": 3, "high": 4, "critical": 5}


def ocsf_events(findings: DataFrame) -> DataFrame:
    """One detection-finding event per finding."""
    severity = F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col("level")], F.lit(0))
    time = F.unix_millis(F.coalesce(F.col("last_seen").cast("timestamp"), F.timestamp_seconds(F.lit(0))))
    info = F.struct(F.col("id").alias("uid"), F.col("title"), F.array("kind").alias("types"), F.unix_millis(F.col("first_seen").cast("timestamp")).alias("first_seen_time"), F.unix_millis(F.col("last_seen").cast("timestamp")).alias("last_seen_time"))
    return findings.select(F.lit(2004).alias("class_uid"), F.lit(2).alias("category_uid"), F.lit(200401).alias("type_uid"), F.lit(1).alias("activity_id"), severity.alias("severity_id"), time.alias("time"), info.alias("finding_info"), F.col("score").alias("risk_score"), F.array(F.struct(F.col("resource").alias("uid"), F.col("surface").alias("type"))).alias("resources"), F.struct(F.struct(F.lit("tallyhawk").alias("name")).alias("product"), F.lit("1.3.0").alias("version")).alias("metadata"))


def write_ocsf_events(findings: DataFrame, path: str) -> None:
    ocsf_events(findings).write.mode("overwrite").json(path)


def write_record_export(records: DataFrame, path: str) -> None:
    """Redacted raw records by connector (``connector, raw``), and a manifest of counts."""
    clean = records.withColumn("raw", redact_text(F.col("raw")))
    clean.write.mode("overwrite").partitionBy("connector").json(f"{path}/records")
    records.groupBy("connector").agg(F.count("*").alias("records")).write.mode("overwrite").json(f"{path}/manifest")


def write_control_rows(controls: DataFrame, path: str) -> None:
    flat_cells(controls).write.mode("overwrite").option("header", True).csv(path)


def registration_stubs(findings: DataFrame, kinds: tuple[str, ...] | None = None, least_score: int = 0) -> DataFrame:
    """Rows that would register each shadow finding: slug, owner, resource with wild cards escaped."""
    f = findings.where(F.col("shadow") & (F.col("score") >= least_score))
    f = f.where(F.col("kind").isin(*kinds)) if kinds else f
    slug = F.regexp_replace(F.regexp_replace(F.lower("title"), r"[^a-z0-9]+", "-"), r"^-|-$", "")
    return f.select(F.concat(slug, F.lit("-"), F.substring("id", 4, 6)).alias("agent_id"), "title", F.coalesce("owner", F.lit("")).alias("owner"), F.regexp_replace("resource", r"([*?\[])", "[$1]").alias("resources"), F.col("surface").alias("surfaces"))
