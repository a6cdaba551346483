"""Low-code workflows: AI steps, triggers and reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhawk.plans.session import cut

AI_STEP = r"(?i)openai|anthropic|claude|gpt|gemini|langchain|\bllm\b|\bai[ _-]?agent\b|chatgpt|mistral|cohere|hugging ?face|bedrock|vertex"
TRIGGERS = (("schedule", r"(?i)cron|schedule|recurrence|interval"), ("event", r"(?i)webhook|trigger|event|imap|new[ _]|watch"))


def lowcode_ai_workflows(steps: DataFrame) -> DataFrame:
    """Workflows with an AI step from step rows (``workflow, name, owner, active, step_type, ord``): steps, trigger, tags."""
    kind = None
    for name, p in TRIGGERS:
        kind = F.when(F.col("step_type").rlike(p), name) if kind is None else kind.when(F.col("step_type").rlike(p), name)
    s = steps.withColumns({"_ai": F.col("step_type").rlike(AI_STEP), "_trigger": F.when(F.col("ord") == 0, kind)})
    w = s.groupBy("workflow").agg(F.first("name").alias("name"), F.first("owner").alias("owner"), F.bool_or("active").alias("active"), F.count("*").alias("steps"), F.count_if("_ai").alias("ai_steps"), F.max("_trigger").alias("trigger")).where(F.col("ai_steps") > 0)
    tags = F.array_compact(F.array(F.when(F.col("trigger") == "schedule", "scheduled"), F.when(F.col("trigger") == "event", "event-triggered"), F.when(~F.col("active"), "inactive")))
    return w.withColumn("tags", tags)


def n8n_steps(files: DataFrame, text: str = "text") -> DataFrame:
    """Step rows of exported n8n workflows."""
    spec = "array<struct<id:string, name:string, active:boolean, nodes:array<struct<type:string, name:string>>>>"
    w = files.select(F.explode(F.coalesce(F.from_json(F.get_json_object(text, "$.data"), spec), F.from_json(F.concat(F.lit("["), text, F.lit("]")), spec))).alias("w"))
    return w.select(F.col("w.id").alias("workflow"), F.col("w.name").alias("name"), F.lit(None).cast("string").alias("owner"), F.col("w.active").alias("active"), F.posexplode("w.nodes").alias("ord", "n")).select("workflow", "name", "owner", "active", F.col("n.type").alias("step_type"), "ord")


def zapier_steps(rows: DataFrame) -> DataFrame:
    """Step rows of an exported list of Zaps (``Title, Status, Apps, Owner``)."""
    return rows.select(F.col("Title").alias("workflow"), F.col("Title").alias("name"), F.col("Owner").alias("owner"), (F.lower("Status") == "on").alias("active"), F.posexplode(F.split("Apps", r"\s*[,>|]\s*")).alias("ord", "step_type"))


def reachable_egress(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``workflow, node``: egress steps that an untrusted input reaches by way of an AI step.

    ``edges``: ``workflow, src, dst``; ``nodes``: ``workflow, node, role`` (input, ai, egress). A state is a node and whether AI was
    passed; each round joins only the states found in the last one, and ends when there are none.
    """
    e = edges.join(nodes.select("workflow", F.col("node").alias("dst"), F.coalesce(F.col("role") == "ai", F.lit(False)).alias("_ai")), ["workflow", "dst"])
    seen = cut(nodes.where("role = 'input'").select("workflow", "node", F.lit(False).alias("ai")))
    frontier = seen
    while True:
        step = frontier.withColumnRenamed("node", "src").join(e, ["workflow", "src"]).select("workflow", F.col("dst").alias("node"), (F.col("ai") | F.col("_ai")).alias("ai")).distinct()
        frontier = cut(step.join(seen, ["workflow", "node", "ai"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = cut(seen.union(frontier))
    return seen.where("ai").join(nodes.where("role = 'egress'").select("workflow", "node"), ["workflow", "node"]).select("workflow", "node").distinct()
