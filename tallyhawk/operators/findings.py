"""Findings and their evidence: confidence, merge, summary, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhawk.functions.scalars import likelihood


def noisy_or_confidence(evidence: DataFrame, key: str = "finding_id", group: Column | None = None, weight: str = "weight") -> DataFrame:
    """``key, confidence``: 1 - prod(1 - greatest weight of each group), rounded to 3 places.

    The group is the row's own, else its signal; on the code surface (if there is a ``surface``) rows without a
    group stand each for themselves. Weights are kept within 0 and 1; null ones weigh nothing.
    """
    most = evidence.select(key, (_group(evidence) if group is None else group).alias("_g"), _within_one(F.col(weight)).alias("_b")).groupBy(key, "_g").agg(F.max("_b").alias("_w"))
    return most.groupBy(key).agg(F.round(1 - F.product(1 - F.col("_w")), 3).alias("confidence"))


def _group(evidence: DataFrame) -> Column:
    by_signal = F.concat(F.lit("signal:"), F.coalesce("signal", F.lit("")))
    if "surface" in evidence.columns:
        by_signal = F.when(F.col("surface") == "code", F.concat(F.lit("row:"), F.monotonically_increasing_id())).otherwise(by_signal)
    return F.coalesce(F.concat(F.lit("group:"), "confidence_group"), by_signal)


def _within_one(weight: Column) -> Column:
    return F.least(F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def cap_confidence(weights: Column, cap: float, steps: int = 40, floor: float = 1e-4) -> Column:
    """The weights times the greatest factor under which their noisy-OR stays within ``cap`` (found by halving)."""
    joint = lambda s: 1 - F.aggregate(weights, F.lit(1.0), lambda a, w: a * (1 - w * s))
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        return F.when(joint(mid) <= cap, F.struct(mid.alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))

    scale = F.when(joint(F.lit(1.0)) <= cap, 1.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["lo"])
    # the factor is found once, not once for each weight
    return F.element_at(F.transform(F.array(scale), lambda s: F.transform(weights, lambda w: F.greatest(w * s, F.lit(floor)))), 1)


# The greatest joint weight of an application for which nothing says AI, and the tags that do say so.
UNATTRIBUTED_MOST = 0.35
AI_TAGS = ("policy.llm-access-scopes", "entra-agent-identity", "registry-record")


def bound_unattributed(findings: DataFrame, evidence: DataFrame, key: str = "finding_id") -> DataFrame:
    """``evidence`` in which an application without any sign of AI counts as one weak observation.

    For findings with ``app_assessment`` and neither frameworks, providers, AI tags nor a registry record, all evidence
    but hints from names is of one group and weighs ``UNATTRIBUTED_MOST`` at most. The bound is in the weights, so
    later scores reproduce it.
    """
    open_apps = findings.where(_nothing_says_ai(findings)).select(F.col("id").alias(key)).distinct()
    registered = evidence.where("confidence_group = 'registry-record'").select(key).distinct()
    open_apps = open_apps.join(registered, key, "left_anti").withColumn("_open", F.lit(True))
    weak = F.coalesce("_open", F.lit(False)) & ~_name_hint()
    return evidence.join(open_apps, key, "left").withColumns({
        "confidence_group": F.when(weak, "unattributed-app").otherwise(F.col("confidence_group")), "weight": F.when(weak, F.least("weight", F.lit(UNATTRIBUTED_MOST))).otherwise(F.col("weight")),
    }).select(*evidence.columns)


def _nothing_says_ai(findings: DataFrame) -> Column:
    has = set(findings.columns)
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0 if c in has else F.lit(False)
    tagged = F.coalesce(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in AI_TAGS])), F.lit(False)) if "tags" in has else F.lit(False)
    return F.coalesce("app_assessment", F.lit(False)) & ~(some("frameworks") | some("model_providers") | tagged)


def _name_hint() -> Column:
    sure = ~F.coalesce(F.col("confidence_group").isin("ambiguous-name", "unverified-app-name"), F.lit(False))
    return F.coalesce(F.col("signal").rlike("^(?:signature:)?name") & sure, F.lit(False))


def confidence_and_bound(evidence: DataFrame, key: str = "id", partitions: int | None = None) -> DataFrame:
    """``key, confidence, bounded, registered``: the noisy-OR of all evidence as it is and as ``bound_unattributed`` has it for an open application.

    Both come from one aggregation, so evidence is neither joined nor sorted; ``registered`` says whether a registry
    record is among it. With ``partitions`` it is dealt by ``key`` into so many.
    """
    hint, one = _name_hint(), F.col("_g") == "group:unattributed-app"
    rows = evidence.select(
        key, _group(evidence).alias("_g"), _within_one(F.col("weight")).alias("_w"), F.when(hint, _within_one(F.col("weight"))).alias("_hint"),
        F.when(~hint, _within_one(F.least("weight", F.lit(UNATTRIBUTED_MOST)))).alias("_weak"), F.coalesce(F.col("confidence_group") == "registry-record", F.lit(False)).alias("_r"),
    )
    rows = rows.repartition(partitions, key) if partitions else rows
    most = rows.groupBy(key, "_g").agg(*[F.max(c).alias(c) for c in ("_w", "_hint", "_weak", "_r")])
    hints, weak = F.product(F.when(one, 1.0).otherwise(1 - F.coalesce("_hint", F.lit(0.0)))), F.max(F.greatest("_weak", F.when(one, F.col("_hint"))))
    return most.groupBy(key).agg(F.round(1 - F.product(1 - F.col("_w")), 3).alias("confidence"), F.round(1 - hints * (1 - F.coalesce(weak, F.lit(0.0))), 3).alias("bounded"), F.max("_r").alias("registered"))


def technologies(findings: DataFrame, signatures: DataFrame, partitions: int | None = None) -> DataFrame:
    """``id, technologies``: what a finding's frameworks and providers are, in that order (``signature_id, name, category, vendor``)."""
    none = F.array().cast("array<string>")
    used = F.concat(F.coalesce("frameworks", none), F.coalesce("model_providers", none))
    each = findings.select("id", F.posexplode(used).alias("at", "signature_id")).join(signatures.select("signature_id", "name", "category", "vendor"), "signature_id")
    each = each.repartition(partitions, "id") if partitions else each
    listed = F.array_sort(F.collect_list(F.struct("at", "signature_id", "name", "category", "vendor")))
    return each.groupBy("id").agg(F.transform(listed, lambda t: F.struct(t["signature_id"].alias("id"), t["name"].alias("name"), t["category"].alias("category"), t["vendor"].alias("vendor"))).alias("technologies"))


def finalize_findings(findings: DataFrame, evidence: DataFrame, signatures: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Findings with ``confidence`` and ``likelihood``; framework use with agent indicators is an agent.

    ``evidence`` has the finding's ``id``. Applications that nothing attributes to AI are bounded first (see
    ``bound_unattributed``); with ``signatures`` there is a ``technologies`` list. ``partitions``: how many tasks
    share the findings and their evidence (see ``session.parts_for``), if not the session's number.
    """
    dealt = findings.repartition(partitions, "id") if partitions else findings
    if "app_assessment" in findings.columns:
        dealt = dealt.withColumn("_open", F.max(_nothing_says_ai(findings)).over(Window.partitionBy("id")))
        scored = dealt.join(confidence_and_bound(evidence, "id", partitions), "id", "left")
        scored = scored.withColumn("confidence", F.when(F.col("_open") & ~F.coalesce("registered", F.lit(False)), F.col("bounded")).otherwise(F.col("confidence"))).drop("_open", "bounded", "registered")
    else:
        scored = dealt.join(noisy_or_confidence(evidence.repartition(partitions, "id") if partitions else evidence, "id"), "id", "left")
    scored = scored.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    if "agent_indicators" in findings.columns:
        scored = scored.withColumn("kind", F.when((F.col("kind") == "framework-usage") & (F.col("agent_indicators") > 0), "agent").otherwise(F.col("kind")))
    if signatures is not None:
        scored = scored.join(technologies(findings, signatures, partitions), "id", "left")
    return scored.withColumn("likelihood", likelihood("confidence"))


#: Which kind wins when observations of one finding differ; all others are below these.
KIND_PRIORITY = {"agent": 3, "service-identity": 2, "oauth-grant": 1}


def merge_findings(findings: DataFrame, lists: tuple[str, ...] = ("capabilities", "tags"), firsts: tuple[str, ...] = ("owner", "title"), order: str = "ord") -> DataFrame:
    """One row per id: first known scalar in the given order, union of lists, earliest and latest time.

    Kind and ``resource_type`` (if there) are chosen as a pair: by the kind's priority, then the greatest name, so
    that merges of merges give the same; ``observed_kinds`` has all of them where they differ.
    """
    priority = F.coalesce(F.create_map(*[F.lit(x) for kv in KIND_PRIORITY.items() for x in kv])[F.col("kind")], F.lit(0))
    typed = "resource_type" in findings.columns
    pair = F.struct(priority.alias("p"), F.col("kind").alias("kind"), (F.coalesce("resource_type", F.lit("")) if typed else F.lit("")).alias("resource_type"))
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    aggs = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists]
    aggs += [known(c).alias(c) for c in firsts]
    return findings.groupBy("id").agg(*aggs, F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max(pair).alias("_pair"), F.array_sort(F.collect_set("kind")).alias("_kinds"), F.count("*").alias("observations")).withColumn("kind", F.col("_pair.kind")).withColumns(
        {"observed_kinds": F.when(F.size("_kinds") > 1, F.col("_kinds"))} | ({"resource_type": F.nullif(F.col("_pair.resource_type"), F.lit(""))} if typed else {})
    ).drop("_pair", "_kinds")


def dedupe_evidence(evidence: DataFrame) -> DataFrame:
    """One row per (finding, signal, location, description), the one of greatest weight; equal ones by their other columns."""
    same = ["finding_id", "signal", "location", "description"]
    order = Window.partitionBy(*same).orderBy(F.desc_nulls_last("weight"), *sorted(c for c in evidence.columns if c not in (*same, "weight")))
    return evidence.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def summarise_findings(findings: DataFrame) -> DataFrame:
    """``dim, value, n`` for the total, shadow, surface, kind and level: one pass with grouping sets."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(d).alias("dim"), v.cast("string").alias("value"))
        for d, v in (("total", F.lit("all")), ("shadow", F.when(F.col("shadow"), "shadow")), ("surface", F.col("surface")), ("kind", F.col("kind")), ("level", F.col("level")))
    ]))
    return findings.select(rows.alias("r")).where("r.value is not null").groupBy("r.dim", "r.value").agg(F.count("*").alias("n"))


def order_fleet(findings: DataFrame) -> DataFrame:
    """Findings of several reports: unregistered before unassessed before registered, then by risk, danger, confidence and id."""
    rank = F.when(F.col("shadow"), 0).when(F.col("shadow").isNull(), 1).otherwise(2)
    return findings.orderBy(rank, F.desc_nulls_last("score"), F.desc_nulls_last("danger_score"), F.desc_nulls_last("confidence"), "id")


def order_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc("score"), F.desc("confidence"), "surface", "title")


def review_queue(findings: DataFrame, least_score: int = 25, size: int = 25) -> DataFrame:
    """The ``size`` findings of highest risk at or above a score."""
    return findings.where(F.col("score") >= least_score).orderBy(F.desc("score"), F.desc("confidence"), "id").limit(size)


def cap_per_group(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows of each group, by the given order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def union_findings(*branches: DataFrame) -> DataFrame:
    """All branches one after the other; columns that one lacks are null."""
    out = branches[0].withColumn("ord", F.lit(0))
    for i, b in enumerate(branches[1:], 1):
        out = out.unionByName(b.withColumn("ord", F.lit(i)), allowMissingColumns=True)
    return out


def min_confidence(findings: DataFrame, least: float) -> DataFrame:
    """Findings of at least that confidence; registry records stay."""
    return findings.where((F.col("confidence") >= least) | (F.col("connector").endswith("registry")))


def prune_links(links: DataFrame, findings: DataFrame) -> DataFrame:
    """Links whose ends are both still there."""
    ids = findings.select("id").distinct()
    return links.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
