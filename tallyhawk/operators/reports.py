"""Reports of findings: difference, drift, fleet merge, controls, inventory rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhawk.functions import weights as W
from tallyhawk.plans.session import cut

COVERAGE_RANK = {"complete": 0, "skipped": 1, "incomplete": 2, "failed": 3}


def diff_reports(baseline: DataFrame, current: DataFrame, state: Sequence[str], key: str = "id", comparable: bool = True) -> DataFrame:
    """``key, change``: new, resolved, changed, same; with lost coverage a missing row is ``unknown``, never resolved."""
    fp = F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in state])), 256)
    b, c = baseline.select(key, fp.alias("_b")), current.select(key, fp.alias("_c"))
    gone = "resolved" if comparable else "unknown"
    change = F.when(F.col("_b").isNull(), "new").when(F.col("_c").isNull(), gone).when(F.col("_b") == F.col("_c"), "same").otherwise("changed")
    return b.join(c, key, "full_outer").select(key, change.alias("change"))


def field_drift(baseline: DataFrame, current: DataFrame, fields: Sequence[str], key: str = "id") -> DataFrame:
    """One row per shared key and changed field: ``key, field, before, after``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    long = lambda df, v: df.select(key, *[text(c) for c in fields]).unpivot([key], list(fields), "field", v)
    return long(baseline, "before").join(long(current, "after"), [key, "field"]).where("before <> after")


def list_delta(before: str, after: str) -> tuple[Column, Column]:
    """Items added and removed."""
    none = F.array().cast("array<string>")
    b, a = F.coalesce(F.col(before), none), F.coalesce(F.col(after), none)
    return F.array_sort(F.array_except(a, b)), F.array_sort(F.array_except(b, a))


CLASSES = {"shadow": "inventory", "registry_match": "inventory", "capabilities": "capability", "floor": "autonomy", "ceiling": "autonomy", "oversight": "autonomy", "tags": "governance", "owner": "governance", "score": "governance", "status": "coverage"}


def drift(pairs: DataFrame, lists: Sequence[str] = ("capabilities", "tags"), scalars: Sequence[str] = ("owner", "shadow", "floor")) -> DataFrame:
    """``id, field, class, added, removed, adverse`` for pairs of states with columns ``b_x`` and ``c_x``.

    Gaining a capability or tag is adverse and losing one that mitigates is; so are a higher floor, losing the
    owner and becoming shadow.
    """
    soft = F.array(*[F.lit(t) for t in W.MITIGATING])
    rows = []
    for f in lists:
        added, removed = list_delta(f"b_{f}", f"c_{f}")
        worse = (F.size(F.array_except(added, soft)) > 0) | (F.size(F.array_intersect(removed, soft)) > 0)
        rows.append(F.when((F.size(added) > 0) | (F.size(removed) > 0), F.struct(F.lit(f).alias("field"), F.array_join(added, "|").alias("added"), F.array_join(removed, "|").alias("removed"), worse.alias("adverse"))))
    for f in scalars:
        b, c = F.col(f"b_{f}"), F.col(f"c_{f}")
        worse = {"owner": c.isNull(), "shadow": F.coalesce(c, F.lit(False))}.get(f, F.coalesce(c > b, F.lit(True)))
        rows.append(F.when(~b.eqNullSafe(c), F.struct(F.lit(f).alias("field"), F.coalesce(c.cast("string"), F.lit("")).alias("added"), F.coalesce(b.cast("string"), F.lit("")).alias("removed"), worse.alias("adverse"))))
    cls = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    return pairs.select("id", F.explode(F.array_compact(F.array(*rows))).alias("d")).select("id", "d.field", F.coalesce(cls[F.col("d.field")], F.lit("other")).alias("class"), "d.added", "d.removed", "d.adverse")


def drift_totals(rows: DataFrame) -> DataFrame:
    """Per class: findings that drifted, and whether any drift is adverse."""
    return rows.groupBy("class").agg(F.count_distinct("id").alias("findings"), F.bool_or("adverse").alias("any_adverse"))


def baseline_gate(baseline: DataFrame, current: DataFrame, max_age_days: int = 30) -> DataFrame:
    """One row ``reasons``: why two reports (``started_at, scope, identity_schema, complete, total, rows``) don't compare."""
    b, c = baseline.select(F.struct("*").alias("b")), current.select(F.struct("*").alias("c"))
    reasons = F.array_compact(F.array(
        F.when(F.datediff("c.started_at", "b.started_at") > max_age_days, "baseline-too-old"), F.when(F.col("b.scope") != F.col("c.scope"), "scope-differs"),
        F.when(F.col("b.identity_schema") != F.col("c.identity_schema"), "identity-schema-differs"), F.when(~F.col("c.complete"), "current-incomplete"), F.when(~F.col("b.complete"), "baseline-incomplete"),
        F.when((F.col("b.total") != F.col("b.rows")) | (F.col("c.total") != F.col("c.rows")), "summary-differs-from-rows"),
    ))
    return b.crossJoin(c).select(reasons.alias("reasons"))  # one row each


def fleet_merge(rows: DataFrame, key: str = "id", report: str = "report") -> DataFrame:
    """One row per finding over all reports: greatest risk (score, then danger), sources, registration vote, widest autonomy, times."""
    has = set(rows.columns)
    risk = F.max(F.struct("score", "danger_score"))
    aggs = [risk["score"].alias("score"), risk["danger_score"].alias("danger_score"), F.array_sort(F.collect_set(report)).alias("sources"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")]
    if "shadow" in has:
        aggs += [F.bool_or("shadow").alias("shadow"), F.when(F.count_distinct("registry_match") > 1, "ambiguous").otherwise(F.max("registry_match")).alias("registry_match")]
    if "floor" in has:
        aggs += [F.max("floor").alias("floor"), F.max("ceiling").alias("ceiling")]
    return rows.groupBy(key).agg(*aggs)


def map_controls(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """``id, ref`` for each rule (``ref, kinds, tags, capabilities, min_floor, shadow``) all of whose given conditions hold."""
    overlap = lambda c: F.col(f"r.{c}").isNull() | F.coalesce(F.arrays_overlap(F.col(f"f.{c}"), F.col(f"r.{c}")), F.lit(False))
    test = (F.col("r.kinds").isNull() | F.array_contains("r.kinds", F.col("f.kind"))) & overlap("tags") & overlap("capabilities")
    test = test & (F.col("r.min_floor").isNull() | F.coalesce(F.col("f.floor") >= F.col("r.min_floor"), F.lit(False)))
    test = test & (F.col("r.shadow").isNull() | F.coalesce(F.col("f.shadow") == F.col("r.shadow"), F.lit(False)))
    # a rule is kept under one condition that must hold; a finding looks up all of its own
    named = lambda what, c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.concat(F.lit(what), x))
    first = F.when(F.col("kinds").isNotNull(), named("kind:", "kinds")).when(F.col("tags").isNotNull(), named("tag:", "tags")).when(F.col("capabilities").isNotNull(), named("can:", "capabilities")).otherwise(F.array(F.lit("")))
    own = F.concat(F.array(F.concat(F.lit("kind:"), F.coalesce("kind", F.lit("")))), named("tag:", "tags"), named("can:", "capabilities"), F.array(F.lit("")))
    f = findings.withColumn("_key", F.explode(F.array_distinct(own)))
    r = rules.withColumn("_key", F.explode(F.array_distinct(first)))
    return f.alias("f").join(r.alias("r"), F.col("f._key") == F.col("r._key")).where(test).select("f.id", "r.ref").distinct()


def control_evidence(refs: DataFrame, controls: DataFrame, findings: DataFrame, complete: bool, examples: int = 3) -> DataFrame:
    """Per control: findings that refer to it, by level, best examples and a status; absence needs complete coverage."""
    j = refs.join(findings.select("id", "score", "danger_score", "level"), "id")
    top = j.withColumn("_k", F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("score"), F.desc("danger_score"), "id"))).where(F.col("_k") <= examples)
    top = top.groupBy("ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "id"))), lambda x: x["id"].cast("string")), ",").alias("examples"))
    counts = j.groupBy("ref").agg(F.count("*").alias("findings"), *[F.count_if(F.col("level") == v).alias(v) for v in ("critical", "high", "medium", "low", "info")])
    out = controls.select("ref").join(counts, "ref", "left").join(top, "ref", "left")
    status = F.when(F.col("findings") > 0, "referenced").otherwise("not-observed" if complete else "incomplete")
    return out.withColumn("status", status).fillna(0)


def ranked_counts(rows: DataFrame, value: str) -> DataFrame:
    """``value, n, place``: most frequent first, null last among equals, then by value.

    The counts are dealt by ranges of that order and ranked in each; only the ranges' sizes meet in one task.
    """
    order = (F.desc("n"), F.asc_nulls_last("value"))
    counts = rows.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    dealt = cut(counts.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.select("_range", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return dealt.join(F.broadcast(before), "_range").select("value", "n", place.alias("place"))  # a row per range


def inventory_counts(findings: DataFrame, levels: DataFrame) -> DataFrame:
    """Findings per level with zero rows, without credentials."""
    counts = findings.where("kind <> 'secret'").groupBy("level").agg(F.count("*").alias("n"), F.count_if(F.col("owner").isNull()).alias("unowned"))
    return levels.select("level").join(counts, "level", "left").fillna(0)


def inventory_document(findings: DataFrame) -> DataFrame:
    """``part, name, n, unowned, shadow, worst``: the inventory's figures by level, kind, owner, status and in all, in one pass.

    Credentials are not part of an inventory. A null owner is ``unowned``; a status is three-valued. Every finding
    gives a row per part to the partial aggregation; what is shuffled is as many rows as there are names.
    """
    status = F.when(F.col("shadow"), "shadow").when(~F.col("shadow"), "registered").otherwise("unassessed")
    parts = (("level", F.col("level")), ("kind", F.col("kind")), ("owner", F.coalesce("owner", F.lit("unowned"))), ("status", status), ("total", F.lit("all")))
    rows = findings.where("kind <> 'secret'").select("owner", "shadow", "score", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), v.alias("name")) for p, v in parts])).alias("r"))
    return rows.groupBy("r.part", "r.name").agg(
        F.count("*").alias("n"), F.count_if(F.col("owner").isNull()).alias("unowned"), F.count_if(F.col("shadow")).alias("shadow"), F.max("score").alias("worst")
    )


def inventory_sections(findings: DataFrame, stats: DataFrame, history: DataFrame, refs: DataFrame, worst: int = 3) -> DataFrame:
    """The whole inventory as rows ``section, name, item, n, unowned, shadow, worst, place`` for a reader to lay out.

    Sections: those of ``inventory_document`` (level, kind, owner, status, total); ``owner-worst``: the ``worst`` findings of each
    owner by score, then id; ``coverage``: each source's worst status (``stats``: source, connector, status) and its
    connectors; ``history``: what changed at each report (see ``report_history``); ``control``: findings that refer to a control
    (``refs``: id, ref). What a section does not have is null. Each section is one aggregation; none is collected.
    """
    none = lambda kind: F.lit(None).cast(kind)
    counts = inventory_document(findings).select(F.col("part").alias("section"), "name", none("string").alias("item"), "n", "unowned", "shadow", "worst", none("int").alias("place"))

    def section(df: DataFrame, name: Column) -> DataFrame:
        have = set(df.columns)
        kinds = {"name": "string", "item": "string", "n": "long", "unowned": "long", "shadow": "long", "worst": "long", "place": "int"}
        return df.select(name.alias("section"), *[(F.col(c) if c in have else none(k)).cast(k).alias(c) for c, k in kinds.items()])

    order = Window.partitionBy("name").orderBy(F.desc("score"), "id")
    owners = findings.where("kind <> 'secret'").select(F.coalesce("owner", F.lit("unowned")).alias("name"), "id", "score").withColumn("place", F.row_number().over(order)).where(F.col("place") <= worst)
    owners = owners.select("name", F.col("id").cast("string").alias("item"), F.col("score").alias("worst"), "place")
    rank = F.create_map(*[F.lit(x) for kv in COVERAGE_RANK.items() for x in kv])
    names = F.create_map(*[F.lit(x) for k, v in COVERAGE_RANK.items() for x in (v, k)])
    coverage = stats.groupBy(F.col("source").alias("name")).agg(F.max(rank[F.col("status")]).alias("_worst"), F.count_distinct("connector").alias("n")).select("name", names[F.col("_worst")].alias("item"), "n")
    changes = history.select(F.col("report").alias("name"), F.col("change").alias("item"), F.col("findings").alias("n"))
    controls = refs.groupBy(F.col("ref").alias("name")).agg(F.count_distinct("id").alias("n"))
    out = section(counts, F.col("section"))
    for df, name in ((owners, "owner-worst"), (coverage, "coverage"), (changes, "history"), (controls, "control")):
        out = out.unionByName(section(df, F.lit(name)))
    return out


def autonomy_matrix(findings: DataFrame, tiers: str, status: str, statuses: Sequence[str]) -> DataFrame:
    """Tier by status; the statuses are given, so the pivot takes one pass."""
    return findings.groupBy(tiers).pivot(status, list(statuses)).count().fillna(0)


def registry_rollup(records: DataFrame) -> DataFrame:
    return records.groupBy("registry").agg(F.count("*").alias("records"), F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("approval_mode") == "auto").alias("automatic"), F.bool_and("listing_complete").alias("listing_complete"))


def coverage_matrix(stats: DataFrame, rows: str, cols: str, rank: Column, columns: Sequence[str]) -> DataFrame:
    """Worst status of each source by connector."""
    return stats.withColumn("_rank", rank).groupBy(rows).pivot(cols, list(columns)).agg(F.max("_rank"))


def reference_counts(refs: DataFrame, titles: DataFrame) -> DataFrame:
    return refs.groupBy("ref").agg(F.count_distinct("id").alias("findings")).join(titles, "ref", "left")


def numbered(rows: DataFrame, *order: str | Column, name: str = "ordinal") -> DataFrame:
    """``rows`` with their place from 1 in an order of all: dealt by ranges, of which only the sizes meet in one task."""
    dealt = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_own", own).join(sizes.select("_range", before.alias("_before")), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")


def history_pairs(reports: DataFrame, order: str, ident: str) -> DataFrame:
    """Each report with the one before it."""
    at = numbered(reports, order, ident, name="_at")
    return at.join(at.select((F.col("_at") + 1).alias("_at"), F.col(ident).alias("previous")), "_at", "left").drop("_at")


def report_history(reports: DataFrame, rows: DataFrame, ident: str = "report", order: str = "started_at", key: str = "id") -> DataFrame:
    """``report, previous, change, findings``: what changed at each report against the one before it.

    ``reports``: ``report, started_at, complete`` and a ``scope`` that two comparable reports share. ``rows``:
    ``report, id, state`` (what a change is told by) and ``scan_local`` (an id that means nothing in another scan).
    Changes: ``new`` (never seen before), ``returned`` (seen, but not in the report before), ``same``, ``changed``,
    ``resolved`` (no longer there), ``unknown`` (no longer there, but the two reports don't compare), and ``not_comparable`` (an
    unmatched scan-local id, on either side). All reports are gone through at once: a finding's runs of presence follow
    from its own rows in order, whatever the number of reports.
    """
    at = cut(numbered(reports.select(ident, order, "complete", "scope"), order, ident, name="_at"))
    ahead = at.select((F.col("_at") - 1).alias("_at"), F.col(ident).alias("_next"), F.col("complete").alias("_next_complete"), F.col("scope").alias("_next_scope"))
    behind = at.select((F.col("_at") + 1).alias("_at"), F.col(ident).alias("previous"))
    both = F.coalesce(F.col("complete") & F.col("_next_complete") & (F.col("scope") == F.col("_next_scope")), F.lit(False))
    known = at.join(ahead, "_at", "left").join(behind, "_at", "left").select(ident, "_at", "previous", "_next", both.alias("_compares"))
    runs = Window.partitionBy(key).orderBy("_at")
    seen = rows.select(ident, key, "state", "scan_local").join(known, ident).withColumns({
        "_was": F.lag("_at").over(runs), "_state": F.lag("state").over(runs), "_is": F.lead("_at").over(runs),
    })
    here = (
        F.when(F.col("_was") == F.col("_at") - 1, F.when(F.col("state").eqNullSafe(F.col("_state")), "same").otherwise("changed"))
        .when(F.col("previous").isNull(), None).when(F.col("scan_local"), "not_comparable").when(F.col("_was").isNull(), "new").otherwise("returned")
    )
    gone = F.when(F.col("_next").isNotNull() & ~F.coalesce(F.col("_is") == F.col("_at") + 1, F.lit(False)), F.when(F.col("scan_local"), "not_comparable").when(F.col("_compares"), "resolved").otherwise("unknown"))
    events = F.array(F.struct(F.col(ident).alias("report"), F.col("previous"), here.alias("change")), F.struct(F.col("_next").alias("report"), F.col(ident).alias("previous"), gone.alias("change")))
    out = seen.select(F.explode(events).alias("e")).select("e.*").where("change is not null")
    return out.groupBy(F.col("report").alias(ident), "previous", "change").agg(F.count("*").alias("findings"))


def detection_metrics(cases: DataFrame) -> DataFrame:
    """One row for ``truth, predicted`` booleans: counts, recall, precision, specificity, F1, MCC and the recall's Wilson interval."""
    tp, fp, fn, tn = (F.count_if(t & p).cast("double") for t, p in ((F.col("truth"), F.col("predicted")), (~F.col("truth"), F.col("predicted")), (F.col("truth"), ~F.col("predicted")), (~F.col("truth"), ~F.col("predicted"))))
    c = cases.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    div = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    t, p, n, q = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    z, m = 1.959963984540054, t + n
    centre, half = (t + z * z / 2) / (m + z * z), z / (m + z * z) * F.sqrt(t * n / m + z * z / 4)
    return c.select(
        "tp", "fp", "fn", "tn", div(t, t + n).alias("recall"), div(t, t + p).alias("precision"), div(q, q + p).alias("specificity"), div(2 * t, 2 * t + p + n).alias("f1"),
        div(t * q - p * n, F.sqrt((t + p) * (t + n) * (q + p) * (q + n))).alias("mcc"), F.when(m > 0, F.round(centre - half, 6)).alias("recall_low"), F.when(m > 0, F.round(centre + half, 6)).alias("recall_high"),
    )


def paired_metrics(cases: DataFrame) -> DataFrame:
    """One row for ``truth, first, second`` booleans: how two detectors differ on the same cases (McNemar).

    ``only_first`` and ``only_second`` are cases that one alone gets right; ``statistic`` has the continuity
    correction; ``p_value`` is the exact two-sided binomial one, 1 where they never differ.
    """
    right = lambda c: F.col(c) == F.col("truth")
    c = cases.agg(F.count_if(right("first") & ~right("second")).alias("only_first"), F.count_if(~right("first") & right("second")).alias("only_second"), F.count_if(right("first") & right("second")).alias("both"))
    n, k = F.col("only_first") + F.col("only_second"), F.least("only_first", "only_second")
    at = F.sequence(F.lit(1), F.greatest(k, F.lit(1)))
    # the chance of exactly k of n, by logarithms, and of fewer relative to it
    log = F.aggregate(at, F.lit(0.0), lambda a, i: F.when(k > 0, a + F.log((n - k + i) / i)).otherwise(a)) - n * F.log(F.lit(2.0))
    down = F.aggregate(at, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, i: F.when(k > 0, F.struct((a["t"] * (k - i + 1) / (n - k + i)).alias("t"), (a["s"] + a["t"] * (k - i + 1) / (n - k + i)).alias("s"))).otherwise(a))["s"]
    gap = F.abs(F.col("only_first") - F.col("only_second"))
    statistic = F.when(n > 0, F.round(F.pow(F.greatest(gap - 1, F.lit(0)), F.lit(2)) / n, 6)).otherwise(0.0)
    return c.select("both", "only_first", "only_second", statistic.alias("statistic"), F.round(F.when(n > 0, F.least(F.lit(1.0), 2 * F.exp(log) * down)).otherwise(1.0), 6).alias("p_value"))


def gate(findings: DataFrame, complete: Column, threshold: int) -> DataFrame:
    """One row ``verdict``: 3 incomplete, 2 a score at or over the threshold, else 0."""
    return findings.agg(F.when(~F.bool_and(complete), 3).when(F.coalesce(F.max("score"), F.lit(0)) >= threshold, 2).otherwise(0).alias("verdict"))
