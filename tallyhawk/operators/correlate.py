"""Links between findings: exact identifiers, names, runtime, lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhawk.functions.scalars import usable_identity
from tallyhawk.operators.islands import join_spans
from tallyhawk.plans.session import cut


def key_pairs(rows: DataFrame, identifier: str, entity: str, group_limit: int = 25, differ: tuple[str, ...] = ("connector", "surface"), scope: str | None = None) -> DataFrame:
    """``key, src, dst``: pairs of entities (src < dst) that share an identifier and differ in one of ``differ``.

    Identifiers that more than ``group_limit`` entities share say nothing and are left out before pairs are
    made, which also bounds the pairs of a key. With ``scope``, known scopes must agree.
    """
    cols = [entity, *differ, *([scope] if scope else [])]
    own = rows.where(usable_identity(identifier)).select(F.col(identifier).alias("key"), *cols).distinct()
    fit = own.groupBy("key").agg(F.count_distinct(entity).alias("_n")).where((F.col("_n") > 1) & (F.col("_n") <= group_limit)).select("key")
    own = own.join(fit, "key", "left_semi")
    a, b = own.alias("a"), own.alias("b")
    test = (F.col(f"a.{entity}") < F.col(f"b.{entity}"))
    other = F.lit(False)
    for d in differ:
        other = other | ~F.col(f"a.{d}").eqNullSafe(F.col(f"b.{d}"))
    if differ:
        test = test & other
    if scope:
        test = test & F.coalesce(F.col(f"a.{scope}") == F.col(f"b.{scope}"), F.lit(True))
    return a.join(b, F.col("a.key") == F.col("b.key")).where(test).select(F.col("a.key").alias("key"), F.col(f"a.{entity}").alias("src"), F.col(f"b.{entity}").alias("dst")).distinct()


def correlate_candidates(names: DataFrame, exact: DataFrame, least: int = 8, group_limit: int = 25) -> DataFrame:
    """Pairs by normalised name (``name, finding_id, connector, surface``) that no exact identifier links."""
    from tallyhawk.functions.scalars import normalise_key

    keyed = names.withColumn("norm", normalise_key("name")).where(F.length("norm") >= least)
    return key_pairs(keyed, "norm", "finding_id", group_limit).join(exact.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def attribute_runtime(code: DataFrame, observed: DataFrame) -> DataFrame:
    """Each code finding with its gateway observations: ``status, events, first_seen, last_seen, environments``.

    ``code``: ``id, resource, frameworks``; ``observed``: ``code_resources, frameworks, environment, complete`` and
    the rollup columns. Observed needs a common resource and framework; without one the status is unobserved
    if all observations are complete, else unknown.
    """
    span = [F.sum("events").alias("events"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")]
    of = lambda c: F.array_sort(F.array_distinct(c))
    o = observed.select(F.explode("code_resources").alias("resource"), of("frameworks").alias("_f"), "environment", "events", "first_seen", "last_seen")
    o = o.groupBy("resource", "_f").agg(*span, F.collect_set("environment").alias("_e"))
    c = code.select("id", "resource", of("frameworks").alias("_own"))
    environments = F.array_sort(F.array_distinct(F.flatten(F.collect_list("_e")))).alias("environments")
    # findings of one resource and frameworks see the same: they meet the observations once
    j = c.select("resource", "_own").distinct().join(o, "resource", "left").where(F.col("_f").isNull() | (F.size("_f") == 0) | F.arrays_overlap("_own", "_f"))
    seen = j.groupBy(F.col("resource").alias("_r"), F.col("_own").alias("_o")).agg(*span, environments)
    each = c.join(seen, c["resource"].eqNullSafe(seen["_r"]) & c["_own"].eqNullSafe(seen["_o"])).withColumnRenamed("environments", "_e")
    found = each.groupBy("id").agg(*span, environments)
    complete = observed.agg(F.coalesce(F.bool_and("complete"), F.lit(False)).alias("_complete"))
    out = code.select("id").join(found, "id", "left").crossJoin(F.broadcast(complete))  # one row
    return out.withColumn("status", F.when(F.col("events") > 0, "observed").when(F.col("_complete"), "unobserved").otherwise("unknown")).drop("_complete")


def correlate_lifecycle(configs: DataFrame, processes: DataFrame, window_days: int = 30, group_limit: int = 50) -> DataFrame:
    """Endpoint configuration with running process of one device and subject; when, and of the same user?"""
    c = configs.select(F.col("id").alias("src"), F.lower("device").alias("device"), F.explode("subjects").alias("subject"), F.col("user").alias("_cu"), F.col("observed_at").alias("_ct"))
    p = processes.select(F.col("id").alias("dst"), F.lower("device").alias("device"), F.explode("subjects").alias("subject"), F.col("user").alias("_pu"), F.col("last_seen").alias("_pt"))
    fit = c.select("device", "subject", F.col("src").alias("e")).union(p.select("device", "subject", F.col("dst").alias("e"))).groupBy("device", "subject").agg(F.count("*").alias("_n")).where(F.col("_n") <= group_limit)
    days = F.datediff("_ct", "_pt")
    when = F.when(F.col("_ct").isNull() | F.col("_pt").isNull(), "unknown").when(days > window_days, "historical").when(days < 0, "future").otherwise("in-window")
    return c.join(p, ["device", "subject"]).join(fit, ["device", "subject"], "left_semi").select("src", "dst", "device", "subject", (F.col("_cu") == F.col("_pu")).alias("same_user"), when.alias("timing"))


def link_sessions(events: DataFrame, assumptions: DataFrame, key: str, event_id: str, ts: str, start: str, end: str, ident: str, hours: int = 12) -> DataFrame:
    """Each event with the one assumption that covers it: ``event_id, candidates, linked, status``.

    Covering means equal keys and ``start <= ts <= end <= start + hours``; a link needs exactly one candidate.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    a = assumptions.where(F.col(end) <= F.col(start) + F.expr(f"interval {hours} hours")).select(F.col(key).alias("_key"), micros(start).alias("_s"), micros(end).alias("_e"), F.col(ident).alias("_id"))
    e = events.select(F.col(event_id).alias("_event"), F.col(key).alias("_key"), micros(ts).alias("_t"))
    out = join_spans(e, a, ["_key"], "_t", "_s", "_e", closed=True).groupBy(F.col("_event").alias(event_id)).agg(F.count("_id").alias("candidates"), F.min("_id").alias("_one"))
    status = F.when(F.col("candidates") == 1, "linked").when(F.col("candidates") > 1, "ambiguous").otherwise("none")
    return out.select(event_id, "candidates", F.when(F.col("candidates") == 1, F.col("_one")).alias("linked"), status.alias("status"))


def lineage(links: DataFrame, hops: int | None = None, child: str = "child", parent: str = "parent") -> DataFrame:
    """``child, origin, hops, status``: where each child's chain of parents begins, and how many links away.

    Status ``root``: the origin is nobody's child. ``ambiguous``: the chain ends at one with several parents (its
    origin). ``cycle``: it never ends. ``depth``: it is longer than ``hops`` (if given), which says nothing about its
    end. Cycles and depths have no origin. Null ends are no links; repeated links are one.

    Pointer doubling: a round replaces each pointer by its pointer's pointer, so a chain of n links takes
    about log2(n) rounds. The lengths of chains have no gaps, so a round after which nothing more has
    ended leaves cycles only. The state is cut each round; the driver learns how many are open.
    """
    edges = links.select(F.col(child).alias("node"), F.col(parent).alias("to")).where("node is not null and to is not null").distinct()
    parents = edges.groupBy("node").agg(F.count("*").alias("_n"), F.min("to").alias("to"))
    own = cut(parents.select("node", F.when(F.col("_n") > 1, F.col("node")).otherwise(F.col("to")).alias("to"), F.when(F.col("_n") > 1, 0).otherwise(1).cast("long").alias("hops"), (F.col("_n") > 1).alias("several")))
    inner = own.select(F.col("node").alias("to"), F.col("several").alias("_several"))
    first = own.join(inner, "to", "left")
    # a pointer has arrived at what is nobody's child or has several parents
    ended = F.col("several") | F.col("_several").isNull() | F.col("_several")
    state = cut(first.select("node", "to", "hops", ended.alias("ended"), F.when(F.col("_several").isNull(), "root").otherwise("ambiguous").alias("end")))
    left = state.where("not ended").count()
    while left:
        ahead = state.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("hops").alias("_hops"), F.col("ended").alias("_ended"), F.col("end").alias("_end"))
        moved = state.where("not ended").join(ahead, "to").select("node", F.col("_to").alias("to"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_ended").alias("ended"), F.col("_end").alias("end"))
        state = cut(state.where("ended").unionByName(moved))
        before, left = left, state.where("not ended").count()
        if left == before:
            break
    status = F.when(~F.col("ended"), "cycle").otherwise(F.col("end"))
    if hops is not None:
        status = F.when(F.col("ended") & (F.col("hops") > hops), "depth").otherwise(status)
    known = status.isin("root", "ambiguous")
    return state.select(F.col("node").alias("child"), F.when(known, F.col("to")).alias("origin"), F.when(known, F.col("hops")).alias("hops"), status.alias("status"))


# Identifier kinds that are exact only where both sides name all of these scopes.
REQUIRED_SCOPE = {"client-id": ("tenant",), "role-name": ("account",), "service-account-name": ("cluster", "namespace")}


def scoped_links(identifiers: DataFrame, group_limit: int = 25, peers: int = 24) -> DataFrame:
    """``src, dst, assurance, matches``: findings (src < dst) that share identifiers, told apart by what their scopes prove.

    ``identifiers``: ``finding_id, connector, surface, kind, key, field``, a ``scope`` map (tenant, account, ...) and
    ``is_global`` (the key is unique everywhere). Two findings of one identifier must differ in connector or
    surface, and no scope that both name may differ. A match is exact if both keys are global, or if both name
    all scopes that the kind requires, or, for other kinds, one scope at least. Else it is a candidate for
    review; a pair with an exact match has no candidate. ``matches`` lists kind, fields of either side and the joint scope.

    Identifiers of more than ``group_limit`` findings say nothing and are left out before pairs are made. A
    finding keeps its first ``peers`` peers of either assurance, by kind, key and peer; a link must be kept at both ends.
    """
    own = identifiers.where(usable_identity("key")).groupBy("kind", "key", "finding_id").agg(
        F.min("connector").alias("connector"), F.min("surface").alias("surface"), F.array_sort(F.collect_set("field")).alias("fields"),
        F.min(F.struct(F.array_sort(F.map_entries(F.coalesce("scope", F.create_map().cast("map<string,string>")))).alias("e"), "is_global")).alias("_first"),
    ).select("kind", "key", "finding_id", "connector", "surface", "fields", F.map_from_entries("_first.e").alias("scope"), F.col("_first.is_global").alias("is_global"))
    fit = own.groupBy("kind", "key").agg(F.count("*").alias("_n")).where((F.col("_n") > 1) & (F.col("_n") <= group_limit)).select("kind", "key")
    own = own.join(fit, ["kind", "key"], "left_semi")
    a, b = own.alias("a"), own.alias("b")
    pair = a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.finding_id") < F.col("b.finding_id")))
    pair = pair.where(~F.col("a.connector").eqNullSafe(F.col("b.connector")) | ~F.col("a.surface").eqNullSafe(F.col("b.surface")))
    shared = F.array_intersect(F.map_keys("a.scope"), F.map_keys("b.scope"))
    agree = F.forall(shared, lambda k: F.col("a.scope")[k] == F.col("b.scope")[k])
    verified = F.size(shared) > 0
    for kind, names in REQUIRED_SCOPE.items():
        verified = F.when(F.col("a.kind") == kind, F.size(F.array_intersect(shared, F.array(*[F.lit(n) for n in names]))) == len(names)).otherwise(verified)
    exact = (F.col("a.is_global") & F.col("b.is_global")) | verified
    scope = F.array_sort(F.array_distinct(F.concat(F.map_entries("a.scope"), F.map_entries("b.scope"))))
    found = pair.where(agree).select(
        F.col("a.finding_id").alias("src"), F.col("b.finding_id").alias("dst"), F.when(exact, "exact").otherwise("candidate").alias("assurance"), F.col("a.key").alias("key"),
        F.struct(F.col("a.kind").alias("kind"), F.col("a.fields").alias("source_fields"), F.col("b.fields").alias("target_fields"), scope.alias("scope")).alias("match"),
    )
    links = found.groupBy("src", "dst", "assurance").agg(F.array_sort(F.collect_set("match")).alias("matches"), F.min(F.struct("match.kind", "key")).alias("_first"))
    for here, there in (("src", "dst"), ("dst", "src")):
        order = Window.partitionBy(here, "assurance").orderBy("_first", there)
        links = links.withColumn(f"_{here}", F.row_number().over(order))
    links = links.where((F.col("_src") <= peers) & (F.col("_dst") <= peers))
    best = links.where("assurance = 'exact'").select("src", "dst", F.lit(True).alias("_exact"))
    return links.join(best, ["src", "dst"], "left").where("assurance = 'exact' or _exact is null").select("src", "dst", "assurance", "matches")


def dedupe_events(events: DataFrame, key: str, content: str) -> DataFrame:
    """One row per id: ``copies`` and whether copies differ (``conflict``)."""
    return events.groupBy(key).agg(F.count("*").alias("copies"), (F.count_distinct(F.sha2(F.col(content).cast("string"), 256)) > 1).alias("conflict"))
