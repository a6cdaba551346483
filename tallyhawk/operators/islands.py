"""Unions of spans and joins with spans, for keys that hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhawk.plans.session import cut

#: Bits by which the bucket widths of span covers grow: widths are powers of 4.
STEP = 2
#: Levels that a 64-bit length can have; a row meets as many of them at most as spans have.
LEVELS = 64 // STEP


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    test = F.lit(True)
    for k in keys:
        test = test & a[k].eqNullSafe(b[f"_r_{k}"])
    return test


def union_spans(spans: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", gap: int = 0) -> DataFrame:
    """``keys, start, end, spans``: overlapping and touching spans of a key as one, those at most ``gap`` apart too.

    Spans with a null end or a negative length are dropped; null keys are keys. A segmented scan: rows are dealt by
    ranges of key and start, so a hot key is many segments. Each segment unites its own spans. What crosses the
    edges follows from one row for each key and segment: how far earlier segments reach, and the island that they
    leave open. Islands of a segment that begin within that reach belong to it.
    """
    rows = spans.where(F.col(start).isNotNull() & (F.col(end) >= F.col(start))).select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"))
    rows = rows.repartitionByRange(*keys, "_s", "_e").withColumn("_part", F.spark_partition_id())
    order = Window.partitionBy(*keys, "_part").orderBy("_s", "_e")
    reach = F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(F.col("_s") - gap <= reach, 0).otherwise(1))
    rows = rows.withColumn("_n", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # written down, as the ranges are drawn from a sample: both readers below must see the same segments
    own = cut(rows.groupBy(*keys, "_part", "_n").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.count("*").alias("_count")))

    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    edges = own.groupBy(*keys, "_part").agg(F.max("_e").alias("_far"), F.max_by("_s", "_n").alias("_last"), F.max("_n").alias("_open"))
    edges = edges.withColumn("_before", F.max("_far").over(earlier))
    # the last island of a segment is the open one, unless earlier segments swallow it and all before it
    fresh = F.col("_before").isNull() | (F.col("_last") - gap > F.col("_before"))
    edges = edges.withColumn("_carried", F.last(F.when(fresh, F.struct("_part", F.col("_open").alias("_n"))), ignorenulls=True).over(earlier))
    edges = edges.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_part").alias("_at"), "_before", "_carried")
    joined = own.join(edges, _same(own, edges, keys) & (F.col("_part") == F.col("_at")))
    island = F.when(F.col("_before").isNull() | (F.col("_s") - gap > F.col("_before")), F.struct("_part", "_n")).otherwise(F.col("_carried"))
    return joined.groupBy(*keys, island.alias("_island")).agg(F.min("_s").alias(start), F.max("_e").alias(end), F.sum("_count").alias("spans")).drop("_island")


def _level(length: Column) -> Column:
    """The least level whose buckets (of 4 to the power of it) are as long as a span."""
    bits = F.length(F.bin(F.greatest(length - 1, F.lit(0))))  # of a length of 1 and less: one bit
    return F.when(length <= 1, 0).otherwise(F.ceil(bits / STEP)).cast("int")


def _bucket(t: Column, level: Column) -> Column:
    return F.call_function("shiftright", t.cast("long"), level * STEP)


def join_spans(rows: DataFrame, spans: DataFrame, keys: Sequence[str], ts: str, start: str = "start", end: str = "end", closed: bool = False) -> DataFrame:
    """Each row with each span of its keys that holds its time (``start <= ts < end``, with ``closed`` up to ``end``), or none: a left join.

    ``spans`` has ``keys``, whole-number bounds in the unit of ``ts``, and other columns. A span is dealt to the
    buckets of a width that fits its own length, of which it touches two at most, so neither the unit nor a
    span's length decides how many rows it makes. A row looks up its bucket at each width that spans have, 32 at
    most. Bucket and width are part of the equi key: a busy key is many. Spans with null bounds hold nothing.
    """
    good = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull() & ((F.col(end) >= F.col(start)) if closed else (F.col(end) > F.col(start))))
    last = F.col(end) if closed else F.col(end) - 1
    s = good.withColumnsRenamed({k: f"_r_{k}" for k in keys}).withColumn("_level", _level(F.col(end) - F.col(start) + (1 if closed else 0)))
    s = s.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col(start), F.col("_level")), _bucket(last, F.col("_level")))))
    levels = s.agg(F.collect_set("_level").alias("_levels"))  # one row, of 32 numbers at most
    probes = rows.crossJoin(F.broadcast(levels)).withColumn("_at_level", F.explode_outer("_levels")).drop("_levels")
    probes = probes.withColumn("_at", _bucket(F.col(ts), F.col("_at_level")))
    on = (F.col("_at_level") == F.col("_level")) & (F.col("_at") == F.col("_bucket"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    holds = (F.col(ts) >= F.col(start)) & ((F.col(ts) <= F.col(end)) if closed else (F.col(ts) < F.col(end)))
    return probes.join(s, on & holds, "left").drop(*[f"_r_{k}" for k in keys], "_level", "_bucket", "_at", "_at_level")
