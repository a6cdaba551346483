"""An index of literals for many patterns against many texts.

A pattern that can only match where a literal stands is kept under one short piece (gram) of it. A text meets
the patterns of the grams it holds in an equi-join, so its work follows its own length and its candidates, not
the number of patterns; each candidate is then tried. Patterns without a literal are kept under the
empty gram, which every text holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhawk.plans.session import stored

GRAM = 3
#: So many patterns are sent to every executor; more of them meet the texts in a shuffle.
BROADCAST_PATTERNS = 50_000
#: Bits of the filter of grams, at most, and for each gram.
FILTER_BITS, GRAM_BITS = 1 << 18, 32
#: So few different grams are each looked for in a text, which is faster than its pieces.
FEW_GRAMS = 24


def grams(text: Column, size: int = GRAM) -> Column:
    """The different pieces of ``size`` characters of a text in lower case, and the empty one."""
    return F.array_append(F.array_distinct(_pieces(text, size)), F.lit(""))


def _pieces(text: Column, size: int) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def glob_literal(glob: Column) -> Column:
    """The longest run of a glob that stands for itself, in lower case; of equally long ones the last."""
    runs = F.transform(F.split(F.lower(glob), r"\*+|\?|\[[^\]]*\]"), lambda r: F.struct(F.length(r).alias("n"), r.alias("r")))
    return F.array_max(runs)["r"]


def regex_literal(pattern: Column) -> Column:
    """A run of characters that every match of a regular expression holds, in lower case; empty if none is sure.

    Patterns with groups, sets, alternatives or counted repeats have none; a character that may be missing ends a run.
    """
    bare = F.regexp_replace(pattern, r"^\(\?i\)", "")
    runs = F.transform(F.split(F.lower(bare), r"\\.|.[?*]|[.^$+]"), lambda r: F.struct(F.length(r).alias("n"), r.alias("r")))
    return F.when(bare.rlike(r"[|(\[{]"), "").otherwise(F.array_max(runs)["r"])


def index_patterns(patterns: DataFrame, literal: Column, size: int = GRAM) -> DataFrame:
    """``patterns`` with ``_gram``: the piece of the literal that the fewest other literals have; empty if it is too short or null.

    The index is written once, as every table of texts reads it twice.
    """
    p = patterns.withColumn("_literal", F.lower(F.coalesce(literal, F.lit(""))))
    pieces = p.select("_literal").distinct().select("_literal", F.explode(F.filter(grams(F.col("_literal"), size), lambda g: g != "")).alias("g"))
    common = pieces.groupBy("g").agg(F.count("*").alias("_n"))
    best = pieces.join(common, "g").groupBy("_literal").agg(F.min_by("g", F.struct("_n", "g")).alias("_best"))
    return stored(p.join(best, "_literal", "left").withColumn("_gram", F.coalesce("_best", F.lit(""))).drop("_literal", "_best"))


def _place(gram: Column) -> Column:
    return F.xxhash64(gram).bitwiseAND(F.lit(FILTER_BITS - 1))


def known_grams(text: Column, indexed: DataFrame, size: int = GRAM) -> tuple[Column, int]:
    """Those grams of a text that patterns have, nearly: few by looking for each, many by a filter; and the number of patterns.

    The filter has hashed grams, ``FILTER_BITS`` at most, which the driver folds to the size that the patterns need.
    """
    place = _place(F.col("_gram"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = indexed.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(bit).alias("b"), F.count("*").alias("n")).collect()
    known, different = sum(w["n"] for w in words), sum((w["b"] & (1 << 64) - 1).bit_count() for w in words)
    all_ = [g[0] for g in indexed.select("_gram").distinct().limit(FEW_GRAMS + 1).collect()] if different <= FEW_GRAMS else None
    if all_ is not None and len(all_) <= FEW_GRAMS:
        low = F.lower(F.coalesce(text, F.lit("")))
        held = F.array_compact(F.array(*[F.lit("") if g == "" else F.when(low.contains(g), g) for g in sorted(all_)])).cast("array<string>")
    else:
        bits = FILTER_BITS
        while bits > 64 and bits >= 2 * GRAM_BITS * different:
            bits //= 2
        folded = [0] * (bits // 64)
        for w in words:
            folded[w["w"] % len(folded)] |= w["b"]
        table = F.split(F.lit(",".join(map(str, folded))), ",").cast("array<long>")  # a constant once planned

        def kept(g: Column) -> Column:
            at = F.xxhash64(g).bitwiseAND(F.lit(bits - 1))
            return F.getbit(F.get(table, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1

        held = F.array_distinct(F.filter(F.array_append(_pieces(text, size), F.lit("")), kept))
    return held, known


def candidates(rows: DataFrame, text: Column, indexed: DataFrame, size: int = GRAM) -> DataFrame:
    """Each row with each pattern whose gram its text holds: all columns of both but the gram. A pattern meets a row once.

    A text is copied only for grams that patterns have, and never broadcast.
    """
    held, known = known_grams(text, indexed, size)
    few = known <= BROADCAST_PATTERNS
    return rows.withColumn("_gram", F.explode(held)).join(F.broadcast(indexed) if few else indexed.hint("shuffle_merge"), "_gram").drop("_gram")


def by_prefix(rows: DataFrame, text: Column, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Each row with each of ``prefixes`` that its text begins with, by an equi-join at the lengths that prefixes have."""
    p = prefixes.where(F.col(prefix).isNotNull()).withColumn("_n", F.length(prefix))
    lengths = p.agg(F.collect_set("_n").alias("_lengths"))  # one row, of a number for each length
    own = rows.withColumn("_text", text).crossJoin(F.broadcast(lengths)).withColumn("_n", F.explode("_lengths"))
    own = own.where(F.length("_text") >= F.col("_n")).withColumn("_head", F.expr("left(_text, _n)")).drop("_lengths", "_text")
    return own.join(p, (own["_n"] == p["_n"]) & (own["_head"] == p[prefix])).drop("_n", "_head")
