"""Benchmark leaks by a positional inverted index; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words after A-Z have been lowered: runs of digits, a-z and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: Test sets up to this many words are broadcast; larger ones are joined by a shuffle of the postings.
BROADCAST_WORDS = 2_000_000
#: A term that no text has; its posting at a document's end carries the document itself through the join.
END = "\x00"
#: In the shuffle join each term is split into so many keys, the end into so many.
SALTS, END_SALTS = 16, 4_096


def words_of(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def windows_of(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``window`` (array of words) and ``items`` (ids as text): each different window once."""
    one = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    one = one.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))))
    return one.select("item", F.slice("w", F.col("at") + 1, F.least(F.size("w"), F.lit(width))).alias("window")).groupBy("window").agg(F.collect_set("item").alias("items"))


def find_leaks(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", width: int = WINDOW, slop: int = 3, keep: tuple[str, ...] = (), broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """Per row of ``docs``: ``n_words, n_hit, n_items, items_sha256, contaminated`` and ``n_near``.

    The postings of the test vocabulary are counted first. Each window of ``width`` consecutive test words then
    is looked up by its rarest term: a posting of that term says where the window would start, the list of the
    second rarest term is intersected at its offset, and the words between are compared. ``n_near`` counts the
    items of which the two rarest terms of some window stand within ``slop`` words of their distance (exact
    matches included). Only matches and one row per document are shuffled. Null or empty texts have no words;
    very long texts are one row of the scan; repeated rows are each reported; items without words never match,
    and items with equal windows all count; an item with a null id marks hits but is not counted; an empty table
    gives an empty table. ``keep`` names further columns of ``docs`` to return; one that has the name of a result
    column or of ``doc_id`` is not given a second time; other columns are not read.
    """
    own = {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"}
    names = list(dict.fromkeys([id_col, *(c for c in keep if c not in own)]))
    cols = [f"_c{i}" for i in range(len(names))]  # whatever the columns of docs are called
    doc = docs.select(*[F.col(n).alias(c) for n, c in zip(names, cols, strict=True)], words_of(F.col(text_col)).alias("_w")).withColumn("_row", F.monotonically_increasing_id())
    windows = windows_of(items, item_col, item_text_col, width)
    size = items.select(F.sum(F.size(words_of(F.col(item_text_col)))).alias("n")).first()["n"] or 0
    small = size <= broadcast_words
    hint = F.broadcast if small else (lambda df: df)

    terms = windows.select("window", "items", F.posexplode("window").alias("_o", "term"))
    counts = docs.select(F.explode(words_of(F.col(text_col))).alias("term")).join(hint(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("_df"))
    # a window with a term that occurs nowhere has no exact match, and its rarest term no posting
    order = Window.partitionBy("window").orderBy("_df", "term", "_o")
    ranked = terms.join(hint(counts), "term", "left").withColumn("_df", F.coalesce("_df", F.lit(0))).withColumn("_k", F.row_number().over(order)).where("_k <= 2")
    pick = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c)))
    anchors = ranked.groupBy("window").agg(
        F.first("items").alias("items"), pick(1, "term").alias("term"), pick(1, "_o").alias("_o1"), pick(1, "_df").alias("_df"), pick(2, "term").alias("_t2"), pick(2, "_o").alias("_o2")
    ).where("_df > 0").drop("_df")
    end_salts = 1 if small else END_SALTS
    anchors = anchors.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(0 if small else SALTS - 1))))
    end = docs.sparkSession.range(end_salts).select(
        F.lit(None).cast("array<string>").alias("window"), F.lit(None).cast("array<string>").alias("items"), F.lit(END).alias("term"),
        F.lit(0).alias("_o1"), F.lit(None).cast("string").alias("_t2"), F.lit(None).cast("int").alias("_o2"),
        F.col("id").cast("int").alias("_s"),
    )
    anchors = anchors.unionByName(end)

    postings = doc.select("*", F.size("_w").alias("n_words"), F.posexplode(F.concat("_w", F.array(F.lit(END)))).alias("_p", "term"))
    postings = postings.withColumn("_from", F.lit(0))
    # no term is one key, however many documents have it, and nor is the end, which all have
    salts = F.when(F.col("term") == END, F.lit(end_salts)).otherwise(F.lit(1 if small else SALTS))
    postings = postings.withColumn("_s", F.pmod(F.xxhash64("_row", "_p"), salts).cast("int"))
    if not small:  # what travels is the neighbourhood of a posting, not its document
        first = F.greatest(F.col("_p") - (width + slop), F.lit(0))
        postings = postings.withColumn("_from", first).withColumn("_w", F.slice("_w", F.col("_from") + 1, 2 * (width + slop)))
    start = F.col("_p") - F.col("_o1")
    inside = start - F.col("_from")  # in the words at hand, from 0
    there = inside + F.col("_o2")
    low = F.greatest(there - slop, F.lit(0))
    near = (start >= 0) & (F.col("_t2").isNull() | F.array_contains(F.slice("_w", low + 1, there + slop - low + 1), F.col("_t2")))
    joined = postings.join(hint(anchors), ["term", "_s"]).where((F.col("term") == END) | near)
    length = F.size("window")
    exact = F.coalesce((start + length <= F.col("n_words")) & (F.slice("_w", inside + 1, length) == F.col("window")), F.lit(False))
    joined = joined.select("_row", *cols, "n_words", "items", exact.alias("_exact"), F.struct(start.alias("s"), length.alias("n")).alias("_hit"))
    found = joined.groupBy("_row", *cols, "n_words").agg(
        F.collect_set(F.when(F.col("_exact"), F.col("_hit"))).alias("_hits"),
        F.collect_set(F.when(F.col("_exact"), F.col("items"))).alias("_items"),
        F.collect_set("items").alias("_near"),
    )
    named = F.array_sort(F.array_distinct(F.flatten("_items")))
    places = F.array_distinct(F.flatten(F.transform("_hits", lambda h: F.sequence(h["s"], h["s"] + h["n"] - 1))))
    return found.select(
        *[F.col(c).alias("doc_id" if n == id_col else n) for n, c in zip(names, cols, strict=True)],
        F.col("n_words").cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_hit"),
        F.size(named).cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_hits") > 0).alias("contaminated"),
        F.size(F.array_distinct(F.flatten("_near"))).cast("long").alias("n_near"),
    )


#: DuckDB SQL of the query.
ORACLE = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT g.r, g.s, g.n, win.item FROM grams g JOIN win ON g.k = win.k AND g.n = win.n),
words_hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
named AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r),
whole AS (
  SELECT DISTINCT item, w[s:s + least(len(w), 10) - 1] AS k
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
df AS (SELECT t, count(*) AS n FROM (SELECT unnest(w) AS t FROM d) GROUP BY t),
ranked AS (
  SELECT k, o, t, n, row_number() OVER (PARTITION BY k ORDER BY n, t, o) AS rk
  FROM (SELECT q.k, q.o - 1 AS o, q.k[q.o] AS t, coalesce(df.n, 0) AS n
        FROM (SELECT k, unnest(range(1, len(k) + 1)) AS o FROM (SELECT DISTINCT k FROM whole)) q LEFT JOIN df ON df.t = q.k[q.o])),
anchors AS (
  SELECT x.k, x.t AS t1, x.o AS o1, y.t AS t2, y.o AS o2 FROM ranked x LEFT JOIN ranked y ON x.k = y.k AND y.rk = 2 WHERE x.rk = 1 AND x.n > 0),
posts AS (SELECT r, w, p - 1 AS p, w[p] AS t FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
near AS (
  SELECT DISTINCT posts.r, whole.item
  FROM posts JOIN anchors a ON posts.t = a.t1 JOIN whole ON whole.k = a.k
  WHERE posts.p - a.o1 >= 0
    AND (a.t2 IS NULL OR list_contains(posts.w[greatest(posts.p - a.o1 + a.o2 - 3, 0) + 1 : posts.p - a.o1 + a.o2 + 3 + 1], a.t2))),
nears AS (SELECT r, count(DISTINCT item) AS n_near FROM near GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
       sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated, coalesce(e.n_near, 0) AS n_near
FROM d LEFT JOIN nears e ON d.r = e.r LEFT JOIN words_hit h ON d.r = h.r LEFT JOIN named m ON d.r = m.r
"""
