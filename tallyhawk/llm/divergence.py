"""How far the sources of a language differ in their words: chunk factorisation, smoothed shares, triangular divergence."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhawk.plans.session import cut, stored

#: A-Z to a-z, in UTF-8 bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Runs of ASCII letters and of characters beyond ASCII, in UTF-8 bytes.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: A use of a chunk or term: language and group (language and source) by their 64-bit hashes, occurrences, documents of the
#: group; once a language has them, documents of the language that are sure (one chunk's) and possible (all chunks').
USE = np.dtype([("lang", "<i8"), ("group", "<i8"), ("n", "<i8"), ("docs", "<i8"), ("least", "<i8"), ("most", "<i8")])
#: Words of texts, and different chunks, that a task's counts hold before they are passed on.
HELD_WORDS, HELD_CHUNKS = 3_000_000, 1_000_000
#: Uses that are merged at once.
HELD_USES = 500_000
#: Chunks of a language that a task remembers to have looked up in the filter.
LOOKED_UP = 400_000
#: Bits of the filter of chunks whose documents must be told apart: 2 MB, whatever the input.
FILTER_BITS = 1 << 24
#: Groups (language and source) up to which their table is broadcast; beyond, it is shuffled.
BROADCAST_GROUPS = 50_000
#: Pairs of a term's sources that are computed at once.
PAIRS = 1_000_000
UNIT = 1_000_000_000


def _hash(text: str, seed: int = 42) -> int:
    """The engine's hash of a text column, signed; of a second column with the first one's as its seed."""
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), seed=seed & (2**64 - 1))
    return h - 2**64 if h >= 2**63 else h


def _payloads(uses: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value for each run of uses that ends before ``ends``."""
    offsets = np.concatenate(([0], ends)).astype(np.int64) * USE.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(uses.tobytes())]).cast(pa.binary())


def _summed(key: np.ndarray, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(key, uses)`` sorted, with the uses of equal key and group as one; ``least`` is their maximum."""
    order = np.lexsort((uses["group"], key))
    key, uses = key[order], uses[order]
    if not len(key):
        return key, uses
    starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (uses["group"][1:] != uses["group"][:-1]))))
    out = uses[starts].copy()
    for name in ("n", "docs", "most"):
        out[name] = np.add.reduceat(uses[name], starts)
    out["least"] = np.maximum.reduceat(uses["least"], starts)
    return key[starts], out


def count_chunks(docs: DataFrame) -> DataFrame:
    """``chunk, uses``: partial counts of the chunks between ASCII white space, packed by chunk.

    Every document's different chunks are counted; a task adds them up in bounded memory, so a common chunk leaves it
    as one row, however many documents and groups have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[bytes, int] = defaultdict(count().__next__)
        groups: dict[tuple, int] = {}
        parts: list[tuple[np.ndarray, np.ndarray, int]] = []  # chunks, occurrences and group of a document

        def settle() -> pa.RecordBatch:
            chunk = np.concatenate([p[0] for p in parts])
            uses = np.zeros(len(chunk), dtype=USE)
            uses["n"] = np.concatenate([p[1] for p in parts])
            uses["docs"] = 1
            uses["group"] = np.repeat([p[2] for p in parts], [len(p[0]) for p in parts])
            chunk, uses = _summed(chunk, uses)
            of = list(groups)
            ids = np.array([(_hash(lang), _hash(source, _hash(lang))) for lang, source in of], dtype=np.int64)
            uses["lang"], uses["group"] = ids[uses["group"], 0], ids[uses["group"], 1]
            ends = np.append(np.flatnonzero(np.diff(chunk)) + 1, len(chunk))
            names = pa.array(list(index), pa.binary()).take(pa.array(chunk[ends - 1])).cast(pa.string())
            return pa.RecordBatch.from_arrays([names, _payloads(uses, ends)], ["chunk", "uses"])

        held = 0
        for batch in batches:
            for text, lang, source in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.as_buffer().to_pybytes().split()
                if not words:
                    continue
                ids, n = np.unique(np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words)), return_counts=True)
                parts.append((ids, n, groups.setdefault((lang, source), len(groups))))
                held += len(words)
                if held > HELD_WORDS or len(index) > HELD_CHUNKS:
                    yield settle()
                    parts.clear()
                    index = defaultdict(count().__next__)
                    held = 0
        if parts:
            yield settle()

    return docs.select("text", "lang", "source").mapInArrow(run, "chunk string, uses binary")


def _merged(batches: Iterator[pa.RecordBatch], emit: Callable[[pa.Array, np.ndarray, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (name, uses), sorted by name, with the uses of a name as one: ``emit(names, uses, ends)``.

    A name whose rows go on is summed up as it comes, so what is held of it are its groups.
    """
    rest_name: pa.Array | None = None
    rest = np.zeros(0, dtype=USE)
    for batch in batches:
        names, packed = batch.column(0), batch.column(1)
        if not len(names):
            continue
        step = max(1, len(names) * HELD_USES * USE.itemsize // max(1, packed.nbytes))
        for a in range(0, len(names), step):
            name, payload = names.slice(a, step), packed.slice(a, step)
            offsets = np.frombuffer(payload.buffers()[1], dtype=np.int32)[payload.offset : payload.offset + len(payload) + 1]
            uses = np.frombuffer(payload.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(USE)
            new = np.ones(len(name), dtype=bool)
            new[1:] = pc.not_equal(name.slice(1), name.slice(0, len(name) - 1)).to_numpy(zero_copy_only=False)
            if rest_name is not None:
                new[0] = rest_name[0].as_py() != name[0].as_py()
            key = np.repeat(np.cumsum(new), np.diff(offsets) // USE.itemsize)
            key, uses = _summed(np.concatenate([np.zeros(len(rest), dtype=key.dtype), key]), np.concatenate([rest, uses]))
            last = int(np.searchsorted(key, key[-1]))
            if last:
                at = np.flatnonzero(new)
                whole = name.take(pa.array(at[:-1])) if len(at) > 1 else name.slice(0, 0)
                done = [rest_name, whole] if rest_name is not None else [whole]
                yield emit(pa.concat_arrays(done), uses[:last], np.append(np.flatnonzero(np.diff(key[:last])) + 1, last))
            if rest_name is None or new.any():
                rest_name = name.slice(int(np.flatnonzero(new)[-1]), 1)
            rest = uses[last:]
    if rest_name is not None:
        yield emit(rest_name, rest, np.array([len(rest)]))


def chunk_terms(counts: DataFrame, least_documents: int) -> DataFrame:
    """``chunk, term, uses, rare``: each different chunk of the corpus is split into terms once; its uses go to each.

    ``uses`` has the occurrences of each group and, once a language, its documents. A term that a chunk has twice is
    two rows. ``rare`` are languages in which the chunk is in too few documents to decide about its terms.
    """

    def emit(names: pa.Array, uses: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        # documents of a language: those of its groups, as documents are in one group
        key = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))
        order = np.lexsort((uses["lang"], key))
        uses, key = uses[order].copy(), key[order]
        starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (uses["lang"][1:] != uses["lang"][:-1]))))
        documents = np.add.reduceat(uses["docs"], starts)
        uses["least"][starts], uses["most"][starts] = documents, documents
        few = documents < least_documents
        rare_of, rare_lang = key[starts][few], uses["lang"][starts][few]
        bounds = np.searchsorted(rare_of, np.arange(len(ends) + 1))
        rare = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(rare_lang))
        found = [TERM.findall(name.as_buffer().to_pybytes().translate(LOWER)) for name in names]
        which = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        terms = pa.array([t for f in found for t in f], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([names.take(which), terms, _payloads(uses, ends).take(which), rare.take(which)], ["chunk", "term", "uses", "rare"])

    dealt = counts.repartition("chunk").sortWithinPartitions("chunk")
    return dealt.mapInArrow(lambda batches: _merged(batches, emit), "chunk string, term string, uses binary, rare array<long>")


def term_uses(chunks: DataFrame, least_documents: int) -> DataFrame:
    """``lang_id, term, least, most, groups, counts``: terms that may be in enough documents of a language.

    A term is in as many documents as any of its chunks at least, and as all of them together at most.
    """

    def emit(names: pa.Array, uses: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        key = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))
        order = np.lexsort((uses["lang"], key))
        uses, key = uses[order], key[order]
        starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (uses["lang"][1:] != uses["lang"][:-1]))))
        least, most = np.maximum.reduceat(uses["least"], starts), np.add.reduceat(uses["most"], starts)
        keep = most >= least_documents
        sizes = np.diff(np.append(starts, len(uses)))
        inside = np.repeat(keep, sizes)
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes[keep]))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(uses[c][inside])) for c in ("group", "n")]
        rows = [pa.array(uses["lang"][starts][keep]), names.take(pa.array(key[starts][keep])), pa.array(least[keep]), pa.array(most[keep])]
        return pa.RecordBatch.from_arrays([*rows, *lists], ["lang_id", "term", "least", "most", "groups", "counts"])

    dealt = chunks.select("term", "uses").repartition("term").sortWithinPartitions("term")
    return dealt.mapInArrow(lambda batches: _merged(batches, emit), "lang_id long, term string, least long, most long, groups array<long>, counts array<long>")


def _positions(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a 64-bit hash in the filter."""
    return hashes % np.uint64(FILTER_BITS), (hashes >> np.uint64(32)) % np.uint64(FILTER_BITS)


def _filter(keys: DataFrame) -> np.ndarray:
    """A bit filter of (language, chunk): as many rows as it has 64-bit words reach the driver at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.unique(np.concatenate(_positions(batch.column(0).to_numpy().view(np.uint64))))
            bits = np.left_shift(np.uint64(1), places & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((places >> np.uint64(6)).astype(np.int64)), pa.array(bits)], ["word", "bits"])

    rows = keys.select("h").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    words[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return words.view(np.uint64)


def count_documents(docs: DataFrame, chunks: DataFrame, open_terms: DataFrame, least_documents: int) -> DataFrame:
    """``lang_id, term`` of those ``open_terms`` that are in enough documents, whose different documents are counted.

    Only chunks of fewer documents matter here: others would have decided their terms. The documents are read
    again; what passes a filter of fixed size meets these chunks and their terms in a join.
    """
    rare = chunks.select("chunk", "term", F.explode("rare").alias("lang_id")).distinct()
    rare = cut(rare.join(open_terms, ["lang_id", "term"], "left_semi"))
    bits = _filter(rare.select("lang_id", "chunk").distinct().select(F.xxhash64("lang_id", "chunk").alias("h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        def looked_up(lang_id: int, chunks: list[bytes]) -> Iterator[bytes]:
            seed = xxhash.xxh64_intdigest(lang_id.to_bytes(8, "little", signed=True), seed=42)  # as the hash of two columns has it
            h = np.fromiter((xxhash.xxh64_intdigest(c, seed=seed) for c in chunks), dtype=np.uint64, count=len(chunks))
            hit = np.ones(len(h), dtype=bool)
            for place in _positions(h):
                hit &= (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
            return (chunks[i] for i in np.flatnonzero(hit).tolist())

        row = TaskContext.get().partitionId() << 40
        ids: dict[str, int] = {}
        known: dict[int, tuple[set[bytes], set[bytes]]] = defaultdict(lambda: (set(), set()))
        for batch in batches:
            rows, langs, found = [], [], []
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                row += 1
                different = set(text.as_buffer().to_pybytes().split())
                lang_id = ids[lang] if lang in ids else ids.setdefault(lang, _hash(lang))
                seen, hits = known[lang_id]
                new = different - seen
                if new:
                    if len(seen) > LOOKED_UP:
                        seen.clear()
                        hits.clear()
                        new = different
                    seen |= new
                    hits.update(looked_up(lang_id, list(new)))
                mine = different & hits
                rows += [row] * len(mine)
                langs += [lang_id] * len(mine)
                found += mine
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(langs, pa.int64()), pa.array(found, pa.binary()).cast(pa.string())], ["row", "lang_id", "chunk"])

    seen = docs.select("text", "lang").mapInArrow(run, "row long, lang_id long, chunk string").join(rare, ["lang_id", "chunk"])
    return seen.select("lang_id", "term", "row").distinct().groupBy("lang_id", "term").agg(F.count("*").alias("_n")).where(F.col("_n") >= least_documents).select("lang_id", "term")


def _share(n: str | Column, total: str, terms: str) -> Column:
    """1 and the whole part of a billion times the smoothed share, in exact decimals."""
    n = F.coalesce(F.col(n) if isinstance(n, str) else n, F.lit(0)).cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", (n + 2) * UNIT, (F.col(total) + 2 * F.col(terms)).cast("decimal(20,0)"))).cast("long")


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shared_terms(entries: DataFrame) -> DataFrame:
    """``lang, source, item, both`` (the lesser source first; to be summed): what terms in both of two sources add beyond terms that either has alone.

    ``entries`` has a row for each term: ``lang`` and ``uses`` of (source, p, p0) by source. A task multiplies the
    sources of its terms in numpy and passes on sums, so a common term makes no rows.
    """

    def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uses = batch.column(1)
            flat = uses.flatten()
            sizes = np.diff(uses.offsets.to_numpy())
            names = flat.field("source").dictionary_encode()
            name = names.indices.to_numpy().astype(np.int64)
            p, p0 = flat.field("p").to_numpy(), flat.field("p0").to_numpy()
            langs = batch.column(0).dictionary_encode()
            lang = np.repeat(langs.indices.to_numpy().astype(np.int64), sizes)
            place = np.arange(len(p))
            later = np.repeat(np.cumsum(sizes), sizes) - place - 1
            ends = np.cumsum(later)
            width = np.int64(max(1, len(names.dictionary)))
            a = 0
            while a < len(p):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS)))
                left = np.repeat(place[a:b], later[a:b])
                start = np.repeat(np.cumsum(later[a:b]) - later[a:b], later[a:b])
                right = left + 1 + np.arange(len(left)) - start
                value = gap(p[left], p[right]) - gap(p[left], p0[right]) - gap(p0[left], p[right]) + gap(p0[left], p0[right])
                keys, group = np.unique((lang[left] * width + name[left]) * width + name[right], return_inverse=True)
                sums = np.zeros(len(keys), dtype=np.int64)
                np.add.at(sums, group, value)
                pick = lambda d, i: d.take(pa.array(i))
                yield pa.RecordBatch.from_arrays(
                    [pick(langs.dictionary, keys // width // width), pick(names.dictionary, keys // width % width), pick(names.dictionary, keys % width), pa.array(sums)], ["lang", "source", "item", "both"]
                )
                a = b

    return entries.select("lang", "uses").mapInArrow(run, "lang string, source string, item string, both long")


def audit(docs: DataFrame, *, least_documents: int = 10, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank``: sources compared with each other, and the terms that set them apart.

    ``docs`` has text, lang and source. The chunks between white space are counted for each document and added
    up; each different chunk of the corpus is split into terms once, and its counts go to its terms. Where a chunk
    by itself is in enough documents, or all chunks of a term together are in too few, that decides a term; the
    documents of the others are told apart and counted. All numbers are whole.

    Two sources differ by the sum over all kept terms. Terms that neither has add the same each, terms that one
    has depend on its count only, so a histogram of counts does for them; only terms that both have are looked at
    in pairs, in arrays. The result has a row for each two sources of a language.

    Null texts, languages and sources are read as empty; an empty or null text adds its group only; very long
    texts are counted whole; repeated rows count as documents of their own; ids and other columns are not read;
    ties go by the item's bytes; an empty table gives an empty table.
    """
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    named = docs.select("lang", "source").distinct().select("lang", "source", F.xxhash64("lang").alias("lang_id"), F.xxhash64("lang", "source").alias("group_id"))
    named = cut(named)
    apart = named.agg(F.count("*") == F.count_distinct("group_id"), F.count_distinct("lang") == F.count_distinct("lang_id")).first()
    if not all(apart):
        raise RuntimeError("two sources or languages share a 64-bit hash")
    chunks = stored(chunk_terms(count_chunks(docs), least_documents))
    terms = cut(term_uses(chunks, least_documents))
    undecided = terms.where(F.col("least") < least_documents)
    kept = terms.where(F.col("least") >= least_documents)
    if not undecided.isEmpty():
        counted = count_documents(docs, chunks, undecided.select("lang_id", "term"), least_documents)
        kept = kept.unionByName(undecided.join(counted, ["lang_id", "term"], "left_semi"))
    kept = cut(kept.select("lang_id", "term", "groups", "counts", F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n).alias("in_lang")))
    whole = kept.groupBy("lang_id").agg(F.count("*").alias("v"), F.sum("in_lang").alias("lang_n"))
    uses = kept.select("lang_id", "term", "in_lang", F.explode(F.arrays_zip(F.col("groups").alias("g"), F.col("counts").alias("n"))).alias("u")).select("lang_id", "term", "in_lang", F.col("u.g").alias("group_id"), F.col("u.n").alias("count"))
    own = uses.groupBy("group_id").agg(F.sum("count").alias("n"))
    groups = named.join(own, "group_id", "left").join(whole, "lang_id", "left").select("lang", "source", "group_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v", "lang_n")])
    groups = cut(groups.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0), "n", "v"))))
    few = F.broadcast if groups.count() <= BROADCAST_GROUPS else (lambda df: df)
    entries = cut(uses.join(few(groups), "group_id").select("lang", "source", "term", _share("count", "n", "v").alias("p"), _share("in_lang", "lang_n", "v").alias("q"), "p0"))

    marks = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    marks = marks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    one, two = F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item")
    base = groups.join(few(other), "lang").where("source < item").select("lang", "source", "item", F.coalesce(F.col("v") * _gap(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    steps = entries.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))
    alone = steps.join(few(other), "lang").where("source <> item").select("lang", one, two, (F.col("n") * (_gap(F.col("p"), F.col("q0")) - _gap(F.col("p0"), F.col("q0")))).alias("value"))
    uses = entries.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "p0"))).alias("uses"))
    both = shared_terms(uses).withColumnRenamed("both", "value")
    pairs = base.unionByName(alone).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", ways.alias("w"), "value").select("lang", "w.source", "w.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.unionByName(marks)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, CAST(1 + (1000000000 * (coalesce(c.c, 0) + 2)::HUGEINT) // (coalesce(n.n, 0) + 2 * v.v) AS BIGINT) AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, CAST(1 + (1000000000 * (sum(c) + 2)::HUGEINT) // (any_value(n) + 2 * any_value(v)) AS BIGINT) AS q
      FROM c JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
      WHERE x.term IS NULL OR y.term IS NOT NULL GROUP BY ALL
      UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 10"""
