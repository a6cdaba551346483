"""Near-duplicates by BagMinHash signatures of word-shingle multisets, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhawk.llm.common import WordHashes, folded_words, mix64, slices
from tallyhawk.operators.graph import connected_components
from tallyhawk.plans.session import cut

WORDS = 5
SIMILARITY = 0.8
#: Signature of 320 values in 40 bands of 8: a pair of similarity 0.8 shares a band with probability 0.9994.
BANDS, ROWS = 40, 8
SIZE = BANDS * ROWS
#: Documents compared with one centre in one group, and shingles of one block of a bucket, at most (a larger
#: document is a block of its own, give or take what the hash puts beside it).
CENTRE_GROUP, BLOCK = 256, 400_000
#: Characters of texts that are shingled and signed at once; a longer text stands alone.
AT_ONCE = 1_000_000
_U = np.uint64


def shingles(text: str | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of five folded words (all words, if there are fewer) and their counts."""
    words = hashes.of(folded_words(text))
    if not len(words):
        return words, np.zeros(0, np.int64)
    n = max(1, len(words) - WORDS + 1)
    h = np.full(n, len(words) if n == 1 else WORDS, dtype=np.uint64)
    for k in range(min(WORDS, len(words))):
        h = mix64(h * _U(0x9E3779B97F4A7C15) + words[k : k + n])
    return np.unique(h, return_counts=True)


def bag_min_hash(elements: list[tuple[np.ndarray, np.ndarray]], size: int = SIZE, points_at_once: int = 400_000) -> np.ndarray:
    """Signatures (times, one row per bag) whose share of equal values estimates the weighted Jaccard index.

    The weight axis is cut into dyadic blocks [0,1), [1,2), [2,4), [4,8) ... Every (element, block) is a Poisson
    process of its own, of a rate that is the block's length; a point falls on a random signature value and a
    random place of its block, and counts if the place is below the element's weight. A value is the time of
    its first point. All bags draw from the same processes, block by block in ascending time, and a process
    stops once its time exceeds the bag's largest value.
    """
    out = np.full((len(elements), size), np.inf)
    flat = out.reshape(-1)
    counts = [len(e) for e, _ in elements]
    bag = np.repeat(np.arange(len(elements)), counts)
    element = np.concatenate([e for e, _ in elements]) if elements else np.zeros(0, np.uint64)
    weight = np.concatenate([w for _, w in elements]) if elements else np.zeros(0, np.int64)
    parts, start, length = [], 0, 1
    while (over := weight > start).any():
        parts.append((bag[over], mix64(element[over] + _U(start)), np.full(over.sum(), start), np.full(over.sum(), length), weight[over]))
        start, length = start + length, max(1, start + length)
    if not parts:
        return out
    bag, seed, start, length, weight = (np.concatenate(c) for c in zip(*parts, strict=True))
    time, drawn = np.zeros(len(bag)), 0
    while len(bag):
        k = int(np.clip(points_at_once // len(bag), 1, 256))
        h = mix64(seed[:, None] + np.arange(drawn + 1, drawn + k + 1, dtype=np.uint64)[None] * _U(0xD1342543DE82EF95))
        # added one after the other, so that times have the same bits however many are drawn at once
        times = np.cumsum(np.append(time[:, None], -np.log1p(-(h >> _U(24)).astype(float) * 2.0**-40) / length[:, None], axis=1), axis=1)[:, 1:]
        at = bag[:, None] * size + ((h & _U(0xFFFFFF)) % _U(size)).astype(np.int64)
        if (length > 1).any():
            place = start[:, None] + (mix64(h) >> _U(11)).astype(float) * 2.0**-53 * length[:, None]
            ok = place < weight[:, None]
            np.minimum.at(flat, at[ok], times[ok])
        else:
            np.minimum.at(flat, at.reshape(-1), times.reshape(-1))
        time, drawn = times[:, -1], drawn + k
        most = np.zeros(len(out))
        alive = np.unique(bag)
        most[alive] = out[alive].max(axis=1)
        keep = time < most[bag]
        bag, seed, start, length, weight, time = (c[keep] for c in (bag, seed, start, length, weight, time))
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(signature), BANDS)).copy()
    for r in range(ROWS):
        key = mix64(key * _U(0x9E3779B97F4A7C15) + bits[:, :, r])
    return key.view(np.int64)


def bag_key(e: np.ndarray, w: np.ndarray) -> tuple[int, int]:
    """128 bits that tell bags apart, as two signed numbers."""
    n = w.astype(np.uint64)
    both = np.array([(e * n).sum(), (mix64(e) * mix64(n)).sum()], dtype=np.uint64).view(np.int64)
    return int(both[0]), int(both[1])


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, set_a, set_b, size, bands`` for each document with words and an id; equal bags have equal keys."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(pc.fill_null(pc.utf8_length(texts), 0).to_pylist(), AT_ONCE):
                bags = [shingles(t, hashes) for t in texts.slice(a, b - a).to_pylist()]
                rows = [i for i, (e, _) in enumerate(bags) if len(e)]
                bags = [bags[i] for i in rows]
                bands = band_keys(bag_min_hash(bags))
                key = np.array([bag_key(*x) for x in bags], dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.array(rows, dtype=np.int64) + a)), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array([int(w.sum()) for _, w in bags], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1)))],
                    ["id", "set_a", "set_b", "size", "bands"],
                )

    return docs.where(F.col(id_col).isNotNull()).select(id_col, text_col).mapInArrow(run, f"id {kind}, set_a long, set_b long, size long, bands array<long>")


def star_edges(reps: DataFrame) -> DataFrame:
    """``a, b``: each node with the least one of its band buckets; rows, not pairs.

    Each batch of nodes first makes its own stars and passes only their centres on; a bucket that holds a
    third of all nodes so reaches the shuffle as one row per batch.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("node").to_numpy()
            keys = batch.column("bands").flatten().to_numpy().reshape(len(ids), -1)
            order = np.argsort(ids, kind="stable")
            ids, keys = ids[order], keys[order].reshape(-1)
            _, first, group = np.unique(keys, return_index=True, return_inverse=True)
            node = np.arange(len(keys)) // BANDS
            centre = ids[node[first]]  # nodes ascend, so the first place of a key has its least one
            edge = np.unique(np.stack([centre[group], ids[node]], 1)[centre[group] != ids[node]], axis=0)
            names = ["key", "a", "b"]
            yield pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(centre), pa.nulls(len(first), pa.int64())], names)
            spread = mix64(mix64(edge[:, 0].astype(np.uint64)) + edge[:, 1].astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(edge[:, 0]), pa.array(edge[:, 1])], names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with an end are edges already and go through; the others are a bucket's centres, in order."""
        key, centre = None, -1
        for whole in batches:
            edge = whole.column("b").is_valid()
            yield whole.filter(edge).select(["a", "b"])
            batch = whole.filter(pc.invert(edge))
            keys, ids = batch.column("key").to_numpy(), batch.column("a").to_numpy()
            if not len(keys):
                continue
            new = np.append(True, keys[1:] != keys[:-1])
            if keys[0] == key:
                new[0] = False
            held = np.append(centre, ids)
            own = held[np.maximum.accumulate(np.where(new, np.arange(len(keys)) + 1, 0))]
            key, centre = keys[-1], own[-1]
            far = own != ids
            yield pa.RecordBatch.from_arrays([pa.array(own[far]), pa.array(ids[far])], ["a", "b"])

    made = reps.select("node", "bands").mapInArrow(local, "key long, a long, b long")
    return made.repartition("key").sortWithinPartitions("key", "a").mapInArrow(stream, "a long, b long").distinct()


def _packed(e: np.ndarray, w: np.ndarray) -> bytes:
    """The bag as 40-bit hashes of (shingle, how often so far), sorted."""
    if len(w) and w.max() > 1:
        nth = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        e = mix64(np.repeat(e, w) + nth.astype(np.uint64))
    else:
        e = mix64(e)
    return np.sort(e >> _U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    raw = np.zeros((len(blob) // 5, 8), dtype=np.uint8)
    raw[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return raw.reshape(-1).view("<u8")


def bags_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node, bag``: the packed bags of the wanted representatives (``node, id, set_a, set_b``)."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted.select("id").distinct(), "id", "left_semi")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(pc.fill_null(pc.utf8_length(texts), 0).to_pylist(), AT_ONCE):
                found = [shingles(t, hashes) for t in texts.slice(a, b - a).to_pylist()]
                key = np.array([bag_key(*x) for x in found], dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array([_packed(*x) for x in found], pa.binary())], ["set_a", "set_b", "bag"])

    made = texts.select("text").mapInArrow(bags, "set_a long, set_b long, bag binary")
    # an id may have several texts, and a text several rows
    return made.join(wanted.select("set_a", "set_b", "node"), ["set_a", "set_b"]).groupBy("node").agg(F.first("bag").alias("bag"))


def alike(both: np.ndarray, one: int, other: np.ndarray, similarity: float) -> np.ndarray:
    return both >= similarity * (one + other - both) - 1e-9


def verified(edges: DataFrame, bag: DataFrame, similarity: float) -> DataFrame:
    """The edges whose bags have a weighted Jaccard index of ``similarity`` or more.

    The bags of the nodes concerned travel once per edge to their centre, whose own bag is read first and
    held; a centre with many edges is split over several groups.
    """
    groups = edges.groupBy("a").agg(F.ceil(F.count("*") / CENTRE_GROUP).cast("int").alias("n"))
    wanted = edges.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("g"), "b", F.lit(1).alias("role"))
    centres = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("g"), F.col("a").alias("b"), F.lit(0).alias("role"))
    rows = wanted.union(centres).join(bag.withColumnRenamed("node", "b"), "b").repartition("a", "g").sortWithinPartitions("a", "g", "role", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, np.zeros(0, np.uint64)
        for batch in batches:
            kept = []
            for i, (a, g, role, blob) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "g", "role", "bag")), strict=True)):
                if role == 0:
                    at, centre = (a, g), _unpacked(blob)
                elif at == (a, g):
                    own = _unpacked(blob)
                    if alike(len(np.intersect1d(centre, own, assume_unique=True)), len(centre), len(own), similarity):
                        kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return rows.select("a", "g", "role", "b", "bag").mapInArrow(compare, "a long, b long")


def joined_so_far(links: DataFrame) -> DataFrame:
    """``node, label``: what two leaps along the least links lead to. Equal labels mean one class, not the reverse."""
    up = cut(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")))
    for _ in range(2):
        next_ = up.select(F.col("node").alias("label"), F.col("label").alias("far"))
        up = up.join(next_, "label", "left").select("node", F.coalesce("far", "label").alias("label"))
    return up


def crossing_links(reps: DataFrame, links: DataFrame, bag: DataFrame, similarity: float) -> DataFrame:
    """Links between nodes of one bucket that star links have not joined: enough of them to join what is linked.

    Only buckets that still hold several labels count, and of buckets with the same nodes only one. A bucket's
    most common label is its main part; its rows are needed only against the others. Both are cut into blocks
    of BLOCK shingles; a pair of blocks is compared in one group, every pair in it exactly but for those that
    are joined by then, and gives no more links than it has nodes.
    """
    labels = cut(joined_so_far(links))
    placed = reps.join(labels, "node", "left").select("node", "size", F.coalesce("label", "node").alias("label"), F.explode("bands").alias("key"))
    parts = placed.groupBy("key", "label").agg(
        F.sum("size").alias("w"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1L))").alias("y")
    )
    buckets = parts.groupBy("key").agg(
        F.count("*").alias("labels"), F.max_by("label", F.struct("w", "label")).alias("main"), F.sum("w").alias("w"), F.max("w").alias("w_main"),
        F.expr("bit_xor(x)").alias("x"), F.expr("bit_xor(y)").alias("y"),
    ).where("labels > 1")
    blocks = lambda w: F.ceil(w / BLOCK).cast("int")
    buckets = buckets.groupBy("x", "y", "w").agg(F.min(F.struct("key", "main", "w_main")).alias("b")).select(
        "b.key", "b.main", blocks(F.col("w") - F.col("b.w_main")).alias("s"), blocks(F.col("b.w_main")).alias("s_main")
    )
    rows = placed.join(cut(buckets), "key")
    is_main = F.col("label") == F.col("main")
    own = F.when(is_main, F.col("s") + F.pmod(F.xxhash64("node"), F.col("s_main"))).otherwise(F.pmod(F.xxhash64("node"), F.col("s"))).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_main, F.col("s")).otherwise(F.col("s") + F.col("s_main")) - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(is_main, 1).otherwise(0).alias("role"), "own", "node", "label")
    rows = rows.join(bag, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def close(group: list[tuple]) -> list[tuple[int, int]]:
        bags = [_unpacked(g[-1]) for g in group]
        size = np.array([len(x) for x in bags])
        start = np.cumsum(size) - size
        _, at = np.unique(np.concatenate(bags), return_inverse=True)
        mark = np.zeros(int(at.max()) + 1, dtype=np.int64)
        own, label = np.array([g[2] for g in group]), np.array([g[4] for g in group])
        out = []
        for k, ((_, i, j), role, mine, node, *_) in enumerate(group):
            apart = label != label[k]
            if i != j:
                apart &= own != mine  # pairs inside a block have a group of their own
            if role or not apart.any():
                continue
            mark[at[start[k] : start[k] + size[k]]] = 1
            found = np.flatnonzero(apart & alike(np.add.reduceat(mark[at], start), int(size[k]), size, similarity))
            mark[at[start[k] : start[k] + size[k]]] = 0
            for x in found:
                if label[x] != label[k]:
                    out.append((node, group[x][3]))
                    label[label == label[x]] = label[k]
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

        group: list[tuple] = []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for key, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "role", "own", "node", "label", "bag")), strict=True):
                if group and group[0][0] != (key, i, j):
                    out += close(group)
                    group = []
                group.append(((key, i, j), *row))
            yield told(out)
        if group:
            yield told(close(group))

    return rows.select("key", "i", "j", "role", "own", "node", "label", "bag").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id, kept`` for every row of ``docs``; ``class_id`` is the least id of the class.

    A class is a connected group of documents, a link being a weighted Jaccard index of 0.8 or more of the
    bags of five-word shingles (folded words; a text of one to four words is one shingle). Equal bags are one
    node from the start.

    Candidates share a band of their BagMinHash signatures. First each node is compared with the centre of each
    of its buckets, so that a group of near-copies costs rows, not pairs; then, in buckets whose nodes that has
    not joined, all others exactly with each other and with the bucket's main part. No pair of a bucket is left
    out but those that are in one class already.

    Ids may be of any type that can be ordered. Documents without words (null, empty) are classes by
    themselves; a null id has class null and is kept; rows that share an id are one document, linked to
    whatever one of its texts is linked to, and a row is kept only under the class's least id. A very long
    text is one row like the others: it is signed alone and compared in a block of its own. Columns other than
    the two named are not read, whatever their names. An empty table gives an empty table.
    """
    sigs = cut(signatures(docs, id_col, text_col))
    reps = sigs.groupBy("set_a", "set_b").agg(F.min("id").alias("id"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    reps = cut(reps.withColumn("node", F.monotonically_increasing_id()))
    stars = cut(star_edges(reps))
    ends = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    # all later candidates share a bucket, so they are among these
    bag = cut(bags_of(docs, cut(reps.select("node", "id", "set_a", "set_b").join(ends, "node")), id_col, text_col))
    links = cut(verified(stars, bag, similarity))
    more = cut(crossing_links(reps, links, bag, similarity))
    nodes = cut(sigs.select("id", "set_a", "set_b").join(reps.select("set_a", "set_b", "node"), ["set_a", "set_b"]).select("id", "node"))
    shared = nodes.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("id", "a").join(nodes, "id").select("a", F.col("node").alias("b"))
    labels = connected_components(links.union(more).union(shared), "a", "b")
    placed = nodes.join(labels, "node", "left").select("id", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("id").alias("class_id"))
    classes = placed.join(least, "component").select(F.col("id").alias("doc_id"), "class_id").distinct()
    out = docs.select(F.col(id_col).alias("doc_id")).join(classes, "doc_id", "left")
    class_id = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))
