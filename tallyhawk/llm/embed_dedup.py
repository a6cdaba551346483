"""Near-duplicate vectors by lattice hashing: random projections decoded to points of the E8 lattice."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhawk.llm.common import mix64
from tallyhawk.operators.graph import connected_components
from tallyhawk.plans.session import cut

COSINE = 0.98
#: Tables of one projection to 8 dimensions each; cells looked into per table, the own one included; how far apart,
#: in lattice coordinates (packing radius 0.71), two vectors at the threshold are to be.
TABLES, PROBES, REACH = 4, 4, 0.6
#: Rows of one block; a cell with more rows is compared block by block, so many rows of a block at once.
BLOCK, TILE = 4_096, 512


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled to be integers."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            whole.append(v)
    half = [v for v in product((1, -1), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(whole + half, dtype=np.int64)


NEIGHBOURS = _shortest()


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest lattice point of each row, doubled: E8 is D8 and D8 moved by one half in every coordinate."""

    def d8(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        odd = np.flatnonzero(near.sum(1) % 2 != 0)
        worst = np.abs(y[odd] - near[odd]).argmax(1)
        gap = y[odd, worst] - near[odd, worst]
        near[odd, worst] += np.where(gap >= 0, 1, -1)
        return near

    a, b = d8(x), d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.rint(2 * np.where(closer[:, None], a, b)).astype(np.int64)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = REACH / np.sqrt(2 - 2 * COSINE), seed: int = 11) -> np.ndarray:
    """Hashes of the ``probes`` nearest cells of each unit vector in each table, own cell first."""
    n, dim = unit.shape
    out = np.empty((n, tables, probes), dtype=np.uint64)
    for t in range(tables):
        rng = np.random.default_rng([seed, t, dim])
        axes = np.linalg.qr(rng.normal(size=(dim, 8)))[0] if dim >= 8 else rng.normal(size=(dim, 8)) / np.sqrt(8)
        x = unit @ axes * scale * np.sqrt(dim / 8) + rng.random(8)
        own = decode_e8(x)
        gap = x - own / 2
        # distance to own + v is |gap|^2 - gap.v2 + |v|^2, and all v are equally long
        near = np.argsort(-(gap @ NEIGHBOURS.T), axis=1, kind="stable")[:, : probes - 1]
        points = np.concatenate([own[:, None], own[:, None] + NEIGHBOURS[near]], axis=1)
        h = np.full((n, probes), t + 1, dtype=np.uint64)
        for k in range(8):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + points[:, :, k].astype(np.uint64))
        out[:, t] = h
    return out.reshape(n, -1)


def _unit(blobs: list[bytes], kind: str) -> np.ndarray:
    """Vectors of length 1 in double precision; scaled first, so that no square over- or underflows."""
    x = np.stack([np.frombuffer(b, kind) for b in blobs]).astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def link_counts(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Two rows are linked if their labels are equal and not null and the cosine is ``cosine`` or more in double
    precision, provided they share a cell (own or probed) in one of the tables; that is checked pair by pair
    inside a cell, and a pair is counted in the first cell it shares. Equal vectors are one node of some
    weight. A cell gives a row per vector (how many links, least linked row), never its pairs; a cell with many rows
    is compared block by block in as many tasks. Components of any finite magnitude are compared (vectors are scaled before they are squared). Null, zero, empty and non-finite vectors, or those with null
    components, link with nothing; vectors of different length neither; a null id is counted by the others but
    reports no links and belongs to no component (its own is null, and it is kept); rows with one id are one vector each for the
    counts and one node for the components. An empty table gives an empty table.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    number = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"  # exact either way
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for v in batch.column("v").to_pylist():
                x = np.array([np.nan if c is None else c for c in v or []], dtype=number)
                blobs.append((x + 0).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(blobs, pa.binary())], ["vec_id", "label", "x"])

    good = rows.where("label is not null").mapInArrow(usable, f"vec_id {kind}, label string, x binary").where("x is not null")
    # ``id`` is the node: the least id among equal vectors
    nodes = cut(good.groupBy("label", "x").agg(F.min("vec_id").alias("id"), F.count("*").alias("w")).withColumn("node", F.xxhash64("label", "x")))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("x").to_pylist()
            found: list[bytes] = [b""] * len(blobs)
            for size in {len(b) for b in blobs}:
                at = [i for i, b in enumerate(blobs) if len(b) == size]
                for i, c in zip(at, cells(_unit([blobs[i] for i in at], number), scale=REACH / np.sqrt(2 - 2 * cosine)), strict=True):
                    found[i] = c.tobytes()
            keys = [np.frombuffer(f, np.int64).tolist() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("label", "x", "w", "node")] + [pa.array(keys, pa.list_(pa.int64()))], ["label", "x", "w", "node", "cells"])

    spread = cut(nodes.select("label", "x", "w", "node").mapInArrow(placed, "label string, x binary, w long, node long, cells array<long>"))
    # cells travel without their vectors until it is known which of them have company
    members = spread.select("label", F.length("x").alias("dim"), "node", F.explode("cells").alias("cell"))
    sizes = members.groupBy("label", "dim", "cell").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.withColumn("s", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    rows_ = members.join(sizes, ["label", "dim", "cell"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("s")).cast("int"))
    rows_ = rows_.withColumn("other", F.explode(F.expr("sequence(0, s - 1)")))
    rows_ = rows_.select("label", "dim", "cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node")
    rows_ = rows_.join(spread.select("node", "x", "w", "cells"), "node")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        cell, i, j = key[2].as_py(), key[3].as_py(), key[4].as_py()
        x = _unit(group.column("x").to_pylist(), number)
        w, node, mine = (group.column(c).to_numpy() for c in ("w", "node", "mine"))
        own = group.column("cells").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        at = np.argmax(own == cell, axis=1)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for lo in range(0, len(x), TILE):
            linked = x[lo : lo + TILE] @ x.T >= cosine
            linked[np.arange(len(linked)), np.arange(lo, lo + len(linked))] = False
            if i != j:
                linked &= mine[lo : lo + TILE, None] != mine[None]
            a, b = np.nonzero(linked)
            ends.append((a + lo, b))
        a, b = (np.concatenate(e) for e in zip(*ends, strict=True))
        # this cell counts a pair only if no cell before it (in the order of a's cells and b's alike) is shared
        counted = np.ones(len(a), dtype=bool)
        per = PROBES
        for t in range(own.shape[1] // per):
            side = own[:, t * per : (t + 1) * per]
            live = np.flatnonzero(counted & (at[a] // per >= t))
            if not len(live):
                break
            for lo in range(0, len(live), 200_000):
                k = live[lo : lo + 200_000]
                same = side[a[k]][:, :, None] == side[b[k]][:, None, :]
                shared = np.where(same, side[a[k]][:, :, None], np.iinfo(np.int64).max).min(axis=(1, 2))
                here = at[a[k]] // per == t
                counted[k[np.where(here, shared < cell, shared != np.iinfo(np.int64).max)]] = False
        count = np.bincount(a[counted], weights=w[b[counted]], minlength=len(node)).astype(np.int64)
        label = np.arange(len(node))
        while len(a):  # least row reachable
            before = label.copy()
            np.minimum.at(label, a, label[b])
            label = label[label]
            if (label == before).all():
                break
        some = np.unique(a)
        return pa.table({"node": node[some], "links": count[some], "root": node[label[some]]})

    found = rows_.groupBy("label", "dim", "cell", "i", "j").applyInArrow(compare, "node long, links long, root long")
    found = cut(found.groupBy("node", "root").agg(F.sum("links").alias("links")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select("node", "root"), "node", "root")
    nodes = nodes.join(counts, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = nodes.groupBy("component").agg(F.min("id").alias("component_id"))
    nodes = nodes.join(least, "component").select("label", "x", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    linked = good.join(nodes, ["label", "x"]).groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(linked, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")
    )
