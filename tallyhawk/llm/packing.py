"""Shortest-pack-first packing over the length histogram."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhawk.llm.byte_pairs import vocabulary
from tallyhawk.llm.token_counts import default_vocabulary
from tallyhawk.plans.session import cut

#: Ranks within one length are counted in this many groups a length, so that a length with a third of all
#: pieces is still ranked by many tasks.
RANK_GROUPS = 128


def patterns_of(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Packing patterns ``(lengths, how many packs)`` for ``{length: count}``.

    Lengths are placed longest first, each into the shortest packs that exist (those with most room) before
    new packs are opened; a new pack is the shortest until it is full. A pattern stands for all its packs, so a
    step costs the same however many documents it places, and the list is bounded by ``size`` whatever the
    corpus holds: a step uses up either a length or a pattern.
    """
    rooms: list[list[tuple[list[int], int]]] = [[] for _ in range(size + 1)]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        room = size
        while left and room >= length:
            if not rooms[room]:
                room -= 1
                continue
            parts, packs = rooms[room].pop()
            placed = min(packs, left)  # one copy a pack: after that, other packs may be shorter
            rooms[room - length].append((parts + [length], placed))
            left -= placed
            if packs > placed:
                rooms[room].append((parts, packs - placed))
        if left:
            fit = size // length
            if whole := left // fit:
                rooms[size - fit * length].append(([length] * fit, whole))
            if rest := left % fit:
                rooms[size - rest * length].append(([length] * rest, 1))
    return [x for at in rooms for x in at]


def blocks_of(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, ranks, first sequence, offset)``: which ranks of a length go where."""
    out, used, sequence = [], {}, 0
    for parts, packs in patterns:
        offset = 0
        for length, same in groupby(parts):
            for _ in same:
                rank = used.get(length, 0)
                out.append((length, rank, packs, sequence, offset))
                used[length] = rank + packs
                offset += length
        sequence += packs
    return out


def pieces(docs: DataFrame, size: int, end: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most ``size`` ids, cut at multiples of ``size``; no text leaves the scan."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(vocab.token_ids(text.as_py() or ""), end).astype("<u4")
                for start in range(0, len(ids), size):
                    part = ids[start : start + size]
                    rows.append((i, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            at, *rest = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, rest)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end: int = 0, path: str | None = None
) -> DataFrame:
    """Every id of every document in exactly one piece of one sequence of at most ``size`` ids.

    The driver holds the histogram only (``size`` numbers) and the patterns made from it; pieces find their
    pattern by their rank among the pieces of their length. Ranks come from counts per (length, group) and a
    row number inside a group, so a length that many pieces share is no single task's work. Full pieces are
    sequences by themselves and need no rank: theirs are the negative sequence ids. A null or empty text is its
    end id alone; a very long text is encoded whole and cut; repeated documents are each packed; ties of rank
    are broken by id, start and checksum, and pieces equal in all of these may change places; other columns
    are not read, whatever their names; an empty table gives an empty table.
    """
    made = cut(
        pieces(docs, size, end, path or default_vocabulary(), id_col, text_col).withColumn(
            "_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(RANK_GROUPS)).cast("int")
        )
    )
    part = F.col("length") < size
    counts = made.where(part).groupBy("length", "_group").count().toArrow()  # at most size x RANK_GROUPS rows
    histogram: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for length, group, n in sorted(zip(*(counts.column(c).to_pylist() for c in ("length", "_group", "count")), strict=True)):
        before[length, group] = histogram.get(length, 0)
        histogram[length] = before[length, group] + n
    spark = docs.sparkSession
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, *block in blocks_of(patterns_of(histogram, size)):
        by_length.setdefault(length, []).append(tuple(block))
    held = spark.sparkContext.broadcast((before, {k: np.array(sorted(v), dtype=np.int64) for k, v in by_length.items()}))

    inside = Window.partitionBy("length", "_group").orderBy("doc_id", "start", "ids_crc32")
    ranked = made.where(part).withColumn("_rank", F.row_number().over(inside) - 1)
    kind = made.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, blocks = held.value
        for batch in batches:
            length, group, rank = (batch.column(n).to_numpy() for n in ("length", "_group", "_rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                own = rank[rows] + np.array([offsets[n, g] for g in group[rows].tolist()])
                table = blocks[n]
                at = np.searchsorted(table[:, 0], own, side="right") - 1
                sequence[rows] = table[at, 2] + own - table[at, 0]
                offset[rows] = table[at, 3]
            cols = [batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    placed = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_group", "_rank").mapInArrow(
        place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    whole = made.where(~part).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return placed.unionAll(whole)
