"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhawk.llm.common import Memory, slices

_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[a-zß-öø-ÿ]+"), re.compile(r"\d+")


class Words(Memory):
    """Hash of each word and of its shape (letters, capitals and digits as classes, runs as one, signs kept)."""

    def learn(self, words: list[str]) -> None:
        for w in self.unknown(words):
            shape = _DIGIT.sub("0", _UPPER.sub("A", _LOWER.sub("a", w)))
            self[w] = zlib.crc32(w.encode()) << 32 | zlib.crc32(b"\x00" + shape.encode())


def features(text: str, bits: int, memory: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text and their values (log counts, of length 1 together).

    Words, pairs of words, and shapes of one to three words; a word that repeats the one before has a shape of
    its own.
    """
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    memory.learn(words)
    both = np.fromiter(map(memory.__getitem__, words), dtype=np.uint64, count=len(words))
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    shape[1:][word[1:] == word[:-1]] = 1
    k1, k2 = np.uint64(0x9E3779B1), np.uint64(0x85EBCA77)
    grams = [word, word[:-1] * k1 + word[1:] * k2 + np.uint64(1), shape, shape[:-1] * k1 + shape[1:] * k2 + np.uint64(2)]
    if len(shape) > 2:
        grams.append((shape[:-2] * k1 + shape[1:-1]) * k1 + shape[2:] * k2 + np.uint64(3))
    h = np.concatenate(grams) * np.uint64(0xD6E8FEB86659FD93)
    at, n = np.unique((h >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    value = np.log1p(n)
    return at, value / np.sqrt(np.sum(value * value))


@dataclass
class Ftrl:
    """Per-coordinate follow-the-regularised-leader; ``weights`` is the sparse model."""

    bits: int = 18
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.1

    def __post_init__(self) -> None:
        # the last coordinate is the bias, which is not regularised
        self.z, self.n = np.zeros((1 << self.bits) + 1), np.zeros((1 << self.bits) + 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        bias = i == 1 << self.bits
        l1, l2 = np.where(bias, 0, self.l1), np.where(bias, 0, self.l2)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + l2))

    def learn(self, i: np.ndarray, x: np.ndarray, y: float) -> None:
        i, x = np.append(i, 1 << self.bits), np.append(x, 1.0)
        w = self.at(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        self.z[i] += g - sigma * w
        self.n[i] += g * g

    def weights(self) -> np.ndarray:
        return self.at(np.arange((1 << self.bits) + 1))


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 5, sample: int = 8_000, bits: int = 18, epochs: int = 3,
) -> np.ndarray:
    """Weights learnt from a bounded sample of the labelled rows outside fold 0 (``crc32(id) mod folds``).

    ``sample`` is the documented bound: the labelled ids with the least hashes are taken, whatever the size of
    the corpus, and of their different texts again that many with the least hashes, so the driver gets the
    features of that many texts at most; equal rows are learnt once. Rows with a null id or label don't count;
    without any labelled row every score is one half.
    """
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
        .where("_id is not null and _y is not null")
        .where(F.pmod(F.crc32(F.col("_id").cast("string").cast("binary")), F.lit(folds)) != 0)
        .distinct()
        .orderBy(F.xxhash64("_id"), "_id", "_y")
        .limit(sample)
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Words()
        for batch in batches:
            found = [features(t or "", bits, memory) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([str(x) for x in batch.column("_id").to_pylist()]), batch.column("_y"),
                 pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in found], pa.binary())],
                ["id", "y", "i", "x"],
            )

    found = rows.mapInArrow(run, "id string, y double, i binary, x binary").distinct()
    got = found.orderBy(F.xxhash64("id", "y", "i", "x"), "id", "y", "i", "x").limit(sample).collect()
    got.sort(key=lambda r: (zlib.crc32(r["id"].encode()), r["id"], r["y"], bytes(r["i"])))
    model = Ftrl(bits)
    for _ in range(epochs):
        for r in got:
            model.learn(np.frombuffer(r["i"], "<i4").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(float), float(r["y"] > 0))
    return model.weights()


def scorer(docs: DataFrame, weights: np.ndarray) -> Callable[[str, Words], float]:
    """A function of a text, for use inside tasks; the weights travel once to each executor."""
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    bits = int(np.log2(len(weights) - 1))

    def score(text: str, memory: Words) -> float:
        i, x = features(text, bits, memory)
        w = held.value
        return float(1 / (1 + np.exp(-np.clip(float(w[i].astype(float) @ x) + float(w[-1]), -35, 35))))

    return score


def classify(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 5, threshold: float = 0.3, keep: tuple[str, ...] = (), sample: int = 8_000,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` (and the columns in ``keep``) for every row of ``docs``.

    Only the text decides a score. Training looks at no row of fold 0. Null and empty texts get the score of
    the bias alone; repeated rows get the same score; a null id counts as the empty text for ``held_out``; very
    long texts are scored whole, one at a time; a column in ``keep`` that has the name of a result column is
    not given a second time; other columns are not read; an empty table gives an empty table.
    """
    weights = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, folds=folds, sample=sample)
    score = scorer(docs, weights)
    cols = list(dict.fromkeys([id_col, text_col, *keep]))
    fields = {f.name: f.dataType.simpleString() for f in docs.select(*cols).schema.fields}
    kept = [c for c in dict.fromkeys(keep) if c not in (id_col, "doc_id", "held_out", "score", "predicted")]
    schema = ", ".join([f"doc_id {fields[id_col]}", *[f"`{c}` {fields[c]}" for c in kept], "held_out boolean, score double, predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Words()
        for batch in batches:
            for a, b in slices(pc.fill_null(pc.utf8_length(batch.column(text_col)), 0).to_pylist(), 2_000_000):
                part = batch.slice(a, b - a)
                scores = [score(t or "", memory) for t in part.column(text_col).to_pylist()]
                held = [zlib.crc32(b"" if i is None else str(i).encode()) % folds == 0 for i in part.column(id_col).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), *[part.column(c) for c in kept], pa.array(held, pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                    ["doc_id", *kept, "held_out", "score", "predicted"],
                )

    return docs.select(*cols).mapInArrow(run, schema)
