"""Language-model scores from a probabilistic suffix tree over words, whose contexts live in a shuffle by context."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhawk.llm.common import bucket, hash_words, mix64, slices
from tallyhawk.plans.session import cut

#: Words of at least this share of all tokens (so a million at most, of 12 bytes each) have their counts broadcast.
HEAD_SHARE = 1e-6
#: A word that occurs more often than this is no context by itself: a context grows by the words before it. None is left out.
HOT = math.inf
#: A context that occurs more often than both of these is dealt to several groups, of about ``SPLIT`` tokens each.
SPLIT, SPLIT_SHARE = 600_000, 1e-6
#: Frequent contexts of two and four words are looked for in so many texts that one would be met about this often.
SAMPLED = 200
#: Contexts of one, two and four words: bits of the key that a context of each level covers, nearest word first.
LEVELS, BITS = (1, 2, 4), (24, 44, 64)
#: A context must have been seen this often.
LEAST = 2
#: Tokens of one group of contexts and of one group of words, about, and of one group of words after frequent contexts.
GROUP, WORD_GROUP, NEXT_GROUP = 400_000, 4_000_000, 8_000_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64
#: What stands before a text's first word.
BEGIN = _U(0x5851F42D4C957F2D)
_RARE = np.uint32(1 << 31)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), codec="zstd", asbytes=True)


def unplanes(data: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind)[:, 0]


def place(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where values stand in an ascending array, -1 for those that don't."""
    if not len(known):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, -1)


@dataclass
class Root:
    """The tree's root: word counts. Words beyond the head share what is left of the base's distribution evenly."""

    head: np.ndarray  # hashes, ascending
    n: np.ndarray  # their counts, and at last that of the end
    total: int
    different: int

    def __post_init__(self) -> None:
        self.whole = self.total + self.different + 1
        rest, slots = self.total - int(self.n.sum()), self.different - len(self.head) - int(self.n[-1] > 0) + 1
        #: log10 of the probability of each head word, of the end, and of any other word
        self.logp = np.log10(np.append(self.n + 1.0, (rest + slots) / slots) / self.whole)
        self.hot, self.split = HOT, max(SPLIT, SPLIT_SHARE * self.total)

    @property
    def end(self) -> int:
        return len(self.head)

    def rank(self, h: np.ndarray) -> np.ndarray:
        """Place among the head words, -1 for others."""
        return place(self.head, h)

    def p(self, symbol: np.ndarray) -> np.ndarray:
        """Probability of symbols: ranks, or the marked hashes of words beyond the head."""
        return 10.0 ** self.logp[np.where(symbol & _RARE, len(self.logp) - 1, symbol & ~_RARE)]


@dataclass
class Split:
    """Contexts too frequent for one group. They have numbers, level by level, and groups of their own in that order."""

    hashes: list[np.ndarray]  # by level, ascending
    parent: np.ndarray  # by number: that of the next shorter context
    groups: np.ndarray  # by number: how many

    def __post_init__(self) -> None:
        self.offset = np.cumsum([0, *map(len, self.hashes)])
        self.first = np.cumsum(self.groups) - self.groups

    def find(self, level: int, h: np.ndarray) -> np.ndarray:
        at = place(self.hashes[level], h)
        return np.where(at < 0, -1, at + self.offset[level])

    def level(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offset[1:], x, side="right")


def count_words(docs: DataFrame, id_col: str, text_col: str, folds: int, held: int) -> Root:
    """Counts over the training texts; the driver gets two sums and the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        ends = 0

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(hash_words(counts).view(np.int64)), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket(i, folds) != held:
                    ends += 1
                    for w in tokens(text.as_py()):
                        counts[w] = counts.get(w, 0) + 1
                    if len(counts) > 100_000:
                        yield out()
        yield out()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([ends], pa.int64())], ["word", "n"])  # ends are no word

    counts = cut(docs.select(id_col, text_col).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    sums = counts.agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("different"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("ends")).first()
    total, ends = sums["total"] or 0, sums["ends"] or 0
    bound = max(2, math.ceil(HEAD_SHARE * total))
    head = counts.where(F.col("word").isNotNull() & (F.col("n") >= bound)).toArrow()
    h, n = head.column("word").to_numpy().view(np.uint64), head.column("n").to_numpy()
    order = np.argsort(h)
    return Root(h[order], np.append(n[order], ends).astype(np.int64), total, sums["different"])


def numbered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different words, the number of each word in these, and how many a text has."""
    words = [tokens(t) for t in texts]
    size = np.array(list(map(len, words)))
    local: dict[bytes, int] = {}
    word = np.fromiter((local.setdefault(x, len(local)) for w in words for x in w), np.int64, int(size.sum()))
    return hash_words(local), word, size


def contexts_of(root: Root, split: Split, h: np.ndarray, rank: np.ndarray, word: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray], np.ndarray]:
    """Of every position after a text's first word: document, hashes of the contexts by level, the level from which on
    they count, the numbers of frequent contexts by level, and the next symbol.

    ``word`` has the number of each word in ``h``, ``size`` how many a text has. The level follows from the nearest
    words: the first that hold a word that is not hot. A context has a number only if all shorter ones have.
    """
    n = size + 1
    start = np.cumsum(n) - n
    tok = np.full(int(n.sum()), len(h))
    tok[np.arange(len(word)) + np.repeat(np.arange(len(size)), size)] = word
    doc = np.repeat(np.arange(len(size)), n)
    away = np.arange(len(tok)) - start[doc]
    hashes = np.append(h, _U(0))[tok]
    hot = np.append(np.where(rank >= 0, root.n[rank], 0) > root.hot, False)[tok]

    def back(k: int) -> tuple[np.ndarray, np.ndarray]:
        w, warm = np.full(len(tok), BEGIN), np.ones(len(tok), dtype=bool)
        w[k:], warm[k:] = hashes[:-k], hot[:-k]
        w[away < k], warm[away < k] = BEGIN, True
        return w, warm

    at = np.flatnonzero(away > 0)
    (w1, hot1), (w2, hot2), (w3, _), (w4, _) = ((w[at], warm[at]) for w, warm in map(back, (1, 2, 3, 4)))
    a1 = mix64(w1)
    a2 = mix64(a1 + w2)
    a4 = mix64(mix64(a2 + w3) + w4)
    level = np.where(~hot1, 0, np.where(~hot2, 1, 2))
    numbers = [np.where(level == 0, split.find(0, a1), -1)]
    for k, a in ((1, a2), (2, a4)):
        x, rows = np.full(len(at), -1), np.flatnonzero(numbers[-1] >= 0)
        x[rows] = split.find(k, a[rows])
        numbers.append(x)
    code = np.append(np.where(rank >= 0, rank.astype(np.uint32), h.astype(np.uint32) | _RARE), np.uint32(root.end)).astype(np.uint32)
    return doc[at], [a1, a2, a4], level, numbers, code[tok][at]


def places_of(root: Root, split: Split, h: np.ndarray, rank: np.ndarray, word: np.ndarray, size: np.ndarray, groups: int, batch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, group, context key and next symbol of every position after a text's first word.

    Positions meet by their shortest context that is not frequent, in a group of the longest one that is; where all
    are frequent, nothing is left to count, and a batch goes to any group of the longest. A key starts with the
    level from which on its contexts are counted there.
    """
    doc, (a1, a2, a4), level, numbers, code = contexts_of(root, split, h, rank, word, size)
    group = mix64(np.choose(level, (a1, a2, a4)))
    group = (group >> _U(64 - int(math.log2(groups)))).astype(np.int64)
    for k, (x, rest) in enumerate(zip(numbers, (a2, a4, None), strict=True)):
        rows = np.flatnonzero(x >= 0)
        level[rows] = k + 1
        own = x[rows]
        within = np.full(len(rows), _U(batch)) if rest is None else rest[rows]
        group[rows] = groups + split.first[own] + (mix64(within) % split.groups[own].astype(_U)).astype(np.int64)
    key = level.astype(_U) << _U(62) | a1 >> _U(42) << _U(40) | a2 >> _U(44) << _U(20) | a4 >> _U(44)
    key[level == len(LEVELS)] = _U(len(LEVELS) << 62)
    return doc, group, key, code


def gains(each: np.ndarray, whole: np.ndarray, types: np.ndarray, before: np.ndarray) -> np.ndarray:
    """By how much log p of a symbol's occurrences grows in a context, if each is left out in turn."""
    others = types - (each == 1)
    left_out = (each - 1 + others * before) / np.maximum(whole - 1 + others, 1e-9)
    return each * np.log(np.maximum(left_out, 1e-300) / before)


def smoothed(each: np.ndarray, whole: np.ndarray, types: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A state gives its suffix's distribution the weight of as many occurrences as it has different symbols."""
    return (each + types * before) / np.maximum(whole + types, 1)


def changes(root: Root, key: np.ndarray, symbol: np.ndarray, n: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """By how much contexts change log10 of the next symbol's probability, for different (key, symbol) in order.

    ``n``: how often each occurs in training texts; a group has all occurrences of its contexts. A context is a
    state if it was seen LEAST times and predicts its own occurrences, each left out in turn, better than the
    longest state before it does. ``before``: the symbols' probabilities after a frequent context that all share.
    """
    from_ = (key >> _U(62)).astype(np.int64)
    base = root.p(symbol)
    p = base.copy() if before is None else before.copy()
    for level, bits in enumerate(BITS):
        rows = np.flatnonzero(from_ <= level)
        if not len(rows):
            continue
        context = key[rows] >> _U(64 - bits)
        node = np.cumsum(np.append(0, context[1:] != context[:-1]))
        order = np.lexsort((symbol[rows], node))  # the same symbol after longer contexts that differ
        v, s = node[order], symbol[rows][order]
        pair = np.cumsum(np.append(0, (v[1:] != v[:-1]) | (s[1:] != s[:-1])))
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        each, owner, shorter = np.bincount(pair, weights=n[rows][order]), v[first], p[rows][order][first]
        whole = np.bincount(owner, weights=each)
        types = np.bincount(owner, weights=each > 0)
        seen = each > 0
        gain = np.bincount(owner[seen], weights=gains(each[seen], whole[owner[seen]], types[owner[seen]], shorter[seen]), minlength=len(whole))
        state = (whole >= LEAST) & (gain > 0)
        new = np.where(state[owner], smoothed(each, whole[owner], types[owner], shorter), shorter)
        p[rows[order]] = new[pair]
    return np.log10(p / base)


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str | None]]]:
    """Ids and texts of about 3,000,000 characters; a longer text is alone."""
    for batch in batches:
        texts = batch.column(1)
        for a, b in slices(pc.fill_null(pc.utf8_length(texts), 0).to_pylist(), 3_000_000):
            yield batch.column(0).slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist()


def frequent_contexts(docs: DataFrame, told: Broadcast[Root]) -> Split:
    """The contexts that are dealt to several groups, which any could be: scores don't depend on them.

    Words are known by their counts, longer contexts are counted in a part of the texts that gets no larger with
    the corpus than one in ``SPLIT / SAMPLED``. The driver gets the frequent ones.
    """
    root = told.value
    often = np.flatnonzero(root.n[:-1] > root.split)
    none = np.empty(0, np.uint64)
    h, n = mix64(root.head[often]), root.n[:-1][often]
    order = np.argsort(h)
    h, n = h[order], n[order]
    words = Split([h, none, none], np.full(len(h), -1), np.ones(len(h), np.int64))
    if not len(h):
        return words
    share = min(1.0, SAMPLED / root.split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = told.value
        for _, texts in in_slices(batches):
            h, word, size = numbered(texts)
            _, a, _, (x, _, _), _ = contexts_of(root, words, h, root.rank(h), word, size)
            for k in (1, 2):
                rows = np.flatnonzero(x >= 0)
                own, at, n = np.unique(a[k][rows], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k)), pa.array(own.view(np.int64)), pa.array(a[k - 1][rows[at]].view(np.int64)), pa.array(n)], ["level", "context", "shorter", "n"])

    some = docs if share == 1 else docs.sample(share, seed=1)
    found = some.mapInArrow(run, "level long, context long, shorter long, n long").groupBy("level", "context").agg(F.first("shorter").alias("shorter"), F.sum("n").alias("n"))
    longer = found.where(F.col("n") > share * root.split).toArrow()
    level, context, shorter, m = (longer.column(c).to_numpy() for c in longer.column_names)
    hashes, parents, counts = [h], [np.full(len(h), -1)], [n]
    for k in (1, 2):
        up = place(hashes[-1], shorter.view(np.uint64))
        rows = np.flatnonzero((level == k) & (up >= 0))
        rows = rows[np.argsort(context[rows].view(np.uint64))]
        parents.append(up[rows] + sum(map(len, hashes[:-1])))
        hashes.append(context[rows].view(np.uint64))
        counts.append(m[rows] / share)
    return Split(hashes, np.concatenate(parents), np.ceil(np.concatenate(counts) / root.split).astype(np.int64))


def after_frequent(docs: DataFrame, told: Broadcast[Root], split: Split, taught: Callable[[object], bool], to: int) -> DataFrame:
    """What follows frequent contexts, counted over all texts, in rows for the groups of these: ``bucket, symbols, scores, sizes``.

    A context's symbols are counted in parts by symbol. As a part has its symbols after all contexts, only sums of
    each context are put together, level by level: how often it occurs, its different symbols, and its gain.
    Each of its groups, of which the first is ``to``, gets the probabilities.
    """
    root = told.value
    dealt = docs.sparkSession.sparkContext.broadcast(split)
    bits = max(3, math.ceil(math.log2(max(1.0, root.total / NEXT_GROUP))))
    low = (1 << 32) - 1

    def merged(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        own, at = np.unique(np.concatenate(keys), return_inverse=True)
        return own, np.bincount(at, weights=np.concatenate(n), minlength=len(own)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, split = told.value, dealt.value
        keys, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def out() -> pa.RecordBatch:
            part = (mix64((keys[0] & low).astype(np.uint64)) >> _U(64 - bits)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            own, often = keys[0][order], n[0][order]
            edges = np.searchsorted(part[order], np.arange((1 << bits) + 1))
            rows = [(k, b - a, planes(own[a:b]), planes(often[a:b])) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
            keys[:], n[:] = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            return pa.RecordBatch.from_pylist([dict(zip(packed.names, r, strict=True)) for r in rows], schema=packed)

        for ids, texts in in_slices(batches):
            h, word, size = numbered(texts)
            doc, _, _, numbers, code = contexts_of(root, split, h, root.rank(h), word, size)
            learnt = np.array([taught(i) for i in ids], np.int64)[doc]
            for x in numbers:
                rows = np.flatnonzero(x >= 0)
                own, often = merged([x[rows] << 32 | code[rows].astype(np.int64)], [learnt[rows]])
                keys.append(own)
                n.append(often)
            if sum(map(len, keys)) > 800_000:
                keys[:], n[:] = ([x] for x in merged(keys, n))
                if len(keys[0]) > 400_000:
                    yield out()
        keys[:], n[:] = ([x] for x in merged(keys, n))
        yield out()

    packed = pa.schema([("part", pa.int64()), ("m", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])
    schema = "part long, m long, keys binary, n binary"

    def unpacked(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for r in table.select(["m", "keys", "n"]).to_pylist():
            yield unplanes(r["keys"], r["m"], "<i8"), unplanes(r["n"], r["m"], "<i8")

    def add(key: tuple, group: pa.Table) -> pa.Table:
        keys, n = merged(*map(list, zip(*unpacked(group), strict=True)))
        return pa.table([[key[0].as_py()], [len(keys)], [planes(keys)], [planes(n)]], schema=packed)

    parts = cut(docs.mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema))

    def sums(of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]], width: int) -> list[np.ndarray]:
        """Sums by context of what ``of`` gives for a part: numbers of contexts, and values."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, n in unpacked(batch):
                    x, *values = of(keys, n)
                    own, at = np.unique(x, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(np.bincount(at, weights=v, minlength=len(own))) for v in values)], ["x", *names])

        names = [f"v{i}" for i in range(width)]
        got = parts.mapInArrow(run, "x long, " + ", ".join(f"{v} double" for v in names)).groupBy("x").agg(*(F.sum(v).alias(v) for v in names)).toArrow()
        out = [np.zeros(len(split.parent)) for _ in names]
        for o, v in zip(out, names, strict=True):
            o[got.column("x").to_numpy()] = got.column(v).to_numpy()
        return out

    whole, types = sums(lambda keys, n: (keys >> 32, n, n > 0), 2)
    state = np.zeros(len(whole), dtype=bool)

    def shorter(keys: np.ndarray, n: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of contexts of one level and their symbols' probabilities in the next shorter ones, and those of all rows before it."""
        root, split = told.value, dealt.value
        x, s, p = keys >> 32, (keys & low).astype(np.uint32), np.zeros(len(keys))
        level, rows, before = split.level(x), np.empty(0, np.int64), np.empty(0)
        for k in range(upto + 1):
            rows = np.flatnonzero(level == k)
            before = p[np.searchsorted(keys, split.parent[x[rows]] << 32 | keys[rows] & low)] if k else root.p(s[rows])
            if k < upto:
                own = x[rows]
                p[rows] = np.where(state[own], smoothed(n[rows], whole[own], types[own], before), before)
        return rows, before, p

    for k, known in enumerate(split.hashes):
        if len(known):

            def gained(keys: np.ndarray, n: np.ndarray, k: int = k) -> tuple[np.ndarray, np.ndarray]:
                rows, before, _ = shorter(keys, n, k)
                seen = n[rows] > 0
                own = keys[rows][seen] >> 32
                return own, gains(n[rows][seen], whole[own], types[own], before[seen])

            (gain,) = sums(gained, 1)
            state = state | (whole >= LEAST) & (gain > 0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = dealt.value
        for batch in batches:
            for keys, n in unpacked(batch):
                p = shorter(keys, n, len(LEVELS))[2]
                x = keys >> 32
                edges = np.flatnonzero(np.diff(x, prepend=-1, append=-1))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    symbols, scores, size = planes(keys[a:b].astype("<u4")), planes(p[a:b]), np.array([0, b - a, 0], "<i8").tobytes()
                    first, groups = int(split.first[x[a]]), int(split.groups[x[a]])
                    for g in range(0, groups, 64):
                        more = [to + first + j for j in range(g, min(g + 64, groups))]
                        yield pa.RecordBatch.from_arrays([pa.array(more, pa.int64()), *(pa.array([v] * len(more), pa.binary()) for v in (symbols, scores, size))], ["bucket", "symbols", "scores", "sizes"])

    return parts.mapInArrow(deal, "bucket long, symbols binary, scores binary, sizes binary")


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Texts of which ``crc32(id) mod folds`` is not ``held`` teach the tree; all are scored. ``score`` is log10 of the
    text's probability: of every word and of the end, given the longest state that is a suffix of the words before
    it. Contexts have one, two or four words and are told apart by 62 bits of hash and their group's. Positions meet
    by context in a shuffle, where each group counts, tests and applies its own, so the number of states grows with
    the corpus and no executor holds the tree. A context too frequent for one group is counted and tested before, in
    parts by symbol, and the groups that its longer contexts are dealt to get its probabilities. ``base_score`` needs
    each word's count: frequent words have it from a broadcast table (a million at most), all others meet their
    occurrences in a shuffle by word hash. In both a
    batch of texts sends what is different once, with the places it stands, so that copies and frequent words
    cost a batch little, and gets sums per text back. Nothing is capped or sampled.

    A null or empty text is its end alone; a null id counts as the empty text for the fold; repeated rows are
    each learnt and scored; a very long text is a batch by itself; other columns are not read; with an empty table nothing is
    learnt and nothing returned.
    """
    root = count_words(docs, id_col, text_col, folds, held)
    told = docs.sparkSession.sparkContext.broadcast(root)
    kind = docs.schema[id_col].dataType.simpleString()
    power = lambda x: 1 << max(3, math.ceil(math.log2(max(1.0, x))))
    buckets, groups = power(root.total / WORD_GROUP), power(root.total / GROUP)
    texts_ = docs.select(id_col, text_col)
    split = frequent_contexts(texts_, told)
    dealt = docs.sparkSession.sparkContext.broadcast(split)

    import pyspark.sql.pandas.types as arrow_types

    id_type = arrow_types.to_arrow_type(docs.schema[id_col].dataType)
    names = ["batch", "bucket", "ids", "keys", "symbols", "train", "places", "docs", "sizes", "known", "sums", "scores"]
    kinds = [pa.int64(), pa.int64(), pa.list_(id_type), *[pa.binary()] * 9]

    def packed(new: np.ndarray, train: np.ndarray, doc: np.ndarray, docs_: int) -> tuple[bytes, bytes, bytes, bytes]:
        """What starts at ``new``: how often it is taught, how often it stands, in which texts; and the sizes."""
        n = np.add.reduceat(train[doc].astype("<i4"), new, dtype="<i4")
        wide = "<u4" if docs_ > 65_535 else "<u2"
        return planes(n), planes(np.diff(np.append(new, len(doc))).astype("<i4")), planes(doc.astype(wide)), np.array([docs_, len(new), len(doc)], "<i8").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, split = told.value, dealt.value
        base, part = TaskContext.get().partitionId() << 32, 0

        def sent(ids: list, texts: list[str | None]) -> Iterator[list]:
            nonlocal part
            h, word, size = numbered(texts)
            taught = np.array([bucket(i, folds) != held for i in ids])
            rank, doc = root.rank(h), np.repeat(np.arange(len(size)), size)
            easy = rank[word] >= 0
            logp = root.logp[rank][word]  # rank -1 is the last: any other word
            end = root.n[-1]
            known = np.bincount(doc[easy], minlength=len(size)) + int(end > 0)
            sums = np.bincount(doc[easy], weights=np.log10(root.n[rank[word[easy]]] + 1.0), minlength=len(size)) + math.log10(end + 1)
            score = np.bincount(doc, weights=logp, minlength=len(size)) + root.logp[root.end]
            part += 1
            me = base | part
            yield [me, -1 - me, ids, None, None, None, None, None, (size + 1).astype("<i8").tobytes(), known.astype("<i8").tobytes(), sums.tobytes(), score.tobytes()]
            rare, whose = word[~easy], doc[~easy]
            to = (h >> _U(64 - int(math.log2(buckets)))).astype(np.int64)
            order = np.lexsort((rare, to[rare]))
            rare, whose = rare[order], whose[order]
            edges = np.searchsorted(to[rare], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edges)):
                own = rare[edges[k] : edges[k + 1]]
                new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                train, places, docs_, sizes = packed(new, taught, whose[edges[k] : edges[k + 1]], len(size))
                yield [me, int(k), None, planes(h[own[new]]), None, train, places, docs_, sizes, None, None, None]
            del easy, logp, rare, whose, order, doc
            whose, group, key, symbol = places_of(root, split, h, rank, word, size, groups, me)
            order = np.lexsort((symbol, key, group))
            whose, group, key, symbol = whose[order], group[order], key[order], symbol[order]
            edges = np.searchsorted(group, np.arange(groups + int(split.groups.sum()) + 1))
            for k in np.flatnonzero(np.diff(edges)):
                cut_ = slice(edges[k], edges[k + 1])
                own, next_ = key[cut_], symbol[cut_]
                new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (next_[1:] != next_[:-1])))
                train, places, docs_, sizes = packed(new, taught, whose[cut_], len(size))
                yield [me, buckets + int(k), None, planes(own[new]), planes(next_[new]), train, places, docs_, sizes, None, None, None]

        for ids, texts in in_slices(batches):
            rows: list[list] = []
            for row in sent(ids, texts):
                rows.append(row)
                if len(rows) == 64:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = f"batch long, bucket long, ids array<{kind}>, " + ", ".join(f"{n} binary" for n in names[3:])
    sent_ = texts_.mapInArrow(first, schema)
    if len(split.parent):
        sent_ = sent_.unionByName(after_frequent(texts_, told, split, lambda i: bucket(i, folds) != held, buckets + groups), allowMissingColumns=True)

    replies = ["batch", "ids", "sizes", "known", "sums", "scores"]
    met = f"batch long, ids array<{kind}>, sizes binary, known binary, sums binary, scores binary"

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        """All batches' rows of one group: counts over the training texts, then sums per text of each batch.

        A batch's own row is a group of its own and goes through as it is.
        """
        to = key[0].as_py()
        if to < 0:
            return group.select(replies)
        root: Root = told.value
        own = group.column("batch").is_valid()
        shared, group = group.filter(pc.invert(own)), group.filter(own)
        n_rows = group.num_rows
        if not n_rows:
            return group.select(replies)
        col = lambda name, i: group.column(name)[i].as_py()
        sizes = [np.frombuffer(x, "<i8") for x in group.column("sizes").to_pylist()]
        keys = np.concatenate([unplanes(col("keys", i), m, "<u8") for i, (_, m, _) in enumerate(sizes)])
        n = np.concatenate([unplanes(col("train", i), m, "<i4") for i, (_, m, _) in enumerate(sizes)])
        if to < buckets:
            _, at = np.unique(keys, return_inverse=True)
            count = np.bincount(at, weights=n)[at]
            tables = {"known": (count > 0).astype(float), "sums": np.log10(count + 1)}
        else:
            symbols = np.concatenate([unplanes(col("symbols", i), m, "<u4") for i, (_, m, _) in enumerate(sizes)])
            order = np.lexsort((symbols, keys))
            k, s = keys[order], symbols[order]
            new = np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1]))
            at = np.empty(len(k), np.int64)
            at[order] = np.cumsum(new) - 1
            before = None
            if to >= buckets + groups:
                told_, p = (np.concatenate([unplanes(r[c], np.frombuffer(r["sizes"], "<i8")[1], t) for r in shared.select(["symbols", "scores", "sizes"]).to_pylist()]) for c, t in (("symbols", "<u4"), ("scores", "<f8")))
                order = np.argsort(told_)
                before = p[order][place(told_[order], s[new])]
            tables = {"scores": changes(root, k[new], s[new], np.bincount(at, weights=n), before)[at]}
        out: dict[str, list] = {c: [None] * n_rows for c in replies[1:]}
        start = 0
        for i, (docs_, m, places) in enumerate(sizes):
            doc = unplanes(col("docs", i), places, "<u4" if docs_ > 65_535 else "<u2")
            often = unplanes(col("places", i), m, "<i4")
            for name, x in tables.items():
                out[name][i] = np.bincount(doc, weights=np.repeat(x[start : start + m], often), minlength=docs_).astype("<f8").tobytes()
            start += m
        return pa.table({"batch": group.column("batch"), "ids": pa.nulls(n_rows, pa.list_(id_type)), **{c: pa.array(out[c], pa.binary()) for c in replies[2:]}})

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per batch for all that a task's groups say of its texts, as long as 32 MB hold them."""
        held_: dict[int, dict[str, np.ndarray]] = {}
        taken = 0

        def out() -> pa.RecordBatch:
            cols = {c: pa.array([x[c].tobytes() if c in x else None for x in held_.values()], pa.binary()) for c in replies[3:]}
            made = pa.RecordBatch.from_arrays([pa.array(list(held_), pa.int64()), pa.nulls(len(held_), pa.list_(id_type)), pa.nulls(len(held_), pa.binary()), *cols.values()], replies)
            held_.clear()
            return made

        for batch in batches:
            own = batch.column("sizes").is_valid()
            yield batch.filter(own)
            for row in batch.filter(pc.invert(own)).select(["batch", *replies[3:]]).to_pylist():
                mine = held_.setdefault(row["batch"], {})
                for c in replies[3:]:
                    if row[c] is not None:
                        x = np.frombuffer(row[c], "<f8")
                        if c in mine:
                            mine[c] += x
                        else:
                            mine[c] = x.copy()
                            taken += x.nbytes
                if taken > 32_000_000:
                    yield out()
                    taken = 0
        if held_:
            yield out()

    rows = sent_.groupBy("bucket").applyInArrow(meet, met).mapInArrow(together, met)
    floor, total = math.log10(root.whole), root.total

    def finish(key: tuple, group: pa.Table) -> pa.Table:
        table = group.to_pylist()
        main = next(r for r in table if r["sizes"] is not None)
        n, known = np.frombuffer(main["sizes"], "<i8"), np.frombuffer(main["known"], "<i8")

        def summed(c: str) -> np.ndarray:
            """The same sum in whatever order rows arrive."""
            return sum((np.frombuffer(x, "<f8") for x in sorted(r[c] for r in table if r[c] is not None and r is not main)), np.frombuffer(main[c], "<f8") if c != "known" else known.astype(float))

        ids = pa.array(main["ids"], id_type)
        held_out = pa.array([bucket(i, folds) == held for i in main["ids"]], pa.bool_())
        return pa.table({
            "doc_id": ids, "held_out": held_out, "n_tokens": n, "n_known": np.rint(summed("known")).astype(np.int64), "train_tokens": np.full(len(n), total, np.int64),
            "base_score": summed("sums") - n * floor, "score": summed("scores"),
        })

    return rows.groupBy("batch").applyInArrow(finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
