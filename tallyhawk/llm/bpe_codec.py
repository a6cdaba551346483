"""Byte-level BPE encoding with segment trees of pair ranks, and decoding; no tokenizer is called."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tallyhawk.llm.byte_pairs import SPACE
from tallyhawk.llm.common import Memory, slices

#: Above every (rank, position) key.
NONE = np.int64(1) << 62
#: Leaves that the trees of one batch of short pre-tokens have together.
LEAVES = 1 << 18
#: A longer pre-token has a tree of its own.
SHORT = 64
#: Characters of texts whose pre-tokens are held at once, and pre-tokens of a longer text that are.
WHOLE, BLOCK = 1_000_000, 200_000
#: About how many bytes a task remembers of pre-tokens: invented words are many.
KNOWN = 64_000_000


class RankFile:
    """A file of ranks as arrays; it holds no texts. A token's id is its rank."""

    def __init__(self, path: str) -> None:
        import regex
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bits = max(1, len(self.tokens).bit_length())
        # every way in which two tokens side by side make a third one
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << self.bits | right] = rank
        keys = np.fromiter(self.pairs, dtype=np.int64, count=len(self.pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], NONE)
        self.made = np.append(np.fromiter(self.pairs.values(), dtype=np.int64, count=len(keys))[order], -1)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        # the library's white space, not Python's
        own = PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.pattern = regex.compile(own)

    def _pair_keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, shift: int) -> np.ndarray:
        """(rank, place) of neighbouring symbols as one number; NONE where they make no token or one is missing (-1)."""
        key = np.where((left >= 0) & (right >= 0), left << self.bits | right, -1)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at] << shift | place, NONE)

    def encode_short(self, tokens: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens of ``SHORT`` bytes at most, each as packed little-endian 32-bit numbers.

        Each pre-token has a row: its symbols, the links to the live neighbours, and a segment tree whose leaf is
        the rank of the pair that begins at a byte, with that place, so a node's minimum is its leftmost lowest
        rank. A round merges the root's pair of every row and mends the paths of the three leaves concerned;
        rows without a pair leave.
        """
        out = [b""] * len(tokens)
        size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        width = 2
        while len(tokens) and width < SHORT * 2:
            rows = np.flatnonzero((size <= width) & (size > (width // 2 if width > 2 else 0)))
            for i in range(0, len(rows), max(1, LEAVES // width)):
                part = rows[i : i + max(1, LEAVES // width)]
                for row, packed in zip(part.tolist(), self._encode_rows([tokens[r] for r in part], size[part], width), strict=True):
                    out[row] = packed
            width *= 2
        return out

    def _encode_rows(self, tokens: list[bytes], size: np.ndarray, width: int) -> list[bytes]:
        n, shift = len(tokens), width.bit_length() - 1
        raw = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in tokens), dtype=np.uint8).reshape(n, width)
        place = np.arange(width, dtype=np.int64)
        symbols = np.full((n, width + 1), -1, dtype=np.int64)  # the last column is the end of every row
        symbols[:, :width] = np.where(place < size[:, None], self.byte_ids[raw], -1)
        after = np.minimum(np.broadcast_to(place + 1, (n, width)), size[:, None])
        after = np.where(after == size[:, None], width, after)
        before = np.broadcast_to(place - 1, (n, width)).copy()  # -1 is the last column too
        before = np.hstack([before, np.full((n, 1), -1, dtype=np.int64)])
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        tree[:, width:] = self._pair_keys(symbols[:, :width], symbols[:, 1:], np.broadcast_to(place, (n, width)), shift)
        for level in range(shift - 1, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            best = tree[live, 1]
            at, made = best & (width - 1), best >> shift
            gone = after[live, at]
            then, prior = after[live, gone], before[live, at]
            symbols[live, at], symbols[live, gone] = made, -1
            after[live, at], before[live, then] = then, at
            tree[live, width + gone] = NONE
            tree[live, width + at] = self._pair_keys(made, symbols[live, then], at, shift)
            # a row without an earlier neighbour mends the leaf of the merge once more
            first = prior < 0
            low = np.where(first, at, prior)
            tree[live, width + low] = np.where(first, tree[live, width + at], self._pair_keys(symbols[live, low], made, low, shift))
            row, node = np.tile(live, 3), np.concatenate([gone, at, low]) + width
            for _ in range(shift):
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            live = live[tree[live, 1] < NONE]
        kept = symbols[:, :width] >= 0
        ends = np.cumsum(kept.sum(axis=1)) * 4
        packed = symbols[:, :width][kept].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode_long(self, token: bytes) -> bytes:
        """The same for one long pre-token, with one tree over all its bytes: logarithmic work for a merge."""
        n = len(token)
        width = 1 << max(1, (n - 1).bit_length())
        shift = width.bit_length() - 1
        ids = self.byte_ids[np.frombuffer(token, dtype=np.uint8)]
        level = np.full(width, NONE, dtype=np.int64)
        level[: n - 1] = self._pair_keys(ids[:-1], ids[1:], np.arange(n - 1), shift)
        levels = [level]
        while len(level) > 1:
            level = np.minimum(level[::2], level[1::2])
            levels.append(level)
        tree, pairs, bits, none = [int(NONE), *np.concatenate(levels[::-1]).tolist()], self.pairs, self.bits, int(NONE)
        symbols, after, before = [*ids.tolist(), -1], list(range(1, n + 2)), list(range(-1, n))
        while (best := tree[1]) < none:
            at, made = best & (width - 1), best >> shift
            gone = after[at]
            then = after[gone]
            symbols[at], symbols[gone] = made, -1
            after[at], before[then] = then, at
            changed = [(gone, none)]
            for left in (at, before[at]):
                if left >= 0:
                    right = after[left]
                    rank = pairs.get(symbols[left] << bits | symbols[right], -1) if right < n else -1
                    changed.append((left, rank << shift | left if rank >= 0 else none))
            for leaf, key in changed:
                node = leaf + width
                tree[node] = key
                while node > 1:
                    node >>= 1
                    a, b = tree[2 * node], tree[2 * node + 1]
                    low = a if a < b else b
                    if tree[node] == low:
                        break
                    tree[node] = low
        left_over = np.array(symbols, dtype=np.int64)
        return left_over[left_over >= 0].astype("<u4").tobytes()

    def learn(self, tokens: Iterable[str], known: Memory) -> None:
        """Put the packed ids of different pre-tokens into ``known``, those of the short ones in common batches."""
        new = known.unknown(tokens)
        short: list[tuple[str, bytes]] = []
        for t in new:
            raw = t.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                known[t] = whole.to_bytes(4, "little")
            elif len(raw) > SHORT:
                known[t] = self.encode_long(raw)
            else:
                short.append((t, raw))
        known.update(zip([t for t, _ in short], self.encode_short([b for _, b in short]), strict=True))

    def encode(self, texts: list[str], known: Memory) -> Iterator[tuple[int, bytes]]:
        """``(index, packed ids)`` of each text in order; a very long text has several such blocks, an empty one a block of none."""
        if sum(map(len, texts)) <= 2 * WHOLE:
            split = [self.pattern.findall(t) for t in texts]
            self.learn((p for ps in split for p in ps), known)
            for i, ps in enumerate(split):
                yield i, b"".join(map(known.__getitem__, ps))
            return
        for i, text in enumerate(texts):
            found = (m[0] for m in self.pattern.finditer(text))
            while ps := list(islice(found, BLOCK)):
                self.learn(ps, known)
                yield i, b"".join(map(known.__getitem__, ps))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def rank_file(path: str) -> RankFile:
    """One per worker and file."""
    return RankFile(path)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs``; with ``ids`` also the ``ids`` themselves.

    Each match of the pattern is encoded by itself, as the tiktoken library does without special tokens; the ids
    are then decoded again. One pass, no shuffle; a task remembers what it found out about pre-tokens in bounded
    memory. A null or empty text has no tokens and the hashes of nothing; a very long text is split in blocks,
    and a long pre-token takes time by its length times the logarithm; repeated rows are encoded each; a null
    id stays null; other columns are not read; an empty table gives an empty table.
    """
    where = path or default_ranks()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known = rank_file(where), Memory(KNOWN)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            rows = [[0, hashlib.sha256(), hashlib.sha256(), []] for _ in range(len(texts))]
            for a, b in slices(pc.utf8_length(texts).to_pylist(), WHOLE):
                for i, packed in ranks.encode(texts.slice(a, b - a).to_pylist(), known):
                    row = rows[a + i]
                    row[0] += len(packed) // 4
                    row[1].update(packed)
                    row[2].update(ranks.decode(packed))
                    if ids:
                        row[3].append(packed)
            columns = [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].hexdigest() for r in rows]), pa.array([r[2].hexdigest() for r in rows])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                lists = [np.frombuffer(b"".join(r[3]), dtype="<u4").astype(np.int64) for r in rows]
                columns, names = [*columns, pa.array(lists, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>" if ids else "")
    return docs.select(id_col, text_col).mapInArrow(run, schema)
