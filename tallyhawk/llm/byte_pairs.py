"""Pre-tokens and byte-pair merges of a byte-level vocabulary file."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from tallyhawk.llm.common import Memory

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The characters that the library takes for white space (Unicode's White_Space; Python's own \s has four more).
SPACE = r"\t\n\v\f\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NONE = np.int64(1) << 40


class Vocabulary:
    """A tokenizers file with the merges as arrays. It holds no texts."""

    def __init__(self, path: str) -> None:
        import regex
        from public_tokenizers import PATTERN
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], NONE)
        self.rank = np.append(order, NONE)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.made = made
        from tokenizers.pre_tokenizers import ByteLevel

        visible = {c for c in ByteLevel.alphabet()}
        shift = iter(range(256, 512))
        letters = [chr(b) if chr(b) in visible and (33 <= b <= 126 or b >= 161) else chr(next(shift)) for b in range(256)]
        self.byte_ids = np.array([vocab[c] for c in letters], dtype=np.int64)
        # the same vocabulary as ranks: encodes whole texts several times faster, with the same ids (tested)
        import tiktoken

        raw = {c: b for b, c in enumerate(letters)}
        ranks = {bytes(map(raw.__getitem__, t)): i for t, i in vocab.items() if t not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        own = PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.pattern = regex.compile(own)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The library's pre-tokens of a whole text, and how many special tokens stand between them."""
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text), 0
        parts = self.special.split(text)
        return [t for part in parts for t in self.pattern.findall(part)], len(parts) - 1

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of neighbours; NONE for those that do not merge."""
        key = (left << 20) | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def count_merged(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left in each pre-token after all merges: rank-synchronous, on ragged arrays.

        In each round every sequence finds its lowest-ranked adjacent pair and merges all its places (from
        the left, without overlap) at once; sequences without a pair are done and leave the arrays. Ranks are
        looked up anew only where a merge has changed a neighbour.
        """
        left = np.zeros(len(tokens), dtype=np.int64)
        size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        live = np.flatnonzero(size)
        symbols = self.byte_ids[np.frombuffer(b"".join(tokens), dtype=np.uint8)]
        size = size[live]
        rank = self._ranks(symbols, np.append(symbols[1:], 0)[: len(symbols)])
        rank[np.cumsum(size) - 1] = NONE
        while len(live):
            start = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, start)
            done = low == NONE
            left[live[done]] = size[done]
            hit = rank == np.repeat(np.where(done, -1, low), size)
            # of overlapping places (aaa) take the 1st, 3rd ... of each unbroken run
            first = hit & ~np.append(False, hit[:-1])
            place = np.arange(len(hit))
            hit &= (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0
            where = np.flatnonzero(hit)
            symbols[where] = self.made[rank[where]]
            keep = np.repeat(~done, size)
            keep[where + 1] = False
            size = (size - np.add.reduceat(hit.astype(np.int64), start))[~done]
            live = live[~done]
            changed = (np.cumsum(keep) - 1)[where]
            symbols, rank = symbols[keep], rank[keep]
            ends = np.zeros(len(symbols), dtype=bool)
            ends[np.cumsum(size) - 1] = True
            near = np.concatenate([changed, changed[changed > 0] - 1])
            rank[near] = NONE
            near = near[~ends[near]]
            rank[near] = self._ranks(symbols[near], symbols[near + 1])
        return left

    def token_counts(self, texts: list[str], known: Memory, block: int = 50_000) -> list[int]:
        """Tokens of each text; ``known`` remembers the sizes of pre-tokens."""
        split = [self.pre_tokens(t) for t in texts]
        new = known.unknown(t for ts, _ in split for t in ts)
        for i in range(0, len(new), block):
            part = new[i : i + block]
            known.update(zip(part, self.count_merged([t.encode() for t in part]).tolist(), strict=True))
        return [n + sum(map(known.__getitem__, ts)) for ts, n in split]

    def token_ids(self, text: str) -> np.ndarray:
        """Token ids of a whole text, equal to the library's."""
        return self.fast.encode_to_numpy(text, allowed_special="all")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker and file."""
    return Vocabulary(path)
