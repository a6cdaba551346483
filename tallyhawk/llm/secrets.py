"""Secret scan: patterns, and a character convolutional network over every other candidate."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhawk.llm.common import slices
from tallyhawk.plans.session import cut

# Fixed values of the base findings: pattern, group that is measured, least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
ORDER = {"assign": 0, "access": 1, "hex": 2, "model": 3}
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
#: What the network looks at: every run of 12 and more characters of keys and tokens.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The base findings, ``(kind, start, end)`` in code points: leftmost matches of each kind, failing ones dropped."""
    out: list[Span] = []
    low = text.lower()
    for kind, pattern, group, least in BASE:
        if kind == "assign" and not any(w in low for w in _WORDS) or kind == "access" and "AKIA" not in text:
            continue
        # runs are maximal, so for hex only the long ones need be looked for
        for m in (_LONG_HEX if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CANDIDATE.finditer(text)]


class Covered:
    """Which stretches of a text a set of spans covers; a question costs the logarithm of their number."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted((s, e) for _, s, e in spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.ends) and self.starts[i] < end


#: Characters of context on either side; a value is seen whole, in pieces of PIECE that overlap by what a filter spans.
LEFT, RIGHT, PIECE, OVERLAP = 24, 10, 52, 4
#: Values beyond this are found like all others but not learnt from.
LEARNT = 4_096
_CLASSES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n\"':=+/_.-,;()<>@#$&*?!%[]{}|\\~^`\t"
_CODE = np.full(128, len(_CLASSES) + 1, dtype=np.uint8)
_CODE[[ord(c) for c in _CLASSES]] = np.arange(1, len(_CLASSES) + 1)
_CODE[0] = 0
_CAPITAL, _LETTER, _OTHER = range(len(_CLASSES) + 2, len(_CLASSES) + 5)
N_CODES = len(_CLASSES) + 5


def encode(strings: list[str]) -> np.ndarray:
    """Character classes: ASCII characters for themselves, beyond ASCII capitals, other letters and all else; 0 is nothing."""
    at = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")
    out = _CODE[np.minimum(at, 127)].copy()
    far = at > 127
    if far.any():
        known, inverse = np.unique(at[far], return_inverse=True)
        kind = [_CAPITAL if (c := chr(u)).isupper() else _LETTER if c.isalpha() else _OTHER for u in known.tolist()]
        out[far] = np.array(kind, dtype=np.uint8)[inverse]
    return out


@dataclass
class Seen:
    """Candidates as the network sees them: contexts, pieces of values and where each candidate's begin, lengths."""

    context: np.ndarray
    pieces: np.ndarray
    first: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str, str, str]]) -> Seen:
        """From what stands before, the value, and what stands after."""
        context = [(b[-LEFT:] if b else "").rjust(LEFT, "\0") + a[:RIGHT].ljust(RIGHT, "\0") for b, _, a in rows]
        pieces: list[str] = []
        first = []
        step = PIECE - OVERLAP
        for _, v, _ in rows:
            first.append(len(pieces))
            pieces += [v[k : k + PIECE].ljust(PIECE, "\0") for k in range(0, max(1, len(v) - OVERLAP), step)]
        return cls(encode(context).reshape(-1, LEFT + RIGHT), encode(pieces).reshape(-1, PIECE), np.array(first, dtype=np.int64), np.log2([max(1, len(v)) for _, v, _ in rows]) - 5)

    def take(self, at: np.ndarray) -> Seen:
        n = np.append(self.first[1:], len(self.pieces)) - self.first
        size = n[at]
        first = np.cumsum(size) - size
        rows = np.repeat(self.first[at] - first, size) + np.arange(int(size.sum()))
        return Seen(self.context[at], self.pieces[rows], first, self.length[at])

    def __len__(self) -> int:
        return len(self.first)


@dataclass
class CharNet:
    """Embedding, one convolution, maxima over the context and over the whole value, one hidden layer, one output.

    ``platt`` turns the output into a probability; ``threshold`` is the greatest that keeps the recall asked
    for on labelled findings that training did not see; ``recall`` is what it reaches on them.
    """

    params: dict[str, np.ndarray]
    platt: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5
    recall: float = 0.0

    @classmethod
    def new(cls, seed: int = 7, dim: int = 8, filters: int = 24, span: int = OVERLAP + 1, hidden: int = 24) -> CharNet:
        rng = np.random.default_rng(seed)
        shape = {"emb": (N_CODES, dim), "conv": (span * dim, filters), "conv_b": (filters,), "hid": (2 * filters + 1, hidden), "hid_b": (hidden,), "out": (hidden, 1), "out_b": (1,)}
        return cls({k: (rng.normal(0, 0.3 if k == "emb" else np.sqrt(2 / s[0]), s) * (not k.endswith("_b"))).astype(np.float32) for k, s in shape.items()})

    def _convolve(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.params
        span = len(p["conv"]) // p["emb"].shape[1]
        cols = np.lib.stride_tricks.sliding_window_view(p["emb"][x], span, axis=1).transpose(0, 1, 3, 2).reshape(len(x), x.shape[1] - span + 1, -1)
        return cols, np.maximum(cols @ p["conv"] + p["conv_b"], 0)

    def forward(self, x: Seen) -> tuple[np.ndarray, tuple]:
        p = self.params
        near, value = self._convolve(x.context), self._convolve(x.pieces)
        tops = near[1].max(1), np.maximum.reduceat(value[1].max(1), x.first, axis=0)
        pooled = np.concatenate([*tops, x.length[:, None].astype(np.float32)], 1)
        h = np.maximum(pooled @ p["hid"] + p["hid_b"], 0)
        return (h @ p["out"] + p["out_b"])[:, 0], (near, value, tops, pooled, h)

    def gradients(self, x: Seen, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.params
        logit, (near, value, tops, pooled, h) = self.forward(x)
        d = ((1 / (1 + np.exp(-logit)) - y) / len(y))[:, None].astype(np.float32)
        g = {"out": h.T @ d, "out_b": d.sum(0)}
        dh = (d @ p["out"].T) * (h > 0)
        g |= {"hid": pooled.T @ dh, "hid_b": dh.sum(0)}
        dp = (dh @ p["hid"].T) * (pooled > 0)
        filters = p["conv"].shape[1]
        owner = np.repeat(np.arange(len(x)), np.diff(np.append(x.first, len(x.pieces))))
        g |= {"conv": 0.0, "conv_b": 0.0, "emb": np.zeros_like(p["emb"])}
        for (cols, c), top, share, codes, of in ((near, tops[0], dp[:, :filters], x.context, np.arange(len(x))), (value, tops[1], dp[:, filters:-1], x.pieces, owner)):
            dc = (c == top[of][:, None]) * share[of][:, None]  # a maximum takes the gradient wherever it stands
            g["conv"] = g["conv"] + np.tensordot(cols, dc, ((0, 1), (0, 1)))
            g["conv_b"] = g["conv_b"] + dc.sum((0, 1))
            de = (dc @ p["conv"].T).reshape(len(codes), cols.shape[1], -1, p["emb"].shape[1])
            for k in range(de.shape[2]):
                np.add.at(g["emb"], codes[:, k : k + cols.shape[1]], de[:, :, k])
        return g

    def fit(self, x: Seen, y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        m, v, step = {k: 0 * a for k, a in self.params.items()}, {k: 0 * a for k, a in self.params.items()}, 0
        for epoch in range(epochs):
            order, pace = rng.permutation(len(x)), rate * (1 - epoch / epochs)
            for i in range(0, len(x), batch):
                rows, step = order[i : i + batch], step + 1
                for k, g in self.gradients(x.take(rows), y[rows]).items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.params[k] = self.params[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: Seen, y: np.ndarray, recall: float) -> None:
        logit = self.forward(x)[0]
        a, b = 1.0, 0.0
        for _ in range(300):  # Platt scaling by gradient steps
            e = 1 / (1 + np.exp(-(a * logit + b))) - y
            a, b = a - 0.5 * float(np.mean(e * logit)) / max(1.0, float(np.mean(logit * logit))), b - 0.5 * float(np.mean(e))
        self.platt = (a, b)
        hits = np.sort(self.probability(x)[y > 0])[::-1]
        at = float(hits[min(len(hits) - 1, int(np.ceil(recall * len(hits))) - 1)]) if len(hits) else 2.0
        self.threshold, self.recall = at, float(np.mean(hits >= at)) if len(hits) else 0.0

    def probability(self, x: Seen) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.forward(x)[0] + b, -35, 35)))


def _parts(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[max(0, start - LEFT) : start], text[start:end], text[end : end + RIGHT]


def looks_random(value: str) -> bool:
    """Letters and digits change often: in an unlabelled value that may be a secret, so it is no example of a plain one."""
    kinds = "".join("d" if c.isdigit() else "a" if c.isalpha() else "" for c in value)
    return len(kinds) >= 16 and sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) >= 4


#: Labels by rule: forms of secrets that the patterns do not know, with what may stand before them, and forms that
#: are long but no secrets. ``n`` gives a number below its argument.
def _drawn(n: Callable[[int], int], letters: str, least: int, most: int) -> str:
    return "".join(letters[n(len(letters))] for _ in range(least + n(most - least + 1)))


_LOW, _UP, _DIG = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_LEADS = ("key = ", "Bearer ", "auth: ", '"credential": "', "export SESSION=", "pw: ", "://user:", "sig=", "--key ", "X-Auth: ", "private ", "license ", "", " ", "\n", "(")


def secret_form(n: Callable[[int], int]) -> str:
    """A made-up secret of one of several forms."""
    match n(7):
        case 0:
            return _drawn(n, _LOW + _UP + _DIG, 20, 48)
        case 1:
            return _drawn(n, _LOW + _UP + _DIG + "+/", 22, 86) + "=" * n(3)
        case 2:
            return _drawn(n, _DIG + "ABCDEF", 24, 64)
        case 3:
            return _drawn(n, _LOW, 2, 4) + "_-"[n(2)] + _drawn(n, _LOW + _UP + _DIG, 20, 40)
        case 4:
            return ".".join(_drawn(n, _LOW + _UP + _DIG + "_-", 18, 40) for _ in range(3))
        case 5:
            return _drawn(n, _LOW + _DIG, 20, 40)
        case _:  # a base32 seed
            return _drawn(n, _UP + "234567", 26, 56)


def plain_form(n: Callable[[int], int]) -> str:
    """A made-up long run that is no secret: words in a row, numbers, and public identifiers."""
    word = lambda: _drawn(n, "aeiou", 1, 1) + _drawn(n, _LOW, 2, 8)
    match n(20):
        case 10:  # a UUID
            return "-".join(_drawn(n, (_LOW[:6], _UP[:6])[k % 2] + _DIG, size, size) for k in [n(8) // 7] for size in (8, 4, 4, 4, 12))
        case 11:  # a DOI
            return f"10.{1000 + n(90000)}/" + (f"{n(10**7)}.{n(10**7)}" if n(2) else f"{word()}.{n(10**6)}")
        case 12:  # an ISBN
            return f"97{8 + n(2)}-{n(10)}-{n(10**2):02d}-{n(10**6):06d}-{n(10)}"
        case 13:
            return "-".join(word() for _ in range(2 + n(4)))
        case 14 | 16 | 17 | 18 | 19:  # names of programs
            return "".join((word() if n(2) else _drawn(n, _LOW, 2, 6)).capitalize() + (str(n((10, 1000)[n(2)])) if n(3) else "") for _ in range(2 + n(4)))
        case 15:
            return "/".join(word() + (str(n(100)) if n(3) == 0 else "") for _ in range(2 + n(3))) + f".{_drawn(n, _LOW, 1, 4)}"
        case 9:
            return (word() + _drawn(n, _LOW, 10, 16)).upper()
        case 0:
            return ".".join(str(n(256)) for _ in range(4)).ljust(12, "0")
        case 1:
            return f"{word()}.{word()}{n(100)}.example.com"
        case 2:
            return "/".join(word() for _ in range(3 + n(3)))
        case 3:
            return f"20{n(10)}{n(10)}-{1 + n(9):02d}-{1 + n(28):02d}T{n(24):02d}"
        case 4:
            return _drawn(n, _DIG, 12, 20)
        case 5:
            return "_".join(word() for _ in range(2 + n(3)))
        case 6:
            return "".join(word().capitalize() for _ in range(2 + n(3)))
        case 7:
            return f"{word()}-{n(20)}.{n(20)}.{n(20)}-{word()}"
        case _:
            return word() + _drawn(n, _LOW, 10, 16)


def train(
    docs: DataFrame, *, text_col: str = "text", per_label: int = 3_000, made: int = 3_000, recall: float = 0.98
) -> CharNet | None:
    """A network learnt from labelled findings.

    Labels: candidates that a base finding covers are secrets; all others that do not look random are none (a
    value that looks random may be a secret that no pattern knows). All documents are looked at, so rare secrets
    are found in however large a corpus. Bound: of either label, and of plain words and other plain values, the
    ``per_label`` different candidates with the least hashes leave each task and are fetched. To these come
    ``made`` secrets and as many plain values of forms that the patterns do not know, before and after which
    stands what stands around plain candidates of the corpus, and a copy of each real secret with such a
    context, so that values count without a tell-tale word. A fourth of all that is kept for calibration.
    None if the documents hold no secret or no plain candidate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        best: list[dict[tuple[str, str, str], int]] = [{}, {}, {}]

        def least(of: dict) -> dict:
            return dict(sorted(of.items(), key=lambda r: (r[1], r[0]))[:per_label])

        for batch in batches:
            for text in batch.column("t"):
                if (text := text.as_py()) and (found := candidates(text)):
                    base = Covered(base_spans(text))
                    for s, e in found:
                        covered = base.meets(s, e)
                        if e - s <= LEARNT and (covered or not looks_random(text[s:e])):
                            w = _parts(text, s, e)
                            best[1 if covered else 0 if w[1].strip(".-=_/+").isalpha() else 2][w] = xxhash.xxh64_intdigest("\0".join(w).encode("utf-8", "surrogatepass"), 42) >> 1
                    best = [least(x) if len(x) > 4 * per_label else x for x in best]
        for y, x in enumerate(map(least, best)):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in x], pa.string()) for k in range(3)] + [pa.array([y] * len(x), pa.int32()), pa.array(list(x.values()), pa.int64())], ["b", "v", "a", "y", "h"])

    found = cut(docs.select(F.col(text_col).alias("t")).mapInArrow(run, "b string, v string, a string, y int, h long").distinct())
    rows = [tuple(r) for y in (0, 1, 2) for r in found.where(F.col("y") == y).orderBy("h", "v", "b", "a").limit(per_label).collect()]
    secret, plain = [r[:3] for r in rows if r[3] == 1], [r[:3] for r in rows if r[3] != 1]
    if not secret or not plain:
        return None
    rng = np.random.default_rng(7)
    n = lambda k: int(rng.integers(k))
    around = lambda: plain[n(len(plain))]
    masked = [((c := around())[0], v, c[2]) for _, v, _ in secret]
    new = [((c := around())[0] + (_LEADS[n(len(_LEADS))] if n(2) else ""), secret_form(n), c[2]) for _ in range(made)]
    usual = [((c := around())[0], plain_form(n), c[2]) for _ in range(made)]
    everything = secret + masked + new + plain + usual
    y = np.array([1.0] * (len(secret) + len(masked) + len(new)) + [0.0] * (len(plain) + len(usual)))
    x = Seen.of(everything)
    late = rng.random(len(y)) < 0.25
    if not (y[late] > 0).any() or not (y[~late] > 0).any():
        late = np.ones(len(y), dtype=bool)
    net = CharNet.new()
    taught = np.flatnonzero(~late) if not late.all() else np.arange(len(y))
    net.fit(x.take(taught), y[taught])
    net.calibrate(x.take(np.flatnonzero(late)), y[late], recall)
    return net


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda s: (s[1], ORDER[s[0]])))


def find(texts: list[str], net: CharNet | None) -> list[tuple[list[Span], list[Span], int]]:
    """Of each text the base spans, added spans, and how many candidates of base spans the network finds too.

    Every candidate is judged, whole. Added spans overlap no base span.
    """
    base = [base_spans(t) for t in texts]
    covered = [Covered(b) for b in base]
    all_ = [(i, s, e) for i, t in enumerate(texts) for s, e in candidates(t)] if net else []
    more: list[list[Span]] = [[] for _ in texts]
    agreed = [0] * len(texts)
    for lo, hi in slices([1 + (e - s) // PIECE for _, s, e in all_], 512):
        part = all_[lo:hi]
        for (i, s, e), p in zip(part, net.probability(Seen.of([_parts(texts[i], s, e) for i, s, e in part])), strict=True):
            if p >= net.threshold:
                if covered[i].meets(s, e):
                    agreed[i] += 1
                else:
                    more[i].append(("model", s, e))
    return list(zip(base, more, agreed, strict=True))


def in_parts(texts: pa.Array, net: CharNet | None) -> list[tuple[list[Span], list[Span], int]]:
    texts = pc.fill_null(texts, "")
    return [x for a, b in slices(pc.utf8_length(texts).to_pylist(), 1_000_000) for x in find(texts.slice(a, b - a).to_pylist(), net)]


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", net: CharNet | None = None, redact: bool = False) -> DataFrame:
    """Secrets of every row of ``docs``: ``doc_id``, counts by kind, ``base_sha256``, ``spans``, ``n_model`` and ``n_agreed``.

    ``spans`` are the base's and those that the network adds; ``n_agreed`` counts candidates of base spans that
    it finds as well.

    With ``redact`` the result is ``docs`` itself with the found spans of the text replaced by
    ``[SECRET:kind]`` (overlapping spans as one, named by the first) and ``n_chars``, if there, counted anew.
    ``net`` is learnt from ``docs`` when not given. One pass without a shuffle after training. A null or empty
    text has no spans (and stays null when redacting); a very long text, and a value of any length in it, is
    scanned whole; repeated rows are scanned each; columns other than the two named are not read (and kept as
    they are, whatever their names, when redacting); an empty table gives an empty table.
    """
    net = net or train(docs, text_col=text_col)
    held = docs.sparkSession.sparkContext.broadcast(net)
    if redact:
        names = docs.columns

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(text_col).to_pylist()
                out = [t if t is None else redacted(t, [*b, *m]) for t, (b, m, _) in zip(texts, in_parts(batch.column(text_col), held.value), strict=True)]
                cols = {n: batch.column(n) for n in names} | {text_col: pa.array(out, pa.string())}
                if "n_chars" in names:
                    sizes = [n if t == u else len(t) for n, t, u in zip(batch.column("n_chars").to_pylist(), out, texts, strict=True)]
                    cols["n_chars"] = pa.array(sizes, batch.column("n_chars").type)
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

        return docs.mapInArrow(rewrite, docs.schema)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = in_parts(batch.column(1), held.value)
            count = lambda k: pa.array([sum(s[0] == k for s in b) for b, *_ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), count("assign"), count("access"), count("hex"), pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, *_ in found], pa.string()),
                 pa.array([joined([*b, *m]) for b, m, _ in found], pa.string()), pa.array([len(m) for _, m, _ in found], pa.int64()), pa.array([n for *_, n in found], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model", "n_agreed"],
            )

    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long, n_agreed long"
    )


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each stretch covered by spans replaced by ``[SECRET:kind]`` of its first span."""
    out, at, reach = [], 0, -1
    for kind, start, end in sorted(spans, key=lambda s: (s[1], ORDER[s[0]])):
        if start >= reach:
            out += [text[at:start], f"[SECRET:{kind}]"]
            at = reach = end
        else:
            at = reach = max(reach, end)
    return "".join([*out, text[at:]])
