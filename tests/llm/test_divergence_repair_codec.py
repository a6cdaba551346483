"""Source divergence, conversation repair and the byte-pair codec against plain versions, and on odd rows."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallyhawk.llm import bpe_codec, conversation_repair, divergence
from tallyhawk.llm.common import Memory
from tests.oracle import same_rows


# ---- source divergence


def plain_audit(rows: list[tuple], least: int = 10) -> set[tuple]:
    lower = {c: c + 32 for c in range(65, 91)}
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower)), lang or "", source or "") for t, lang, source in rows]
    out = set()
    for lang in {d[1] for d in docs}:
        df = collections.Counter(t for ts, g, _ in docs if g == lang for t in set(ts))
        kept = {t for t, n in df.items() if n >= least}
        counts = {s: collections.Counter() for _, g, s in docs if g == lang}
        for ts, g, s in docs:
            if g == lang:
                counts[s].update(t for t in ts if t in kept)
        share = lambda c, n: 1 + 1_000_000_000 * (c + 2) // (n + 2 * len(kept))
        total = sum(counts.values(), collections.Counter())
        for s, c in counts.items():
            n = sum(c.values())
            found = {"pair": [], "term": []}
            for o, d in counts.items():
                if o != s:
                    ps = [(share(c[t], n), share(d[t], sum(d.values()))) for t in kept]
                    found["pair"].append((-sum((p - q) ** 2 // (p + q) for p, q in ps), o.encode()))
            for t in kept:
                p, q = share(c[t], n) if kept else 0, share(total[t], sum(total.values()))
                if c[t] and p > q:
                    found["term"].append((-((p - q) ** 2 // (p + q)), t.encode()))
            for part, values in found.items():
                for rank, (v, item) in enumerate(sorted(values), 1):
                    if part == "pair" or rank <= 10:
                        out.add((lang, s, part, item.decode(), -v, rank))
    return out


def test_divergence_against_plain(spark):
    rng = random.Random(5)
    words = ["Alpha", "alpha", "ALPHA,", "beta", "beta-gamma", "gamma.", "Ünïcode", "naïve", "x1y", "日本語", "İ", "end\x00mark", "tab\x0bbed", "nb\xa0sp"] + [f"w{chr(97 + i)}" for i in range(20)] + [f"(w{chr(97 + i)})" for i in range(20)]
    rows = []
    for i in range(400):
        lang = rng.choice(["en", "en", "en", "de", None, "one"])
        source = "only" if lang == "one" else rng.choice(["a", "b", "c", "é", None])
        few = words if i % 3 else words[: 8 + i % 5]
        rows.append((" ".join(rng.choice(few) + (str(i) if rng.random() < 0.1 else "") for _ in range(rng.randint(0, 12))) if rng.random() > 0.03 else None, lang, source))
    rows += [("", "empty", "a"), (None, "empty", "b"), ("rare words", "short", "a")] + [("same text again", "rep", "a")] * 12
    # a word whose single forms are in fewer documents than the word
    rows += [((f"open{c}" if i % 2 else f"Open{c}") + (" more" if i % 3 else " more more"), "split", "a" if i % 3 else "b") for i, c in enumerate(".,;:!?()[]{}")]
    docs = spark.createDataFrame([(i % 7, *r, 0, "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, term string")
    got = {tuple(r) for r in divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect()}
    expected = plain_audit(rows)
    assert got == expected
    assert any(r[0] == "split" and r[3] == "open" for r in got) and any(r[2] == "pair" and r[4] == 0 for r in got)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_flushes_and_shuffles(spark, monkeypatch):
    rows = [(f"a{i % 3} common x{i % 2}", "en", f"s{i % 4}") for i in range(80)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    once = {tuple(r) for r in divergence.audit(docs).collect()}
    monkeypatch.setattr(divergence, "HELD_WORDS", 3)
    monkeypatch.setattr(divergence, "HELD_USES", 2)
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(divergence, "PAIRS", 1)
    assert {tuple(r) for r in divergence.audit(docs).collect()} == once and once


# ---- conversation repair


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str, str]:
    """All edits by plain recursion from the right, of (role, fault, text) rows."""
    step = conversation_repair.STEP
    best: dict[tuple[int, int], tuple] = {}
    for i in range(len(rows), -1, -1):
        own = {}
        for s in range(4):
            options = [(0, "", ())] if i == len(rows) and s in (0, 3) else []
            if i < len(rows):
                role, fault, text = rows[i]
                c, a, o = best[i + 1, s]
                options.append((c + 3, "D" + a, o))
                if fault in ("", "truncated"):
                    more = fault == "truncated"
                    for edit, cost, letter, as_role in (("K", 0, role[:1], role), ("R", 2, "u", "user"), ("R", 2, "a", "assistant")):
                        if (s, letter) in step:
                            c, a, o = best[i + 1, step[s, letter]]
                            options.append((c + cost + more, edit + a, (f"{as_role}:{text}", *o)))
            own[s] = min(options, default=(10**9, "", ()))
        for _ in range(3):  # insertions at this place
            for s in range(4):
                for letter, name in (("u", "user:"), ("a", "assistant:")):
                    if (s, letter) in step:
                        c, a, o = own[step[s, letter]]
                        own[s] = min(own[s], (c + 2, "I" + a, (name, *o)))
        best |= {(i, s): own[s] for s in range(4)}
    cost, audit, out = best[0, 0]
    return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain_repair(turns: list[tuple]) -> dict:
    convs = collections.defaultdict(list)
    for key, turn, role, text in turns:
        convs[key].append((turn, role if role is not None else " ", text if text is not None else " "))
    out = {}
    for key, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, marked, faults = set(), [], collections.Counter()
        for _, role, text in rows:
            bare = text.rstrip(conversation_repair.SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            marked.append((role, fault, text))
        times = [t for t, *_ in rows if t is not None]
        gaps = max(times) - min(times) + 1 - len(set(times)) if times else 0
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        out[key] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, *cheapest(marked))
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(df) -> dict:
    return {r["conv_id"]: tuple(r[n] for n in NAMES) for r in df.collect()}


def some_turns(seed: int, convs: int, most: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for k in range(convs):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "ultra", None])
            text = rng.choice(["Hi.", "ok!", "cut off", "", " \t\n", "Why?", "Hi.", "é…", None, "a.\x0b", "x" * 50])
            rows.append((k if k else None, rng.choice([t, t, t, t + 2, None]), role, text))
    return rows


@pytest.mark.parametrize("sequence", [conversation_repair.SEQUENCE, 1, 3])
def test_repair_against_plain(spark, monkeypatch, sequence):
    rows = some_turns(11, 300, 9)
    monkeypatch.setattr(conversation_repair, "SEQUENCE", sequence)
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string")
    got = repaired(conversation_repair.repair(turns, damaged=True))
    expected = plain_repair(rows)
    assert {k for k in expected if got.get(k) != expected[k]} == set() and len(got) == len(expected)


def test_repair_of_long_conversations(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"text {t % 50}." if t % 7 else "open end") for t in range(6_000)] + [(2, 0, "user", "y" * 1_000_000 + ".")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert repaired(conversation_repair.repair(turns, damaged=True)) == plain_repair(rows)
    assert conversation_repair.repair(turns.limit(0)).count() == 0


def test_repaired_texts(spark):
    rows = [("c", 0, "assistant", "Hello."), ("c", 1, "user", "Yes.")]
    turns = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    row = conversation_repair.repair(turns, damaged=True, texts=True).first()
    assert row["audit"] == "DKI" or row["cost"] == 4
    assert row["repaired_sha256"] == hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in row["repaired"]).encode()).hexdigest()


def test_damage_has_sql(spark, tmp_path):
    from tallyhawk.llm import queries

    rows = [r for r in some_turns(3, 200, 7) if r[1] is not None]
    pq.write_table(pa.table({n: pa.array(c, t) for n, c, t in zip(("conv_id", "turn", "role", "text"), zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)}), f"{tmp_path}/conversations.parquet")
    same_rows(queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path)), queries.ORACLE["op12_conversation_repair"], str(tmp_path))


def test_grammar_gives_the_sequences_back():
    rng = random.Random(1)
    sequences = [bytes(rng.choice(b"ABEFIJ") for _ in range(rng.randint(0, 30))) for _ in range(200)] + [b"A" * 500, b"AB" * 300]
    rules, tops = conversation_repair.re_pair(sequences)

    def read(code: int) -> bytes:
        return bytes([code + conversation_repair.FIRST]) if code < 16 else read(rules[code - 16][0]) + read(rules[code - 16][1])

    assert [b"".join(map(read, top)) for top in tops] == sequences
    pairs = collections.Counter(p for top in tops for p in zip(top, top[1:], strict=False))
    assert max(pairs.values(), default=0) <= 2  # only overlapping places are left


def test_ropes_compare_as_texts():
    rng, ropes = random.Random(2), conversation_repair.Ropes()
    made = [(ropes.text(t), t) for t in ("", "D", "I", "K", "R")]
    for _ in range(800):
        (a, s), (b, t) = rng.choice(made), rng.choice(made[-30:])
        if len(s + t) < 400:
            made.append((ropes.join(a, b), s + t))
    for _ in range(4000):
        (a, s), (b, t) = rng.choice(made), rng.choice(made)
        assert ropes.read(a) == s and ropes.less(a, b) == (s < t)


# ---- byte pairs


@pytest.fixture(scope="module")
def ranks():
    return bpe_codec.rank_file(bpe_codec.default_ranks())


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def ids_of(ranks, texts: list[str]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in texts]
    known = Memory()
    for i, packed in ranks.encode(texts, known):
        out[i] += np.frombuffer(packed, "<u4").tolist()
    return out


def test_codec_equals_the_library(ranks, library):
    rng = random.Random(3)
    parts = ["a", "e", "th", "ing", " ", "\n", "é", "日", "1", "22", ".", ",", "'s", "͸", "😀", "ß", "\xa0", "Q", "\x1c", " ", "<|endoftext|>"]
    texts = ["", "a", "a" * 1000, "日本語" * 50, "   x", "x" * 63, "x" * 64, "x" * 65, "ab" * 40 + "é" * 30] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    assert ids_of(ranks, texts) == [library.encode_ordinary(t) for t in texts]


def test_codec_rows(spark, library):
    texts = [None, "", "one", "one", "nul\x00here", "don't <|endoftext|>", "word " * 60_000, "naïve line"]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = bpe_codec.round_trip(docs, ids=True).collect()
    assert len(got) == len(texts) and bpe_codec.round_trip(docs.limit(0)).count() == 0
    for r, t in zip(sorted(got, key=lambda r: 3 if r["doc_id"] is None else r["doc_id"]), texts, strict=True):
        ids = library.encode_ordinary(t or "")
        assert (r["n_tokens"], r["ids"]) == (len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_codec_on_one_long_pre_token(ranks, library):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh") for _ in range(200_000))
    start = time.monotonic()
    packed = ranks.encode_long(text.encode())
    assert time.monotonic() - start < 20
    assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)


def test_codec_in_blocks(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe_codec, "WHOLE", 10)
    monkeypatch.setattr(bpe_codec, "BLOCK", 3)
    texts = ["one two three four five six seven", "", "x"]
    assert ids_of(ranks, texts) == [library.encode_ordinary(t) for t in texts]
