"""The operators against plain Python on the smallest tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from tallyhawk.llm import byte_pairs, embed_dedup, near_dup, packing, queries, secrets
from tallyhawk.llm.common import Memory
from tests.oracle import same_rows

FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(name, spark, sf):
    same_rows(queries.QUERIES[name](spark, sf), queries.ORACLE[name], sf)


def test_op1_base_spans(spark, sf, texts):
    def spans(t: str) -> str:
        out = []
        word = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        for k, (kind, p, g, n) in enumerate((("assign", word, 1, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))):
            out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, t) if len(m[g]) >= n]
        return ",".join(s for *_, s in sorted(out))

    for r in queries.op1_secrets(spark, sf).collect():
        base = spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def words(rng, n: int) -> str:
    return " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 15)))) for _ in range(n))


@pytest.fixture(scope="module")
def network(spark, sf):
    return secrets.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_op1_finds_secrets_of_forms_no_pattern_knows(network):
    """Held-out secrets (another seed, no key words, two forms that training has not) in running text."""
    rng = np.random.default_rng(1234)
    n = lambda k: int(rng.integers(k))
    made = [secrets.secret_form(n) for _ in range(300)]
    made += ["glx-" + secrets._drawn(n, "abcdefghijkmnpqrstuvwxyz23456789", 28, 36) + "=" for _ in range(50)] + ["/".join(secrets._drawn(n, "abcXYZ0123456789klmnQRS", 10, 14) for _ in range(3)) for _ in range(50)]
    plain = [secrets.plain_form(n) for _ in range(400)]
    leads = ["see ", "value ", "it was ", "then ", "id "]
    texts = [f"{words(rng, 6)} {leads[n(5)]}{v} {words(rng, 6)}" for v in made + plain]
    at = [t.index(v) for t, v in zip(texts, made + plain, strict=True)]
    found = secrets.find(texts, network)
    hit = [any(s < a + len(v) and a < e for _, s, e in [*b, *m]) for (b, m, _), a, v in zip(found, at, made + plain, strict=True)]
    added = sum(len(m) for _, m, _ in found[:400])
    assert np.mean(hit[:400]) >= 0.9 and added > 200
    assert np.mean(hit[400:]) <= 0.05 and network.recall >= 0.98
    clean = [words(rng, 200) for _ in range(50)]
    assert sum(len(m) for _, m, _ in secrets.find(clean, network)) <= 10


def test_op1_judges_long_values_whole(network):
    """What tells a value may stand anywhere in it, and pieces are seen as if the value were one."""
    value = "q" * 300 + "7fK2x9QmZ4tR8wLpV3nB6cYd" + "q" * 300
    net = secrets.CharNet.new()
    a, b = net.forward(secrets.Seen.of([("", value, "")]))[0], net.forward(secrets.Seen.of([("", "q" * 624, "")]))[0]
    assert a != b
    rows = [("x = ", "a1" * k, " y") for k in (6, 26, 50, 51, 52, 53, 100, 333)]
    together = net.forward(secrets.Seen.of(rows))[0]
    alone = [net.forward(secrets.Seen.of([r]))[0][0] for r in rows]
    assert np.allclose(together, alone, rtol=1e-4)


def test_op1_gradients():
    rng = np.random.default_rng(3)
    rows = [(words(rng, 3), secrets.secret_form(lambda k: int(rng.integers(k))), " b") for _ in range(6)]
    x, y, net = secrets.Seen.of(rows), np.array([0.0, 1, 0, 1, 1, 0]), secrets.CharNet.new()
    net.params = {k: v.astype(float) for k, v in net.params.items()}
    loss = lambda: float(np.mean(np.logaddexp(0, z := net.forward(x)[0]) - y * z))
    g = net.gradients(x, y)
    for k in ("conv", "hid", "out", "emb"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        before = net.params[k][at]
        net.params[k][at] = before + 1e-5
        up = loss()
        net.params[k][at] = before - 1e-5
        assert math.isclose((up - loss()) / 2e-5, g[k][at], rel_tol=2e-2, abs_tol=1e-6), k
        net.params[k][at] = before


def test_op1_learns_from_rare_findings(spark):
    from pyspark.sql import functions as F

    docs = spark.range(40_000).withColumnRenamed("id", "doc_id")
    late = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) >= 1 << 19  # what a sample by this hash leaves out
    secret = F.concat(F.lit("password = "), F.sha2(F.col("doc_id").cast("string"), 224))
    plain = F.concat(F.lit("see build/step-2024-"), F.col("doc_id"))
    net = secrets.train(docs.select("doc_id", F.when(late & (F.col("doc_id") % 400 == 0), secret).otherwise(plain).alias("text")))
    assert net is not None and 0 < net.recall <= 1


def test_op2_base_score(spark, sf, texts):
    toks = {i: re.findall(rb"[^\x20\x09-\x0d]+", t.encode().translate(FOLD)) + ["end"] for i, t in texts.items()}
    c = collections.Counter(w for i, ws in toks.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    total, different = sum(c.values()), len(c)
    for r in queries.op2_suffix_tree(spark, sf).collect():
        ws = toks[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), total)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (total + different + 1)) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0


def test_op2_beats_the_base_on_held_out_texts(spark):
    rows = queries.op2_suffix_tree(spark, "/root/testdata/sf0.01").where("held_out").collect()
    n = sum(r["n_tokens"] for r in rows)
    assert sum(r["score"] for r in rows) / n > sum(r["base_score"] for r in rows) / n + 0.2


def test_op2_root_sums_to_one(spark, sf):
    from tallyhawk.llm import suffix_tree as S

    root = S.count_words(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text", 7, 2)
    slots = root.different - len(root.head) - 1 + 1
    p = 10.0**root.logp
    assert math.isclose(p[:-1].sum() + slots * p[-1], 1, rel_tol=1e-9)


@pytest.mark.parametrize("hot", [10**9, 40])
def test_op2_states_against_plain_counts(spark, monkeypatch, hot):
    """All contexts counted, tested and applied one by one."""
    from tallyhawk.llm import suffix_tree as S

    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "GROUP", 500)
    rng = np.random.default_rng(5)
    common, rare = list("abcde"), [f"r{i}" for i in range(120)]
    texts = [" ".join(rng.choice(common if rng.random() < 0.7 else rare) for _ in range(int(rng.integers(0, 40)))) for _ in range(150)]
    texts += texts[:20] + [t + " a b c d a b c e" for t in texts[20:40]] + ["", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    seqs = [t.encode().split() + ["end"] for t in texts]
    taught = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    c = collections.Counter(w for s, t in zip(seqs, taught, strict=True) if t for w in s)
    total, different = sum(c.values()), len(c)
    z = total + different + 1
    often = {w for w in c if c[w] >= 2 and w != "end"}
    slots = different - len(often) - 1 + 1
    rest = total - sum(c[w] for w in often) - c["end"]

    def root(w):
        return (c[w] + 1) / z if w in often or w == "end" else (rest + slots) / slots / z

    def contexts(s, i):
        w = [s[i - k] if i >= k else None for k in range(1, 5)]
        warm = [x is None or c[x] > hot for x in w]
        all_ = [(1, w[0]), (2, w[0], w[1]), (4, *w)]
        return all_[0 if not warm[0] else 1 if not warm[1] else 2 :]

    n = collections.defaultdict(collections.Counter)
    shorter = {}
    for s, t in zip(seqs, taught, strict=True):
        for i in range(1, len(s)):
            cs = contexts(s, i)
            for k, x in enumerate(cs):
                shorter[x] = cs[k - 1] if k else None
                if t:
                    n[x][s[i]] += 1
    import functools

    @functools.lru_cache(None)
    def p(x, w):
        if x is None:
            return root(w)
        up = p(shorter[x], w)
        return (n[x][w] + kinds(x) * up) / (n[x].total() + kinds(x)) if state(x) else up

    def kinds(x):
        return sum(m > 0 for m in n[x].values())

    @functools.lru_cache(None)
    def state(x):
        whole = n[x].total()
        gain = 0.0
        for w, m in n[x].items():
            if m:
                up, others = p(shorter[x], w), kinds(x) - (m == 1)
                left = (m - 1 + others * up) / (whole - 1 + others) if whole - 1 + others else 0
                gain += m * math.log(max(left, 1e-300) / up)
        return whole >= 2 and gain > 0

    got = {r["doc_id"]: r["score"] for r in S.score_texts(docs).collect()}
    states = 0
    for d, s in enumerate(seqs):
        expected = math.log10(root(s[0])) + sum(math.log10(p(contexts(s, i)[-1], s[i])) for i in range(1, len(s)))
        states += sum(state(contexts(s, i)[-1]) for i in range(1, len(s)))
        assert math.isclose(got[d], expected, rel_tol=1e-6), d
    assert states > 100


def test_op2_frequent_words_are_contexts(spark, monkeypatch):
    """All contexts, those of a word of more than 200,000 occurrences too, counted, tested and applied one by one."""
    from tallyhawk.llm import suffix_tree as S

    for name, x in (("SPLIT", 4_000), ("GROUP", 50_000), ("NEXT_GROUP", 20_000)):
        monkeypatch.setattr(S, name, x, raising=False)
    rng = np.random.default_rng(6)
    common, rare = list("aaaaabbc"), [f"r{i}" for i in range(40)]
    texts = ["one text begins like all " + " ".join(rng.choice(common if rng.random() < 0.9 else rare) for _ in range(100)) for _ in range(60)]
    texts = [" ".join(rng.permutation(texts[i % 60].split()[5:])) if i % 9 == 0 else texts[i % 60] + f" z{i % 700} a a a a b" for i in range(4_600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    seqs = [[*t.split(), "end"] for t in texts]
    taught = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    c = collections.Counter(w for s, t in zip(seqs, taught, strict=True) if t for w in s)
    assert c["a"] > 200_000
    z = c.total() + len(c) + 1
    shorter, n = {}, collections.defaultdict(collections.Counter)

    def contexts(s, i):
        w = [s[i - k] if i >= k else None for k in range(1, 5)]
        return (w[0],), (w[0], w[1]), (*w,)

    for s, t in zip(seqs, taught, strict=True):
        for i in range(1, len(s)):
            x1, x2, x4 = contexts(s, i)
            shorter |= {x1: None, x2: x1, x4: x2}
            for x in (x1, x2, x4):
                n[x][s[i]] += t
    state, p, kinds, whole = {}, {}, {}, {}
    often = {w for w in c if c[w] >= 2 and w != "end"}
    slots = len(c) - len(often)
    rest = c.total() - sum(c[w] for w in often) - c["end"]
    p[None] = {w: (c[w] + 1) / z if w in often or w == "end" else (rest + slots) / slots / z for s in seqs for w in s}
    for x in sorted(n, key=len):
        up, kinds[x], whole[x] = p[shorter[x]], sum(m > 0 for m in n[x].values()), n[x].total()
        gain = 0.0
        for w, m in n[x].items():
            if m:
                others = kinds[x] - (m == 1)
                gain += m * math.log(max((m - 1 + others * up[w]) / max(whole[x] - 1 + others, 1e-9), 1e-300) / up[w])
        state[x] = whole[x] >= 2 and gain > 0
        p[x] = {w: (m + kinds[x] * up[w]) / (whole[x] + kinds[x]) if state[x] else up[w] for w, m in n[x].items()}
    assert state["a",] and state["a", "a"]
    got = {r["doc_id"]: r["score"] for r in S.score_texts(docs).collect()}
    for d, s in enumerate(seqs):
        expected = math.log10(p[None][s[0]]) + sum(math.log10(p[contexts(s, i)[-1]][s[i]]) for i in range(1, len(s)))
        assert math.isclose(got[d], expected, rel_tol=1e-6), d


def test_op3_round_trip(spark, sf, texts):
    lib = library()
    ids = {i: lib.encode(t, add_special_tokens=False).ids + [0] for i, t in texts.items()}
    rows = queries.op3_packing(spark, sf).collect()
    at = collections.defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    for pieces in at.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024


def test_op3_patterns_place_everything():
    rng = np.random.default_rng(1)
    for size in (8, 64, 1024):
        lengths, counts = np.unique(rng.integers(1, size + 1, 5000), return_counts=True)
        h = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
        got = collections.Counter()
        for parts, n in packing.patterns_of(h, size):
            assert sum(parts) <= size
            for p in parts:
                got[p] += n
        assert got == h
    assert packing.patterns_of({}, 8) == []
    # one copy a pack: both packs of 5 get a 2 before either gets a second
    assert sorted((sorted(x), n) for x, n in packing.patterns_of({5: 2, 2: 2}, 9)) == [([2, 5], 2)]


def test_op3_packs_tightly(spark):
    rows = queries.op3_packing(spark, "/root/testdata/sf0.01").groupBy("sequence_id").sum("length").collect()
    assert sum(r[1] for r in rows) >= 0.97 * 1024 * len(rows)


def test_op5_matches_library(spark, sf, texts):
    lib = library()
    for r in queries.op5_token_counts(spark, sf).collect():
        t = texts[r["doc_id"]]
        assert r["n_tokens"] == len(lib.encode(t, add_special_tokens=False).ids) and r["n_bytes"] == len(t.encode())


def test_op5_odd_texts():
    vocab = byte_pairs.vocabulary(queries.token_counts.default_vocabulary())
    odd = ["", " ", "  ", "a  b", "a \n b", "foo\n \t bar", "x <|endoftext|> y", "<|endoftext|><|endoftext|>", "aaaaaaaaaaaaa", "\n\n x \n\n", "don't we'll I'd", "日本語 テスト", "x\x1c y", " \tq", "a b ", "a\xa0b \xa0", "é" * 500, "a" * 3000, "  x", "\x85 a"]
    rng = np.random.default_rng(8)
    signs = [" ", "  ", "\n", "\t", "a", "b", "é", "1", ".", "'s", "\x1c", "\x1f", "\x85", "\xa0", "\u2009", "\u3000", "\u200b", "日", "<|endoftext|>", "<|endof", "\u0301", "²"]
    odd += ["".join(rng.choice(signs, int(rng.integers(1, 20)))) for _ in range(1500)]
    lib = library()
    expected = [lib.encode(t, add_special_tokens=False).ids for t in odd]
    assert vocab.token_counts(odd, Memory()) == [len(e) for e in expected]
    assert vocab.token_counts(odd, Memory(0)) == [len(e) for e in expected]
    assert [vocab.token_ids(t).tolist() for t in odd] == expected


def test_op6_links(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 64))
    v = np.concatenate([centres[rng.integers(0, 30, 400)] + 0.12 * rng.normal(size=(400, 64)), rng.normal(size=(100, 64))]).astype(np.float32)
    labels = rng.integers(0, 2, 500)
    df = spark.createDataFrame([(i, [float(c) for c in x], int(y)) for i, (x, y) in enumerate(zip(v, labels, strict=True))], "vec_id long, embedding array<float>, label int")
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    linked = (u @ u.T >= 0.98) & (labels[:, None] == labels[None])
    np.fill_diagonal(linked, False)
    got = {r["vec_id"]: r for r in embed_dedup.link_counts(df).collect()}
    found = sum(r["n_links"] for r in got.values())
    assert linked.sum() > 500 and found >= 0.99 * linked.sum() and all(got[i]["n_links"] <= linked[i].sum() for i in got)


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 8)) * 2
    best = embed_dedup.decode_e8(x)
    d = ((x - best / 2) ** 2).sum(1)
    for n in embed_dedup.NEIGHBOURS:
        assert (d <= ((x - (best + n) / 2) ** 2).sum(1) + 1e-9).all()
    assert len(embed_dedup.NEIGHBOURS) == 240 and set((embed_dedup.NEIGHBOURS**2).sum(1)) == {8}


def test_op9_held_out_and_inputs(spark, sf):
    rows = queries.op9_quality(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_op9_learns(spark):
    d = spark.createDataFrame([(i, ("fine words of prose number " if i % 2 else "BUY!! NOW!! $$$ ### ") * (1 + i % 5)) for i in range(400)], "doc_id long, text string")
    y = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    rows = queries.quality.classify(d, y).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in rows if r["held_out"])


def test_op9_scores_against_plain_ftrl(spark, sf, texts):
    """Coordinates one by one, in dictionaries."""
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    q, memory, bits = queries.quality, queries.quality.Words(), 18
    seen = {}
    for i, y in labels:
        if i in texts:
            at, x = q.features(texts[i], bits, memory)
            x = x.astype(np.float32).astype(float)
            seen[str(i), y, tuple(at.tolist())] = list(zip(at.tolist(), x.tolist(), strict=True)), (zlib.crc32(str(i).encode()), str(i), float(y), at.astype("<i4").tobytes())
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k):
        l1, l2 = (0.0, 0.0) if k == 1 << bits else (0.05, 0.1)
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((1 + math.sqrt(n[k])) / 0.5 + l2)

    for _ in range(3):
        for (_, y, _), (xs, _) in sorted(seen.items(), key=lambda r: r[1][1]):
            xs = [*xs, (1 << bits, 1.0)]
            w = {k: weight(k) for k, _ in xs}
            p = 1 / (1 + math.exp(-sum(w[k] * x for k, x in xs)))
            for k, x in xs:
                g = (p - (y > 0)) * x
                sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / 0.5
                z[k] += g - sigma * w[k]
                n[k] += g * g
    for r in queries.op9_quality(spark, sf).collect():
        at, x = q.features(texts[r["doc_id"]], bits, memory)
        score = 1 / (1 + math.exp(-(sum(weight(k) * v for k, v in zip(at.tolist(), x.tolist(), strict=True)) + weight(1 << bits))))
        assert math.isclose(r["score"], score, abs_tol=1e-4)


def bag(t: str) -> collections.Counter:
    w = t.encode().translate(near_dup_fold()).split()
    return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()


def near_dup_fold() -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def test_op10_classes(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    base = [[word() for _ in range(120)] for _ in range(12)]
    texts = []
    for i in range(150):
        w = list(base[i % 12])
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(0, len(w)))] = word()
        texts.append(" ".join(w))
    bags = [bag(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = sum((bags[a] & bags[b]).values())
            if both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(df).collect()}
    assert len(set(got.values())) < 140 and got == {i: find(i) for i in range(len(texts))}


def test_op10_signatures_are_unbiased():
    rng = np.random.default_rng(6)
    u = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(0, 6, 300), rng.integers(0, 6, 300)
    b = np.where(rng.random(300) < 0.7, a, b)
    a[0] = b[0] = 40
    s = near_dup.bag_min_hash([(u[a > 0], a[a > 0]), (u[b > 0], b[b > 0])], 8192)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.02


def test_op10_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(9)
    bags = [(np.unique(rng.integers(0, 2**63, n).astype(np.uint64)), None) for n in (30, 400, 5, 90)]
    bags = [(e, rng.integers(1, 4, len(e))) for e, _ in bags]
    together = near_dup.bag_min_hash(bags)
    assert (together == near_dup.bag_min_hash(bags, points_at_once=3)).all()
    assert all((together[i] == near_dup.bag_min_hash([b])[0]).all() for i, b in enumerate(bags))


def test_op10_ids_of_any_type_and_repeated_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    near_a, near_b = a.replace("a30 ", "q "), b + " more"
    rows = [("x", a), ("y", near_a), ("x", b), ("z", near_b), ("u", "other words here"), (None, a)]
    got = {(r["doc_id"], r["class_id"], r["kept"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {("x", "x", True), ("y", "x", False), ("z", "x", False), ("u", "u", True), (None, None, True)}


def test_op10_links_across_star_centres(spark, monkeypatch):
    """Chains whose ends are not alike: only comparing all of a bucket finds the links; blocks of two sizes."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[9 * k : 9 * k + 200]) for k in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for block in (near_dup.BLOCK, 300):
        monkeypatch.setattr(near_dup, "BLOCK", block)
        assert {r["class_id"] for r in near_dup.near_duplicates(df).collect()} == {0}


def test_op4_pages(spark, sf):
    from html import unescape

    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op4_main_text(spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", html[r["page_id"]], re.DOTALL)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", article)]
        assert r["text"] == "\n".join(filter(None, blocks)) and r["n_chars"] == len(r["text"])


P = "<p>One sentence, and then another one. It goes on, as articles do, for some time; then it ends.</p>"


@pytest.mark.parametrize(("html", "text"), [
    (f"<article>{P}<div class='x'>buy now</div>{P}{P}</article>", "PPP"),
    (f"<main><h1>T</h1>{P}{P}<ul><li><a href='a'>First teaser here</a></li><li><a href='b'>Second teaser</a></li></ul></main>", "TPP"),
    (f"<article>{P}<section class='social-history'>{P}</section></article>", "PP"),
    (f"<article>{P}<h2 id='related-work'>W</h2>{P}</article>", "PWP"),
    (f"<article>{P}<p>As <math><mi>x</mi></math> grows, so it does.</p></article>", "P|As x grows, so it does."),
    (f"<body><div class='cookie-notice'><p>We use cookies, as all do. Accept them, please.</p></div><div id='content'><h1>T</h1>{P}{P}</div><div class='sidebar'><p>About me, the writer. Hello.</p></div><div class='comments'><p>I liked this, a lot. Thank you for it!</p></div></body>", "TPP"),
    (f"<form><div><h1>T</h1>{P}{P}</div></form>", "TPP"),
    (f"<header><h1>Site</h1></header><nav><a href='/'>Home</a></nav><article><header><h1>T</h1></header>{P}<ul><li>first thing</li><li>second thing</li></ul></article><aside>{P}</aside><footer><p>All rights, reserved. Forever.</p></footer>", "TP|first thing|second thing"),
    (f"<table><tr><td>{P}{P}</td><td><a href='x'>A link to go</a></td></tr></table>", "PP"),
    (f"<article>{P}</article><h3>More</h3><ul><li><a href='1'>one more story</a></li></ul>", "P"),
    ("<div>" * 20_000 + P + "</div>" * 20_000, "P"),
    ("<div>x " * 20_000, None),
])
def test_op4_page_forms(html, text):
    import time

    from tallyhawk.llm.html_extract import main_text

    start = time.perf_counter()
    got = main_text(html)
    assert time.perf_counter() - start < 3
    if text is not None:
        p = P[3:-4]
        expected = [p if c == "P" else c for c in text.partition("|")[0]] + [x for x in text.partition("|")[2].split("|") if x]
        assert got.split("\n") == expected


def test_pipeline_rows(spark, sf, texts):
    """Stage by stage against the operators' own results; the packed ids are those of the redacted texts."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    good = {r["doc_id"] for r in queries.op9_quality(spark, sf).where("predicted = 1").collect()}
    a = corpus_pipeline.keep_quality(spark, docs, sf)
    assert {r["doc_id"] for r in a.collect()} == good
    classes = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(a).collect()}
    b = corpus_pipeline.drop_near_duplicates(spark, a, sf)
    assert {r["doc_id"] for r in b.collect()} == {i for i, c in classes.items() if i == c}
    leaked = {r["doc_id"] for r in queries.op8_leaks(spark, sf).where("contaminated").collect()}
    c = corpus_pipeline.drop_leaks(spark, b, sf)
    assert {r["doc_id"] for r in c.collect()} == {i for i, k in classes.items() if i == k} - leaked
    d = corpus_pipeline.redact_secrets(spark, c, sf)
    for r in d.collect():
        assert not secrets.base_spans(r["text"] or "") and r["n_chars"] >= 0
    redacted = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    lib, rows = library(), corpus_pipeline.pack(spark, d, sf).collect()
    ids = {i: lib.encode(t, add_special_tokens=False).ids + [0] for i, t in redacted.items()}
    placed = collections.Counter()
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"] and r["length"] == len(own)
        placed[r["doc_id"]] += r["length"]
    assert placed == {i: len(x) for i, x in ids.items()}
