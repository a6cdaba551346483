"""Texts and pages whose shape would make a careless search quadratic, and identifiers that are no secrets."""

from __future__ import annotations

import random
import time
import uuid

import pytest

from tallyhawk.llm import html_extract, secrets


@pytest.mark.parametrize("page", ["<h1>x" * 50_000, "<li><div>" + "<h1>x" * 20_000 + "<li>y" * 20_000, "<div>" * 30_000 + "<h2><p>x" * 10_000])
def test_deep_headings(page):
    start = time.monotonic()
    html_extract.read(page)
    assert time.monotonic() - start < 10


def test_items_still_close_each_other():
    page = html_extract.read("<ul><li><h3>a</h3><li>b<h2>c<li>d</ul>")
    assert [page.tags[page.parents[b.element]] for b in page.blocks] == ["li", "ul", "li", "ul"] and [b.text for b in page.blocks] == ["a", "b", "c", "d"]


def test_many_spans_in_a_text():
    text = " ".join(f"{i:016x}" for i in range(100_000))
    start = time.monotonic()
    covered = secrets.Covered(secrets.base_spans(text))
    assert all(covered.meets(s, e) for s, e in secrets.candidates(text))
    assert time.monotonic() - start < 10


def test_coverage_against_every_span():
    rng = random.Random(7)
    for _ in range(200):
        spans = [("x", s := rng.randint(0, 60), s + rng.randint(1, 12)) for _ in range(rng.randint(0, 8))]
        covered = secrets.Covered(spans)
        for _ in range(30):
            a = rng.randint(0, 70)
            b = a + rng.randint(1, 10)
            assert covered.meets(a, b) == any(a < e and s < b for _, s, e in spans)


def test_public_identifiers_are_no_secrets(spark):
    net = secrets.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rng = random.Random(5)
    number = lambda k: rng.randint(10 ** (k - 1), 10**k - 1)
    words = ["https", "redirect", "middleware", "config", "service", "worker", "queue", "gateway", "report", "index"]
    texts = [f"see {uuid.UUID(int=rng.getrandbits(128))} there" for _ in range(125)] + [f"doi 10.{number(4)}/{number(7)}.{number(7)} cited" for _ in range(125)]
    texts += [f"ISBN 978-{rng.randint(0, 9)}-{number(2)}-{number(6)}-{rng.randint(0, 9)} sold" for _ in range(125)] + [f"the {'-'.join(rng.sample(words, 4))} runs" for _ in range(125)]
    assert sum(bool(more) for _, more, _ in secrets.find(texts, net)) <= 2
    made = [f"key = {secrets.secret_form(rng.randrange)} there" for _ in range(300)]
    assert sum(bool(base or more) for base, more, _ in secrets.find(made, net)) >= 0.95 * 300


def test_one_long_pre_token():
    from tokenizers import Tokenizer

    from tallyhawk.llm.byte_pairs import vocabulary
    from tallyhawk.llm.token_counts import default_vocabulary

    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh") for _ in range(200_000))
    start = time.monotonic()
    n = int(vocabulary(default_vocabulary()).count_merged([text.encode()])[0])
    assert time.monotonic() - start < 10
    assert n == len(Tokenizer.from_file(default_vocabulary()).encode(text, add_special_tokens=False).ids)
