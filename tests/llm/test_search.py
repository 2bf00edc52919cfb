"""Ranked search against a plain version by definition."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import search

DOCS = "doc_id long, text string, item_id string, rank string, score string, item string"
ITEMS = "item_id long, text string, doc_id string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def brute(docs, items, top=10):
    """Sorted (item_id, rank, doc_id, score) by definition."""
    counts = [Counter(terms(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    found = []
    for item, text in dict.fromkeys(items):
        scored = []
        for (doc, _), c, n in zip(docs, counts, sizes):
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // n_terms)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        found += [(item, i, None if null else doc, -s) for i, (s, null, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(found, key=str)


def got(spark, docs, items, **options):
    frame = spark.createDataFrame([(*d, "x", "x", "x", "x") for d in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    return sorted((tuple(r) for r in search.search(frame, asked, **options).collect()), key=str)


def corpus(n=700, seed=4):
    """Words of very different frequency, in some regions of the table only; many equal texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = []
    for i in range(n):
        some = rng.choices(words, weights, k=rng.choice([3, 20, 60, 200]))
        if i % 97 < 5:
            some += ["Regional", "É", "naïve"] * rng.randint(1, 4)
        docs.append((i, ", ".join(some)))
    docs += [(n + i, docs[5][1]) for i in range(40)]  # ties
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 40)))) for i in range(25)]
    items += [(100, "REGIONAL é É naïve W0 w0 w0"), (101, "absent words only"), (102, docs[5][1])]
    return docs, items


ODD_DOCS = [(None, "a b"), (None, None), (3, ""), (3, "a-b\x00c"), (3, "a-b\x00c"), (4, " \n"), (5, "a " * 70_000), (6, "x" * 100_000)]
ODD_ITEMS = [(1, "a c"), (1, "a c"), (1, "b"), (2, None), (3, ""), (None, "X" * 100_000)]


@pytest.mark.parametrize("docs, postings, items", [(1 << 16, 2_000_000, 1 << 25), (64, 1_000, 1_000)])
def test_equals_the_definition(spark, monkeypatch, docs, postings, items):
    """Also with blocks of few documents, and the items in several blocks."""
    for name, value in (("BLOCK_DOCS", docs), ("BLOCK_POSTINGS", postings), ("ITEM_BYTES", items)):
        monkeypatch.setattr(search, name, value)
    rows, asked = corpus()
    assert got(spark, rows, asked) == brute(rows, asked)


def test_odd_rows(spark):
    assert got(spark, ODD_DOCS, ODD_ITEMS) == brute(ODD_DOCS, ODD_ITEMS)
    assert got(spark, ODD_DOCS[:1], ODD_ITEMS, top=1) == brute(ODD_DOCS[:1], ODD_ITEMS, 1)


def test_empty_tables(spark):
    assert got(spark, [], ODD_ITEMS) == got(spark, ODD_DOCS, []) == got(spark, [(1, None)], ODD_ITEMS) == []


def test_ranges_are_skipped_and_nothing_is_lost():
    """A block in which rare terms decide: most ranges of the long lists are never scored."""
    rng = np.random.default_rng(1)
    n = 20_000
    texts = [" ".join(["the"] * int(rng.integers(1, 4)) + [f"w{int(rng.integers(500))}"] * 2) for _ in range(n)]
    for i in rng.choice(n, 12, replace=False):
        texts[i] += " rare rare"
    items = search.Items.of(pa.array([1]), pa.array(["the rare"]))
    (_, lengths, pairs, tf) = next(search._postings(pa.array(texts), items))
    order = np.argsort(pairs // n, kind="stable")
    kinds, sizes = np.unique(pairs // n, return_counts=True)
    row = {"lengths": lengths, "terms": kinds, "sizes": sizes, "docs": (pairs % n)[order].astype(np.uint16), "tfs": tf[order]}
    row = {k: v.astype(np.uint16 if k == "docs" else np.uint32).tobytes() for k, v in row.items()}
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * s + 1))) for s in sizes])
    block, best = search.Block(row, weights, n, int(lengths.sum())), search.Best(10)
    ids = np.arange(n)
    scored = search.rank_block(block, ids, np.ones(n, bool), items.terms[0], items.times[0], best)
    assert scored < block.n_ranges / 10
    expected = [(d, s) for _, _, d, s in sorted(brute(list(enumerate(texts)), [(1, "the rare")]), key=lambda r: r[1])]
    assert list(zip(best.rows[1].tolist(), best.rows[0].tolist())) == expected
