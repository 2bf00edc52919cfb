"""Segmentation sums against plain enumeration, and languages on held-out rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import langid, queries
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, key string, letter string, score string"


@pytest.fixture(scope="module")
def vocabulary():
    return langid.Vocabulary(queries.PIECE_MODEL)


def cuts(marked, vocabulary):
    """All ways to cut a marked word, as lists of piece numbers."""
    if not marked:
        return [[]]
    found = []
    if marked[0] not in vocabulary.pieces:
        found += [[vocabulary.bytes[b] for b in marked[0].encode()] + rest for rest in cuts(marked[1:], vocabulary)]
    for k in range(1, len(marked) + 1):
        piece = vocabulary.pieces.get(marked[:k], -1)
        if piece >= 0:
            found += [[piece] + rest for rest in cuts(marked[k:], vocabulary)]
    return found


WORDS = ["a", "then", "naïve", "hello", "Ünter-x", "漢\U0001f642", "\U00010348o\U00010348", "2024,", "▁▁x", "x" * 12, "\x00q"]


def test_forward_sums_all_segmentations(vocabulary):
    logp = np.log(np.random.default_rng(0).dirichlet(np.ones(vocabulary.size), 3).T)
    got = langid.forward(langid.Lattice(WORDS, vocabulary), logp, vocabulary.longest)
    for word, row in zip(WORDS, got):
        ways = cuts(langid.MARK + word, vocabulary)
        for k in range(3):
            assert row[k] == pytest.approx(math.log(sum(math.exp(sum(logp[p, k] for p in way)) for way in ways)), rel=1e-9)


def test_expected_counts_are_posterior(vocabulary):
    logp = np.log(np.random.default_rng(1).dirichlet(np.ones(vocabulary.size)))
    times = np.arange(1.0, len(WORDS) + 1)
    lattice = langid.Lattice(WORDS, vocabulary)
    got = np.zeros(vocabulary.size)
    np.add.at(got, lattice.piece, langid.expected(lattice, logp[lattice.piece], times))
    want = np.zeros(vocabulary.size)
    for word, n in zip(WORDS, times):
        ways = cuts(langid.MARK + word, vocabulary)
        p = np.array([math.exp(sum(logp[x] for x in way)) for way in ways])
        for way, share in zip(ways, p / p.sum()):
            for x in way:
                want[x] += n * share
    assert got == pytest.approx(want, rel=1e-9)


def test_long_words_keep_their_scale(vocabulary):
    logp = np.full((vocabulary.size, 2), -9.0)
    long = "ab漢" * 20_000
    found = langid.forward(langid.Lattice([long, long[:3]], vocabulary), logp, vocabulary.longest)
    assert np.isfinite(found).all() and found[0, 0] < 10_000 * found[1, 0] < 0


def brute_fit(rows, vocabulary, rounds):
    """Piece probabilities per language by enumeration."""
    langs = sorted({lang for lang, _ in rows})
    p = {lang: np.full(vocabulary.size, 1 / vocabulary.size) for lang in langs}
    for _ in range(rounds):
        for lang in langs:
            counts = np.full(vocabulary.size, langid.ADDED)
            words = Counter(w for x, t in rows if x == lang for w in re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            for word, n in words.items():
                ways = cuts(langid.MARK + word, vocabulary)
                own = np.array([np.prod(p[lang][way]) for way in ways])
                for way, share in zip(ways, own / own.sum()):
                    np.add.at(counts, way, n * share)
            p[lang] = counts / counts.sum()
    return langs, np.log(np.array([p[lang] for lang in langs]).T)


@pytest.mark.parametrize("remembered", [400_000, 2])
def test_model_equals_plain_maximisation(spark, vocabulary, monkeypatch, remembered):
    monkeypatch.setattr(langid, "TASK_WORDS", remembered)
    rows = [("en", "the then these"), ("en", "the other\tthe"), ("fr", "été les leurs"), ("fr", None), ("xx", ""), ("xx", None)]
    fitted = langid.fit(spark.createDataFrame(rows, "lang string, text string").repartition(3), queries.PIECE_MODEL)
    langs, logp = brute_fit([r for r in rows if r[0] != "xx"], vocabulary, langid.ROUNDS)
    assert fitted.langs == langs and np.exp(fitted.prior) == pytest.approx([2 / 3, 1 / 3])
    assert fitted.logp == pytest.approx(logp, rel=1e-6)


def sentences(letters, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(80)]
    return lambda: " ".join(rng.choices(words, k=12))


def test_odd_rows(spark):
    make = {"en": sentences("theandofi", 1), "fr": sentences("éèlaeuxoi", 2)}
    rows = [(i, make[lang](), lang, "s", "x", "x", "x") for i, lang in enumerate(["en", "en", "fr"] * 20)]
    odd = [None, "", " \n", "12 34 !", "é", "12 the", "x" * 60_000, " ".join(["laéx"] * 30_000)]
    rows += [(100 + i, t, None, None, None, None, None) for i, t in enumerate(odd)]
    rows += [(None, make["fr"](), "fr", None, None, None, None), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, DOCS)
    found = langid.classify(docs, queries.PIECE_MODEL).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert all((by_id[100 + i].lang_pred, by_id[100 + i].score) == ("und", 0.0) for i in range(4))
    assert by_id[104].lang_pred == by_id[107].lang_pred == "fr" and all(0 <= r.score <= 1 for r in found)
    assert all(r.lang_pred == lang for r, lang in [(by_id[i], ["en", "en", "fr"][i % 3]) for i in range(60)])
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    untaught = langid.classify(docs.withColumn("lang", F.lit(None).cast("string")), queries.PIECE_MODEL).collect()
    assert {(r.lang_pred, r.score) for r in untaught} == {("und", 0.0)} and len(untaught) == len(rows)
    assert langid.classify(docs.limit(0), queries.PIECE_MODEL).count() == 0


def test_held_out_rows_teach_nothing(spark):
    make = {"en": sentences("theandofi", 1), "fr": sentences("éèlaeuxoi", 2)}
    rows = [(i, make[lang](), lang, "s", "x", "x", "x") for i, lang in enumerate(["en", "fr"] * 30)]
    docs = spark.createDataFrame(rows, DOCS)
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    swapped = docs.withColumn("lang", F.when(out, F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(langid.classify(docs, queries.PIECE_MODEL).collect()) == sorted(langid.classify(swapped, queries.PIECE_MODEL).collect())


def test_accuracy_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = langid.classify(docs, queries.PIECE_MODEL).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) > 20 and np.mean([r.lang_pred == r.lang for r in found]) >= 0.9
