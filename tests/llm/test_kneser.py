"""The counting task of the Kneser-Ney classifier against windows of single words."""

import random
import tracemalloc
from collections import Counter
from unittest.mock import MagicMock

import pyarrow as pa
import pytest

from millrace.llm import kneser

ODD_WORDS = ["a", "abcd", "abcde", "abcdefgh", "\x00\x00\x02\x00\x00b", "\x03x\x02\x02", "né", "日本語日本語", "😀😀a😀", "﻿ab", "-" * 40]


def counting_task(spark):
    """The function that a counting task of the quality classifier runs."""
    docs = MagicMock()
    kneser.window_counts(docs)
    return docs.select.return_value.mapInArrow.call_args[0][0]


@pytest.mark.parametrize("remembered", [500_000, 3])
def test_windows_of_a_task_are_those_of_its_words(spark, monkeypatch, remembered):
    monkeypatch.setattr(kneser, "TASK_GRAMS", remembered)
    monkeypatch.setattr(kneser, "WINDOW_BYTES", 60, raising=False)
    texts = [" ".join(random.Random(i).choices(ODD_WORDS, k=20)) for i in range(40)] + [None, "", " \n"]
    langs, parts = ["en" if i % 3 else "" for i in range(43)], [i % 3 - 1 for i in range(43)]
    expected = Counter()
    for lang, part, text in zip(langs, parts, texts):
        for gram in (g for w in (text or "").split(" ") if w.strip() for g in kneser.windows(w)):
            expected.update([(lang, gram, "n")] + [(lang, gram, f"n{part}")] * (part >= 0))
    columns = [pa.array(langs), pa.array(parts, pa.int32()), pa.array(texts, pa.string())]
    batches = [pa.RecordBatch.from_arrays([c.slice(k, 15) for c in columns], ["lang", "part", "text"]) for k in (0, 15, 30)]
    found = Counter()
    for batch in counting_task(spark)(iter(batches)):
        for r in batch.to_pylist():
            found.update({(r["lang"], r["gram"], c): r[c] for c in ("n", "n0", "n1") if r[c]})
    assert found == expected


def test_counting_windows_takes_little_memory(spark):
    run, digits = counting_task(spark), "abcdefgh"
    word = lambda k: "".join(digits[k >> 3 * i & 7] for i in range(6))
    texts = [" ".join(map(word, range(i, 1 << 18, 64))) for i in range(64)]  # a quarter of a million different words
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 64), pa.array([0] * 64, pa.int32()), pa.array(texts)], ["lang", "part", "text"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len({g for i in range(1 << 18) for g in kneser.windows(word(i))}) and peak < 90e6
