"""Vector links: a large group over several shards against brute force, odd rows, an empty table."""

from __future__ import annotations

import numpy as np

from millrace.llm import vectors

SCHEMA = "vec_id long, label int, embedding array<double>, node string, shard int"


def test_large_group_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 100)
    rng = np.random.default_rng(7)
    centre = rng.normal(size=16)
    group = [centre + rng.normal(scale=0.08 * np.linalg.norm(centre) / 4, size=16) for _ in range(240)]
    x = np.array(group + [rng.normal(size=16) for _ in range(160)])
    x = np.concatenate([x, x[:3], x[:1]])  # repeated rows are vectors of their own
    rows = [(i, 0, v.tolist(), "n", 1) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15]
    rows += [(1_000 + i, 0, v, None, None) for i, v in enumerate(odd)] + [(2_000, None, x[0].tolist(), None, 2)]
    found = {r.vec_id: r for r in vectors.linked(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(found) == len(rows)

    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= vectors.COSINE
    assert [found[i].n_links for i in range(len(x))] == (linked.sum(axis=1) - 1).tolist()
    part = np.arange(len(x))
    while True:
        least = np.where(linked, part[None, :], len(x)).min(axis=1)
        if (least == part).all():
            break
        part = least
    assert [found[i].component_id for i in range(len(x))] == part.tolist()
    for i in [1_000 + k for k in range(len(odd))] + [2_000]:
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)


def test_empty_table(spark):
    assert vectors.linked(spark.createDataFrame([], SCHEMA)).collect() == []
