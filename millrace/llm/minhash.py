"""MinHash near-duplicates by BagMinHash.

A document is the multiset of its five-word shingles. Each shingle has independent Poisson processes
over the weight axis, one for each of the intervals [0,1) [1,2) [2,4) [4,8) ..., with points at rate
one per unit of weight; each point has a level within its interval and a component of the signature.
A document sees the points whose level lies below the shingle's count, and a component is the first
of its points. Two documents agree in a component with the probability of their weighted Jaccard
similarity. Points are drawn in ascending order and only as long as they can still lower a component,
so a long text costs about one draw for each shingle.

BANDS bands of ROWS components give buckets, and buckets that share texts make candidate groups. The
texts of a group are dealt into chunks, and each pair of chunks is a unit of work of its own with at
most about 2 * CHUNK_TEXTS texts. A unit compares its texts that share a bucket, exactly: sum of
least counts over sum of greatest. It leaves out a comparison only if both texts are already linked
through others, so no link that would join two components is lost, and it returns links that span
what it found. Links from all units join components. A pair of similarity 0.8 shares no bucket with
probability (1 - 0.8^ROWS)^BANDS, 6e-5.

Copies of a text are one node and are never paired. A text moves once for each chunk of its group,
that is once for most; a group of n texts takes n^2 / CHUNK_TEXTS moves. No bucket, group or
component is gathered in one task or on the driver.

A null text is empty; texts without words have no shingle and stay alone. A text of fewer than five
words is one shingle. Documents without id are judged like others; the id of a group is the least id
in it, or null. Columns other than key and text are left out by `groups`; `keep_first` returns
exactly the columns it was given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import blocks, mix, shingles, span_hashes, words
from millrace.llm.components import components
from millrace.workspace import stored

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
#: A chunk has at most about so many texts and bytes.
CHUNK_TEXTS, CHUNK_BYTES = 128, 8 << 20
_POINTS = 64  # drawn at once of each process, at most


def bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hash, row and count of each distinct shingle of each row; sorted by row."""
    data, starts, ends, rows = words(column)
    found, row = shingles(span_hashes(data, starts, ends), rows, len(column), WIDTH)
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    return found[at], row[at], np.diff(np.append(at, len(found)))


def signatures(hashes: np.ndarray, rows: np.ndarray, counts: np.ndarray, n_rows: int, size: int) -> np.ndarray:
    """n_rows x size first arrival times; infinite for rows without shingles."""
    sig = np.full(n_rows * size, np.inf)
    # one process for each shingle and interval that its count reaches
    reach = np.ceil(np.log2(np.maximum(counts, 1))).astype(int) + 1
    item = np.repeat(np.arange(len(counts)), reach)
    power = np.arange(len(item)) - np.repeat(np.cumsum(reach) - reach, reach)
    low = np.where(power == 0, 0, 1 << np.maximum(power - 1, 0))
    length = np.maximum(low, 1)
    row, limit = rows[item], counts[item]
    seed = mix(hashes[item] ^ mix(power.astype(np.uint64)))
    time = np.zeros(len(item))
    drawn, points = 0, 1
    while len(item):
        number = np.arange(drawn, drawn + points, dtype=np.uint64)
        random = mix(seed[:, None] ^ mix(number + np.uint64(1))[None, :])
        gap = -np.log1p(-((random >> np.uint64(11)) * 2.0**-53)) / length[:, None]
        times = time[:, None] + np.cumsum(gap, axis=1)
        other = mix(random)
        place = ((other >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        level = low[:, None] + (other & np.uint64(0xFFFFFFFF)).astype(np.int64) % length[:, None]
        seen = level < limit[:, None]
        np.minimum.at(sig, (row[:, None] * size + place)[seen], times[seen])
        time = times[:, -1]
        most = sig.reshape(n_rows, size).max(axis=1)
        on = time < most[row]
        item, row, limit, low, length, seed, time = (x[on] for x in (item, row, limit, low, length, seed, time))
        drawn, points = drawn + points, min(points * 2, _POINTS)
    return sig.reshape(n_rows, size)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """n x BANDS hashes of the bands; the number of the band is part of the hash."""
    bits = sig.view(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64)), bits.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key ^ bits[:, :, k])
    return key.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets, each as sorted hashes and counts."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    there = b[0][at] == a[0]
    least = int(np.minimum(a[1][there], b[1][at[there]]).sum())
    return least / (int(a[1].sum()) + int(b[1].sum()) - least)


def banded(nodes: DataFrame) -> DataFrame:
    """node, bands; texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in blocks(batch.column(1)):
                part = batch.slice(start, end - start)
                hashes, rows, counts = bags(part.column(1))
                full = np.unique(rows)
                keys = band_keys(signatures(hashes, rows, counts, len(part), BANDS * ROWS)[full])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(full) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1))
                )
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(full)), lists], ["node", "bands"])

    return nodes.select("node", "text").mapInArrow(run, "node binary, bands array<long>")


def unit_links(texts: list[str], bands: np.ndarray, side: np.ndarray, apart: bool) -> list[tuple[int, int]]:
    """Links that span the similar texts of a unit; apart: only pairs across the two sides count."""
    hashes, rows, counts = bags(pa.array(texts, pa.string()))
    edge = np.searchsorted(rows, np.arange(len(texts) + 1))
    bag = [(hashes[a:b], counts[a:b]) for a, b in zip(edge[:-1], edge[1:])]
    root = list(range(len(texts)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i in range(len(texts)):
        candidates = (bands[i + 1 :] == bands[i]).any(axis=1)
        if apart:
            candidates &= side[i + 1 :] != side[i]
        for j in np.flatnonzero(candidates) + i + 1:
            x, y = find(i), find(int(j))
            if x != y and overlap(bag[i], bag[j]) >= SIMILARITY:
                root[x] = y
                links.append((i, int(j)))
    return links


def units(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """unit columns, then node, text and bands: each text in the units of its chunk."""
    sizes = texts.select("node", F.length("text").alias("size")).join(candidates, "node")
    sizes = sizes.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK_TEXTS), F.ceil(F.col("bytes") / CHUNK_BYTES)).cast("int")
    placed = candidates.join(sizes.select("component", chunks.alias("chunks")), "component").withColumn(
        "own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    )
    dealt = placed.select(
        "node", "component", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    )
    return dealt.join(texts, "node").select(
        "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        "own", "node", "text", "bands",
    )


def links_of(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """a, b: verified links that join all texts that are linked."""

    def run(unit: pd.DataFrame) -> pd.DataFrame:
        unit = unit.sort_values("node", kind="stable")
        node, side = unit["node"].to_numpy(), unit["own"].to_numpy()
        found = unit_links(list(unit["text"]), np.stack(unit["bands"]), side, unit["i"].iloc[0] != unit["j"].iloc[0])
        return pd.DataFrame({"a": [node[i] for i, _ in found], "b": [node[j] for _, j in found]}, dtype=object)

    return units(texts, candidates).groupBy("component", "i", "j").applyInPandas(run, "a binary, b binary")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, node (of the text), group_id (least id of the group) and kept; one row per document."""
    seen = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn(
        "node", F.unhex(F.md5("text"))
    )
    classes = stored(seen.groupBy("node").agg(F.min("id").alias("first")), "near_classes")
    bands = stored(banded(seen).dropDuplicates(["node"]), "near_bands")
    exploded = bands.select("node", F.explode("bands").alias("band"))
    shared = (
        exploded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    )
    stars = exploded.join(shared.select("band", "low"), "band").where("node <> low").select("node", "low")
    candidates = stored(components(stars, "node", "low"), "near_candidates")
    wanted = candidates.select("node").join(classes, "node").select(F.col("node").alias("of"), "first")
    same = (F.col("node") == F.col("of")) & F.col("id").eqNullSafe(F.col("first"))
    texts = seen.join(wanted, same, "left_semi").select("node", "text").dropDuplicates(["node"]).join(bands, "node")
    labels = components(stored(links_of(stored(texts, "near_texts"), candidates), "near_links"))
    named = classes.join(labels, "node", "left").withColumn("part", F.coalesce("component", "node"))
    # the least id; documents without id come last, and among them the least node
    order = F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("id"), F.col("node").alias("node"))
    least = named.groupBy("part").agg(F.min(order).alias("least"))
    ids = stored(named.join(least, "part").select("node", "least"), "near_ids")
    joined = seen.select(F.col("id").alias(key), "node").join(ids, "node")
    kept = (F.col("node") == F.col("least.node")) & F.col(key).eqNullSafe(F.col("least.id"))
    return joined.select(key, "node", F.col("least.id").alias("group_id"), kept.alias("kept"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near-duplicates and copies: of each group the one with the least id stays.

    Of rows that repeat both id and text one stays; only these are compared by a shuffle of their own.
    """
    found = groups(docs, key, text).where("kept").groupBy(F.col(key).alias("_id"), F.col("node").alias("_node"))
    chosen = stored(found.agg((F.count("*") > 1).alias("again")), "near_kept")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(key).alias("id"),
        F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("node"),
    )
    same = (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("_id"))
    one = rows.join(chosen.where("not again"), same, "left_semi")
    more = rows.join(chosen.where("again"), same, "left_semi").dropDuplicates(["id", "node"])
    return one.unionByName(more).select("row.*")
