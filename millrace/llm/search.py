"""Ranked lexical search: term-at-a-time for short lists, document-at-a-time for the long ones.

Terms are runs of letters, digits and characters above ASCII, with A-Z in lower case. The score of a
document for an item sums, over the item's terms, weight times saturated frequency, in 64-bit integers:

    weight(t) = floor(1000 * ln((2N + 2) / (2 df + 1)))
    gain(t, d) = weight(t) * ((10**9 * tf) div (1000 * tf + 8 * m(d))),  m(d) = 25 + (75 * n(d) * N) div L

The documents are indexed in blocks, a table row each, with the lists of the terms that the items hold.
Counts for the weights are sums over this table. Each task then ranks all items over its blocks:

* the short lists of an item are summed into accumulators, term by term;
* the accumulators are one more iterator, with a bound, beside the long lists;
* these iterators advance document by document over ranges of RANGE documents. A range is skipped by all
  of them unless the sum of their greatest gains in it can reach the item's TOP documents so far.

Equal bounds are not skipped, so the result is exact. A task gives at most `top` rows per item, and a window
takes the best of these. Texts are never gathered: one scan builds the index, and only its lists are read again.

Terms meet by 64-bit hashes of their bytes. The items are a query set that is sent to all tasks; if their texts
are longer than ITEM_BYTES together, they are ranked in as many blocks, each with a scan of its own.

A null or empty text has no terms: such documents are not counted, and such items have no rows. Rows that repeat a
doc_id are documents of their own; rows that repeat an item with its text are one item, and another text with the
same item_id is another item. Equal scores ascend by doc_id, null last. An empty table of documents or items gives an
empty result. Documents of any length are read whole. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.arrow import blocks, span_hashes, words
from millrace.workspace import stored

TOP = 10
#: Documents whose bound is tested at once.
RANGE = 64
#: A list is long if it holds at least one in so many of the documents of its block.
LONG_PART = 16
#: A block ends with so many documents or postings, whichever comes first.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 16, 2_000_000
ITEM_BYTES = 1 << 25

_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each term of the texts."""
    data, starts, ends, rows = words(column, _OUTSIDE)
    return span_hashes(_LOWER[data], starts, ends), rows


def _counted(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(numbers, return_counts=True)


@dataclass(frozen=True)
class Items:
    """The query set: ids, the hashes of all its terms, and per item the numbers and counts of its terms."""

    ids: pa.Array
    vocabulary: np.ndarray
    terms: list[np.ndarray]
    times: list[np.ndarray]

    @classmethod
    def of(cls, ids: pa.Array, texts: pa.Array) -> Items:
        hashes, rows = term_hashes(texts)
        vocabulary, number = np.unique(hashes, return_inverse=True)
        edges = np.searchsorted(rows, np.arange(len(texts) + 1))
        found = [_counted(number[a:b]) for a, b in zip(edges, edges[1:])]
        return cls(ids, vocabulary, [t for t, _ in found], [c.astype(np.int64) for _, c in found])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each term, -1 for terms of no item."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at, -1) if len(self.vocabulary) else np.full(len(hashes), -1)


_INDEX = (
    "ids array<bigint>, n_docs bigint, n_terms bigint, lengths binary, terms binary, sizes binary, docs binary, tfs binary"
)


def _postings(column: pa.Array, items: Items) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of rows: first row, length of each row, and term * rows + row with its count."""
    for start, end in blocks(column):
        hashes, rows = term_hashes(column.slice(start, end - start))
        lengths = np.bincount(rows, minlength=end - start)
        number = items.numbers(hashes)
        known = number >= 0
        pairs, tf = _counted(number[known] * (end - start) + rows[known])
        yield start, lengths, pairs, tf


def index(docs: DataFrame, items: Items, key: str, text: str) -> DataFrame:
    """A row for each block of documents: their ids and lengths, and the lists of the items' terms."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def row(parts: list[tuple]) -> pa.RecordBatch:
        ids = pa.concat_arrays([p[0] for p in parts])
        lengths = np.concatenate([p[1] for p in parts])
        shift = np.cumsum([0, *[len(p[0]) for p in parts]])[:-1]
        term = np.concatenate([p[2] for p in parts])
        doc = np.concatenate([p[3] + s for p, s in zip(parts, shift)])
        tf = np.concatenate([p[4] for p in parts])
        order = np.argsort(term, kind="stable")  # parts and rows ascend, so documents do within a term
        terms, sizes = _counted(term)
        packed = [lengths, terms, sizes, doc[order], tf[order]]
        kinds = [np.uint32, np.uint32, np.uint32, np.uint32 if len(ids) > 1 << 16 else np.uint16, np.uint32]
        arrays = [
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            pa.array([int((lengths > 0).sum())], pa.int64()),
            pa.array([int(lengths.sum())], pa.int64()),
            *[pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in zip(packed, kinds)],
        ]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        parts, n_docs, n_postings = [], 0, 0
        for batch in batches:
            for start, lengths, pairs, tf in _postings(batch.column(1), own):
                n = len(lengths)
                if parts and (n_docs + n > BLOCK_DOCS or n_postings + len(pairs) > BLOCK_POSTINGS):
                    yield row(parts)
                    parts, n_docs, n_postings = [], 0, 0
                ids = batch.column(0).slice(start, n)
                parts.append((ids, lengths, pairs // n, pairs % n, tf))
                n_docs, n_postings = n_docs + n, n_postings + len(pairs)
        if parts:
            yield row(parts)

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, _INDEX)


def document_counts(table: DataFrame) -> DataFrame:
    """term (its number), df: documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, sizes in zip(batch.column(0), batch.column(1)):
                found = [np.frombuffer(x.as_py(), np.uint32).astype(np.int64) for x in (terms, sizes)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), ["term", "df"])

    found = table.select("terms", "sizes").mapInArrow(run, "term long, df long")
    return found.groupBy("term").agg(F.sum("df").alias("df"))


class Block:
    """The lists of one block of documents, with gains in place of frequencies."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
        terms, sizes = (np.frombuffer(row[c], np.uint32).astype(np.int64) for c in ("terms", "sizes"))
        kind = np.uint16 if len(row["docs"]) == 2 * sizes.sum() else np.uint32
        self.size = len(lengths)
        self.docs = np.frombuffer(row["docs"], kind).astype(np.int64)
        tf = np.frombuffer(row["tfs"], np.uint32).astype(np.int64)
        m = 25 + (75 * lengths * n_docs) // n_terms
        self.gains = np.repeat(weights[terms], sizes) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.docs]))
        ends = np.cumsum(sizes)
        self.lists = {t: (a, b) for t, a, b in zip(terms.tolist(), (ends - sizes).tolist(), ends.tolist())}
        self.n_ranges = -(-self.size // RANGE)
        self._bounds: dict[int, np.ndarray] = {}

    def greatest(self, docs: np.ndarray, gains: np.ndarray) -> np.ndarray:
        """The greatest gain in each range."""
        found = np.zeros(self.n_ranges, np.int64)
        if len(docs):
            ranges = docs // RANGE
            first = np.flatnonzero(np.diff(ranges, prepend=-1))
            found[ranges[first]] = np.maximum.reduceat(gains, first)
        return found

    def bounds(self, term: int) -> np.ndarray:
        if term not in self._bounds:
            a, b = self.lists[term]
            self._bounds[term] = self.greatest(self.docs[a:b], self.gains[a:b])
        return self._bounds[term]

    def iterators(self, terms: np.ndarray, times: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """(documents, gains) of each long list and of the accumulators, and the sum of their bounds by range."""
        found, total = [], np.zeros(self.n_ranges, np.int64)
        short_docs, short_gains = [], []
        for term, count in zip(terms.tolist(), times.tolist()):
            if term not in self.lists:
                continue
            a, b = self.lists[term]
            docs, gains = self.docs[a:b], self.gains[a:b] * count
            if (b - a) * LONG_PART >= self.size:
                found.append((docs, gains))
                total += self.bounds(term) * count
            else:
                short_docs.append(docs)
                short_gains.append(gains)
        if short_docs:
            docs, gains = np.concatenate(short_docs), np.concatenate(short_gains)
            order = np.argsort(docs, kind="stable")
            docs, gains = docs[order], gains[order]
            first = np.flatnonzero(np.diff(docs, prepend=-1))
            docs, gains = docs[first], np.add.reduceat(gains, first)
            found.append((docs, gains))
            total += self.greatest(docs, gains)
        return found, total

    def scores(self, iterators: list[tuple[np.ndarray, np.ndarray]], ranges: np.ndarray) -> np.ndarray:
        """Scores of all documents of these ranges, a row each."""
        found = np.zeros(len(ranges) * RANGE, np.int64)
        for docs, gains in iterators:
            low = np.searchsorted(docs, ranges * RANGE)  # the iterator skips to each range
            size = np.searchsorted(docs, (ranges + 1) * RANGE) - low
            at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
            found[np.repeat(np.arange(len(ranges)), size) * RANGE + docs[at] % RANGE] += gains[at]
        return found.reshape(len(ranges), RANGE)


class Best:
    """The best documents of an item so far: scores, ids and which ids are not null."""

    def __init__(self, top: int):
        self.top, self.least = top, 1
        self.rows = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    def add(self, scores: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        scores, ids, valid = (np.concatenate(x) for x in zip(self.rows, (scores, ids, valid)))
        order = np.lexsort((ids, ~valid, -scores))[: self.top]
        self.rows = (scores[order], ids[order], valid[order])
        if len(order) == self.top:
            self.least = int(self.rows[0][-1])


def rank_block(block: Block, ids: np.ndarray, valid: np.ndarray, terms: np.ndarray, times: np.ndarray, best: Best) -> int:
    """Adds the block's documents to the best ones; returns how many ranges were scored."""
    iterators, bounds = block.iterators(terms, times)
    ranges, seen, some = np.arange(block.n_ranges), 0, 4
    while len(ranges := ranges[bounds[ranges] >= best.least]):
        now, ranges = ranges[:some], ranges[some:]
        scores = block.scores(iterators, now)
        row, place = np.nonzero(scores >= best.least)
        if len(row):
            at = now[row] * RANGE + place
            best.add(scores[row, place], ids[at], valid[at])
        seen, some = seen + len(now), some * 2
    return seen


def _ranked(table: DataFrame, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """item_id, item (its number), doc_id, score: the best of each task."""
    shared = table.sparkSession.sparkContext.broadcast((items, weights))
    kind = items.ids.type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = shared.value
        best = [Best(top) for _ in own.terms]
        for batch in batches:
            for i in range(len(batch)):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names if name != "ids"}
                block = Block(row, weight, n_docs, n_terms)
                listed = batch.column("ids")[i].values
                valid = listed.is_valid().to_numpy(zero_copy_only=False)
                ids = listed.fill_null(0).to_numpy()
                for terms, times, of in zip(own.terms, own.times, best):
                    rank_block(block, ids, valid, terms, times, of)
        number = np.repeat(np.arange(len(best)), [len(b.rows[0]) for b in best])
        if len(number):
            scores, ids, valid = (np.concatenate(x) for x in zip(*[b.rows for b in best]))
            arrays = [own.ids.take(pa.array(number)), pa.array(number), pa.array(ids, mask=~valid), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(arrays, ["item_id", "item", "doc_id", "score"])

    schema = f"item_id {_SQL_TYPES[str(kind)]}, item long, doc_id long, score long"
    return table.select("lengths", "terms", "sizes", "docs", "tfs", "ids").mapInArrow(run, schema)


_SQL_TYPES = {"int64": "long", "int32": "int", "int16": "smallint", "string": "string", "large_string": "string"}


def _search(docs: DataFrame, items: Items, top: int, key: str, text: str) -> DataFrame | None:
    table = stored(index(docs, items, key, text), "search_index")
    counts = table.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not counts[1] or not len(items.vocabulary):
        return None
    n_docs, n_terms = counts
    weights = np.zeros(len(items.vocabulary), np.int64)
    for batch in document_counts(table).toArrow().to_batches():  # at most one row for each term of the items
        for term, df in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    found = _ranked(table, items, weights, n_docs, n_terms, top)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("item")


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of each item with a score above 0."""
    asked = items.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text")).distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // ITEM_BYTES))
    results = []
    for b in range(n_blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).orderBy("item_id", "text").toArrow()
        column = lambda name: pa.concat_arrays(part[name].chunks) if part[name].num_chunks else pa.array([], part[name].type)
        found = _search(docs, Items.of(column("item_id"), column("text")), top, key, text)
        if found is not None:
            results.append(found)
    if not results:
        kind = items.schema[item_key].dataType.simpleString()
        results = [docs.sparkSession.createDataFrame([], f"item_id {kind}, doc_id long, score long, rank int")]
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole.select(F.col("item_id").alias(item_key), "rank", F.col("doc_id").alias(key), "score")
