"""Quality rules with cross-document line frequency.

Each text is measured alone, and its lines are hashed after normalising: lower case, digits as 0,
white space as one space. Documents that contain a line are counted for each host and line over the
whole corpus. Lines in `least_docs` documents of their host or more are frequent, whatever the size of
the host and of the line. `clean` returns the documents without them; `judge` measures what is gone, and
a document that loses more than `most_removed` of its word characters is rejected.

Counts are partial sums before the shuffle, one row per host, line and task; nothing is collected
per host. The lines themselves never leave their task, only hashes. Up to MOST_SENT frequent lines are
sent to all tasks. More are joined to the hashes of the lines, and each document is joined to those of its
own; no text is cut.

Documents are told apart by their words, so repeated rows and exact copies count once, and a text is
not rejected for being copied. A null text has no lines and fails the base rules; a null host is a
host of its own. `judge` leaves out columns other than key, host and text, whatever their names; `clean`
keeps all.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import blocks, mix, raw, shingles, span_hashes, words
from millrace.workspace import stored

WINDOW = 5
MOST_SENT = 1 << 17
SCHEMA = (
    "doc_id {kind}, host string, clean string, n_words long, word_chars long, clean_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long"
)
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]+")


def repeat_words(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Words in runs of five that occur twice or more in their row."""
    count = np.bincount(rows, minlength=n_rows)
    runs, row = shingles(hashes, rows, n_rows, WINDOW)
    full = count[row] >= WINDOW
    key = mix(runs ^ mix(row.astype(np.uint64)))
    key[~full] = mix(np.flatnonzero(~full).astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice &= full
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    run_first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n_rows))[:-1]])
    begin = first[row[twice]] + (np.flatnonzero(twice) - run_first[row[twice]])
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + WINDOW, -1)
    return np.bincount(rows[np.cumsum(edge[:-1]) > 0], minlength=n_rows)


def line_name(line: str) -> tuple[str, int]:
    """The line normalised, and its word characters."""
    found = _WORD.findall(line)
    return _DIGITS.sub("0", " ".join(found).lower()), sum(map(len, found))


def again(text: str) -> int:
    """Lines with words that are equal to an earlier one."""
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return len(lines) - len(set(lines))


def line_sets(docs: DataFrame, host: str, text: str) -> DataFrame:
    """host, node (of the text), row_key (of its words) and the keys of its normalised lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in blocks(batch.column(2)):
                yield sets(batch.slice(start, end - start))

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        column, n = batch.column(2), len(batch)
        data, starts, ends, rows = words(column)
        row_hash = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(row_hash, rows, mix(span_hashes(data, starts, ends) ^ mix(_place(rows, n))))
        found = [{name for name, size in map(line_name, (x or "").split("\n")) if size} for x in column.to_pylist()]
        parts = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        keys = pa.ListArray.from_arrays(pa.array(parts), pa.array(_line_keys([name for x in found for name in x])))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(mix(row_hash).view(np.int64)), keys],
            ["host", "node", "row_key", "line_keys"],
        )

    texts = docs.select(F.col(host).cast("string").alias("host"), _node(text).alias("node"), F.col(text).alias("text"))
    return texts.mapInArrow(run, "host string, node long, row_key long, line_keys array<long>")


def measure(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """The measures of each text (doc_id, host, text, gone), and its clean text with its word characters.

    Cleaned and measured by the same Python worker, a block of texts at a time.
    """
    kind = rows.select("doc_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in blocks(batch.column(2)):
                yield facts(batch.slice(start, end - start))

    def sized(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, starts, ends, rows = words(column)
        letters = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=letters[1:])
        chars = np.bincount(rows, weights=letters[ends] - letters[starts], minlength=len(column)).astype(np.int64)
        return span_hashes(data, starts, ends), rows, chars

    def facts(batch: pa.RecordBatch) -> pa.RecordBatch:
        column, n = batch.column(2), len(batch)
        hashes, rows, chars = sized(column)
        texts = column.to_pylist()
        clean = pa.array(_clean_texts(shared.value, batch.column(1).to_pylist(), texts, batch.column(3).to_pylist()), pa.string())
        texts = [x or "" for x in texts]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                clean,
                pa.array(np.bincount(rows, minlength=n)),
                pa.array(chars),
                pa.array(sized(clean)[2]),
                pa.array([len(_SYMBOLS.findall(x)) for x in texts], pa.int64()),
                pa.array([again(x) for x in texts], pa.int64()),
                pa.array(repeat_words(hashes, rows, n)),
            ],
            ["doc_id", "host", "clean", "n_words", "word_chars", "clean_chars", "n_symbols", "n_dup_lines",
             "n_repeat_words"],
        )

    return rows.select("doc_id", "host", "text", "gone").mapInArrow(run, SCHEMA.format(kind=kind))


def _node(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _place(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Position of each word in its row."""
    count = np.bincount(rows, minlength=n_rows)
    return (np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)


def frequent_lines(sets: DataFrame, least_docs: int) -> DataFrame:
    """host, line_key of the lines above the limit. Copies of a text are one document."""
    return (
        sets.select("host", "row_key", F.explode("line_keys").alias("line_key"))
        .distinct()
        .groupBy("host", "line_key")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least_docs)
        .select("host", "line_key")
    )


def _gone(sets: DataFrame, frequent: DataFrame) -> DataFrame:
    """h, t, gone: the frequent lines of each text that has some."""
    frequent = frequent.select(F.col("host").alias("of"), F.col("line_key").alias("line"))
    found = sets.select("host", "node", F.explode("line_keys").alias("line_key"))
    same = (F.col("line_key") == F.col("line")) & F.col("host").eqNullSafe(F.col("of"))
    found = found.join(frequent, same, "left_semi").groupBy(F.col("host").alias("h"), F.col("node").alias("t"))
    return found.agg(F.collect_set("line_key").alias("gone"))


def _line_keys(names: list[str]) -> np.ndarray:
    data, at = raw(pa.array(names, pa.large_string()))
    return span_hashes(data, at[:-1], at[1:]).view(np.int64)


def without(text: str, gone: set[int]) -> str:
    """The text without the lines whose key is gone; other lines stay as they are."""
    lines = text.split("\n")
    named = [line_name(line) for line in lines]
    keys = _line_keys([name for name, _ in named]).tolist()
    return "\n".join(x for x, (_, size), key in zip(lines, named, keys) if not (size and key in gone))


def _clean_texts(known: dict[str | None, set[int]] | None, hosts: Iterable, texts: Iterable, gone: Iterable) -> list[str | None]:
    """The texts without the lines known for their host or, where none were sent, without their own gone ones."""
    found = []
    for name, x, keys in zip(hosts, texts, gone):
        lost = known.get(name) if known is not None else None if keys is None else set(map(int, keys))
        found.append(without(x, lost) if x and lost else x)
    return found


def _marked(docs: DataFrame, host: str, text: str, least_docs: int) -> tuple[DataFrame, Broadcast]:
    """The rows of docs (all their columns as `row`) with the frequent lines of their text (`gone`), or else
    those of all hosts, sent to all tasks."""
    sets = line_sets(docs, host, text)
    frequent = stored(frequent_lines(sets, least_docs), "frequent_lines")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(host).cast("string").alias("host"), F.col(text).alias("text"), _node(text).alias("node"),
    )
    sent: dict[str | None, set[int]] | None = None
    if frequent.count() <= MOST_SENT:
        sent = {}
        for r in frequent.collect():
            sent.setdefault(r.host, set()).add(r.line_key)
        rows = rows.withColumn("gone", F.lit(None).cast("array<long>"))
    else:
        same = (F.col("node") == F.col("t")) & F.col("host").eqNullSafe(F.col("h"))
        rows = rows.join(_gone(sets, frequent), same, "left")
    return rows, docs.sparkSession.sparkContext.broadcast(sent)


def clean(docs: DataFrame, host: str = "source", text: str = "text", least_docs: int = 10) -> DataFrame:
    """The documents, with all their columns, without the frequent lines of their host."""
    rows, shared = _marked(docs, host, text, least_docs)

    @F.pandas_udf("string")
    def cleaned(hosts: pd.Series, texts: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series(_clean_texts(shared.value, hosts, texts, gone), dtype=object)

    found = rows.select("row", cleaned("host", "text", "gone").alias("clean"))
    return found.select(*[F.col("clean" if c == text else f"row.`{c}`").alias(c) for c in docs.columns])


def judge(
    docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text",
    least_docs: int = 10, most_removed: float = 0.5,
) -> DataFrame:
    """One row per document: the measures, removed_chars, base_failed, kept and the clean text."""
    found, shared = _marked(docs, host, text, least_docs)
    measured = measure(found.select(F.col(f"row.`{key}`").alias("doc_id"), "host", "text", "gone"), shared)
    gone = F.col("word_chars") - F.col("clean_chars")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = gone > F.lit(most_removed) * F.col("word_chars")
    return measured.select(
        F.col("doc_id").alias(key), "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        gone.alias("removed_chars"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "clean",
    )
