"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model predicts each character of a word from up to ORDER - 1 characters before it in the word,
with a mark before and after each word; one model per language. Counts, continuation counts,
discounts and context sums are aggregates over tables of n-grams, and every probability comes from
joins of these tables, order by order:

    p(c | h) = max(a(hc) - D(a(hc)), 0) / sum(a(h.)) + gamma(h) * p(c | h without its first character)

with a the count at the highest order and at word starts, and else the number of different
characters that precede; D has three values per language and order, from counts of counts.

Windows (a character and its context) of all documents are counted in one scan, for all documents and for
the trusted ones of each fold, as columns of one row for each window. Tasks make the windows of a small block of
texts at once as arrays, and tell words and windows apart by 64-bit hashes of language and text. So the three models (all trusted text, and
each fold) share every table, shuffle and join, order by order. Tables are deleted after their last reader. The scores of the most frequent windows, at most HOT_WINDOWS of up to ORDER
characters, go to all tasks; each document adds them up by itself, and only its other windows go by a
shuffle join. Sums per document are partial sums; no n-gram table is gathered anywhere.

A document's score is its mean log probability per character, drawn to the mean of trusted text with
the weight of SHRINK characters. Documents outside the language's quantiles of trusted text are
rejected: above, text unlike the language; below, text of a few repeated words. The quantiles are those
of held-out text: trusted texts are in two folds by their hash, and each is scored by a model of the
other fold. A language all of whose trusted texts are in one fold has the quantiles of the model's own text.

Fitting, the mean and the quantiles use all trusted documents of a language. Quantiles are taken from counts
of scores in steps of 1 / STEPS, in which documents are compared with them too. A null text is empty; texts without words are rejected. A null language
is a language of its own; one without trusted text has no model, and its documents are kept. Rows
that repeat id, language and text share one result. Other columns are left out by `scores`;
`keep_good` returns exactly the columns it was given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.arrow import blocks, mix, span_hashes, words
from millrace.workspace import discard, stored

ORDER = 5
#: Trusted ids, and rows of tables with a row per language, that are sent to all tasks; more go by a shuffle join.
MOST_SENT_IDS, MOST_SENT_LANGUAGES = 500_000, 20_000
HOT_WINDOWS = 1 << 17
SHRINK = 100
LOW, HIGH = 0.005, 0.995
STEPS = 10_000
BEGIN, END = "\x02", "\x03"
#: Distinct windows that a counting task remembers, and bytes of text whose windows are made at once.
TASK_GRAMS, WINDOW_BYTES = 500_000, 1 << 19


def windows(word: str) -> list[str]:
    """Each character of the marked word, the end mark included, with its context."""
    marked = BEGIN + word.replace(BEGIN, " ").replace(END, " ") + END
    short = [marked[:i] for i in range(2, min(len(marked), ORDER) + 1)]
    return short + [marked[i - ORDER : i] for i in range(ORDER + 1, len(marked) + 1)]


def word_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable]]:
    """For blocks of rows: first row, hashes of the distinct words, their counts, the row and the
    distinct word of each word, and a function that gives the text of a distinct word."""
    for start, end in blocks(column):
        data, first, last, rows = words(column.slice(start, end - start))
        hashes, at, which, counts = np.unique(
            span_hashes(data, first, last), return_index=True, return_inverse=True, return_counts=True
        )

        def text(k: int, data=data, first=first, last=last, at=at) -> str:
            return data[first[at[k]] : last[at[k]]].tobytes().decode("utf-8", "replace")

        yield start, hashes, counts, rows, which, text


class BlockWindows(NamedTuple):
    """The words of a block of rows and the windows of its distinct words, of which a language is part."""

    rows: np.ndarray  # of each word
    which: np.ndarray  # of each word the distinct word
    langs: np.ndarray  # of each distinct word
    owner: np.ndarray  # of each window the distinct word; ascending
    keys: np.ndarray  # of each window a 64-bit hash of its language and characters
    chars: tuple[np.ndarray, np.ndarray]  # of each window its characters, packed


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key the number of its distinct key, and of each distinct key a place where it is."""
    which = pa.array(keys).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    at = np.zeros(int(which.max(initial=-1)) + 1, np.int64)
    at[which] = np.arange(len(which))
    return which, at


def _each(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range, one range after another."""
    return np.arange(int(sizes.sum())) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)


def _packed(chars: np.ndarray, last: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of so many code points that end at these places, as two integers of 21 bits for each."""

    def back(k: int) -> np.ndarray:
        return np.where(sizes > k, chars[last - k] + np.uint64(1), np.uint64(0)) << np.uint64(21 * (k % 3))

    return back(0) | back(1) | back(2), back(3) | back(4)


def _unpacked(low: np.ndarray, high: np.ndarray) -> pa.Array:
    """The texts of packed windows."""
    columns = [(part >> np.uint64(shift)) & np.uint64(0x1FFFFF) for part, shift in ((high, 21), (high, 0), (low, 42), (low, 21), (low, 0))]
    chars = np.stack(columns, 1)
    there = chars > 0
    chars = (np.maximum(chars, 1) - np.uint64(1)).astype("<u4")
    sizes = np.where(there, 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000), 0).sum(axis=1)
    text = chars[there].tobytes().decode("utf-32-le").encode()
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(text))


def _keys(chars: tuple[np.ndarray, np.ndarray], langs: np.ndarray) -> np.ndarray:
    low, high = chars
    return mix(low + mix(high + mix(langs.astype(np.uint64))))


def block_windows(texts: pa.Array, langs: np.ndarray) -> BlockWindows:
    """All windows of a block of texts, whose languages are numbers. See `windows` for those of one word."""
    data, first, last, rows = words(texts)
    which, at = _distinct(mix(span_hashes(data, first, last) + mix(langs[rows].astype(np.uint64))))
    first, sizes = first[at], (last - first)[at]
    # each distinct word between two line feeds, which are in no word and become its marks
    marked = np.full(int(sizes.sum()) + 2 * len(sizes), 10, np.uint8)
    marked[_each(np.cumsum(sizes + 2) - sizes - 1, sizes)] = data[_each(first, sizes)]
    chars = np.frombuffer(marked.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.uint64)
    edges = np.flatnonzero(chars == 10)
    chars[(chars == ord(BEGIN)) | (chars == ord(END))] = 32
    chars[edges[::2]], chars[edges[1::2]] = ord(BEGIN), ord(END)
    sizes = edges[1::2] - edges[::2]
    place = _each(edges[::2] + 1, sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    packed = _packed(chars, place, np.minimum(place - edges[::2][owner] + 1, ORDER))
    langs = langs[rows[at]]
    return BlockWindows(rows, which, langs, owner, _keys(packed, langs[owner]), packed)


def _numbers(column: pa.Array, codes: dict[str, int]) -> np.ndarray:
    """The number of each language; new ones are added to the codes."""
    names = column.dictionary_encode()
    known = np.array([codes.setdefault(name, len(codes)) for name in names.dictionary.to_pylist()], np.int64)
    return known[names.indices.to_numpy(zero_copy_only=False)]


class Counts:
    """Windows and their sums in three columns: rows of key, language, two of characters, and the sums."""

    def __init__(self) -> None:
        self.parts: list[list[np.ndarray]] = []
        self.rows = 0

    def add(self, rows: list[np.ndarray]) -> None:
        which, at = _distinct(rows[0])
        sums = [np.bincount(which, x, len(at)).astype(np.int64) for x in rows[4:]]
        self.parts.append([x[at] for x in rows[:4]] + sums)
        self.rows += len(at)

    def merge(self) -> list[np.ndarray]:
        """All rows as one part."""
        if len(self.parts) > 1:
            whole = [np.concatenate(x) for x in zip(*self.parts)]
            self.__init__()
            self.add(whole)
        return self.parts[0] if self.parts else [np.zeros(0, np.int64)] * 7


def window_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n, n0, n1: windows of the texts (lang, part, text), all and those of the parts 0 and 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        found = Counts()

        def flush() -> Iterator[pa.RecordBatch]:
            names = pa.array(list(codes), pa.string())
            whole = found.merge()
            for k in range(0, len(whole[0]), 20_000):
                _, lang, low, high, *sums = (x[k : k + 20_000] for x in whole)
                columns = [names.take(pa.array(lang)), _unpacked(low, high), *map(pa.array, sums)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n", "n0", "n1"])
            found.__init__()

        for batch in batches:
            langs, part = _numbers(batch.column(0), codes), batch.column(1).to_numpy()
            for start, end in blocks(batch.column(2), WINDOW_BYTES):
                one = block_windows(batch.column(2).slice(start, end - start), langs[start:end])
                of = part[start:end][one.rows]
                times = [np.bincount(one.which[x], minlength=len(one.langs)) for x in (slice(None), of == 0, of == 1)]
                found.add([one.keys, one.langs[one.owner], *one.chars, *[x[one.owner] for x in times]])
                if found.rows > 2 * TASK_GRAMS:
                    found.merge()
                    if found.rows > TASK_GRAMS:
                        yield from flush()
        yield from flush()

    found = docs.select("lang", "part", "text").mapInArrow(run, "lang string, gram string, n long, n0 long, n1 long")
    return found.groupBy("lang", "gram").agg(*[F.sum(c).alias(c) for c in ("n", "n0", "n1")])


def _context(gram: str = "gram") -> Column:
    return F.col(gram).substr(F.lit(1), F.length(gram) - 1)


def _suffix(gram: str = "gram") -> Column:
    return F.substring(gram, 2, ORDER)


#: Models: of all trusted text, and of each of its folds. They are columns of the same rows, w, 0 and 1.
MODELS = ("w", "0", "1")


def _orders(counts: DataFrame) -> dict[int, DataFrame]:
    """Per order the grams that the windows need, with their adjusted counts in each model (0: not in it)."""

    def level(n: int) -> DataFrame:
        own = counts.where(F.length("gram") == n)
        return own.select("lang", "gram", "n", (F.col("n0") + F.col("n1")).alias("aw"), F.col("n0").alias("a0"), F.col("n1").alias("a1"))

    found = {ORDER: stored(level(ORDER), "kn_orders")}
    for n in range(ORDER - 1, 0, -1):
        seen = [F.count_if(F.col(f"a{m}") > 0).alias(f"a{m}") for m in MODELS]
        follow = found[n + 1].groupBy("lang", _suffix().alias("gram")).agg(F.lit(0).cast("long").alias("n"), *seen)
        # windows at the start of a word keep their counts; no suffix starts there
        found[n] = stored(level(n).unionByName(follow), "kn_orders")
    return found


def _discounts(grams: DataFrame) -> DataFrame:
    """lang, d{m}{k} for counts k of 1, 2, and 3 or more in model m."""
    of = [F.count_if(F.col(f"a{m}") == k).alias(f"n{m}{k}") for m in MODELS for k in (1, 2, 3, 4)]

    def discount(m: str, k: int) -> Column:
        n1, n2, here, above = (F.col(f"n{m}{i}") for i in (1, 2, k, k + 1))
        y = F.try_divide(n1, n1 + 2 * n2)
        # counts of counts that are missing, as in tiny corpora, leave the plain value k / 2
        more = F.when((here > 0) & (above > 0), k - (k + 1) * y * above / here)
        return F.greatest(F.coalesce(more, F.lit(k / 2)), F.lit(0.05)).alias(f"d{m}{k}")

    return grams.groupBy("lang").agg(*of).select(F.col("lang").alias("_lang"), *[discount(m, k) for m in MODELS for k in (1, 2, 3)])


def _values(n: int, grams: DataFrame, lower: DataFrame | None) -> DataFrame:
    """lang, gram, n and the probability of each gram in each model; a context that a model does not have
    gives the probability of the order below.

    The grams of a context are at most as many as there are characters, so their sums are a window.
    """
    own = grams.join(_per_language(_discounts(grams)), F.col("lang") == F.col("_lang")).withColumn("ctx", _context())
    same = Window.partitionBy("lang", "ctx")
    if lower is not None:
        below = lower.select(F.col("lang").alias("_lower"), F.col("gram").alias("_gram"), *[F.col(f"v{m}").alias(f"l{m}") for m in MODELS])
    values = []
    for m in MODELS:
        a = F.col(f"a{m}")
        d = F.least(F.when(a == 1, F.col(f"d{m}1")).when(a == 2, F.col(f"d{m}2")).otherwise(F.col(f"d{m}3")), a)
        own = own.withColumn(f"h{m}", F.when(a > 0, d).otherwise(0.0))
    sums = [x for m in MODELS for x in (
        F.sum(f"a{m}").over(same).alias(f"total{m}"), F.sum(f"h{m}").over(same).alias(f"held{m}"),
        F.sum((F.col(f"a{m}") > 0).cast("long")).over(same).alias(f"kinds{m}"),
    )]
    own = own.select("lang", "gram", "n", *[f"{x}{m}" for m in MODELS for x in "ah"], *sums)
    if lower is not None:
        own = own.withColumn("suffix", _suffix())
        own = own.join(below, (F.col("lang") == F.col("_lower")) & (F.col("suffix") == F.col("_gram")))
    for m in MODELS:
        total, gamma = F.col(f"total{m}"), F.col(f"held{m}") / F.col(f"total{m}")
        rest = (F.col(f"a{m}") - F.col(f"h{m}")) / total
        if lower is None:  # the lowest order is mixed with the even chance of each known character and one unknown
            value = F.when(total > 0, rest + gamma / (F.col(f"kinds{m}") + 1))
        else:
            value = F.when(total > 0, rest + gamma * F.col(f"l{m}")).otherwise(F.col(f"l{m}"))
        values.append(value.alias(f"v{m}"))
    return own.select("lang", "gram", "n", *values)


def scored_windows(counts: DataFrame) -> DataFrame:
    """lang, gram, n, pw, p0, p1: log probabilities of the windows in each model, of languages with a model.

    A model without any text of a language gives NaN.
    """
    orders = _orders(counts)
    values: list[DataFrame] = []
    for n in range(1, ORDER + 1):
        level = _values(n, orders[n], values[-1] if values else None)
        if n == 1:
            level = level.where("vw is not null")
        values.append(stored(level, "kn_values"))
        discard(orders[n])
    whole = values[-1]
    for level in values[:-1]:  # shorter windows are those at the start of a word
        whole = whole.unionByName(level.where(F.col("gram").startswith(BEGIN)))
    logs = [F.coalesce(F.log(f"v{m}"), F.lit(float("nan"))).alias(f"p{m}") for m in MODELS]
    found = stored(whole.select("lang", "gram", "n", *logs), "kn_scores")
    discard(*values)
    return found


class HotWindows(NamedTuple):
    """The most frequent windows: numbers of languages, keys in ascending order, and log probabilities in each model."""

    langs: dict[str, int]
    keys: np.ndarray
    logs: np.ndarray


def hot_windows(scored: DataFrame) -> HotWindows:
    """The most frequent windows, at most HOT_WINDOWS."""
    level = F.floor(F.log2("n") * 4).cast("int")
    total, least = 0, None
    for r in scored.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        total += r["count"]
        if total > HOT_WINDOWS:
            break
        least = r["level"]
    if least is None:
        return HotWindows({}, np.zeros(0, np.uint64), np.zeros((0, len(MODELS))))
    frequent = scored.where(level >= least).select("lang", "gram", "pw", "p0", "p1").toArrow().combine_chunks()
    langs: dict[str, int] = {}
    numbers = _numbers(frequent.column("lang").combine_chunks(), langs)
    grams = frequent.column("gram").to_pylist()
    sizes = np.array([len(g) for g in grams], np.int64)
    chars = np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").astype(np.uint64)
    keys = _keys(_packed(chars, np.cumsum(sizes) - 1, sizes), numbers)
    order = np.argsort(keys)
    return HotWindows(langs, keys[order], np.stack([frequent.column(f"p{m}").to_numpy() for m in MODELS], 1)[order])


def document_sums(docs: DataFrame, hot: HotWindows) -> DataFrame:
    """id, lang, node, part, n (windows), the sums of the hot ones' logarithms in the whole model (logp) and in
    the one of the other fold (held, for parts 0 and 1), and cold: the other windows with counts."""
    kind = docs.select("id").schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def cold_windows(one: BlockWindows, n_rows: int, which: np.ndarray, at: np.ndarray, cold: np.ndarray) -> pa.Array:
        """Of each row its cold windows with counts; `cold` tells which distinct windows are cold."""
        there = cold[which]
        windows, sizes = which[there], np.bincount(one.owner[there], minlength=len(one.langs))
        begin, of = np.cumsum(sizes) - sizes, sizes[one.which]
        rows = np.repeat(one.rows, of)
        number, n_cold = np.cumsum(cold) - 1, max(int(cold.sum()), 1)
        pairs, times = np.unique(rows * n_cold + number[windows[_each(begin[one.which], of)]], return_counts=True)
        grams = _unpacked(*[x[at[cold]] for x in one.chars]).take(pa.array(pairs % n_cold))
        ends = np.cumsum(np.bincount(pairs // n_cold, minlength=n_rows))
        values = pa.StructArray.from_arrays([grams, pa.array(times.astype(np.int64))], ["gram", "times"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        codes = dict(known.langs)
        for batch in batches:
            numbers = _numbers(batch.column(1), codes)
            for start, end in blocks(batch.column(4), WINDOW_BYTES):
                some, n_rows = batch.slice(start, end - start), end - start
                one = block_windows(some.column(4), numbers[start:end])
                which, at = _distinct(one.keys)
                place = np.searchsorted(known.keys, one.keys[at])
                cold = np.append(known.keys, np.uint64(0))[place] != one.keys[at]
                cold |= place == len(known.keys)
                logs = np.append(known.logs, np.zeros((1, len(MODELS))), axis=0)[np.where(cold, len(known.keys), place)]
                sizes = np.bincount(one.owner, minlength=len(one.langs))
                sums = [np.bincount(one.owner, x[which], len(one.langs)) for x in logs.T]
                n, whole, first, second = (np.bincount(one.rows, x[one.which], n_rows) for x in (sizes, *sums))
                part = some.column(3).to_numpy()
                held = np.choose(part + 1, [np.zeros(n_rows), second, first])  # the other fold's model
                lists = cold_windows(one, n_rows, which, at, cold)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:4], pa.array(n.astype(np.int64)), pa.array(whole), pa.array(held), lists],
                    ["id", "lang", "node", "part", "n", "logp", "held", "cold"],
                )

    return docs.select("id", "lang", "node", "part", "text").mapInArrow(
        run,
        f"id {kind}, lang string, node long, part int, n long, logp double, held double, "
        "cold array<struct<gram string, times long>>",
    )


def _named(docs: DataFrame, key: str, lang: str, text: str) -> DataFrame:
    return docs.select(
        F.col(key).alias("id"),
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("node"),
        F.col(text).alias("text"),
    )


def scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """key, lang, node (of the text), n_windows, perplexity, low, high and kept."""
    named = _named(docs, key, lang, text)
    trusted = labels.where("quality = 1").select(F.col(key).alias("of")).where("of is not null").distinct()
    trusted = _sent(trusted, "kn_trusted", MOST_SENT_IDS)
    fold = F.when(F.col("node") % 2 == 0, 0).otherwise(1)
    named = named.join(trusted, F.col("id") == F.col("of"), "left")
    named = named.withColumn("part", F.when(F.col("of").isNotNull(), fold).otherwise(-1)).drop("of")
    counts = stored(window_counts(named), "kn_windows")
    scored = scored_windows(counts)
    discard(counts)
    sums = stored(document_sums(named, hot_windows(scored)), "kn_sums")
    own = ["id", "lang", "node", "part"]
    other = scored.select(F.col("lang").alias("_lang"), F.col("gram").alias("_gram"), "pw", "p0", "p1")
    cold = sums.select(*own, F.explode("cold").alias("x")).distinct()
    cold = cold.join(other, (F.col("lang") == F.col("_lang")) & (F.col("x.gram") == F.col("_gram")))
    held = F.when(F.col("part") == 0, F.col("p1")).when(F.col("part") == 1, F.col("p0")).otherwise(0.0)
    cold = cold.select(
        *own, F.lit(0).cast("long").alias("n"), (F.col("x.times") * F.col("pw")).alias("logp"), (F.col("x.times") * held).alias("held")
    )
    measures = [F.sum(c).alias(c) for c in ("n", "logp", "held")]
    whole = sums.select(*own, "n", "logp", "held").distinct().unionByName(cold).groupBy(*own).agg(*measures)
    whole = stored(whole, "kn_documents")
    known = _per_language(scored.select(F.col("lang").alias("_lang")).distinct())
    discard(scored, sums)
    return _judged(whole, known).withColumnRenamed("id", key)


def _sent(table: DataFrame, label: str, most: int) -> DataFrame:
    """The table, sent to all tasks by joins if it has at most so many rows."""
    table = stored(table, label)
    return F.broadcast(table) if table.count() <= most else table


def _per_language(table: DataFrame) -> DataFrame:
    return _sent(table, "kn_languages", MOST_SENT_LANGUAGES)


def _judged(whole: DataFrame, known: DataFrame) -> DataFrame:
    good = whole.where("part >= 0 and n > 0")
    means = good.groupBy(F.col("lang").alias("of_lang")).agg((F.sum("logp") / F.sum("n")).alias("mean"))
    means = _per_language(means)

    def shrunk(frame: DataFrame, logp: str) -> DataFrame:
        near = frame.join(means, F.col("lang") == F.col("of_lang"), "left").drop("of_lang")
        near = near.withColumn("score", (F.col(logp) + SHRINK * F.col("mean")) / (F.col("n") + SHRINK))
        return near.withColumn("step", F.round(F.col("score") * STEPS) / STEPS)

    # partial sums first: a language has as many rows as it has different steps, however many documents it has
    out = shrunk(good.where(~F.isnan("held")), "held").withColumn("out", F.lit(True))
    steps = out.unionByName(shrunk(good, "logp").withColumn("out", F.lit(False)))
    steps = steps.groupBy(F.col("lang").alias("of"), "out", "step").agg(F.count("*").alias("times"))
    places = F.array(F.lit(LOW), F.lit(HIGH))
    out, own = (F.percentile(F.when(x, F.col("step")), places, F.col("times")) for x in (F.col("out"), ~F.col("out")))
    limits = steps.groupBy("of").agg(F.coalesce(out, own).alias("q"))
    limits = limits.select("of", F.element_at("q", 1).alias("least"), F.element_at("q", 2).alias("most"))
    limits = _per_language(limits)
    judged = shrunk(whole, "logp").join(limits, F.col("lang") == F.col("of"), "left").join(
        known, F.col("lang") == F.col("_lang"), "left"
    )
    inside = F.col("step").between(F.col("least"), F.col("most"))
    return judged.select(
        "id", "lang", "node", F.col("n").alias("n_windows"),
        F.when(F.col("_lang").isNotNull(), F.exp(-F.col("score"))).alias("perplexity"),
        F.exp(-F.col("most")).alias("low"), F.exp(-F.col("least")).alias("high"),
        ((F.col("n") > 0) & F.coalesce(inside, F.lit(True))).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """The documents that the classifier keeps, with the columns they had."""
    judged = scores(docs, labels, key, lang, text).where("kept").select(
        F.col(key).alias("_id"), F.col("lang").alias("_lang"), F.col("node").alias("_node")
    )
    rows = _rows(docs, key, lang, text)
    same = (F.col("node") == F.col("_node")) & (F.col("lang") == F.col("_lang")) & F.col("id").eqNullSafe(F.col("_id"))
    return rows.join(judged, same, "left_semi").select("row.*")


def _rows(docs: DataFrame, key: str, lang: str, text: str) -> DataFrame:
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(key).alias("id"),
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("node"),
    )
