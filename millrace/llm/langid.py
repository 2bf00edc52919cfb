"""Language identification by unigrams of subword pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. A language has a probability for each piece, and the
probability of a word is the sum, over all ways to cut the marked word into pieces, of the products of their
probabilities; a forward algorithm gets it in one pass over the word. A text is its words, each marked at
its start. A character without a piece of its own is cut into the vocabulary's byte pieces.

Training counts the words of all training documents per language (partial sums in tasks, one row for each
different word afterwards). Expectation-maximisation runs over this table: tasks add up the expected count of
each piece by forward and backward sums, and only languages times pieces come to the driver. The first
ROUNDS - 1 rounds only find a start; they take, of each language, the FIRST_WORDS different words with the least
hashes. The last round, whose counts are the model, takes all words. A language's probability before any word is
its share of the training documents.

Scoring reads whole texts in one scan. A task segments each different word once, for all languages together.
The model, languages times pieces, is sent to all tasks; language codes are taken to be a small set.

Learned from: documents with text and language, outside the held-out fold (crc32 of the id as text, modulo
FOLDS, is 0). A null id belongs to no fold and is not learned from. A text that is null or has no letter is
`und` with score 0, as is every text if nothing could be learned. Otherwise the score is the probability of the
predicted language among the learned ones; of equally likely ones the first by name is taken. Rows that repeat an
id are predicted each. An empty table gives an empty result. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.kneser import word_blocks
from millrace.llm.pieces import load
from millrace.workspace import stored

FOLDS = 5
ROUNDS = 3
FIRST_WORDS = 50_000
#: Added to the expected count of each piece.
ADDED = 0.1
UNKNOWN = "und"
MARK = "▁"
#: Different words that a task remembers, and words and bytes worked on at once.
TASK_WORDS = 400_000
SOME_WORDS, SOME_BYTES = 16_384, 1 << 18


class Vocabulary:
    """The pieces of a model file, and a trie of their bytes: `child[node, byte]` is 0 where no piece goes on."""

    def __init__(self, model: str):
        processor = load(model)
        self.size = processor.get_piece_size()
        self.pieces: dict[str, int] = {}
        self.bytes = np.zeros(256, np.int64)
        for i in range(self.size):
            if processor.is_byte(i):
                self.bytes[int(processor.id_to_piece(i)[3:-1], 16)] = i
            elif not (processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)):
                self.pieces[processor.id_to_piece(i)] = i
        node: dict[bytes, int] = {b"": 1}
        for piece in self.pieces:
            coded = piece.encode()
            for k in range(1, len(coded) + 1):
                node.setdefault(coded[:k], len(node) + 1)
        self.child = np.zeros((len(node) + 1, 256), np.uint16 if len(node) < 1 << 16 else np.uint32)
        for coded, n in node.items():
            if coded:
                self.child[node[coded[:-1]], coded[-1]] = n
        #: The piece that ends at a node, or -1.
        self.ends = np.full(len(node) + 1, -1, np.int64)
        for piece, i in self.pieces.items():
            self.ends[node[piece.encode()]] = i
        self.longest = max((len(p.encode()) for p in self.pieces), default=1)


class Lattice:
    """All pieces of some words by place: `word`, `start`, `end` (in bytes) and `piece` of each edge."""

    def __init__(self, words: list[str], vocabulary: Vocabulary):
        coded = [(MARK + w).encode() for w in words]
        self.lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        data = np.frombuffer(b"".join(coded), np.uint8)
        word = np.repeat(np.arange(len(coded)), self.lengths)
        first = np.cumsum(self.lengths) - self.lengths
        last = np.repeat(first + self.lengths, self.lengths)
        chars = np.flatnonzero((data & 0xC0) != 0x80)
        size = np.diff(chars, append=len(data))
        unknown = np.ones(len(data), bool)
        width = np.zeros(len(data), np.int64)
        width[chars] = size
        at, node, depth = chars, np.ones(len(chars), np.int64), 0
        starts, ends, pieces = [], [], []
        while len(at):  # all places go down the trie together
            there = at + depth < last[at]
            at, node = at[there], node[there]
            node = vocabulary.child[node, data[at + depth]]
            at, node, depth = at[node > 0], node[node > 0], depth + 1
            piece = vocabulary.ends[node]
            full = piece >= 0
            starts.append(at[full])
            ends.append(at[full] + depth)
            pieces.append(piece[full])
            unknown[at[full & (width[at] == depth)]] = False
        alone = np.repeat(unknown[chars], size)  # bytes of characters without a piece of their own
        single = np.flatnonzero(alone)
        start = np.concatenate([*starts, single])
        end = np.concatenate([*ends, single + 1])
        self.piece = np.concatenate([*pieces, vocabulary.bytes[data[single]]])
        self.word = word[start]
        self.start, self.end = start - first[self.word], end - first[self.word]

    def by(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[int, slice, np.ndarray]]]:
        """The order of the edges by place and word, the words in this order, and for each place its edges
        there and where each word's begin."""
        order = np.argsort(place * len(self.lengths) + self.word, kind="stable")
        place, word = place[order], self.word[order]
        cuts = np.flatnonzero(np.diff(place, prepend=-1)).tolist()
        begins = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(word, prepend=-1) != 0))
        parts = np.searchsorted(begins, [*cuts, len(order)]).tolist()

        def places() -> Iterator[tuple[int, slice, np.ndarray]]:
            for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(order)])):
                yield int(place[a]), slice(a, b), begins[parts[i] : parts[i + 1]] - a

        return order, word, places()


def _log_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The logarithm of the sum of exp(values) of each run of rows."""
    most = np.maximum.reduceat(values, first)
    sizes = np.diff(first, append=len(values))
    return most + np.log(np.add.reduceat(np.exp(values - np.repeat(most, sizes, axis=0)), first))


def forward(lattice: Lattice, logp: np.ndarray, longest: int) -> np.ndarray:
    """The log probability of each word in each language; logp has a row for each piece.

    Only the last `longest` places of each word are kept, so a word of any length costs the same memory.
    """
    width, n = longest + 1, len(lattice.lengths)
    alpha = np.zeros((n * width, logp.shape[1]))
    found = np.zeros((n, logp.shape[1]))
    order, word, places = lattice.by(lattice.end)
    before = lattice.start[order] % width * n + word
    piece = lattice.piece[order]
    for end, edges, first in places:
        sums = _log_sums(alpha[before[edges]] + logp[piece[edges]], first)
        words = word[edges][first]
        alpha[end % width * n + words] = sums
        last = lattice.lengths[words] == end
        found[words[last]] = sums[last]
    return found


def expected(lattice: Lattice, logp: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The expected count of each edge's piece; logp has a value for each edge, `times` one for each word."""
    begin = np.cumsum(lattice.lengths + 1) - lattice.lengths - 1
    start, end = begin[lattice.word] + lattice.start, begin[lattice.word] + lattice.end
    size = int((lattice.lengths + 1).sum())
    alpha, beta = np.zeros(size), np.zeros(size)
    back = int(lattice.lengths.max(initial=0))
    for sums, place, source, target in ((alpha, lattice.end, start, end), (beta, back - lattice.start, end, start)):
        order, _, places = lattice.by(place)
        source, target, value = source[order], target[order], logp[order]
        for _, edges, first in places:
            sums[target[edges][first]] = _log_sums(sums[source[edges]] + value[edges], first)
    whole = beta[begin][lattice.word]
    return np.exp(alpha[start] + logp + beta[end] - whole) * times[lattice.word]


def some(words: list[str], most: int = SOME_WORDS) -> Iterator[np.ndarray]:
    """Places of the words in groups of similar length, bounded in number and bytes; a longer word is alone."""
    sizes = np.array([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    total = np.concatenate([[0], np.cumsum(sizes[order] + 1)])
    a = 0
    while a < len(order):
        b = int(np.searchsorted(total, total[a] + SOME_BYTES, "right")) - 1
        b = min(len(order), max(b, a + 1), a + most)
        yield order[a:b]
        a = b


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n: the words of the texts (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict[int, list]] = {}  # language, word hash: text and count

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in seen.items():
                rows = list(found.values())
                for k in range(0, len(rows), 20_000):
                    names, sizes = zip(*rows[k : k + 20_000])
                    columns = [pa.array([lang] * len(names)), pa.array(names), pa.array(sizes, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])
            seen.clear()

        for batch in batches:
            langs = batch.column(0).to_numpy(zero_copy_only=False)
            for lang in sorted(set(langs)):
                texts = batch.column(1).filter(pa.array(langs == lang))
                for _, hashes, counts, _, _, text in word_blocks(texts):
                    own = seen.setdefault(lang, {})
                    for k, (h, n) in enumerate(zip(hashes.tolist(), counts.tolist())):
                        if (entry := own.get(h)) is None:
                            own[h] = [text(k), n]
                        else:
                            entry[1] += n
                    if sum(map(len, seen.values())) > TASK_WORDS:
                        yield from flush()
        yield from flush()

    found = docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def piece_counts(table: DataFrame, langs: list[str], logp: np.ndarray, model: str) -> np.ndarray:
    """Expected counts (a row for each piece, a column for each language) of the words of a table."""
    shared = table.sparkSession.sparkContext.broadcast(logp)
    number = {lang: i for i, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = Vocabulary(model), shared.value
        sums = np.zeros(known.shape)
        for batch in batches:
            own = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            words, times = batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(float)
            for at in some(words):
                lattice = Lattice([words[i] for i in at], vocabulary)
                of = own[at][lattice.word]
                found = expected(lattice, known[lattice.piece, of], times[at])
                np.add.at(sums, (lattice.piece, of), found)
        piece, of = np.nonzero(sums)
        arrays = [pa.array(piece), pa.array(of), pa.array(sums[piece, of])]
        yield pa.RecordBatch.from_arrays(arrays, ["piece", "lang", "n"])

    parts = table.select("lang", "word", "n").mapInArrow(run, "piece long, lang long, n double")
    whole = np.zeros(logp.shape)
    # at most one row for each piece and language
    for batch in parts.groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow().to_batches():
        whole[batch.column(0).to_numpy(), batch.column(1).to_numpy()] = batch.column(2).to_numpy()
    return whole


@dataclass(frozen=True)
class Model:
    langs: list[str]
    #: Log probabilities: a row for each piece, a column for each language; and of the languages themselves.
    logp: np.ndarray
    prior: np.ndarray


def fit(docs: DataFrame, model: str, rounds: int = ROUNDS) -> Model | None:
    """The model of the documents (lang, text), or None if there is not one word."""
    table = stored(word_counts(docs), "language_words")
    sizes = docs.where("text is not null").groupBy("lang").count()
    known = table.select("lang").distinct()
    shares = {r.lang: r["count"] for r in sizes.join(known, "lang", "left_semi").collect()}
    if not shares:
        return None
    langs = sorted(shares)
    size = Vocabulary(model).size
    logp = np.full((size, len(langs)), -np.log(size))
    total = table.groupBy("lang").count().collect()
    share = {r.lang: min(1.0, FIRST_WORDS / r["count"]) for r in total}
    bound = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(share[lang] * 2**62))])[F.col("lang")]
    some_words = table.where(F.shiftrightunsigned(F.xxhash64("word"), 2) <= bound)
    for k in range(rounds):
        counts = piece_counts(table if k == rounds - 1 else some_words, langs, logp, model) + ADDED
        logp = np.log(counts / counts.sum(axis=0))
    prior = np.array([shares[x] for x in langs], float)
    return Model(langs, logp, np.log(prior / prior.sum()))


class Words:
    """The log probabilities of the words a task has met, by hash."""

    def __init__(self, model: Model, vocabulary: Vocabulary):
        self.model, self.vocabulary = model, vocabulary
        self.most = max(64, 8 * SOME_WORDS // len(model.langs))
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.values = np.zeros((1024, len(self.model.langs)))

    def of(self, hashes: list[int], text) -> np.ndarray:
        """A row for each hash; `text(k)` is the word of the k-th."""
        if len(self.place) > TASK_WORDS:
            self.clear()
        new = [k for k, h in enumerate(hashes) if h not in self.place]
        words = [text(k) for k in new]
        first = len(self.place)
        while first + len(new) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.place.update((hashes[k], first + i) for i, k in enumerate(new))
        for at in some(words, self.most):
            lattice = Lattice([words[i] for i in at], self.vocabulary)
            self.values[first + at] = forward(lattice, self.model.logp, self.vocabulary.longest)
        return self.values[[self.place[h] for h in hashes]]


def predict(docs: DataFrame, fitted: Model | None, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        words = Words(own, Vocabulary(model)) if own else None
        for batch in batches:
            names, scores = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            if words:
                total = np.tile(own.prior, (len(batch), 1))
                for start, hashes, _, rows, which, name in word_blocks(batch.column(2)):
                    if not len(hashes):
                        continue
                    values = words.of(hashes.tolist(), name)[which]
                    end = start + int(rows.max()) + 1
                    for k in range(len(own.langs)):
                        total[start:end, k] += np.bincount(rows, weights=values[:, k])
                best = total.argmax(axis=1)
                known = batch.column(1).to_numpy(zero_copy_only=False)
                names[known] = np.array(own.langs, object)[best[known]]
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                scores[known] = share[known]
            columns = [batch.column(0), pa.array(names, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "lang_pred", "score"])

    rows = docs.select(F.col(key).alias("key"), letter.alias("letter"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def classify(
    docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """key, held_out, lang_pred, score; `model` names the vocabulary's file."""
    fold = F.crc32(F.col(key).cast("string")) % FOLDS
    usable = (fold != 0) & F.col(lang).isNotNull()
    fitted = fit(docs.where(usable).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")), model)
    held = F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == 0, F.lit(False))
    return predict(docs, fitted, model, key, text).select(key, held.alias("held_out"), "lang_pred", "score")
