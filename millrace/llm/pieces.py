"""SentencePiece ids and their decoded text, by a table of distinct chunks.

No piece of the model has a white-space marker after another character (`check_model`), so no merge
crosses the place before a run of markers. A text is cut there, each distinct chunk is segmented
once by the library, and the ids of the chunks are joined back by position.

The table is kept while a task lasts and starts anew at TABLE_CHUNKS entries, so memory is bounded
and nothing is shuffled; a chunk is then segmented once in each task and not once in the corpus. A
table of the whole corpus would have to be joined to every word position of it: 133 million
positions for 0.5 GB, several times the disk of the input.

Nulls are empty texts. An empty text has the begin and the end id only. Repeated rows give repeated
rows; columns other than key and text are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TABLE_CHUNKS = 400_000
#: Longer chunks are not kept in the table.
LONG_CHUNK = 64
SCHEMA = "n_tokens long, ids binary, decoded string"
_MARK = "▁"
_RUNS = re.compile(" +[^ ]*")


def model_file(name: str) -> str:
    """Path of a public tokenizer file, or the path itself if it is one."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load(name: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file(name))


def check_model(processor) -> None:
    """Raises for a model whose pieces may cross white-space markers, or that changes its input."""
    pieces = [processor.id_to_piece(i) for i in range(processor.vocab_size())]
    if any(_MARK in p.lstrip(_MARK) for p in pieces):
        raise ValueError("the model has pieces that cross white-space markers")
    if processor.decode(processor.encode(" ²  ﬁ ")) != " ²  ﬁ ":
        raise ValueError("the model normalises its input")


class ChunkTable(dict):
    """Chunk without its first marker -> (ids as little-endian bytes, their text)."""

    def __init__(self, processor):
        super().__init__()
        self.processor = processor
        self.mark = processor.piece_to_id(_MARK)

    def __missing__(self, chunk: str) -> tuple[bytes, str]:
        ids = self.processor.encode(chunk) if chunk else [self.mark]
        made = (np.asarray(ids, "<u4").tobytes(), self.processor.decode(ids) if chunk else "")
        if len(chunk) <= LONG_CHUNK:
            if len(self) >= TABLE_CHUNKS:
                self.clear()
            self[chunk] = made
        return made


def chunks(text: str) -> list[str]:
    """The chunks of a text, each without its first marker. Joined by a space they are the text."""
    text = text.replace(_MARK, " ")
    if not text:
        return []
    parts = text.split(" ")
    if "" in parts:
        parts = [x[1:] for x in _RUNS.findall(" " + text)]
    return parts


def encode_decode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids (little-endian unsigned 32-bit, with begin and end id), decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = load(model)
        check_model(processor)
        table = ChunkTable(processor)
        begin = np.asarray([processor.bos_id()], "<u4").tobytes()
        end = np.asarray([processor.eos_id()], "<u4").tobytes()
        for batch in batches:
            ids, decoded = [], []
            for value in batch.column(1):
                found = [table[x] for x in chunks(value.as_py() or "")]
                ids.append(b"".join([begin, *[x[0] for x in found], end]))
                decoded.append(" ".join([x[1] for x in found]))
            counts = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                ["key", "n_tokens", "ids", "decoded"],
            )

    kind = docs.select(key).schema[0].dataType.simpleString()
    return (
        docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text")
        .mapInArrow(run, f"key {kind}, {SCHEMA}")
        .withColumnRenamed("key", key)
    )
