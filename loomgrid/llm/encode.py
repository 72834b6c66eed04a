"""Token ids of a whole corpus by a public byte-level tokenizer file."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.bpe import Vocabulary, Words, cut_words, gather, vocabulary

TOKENIZERS = "/opt/tokenizers"
#: Bytes of text cut at a time; words and distinct bytes held before they are encoded. All bound the memory of a task.
CHUNK_BYTES, HELD_WORDS, HELD_BYTES = 4_000_000, 12_000_000, 24_000_000


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about CHUNK_BYTES of text (a longer text alone)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


@dataclass
class Held:
    """Texts cut into words, kept until the distinct words of the partition are encoded together."""

    words: Words = field(default_factory=Words)
    parts: list[tuple[pa.Array, np.ndarray, np.ndarray]] = field(default_factory=list)
    count: int = 0
    size: int = 0

    def add(self, batch: pa.RecordBatch) -> None:
        cut, counts = cut_words(batch["text"])
        before = len(self.words.number)
        numbers = self.words.numbers(cut)
        self.parts.append((batch["id"], numbers, counts))
        self.count += len(numbers)
        if len(self.words.number) > before:
            self.size += len(cut.dictionary.buffers()[2] or b"")

    @property
    def full(self) -> bool:
        return self.count >= HELD_WORDS or self.size >= HELD_BYTES


def shipped(df: DataFrame, path: str) -> Broadcast[Vocabulary]:
    """The vocabulary, read once where the driver runs and sent with the job; its size is that of the file, whatever the corpus."""
    return df.sparkSession.sparkContext.broadcast(vocabulary(path))


def token_runs(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each part of a partition: the ids of its texts, the words and word counts of each text, and the
    encoded words (flat tokens, offsets)."""
    held = Held()
    for batch in batches:
        for part in slices(batch, "text"):
            held.add(part)
            if held.full:
                flat, offsets = held.words.encoded(vocabulary)
                yield from ((*p, flat, offsets) for p in held.parts)
                held = Held()
    flat, offsets = held.words.encoded(vocabulary)
    yield from ((*p, flat, offsets) for p in held.parts)


def text_offsets(words: np.ndarray, counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n + 1 token offsets of n texts."""
    tokens = np.concatenate([[0], np.cumsum(offsets[words + 1] - offsets[words])])
    return tokens[np.concatenate([[0], np.cumsum(counts)])]


def encode_corpus(documents: DataFrame, id: str, text: str, file: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """``id`` and ``ids`` (array of integers) of every row, without special tokens; strings that look like special
    tokens are ordinary text. A null and an empty text both give an empty list; repeated ids come out as
    often as they go in. Whole texts are encoded, of any length; other columns of ``documents`` are ignored.

    No shuffle: each task encodes its part of the scan.
    """
    sent = shipped(documents, f"{folder}/{file}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, counts, flat, offsets in token_runs(batches, sent.value):
            ends = text_offsets(words, counts, offsets).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(gather(flat, offsets, words)))
            yield pa.RecordBatch.from_arrays([ids, lists], names=["id", "ids"])

    kind = documents.schema[id].dataType.simpleString()
    named = documents.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return named.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id)


def decode_corpus(encoded: DataFrame, id: str, ids: str, file: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """``id`` and ``text`` of every row, the inverse of ``encode_corpus``; a null list gives an empty text, bytes that aren't UTF-8
    become replacement characters."""
    sent = shipped(encoded, f"{folder}/{file}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = sent.value.spelled
        for batch in batches:
            texts = [b"".join([spelled[i] for i in tokens or ()]).decode("utf-8", "replace") for tokens in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id].dataType.simpleString()
    named = encoded.select(F.col(id).alias("id"), F.col(ids).alias("ids"))
    return named.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id)
