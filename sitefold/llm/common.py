"""Word hashing and column helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

WORD = re.compile(r"\w+")
#: Entries of a worker's word memo; it is emptied when full, so its memory is bounded.
MEMO_ENTRIES = 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes by word, the same in every process."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(text: str, memo: WordHashes, pattern: re.Pattern = WORD) -> np.ndarray:
    """Hashes of the lower-cased words of ``text``, in order."""
    words = pattern.findall(text.lower())
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """Order-dependent hash of equally long arrays, element by element."""
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        out = (out ^ part) * _MIX
        out ^= out >> np.uint64(32)
    return out


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size`` consecutive words.

    A text with fewer words has one shingle of all its words; without words, none.
    """
    size = min(size, len(words))
    if not size:
        return np.empty(0, np.uint64)
    last = len(words) - size + 1
    return np.unique(combine([words[k : k + last] for k in range(size)]))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and whole ``text`` only (null: empty); other columns are left behind."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def release_memory() -> None:
    """Gives freed memory back to the system.

    A worker process serves task after task; without this it keeps the most that any of them held.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        pass


def parts(batches, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small pieces of Arrow batches; memory is released before and after a task."""
    release_memory()
    try:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield batch.slice(start, rows)
    finally:
        release_memory()


def id_texts(batches) -> Iterator[list[tuple[int, str]]]:
    """Small lists of rows of Arrow batches of ``doc_id`` and ``text``."""
    for part in parts(batches):
        yield list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))


def arrow_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )
