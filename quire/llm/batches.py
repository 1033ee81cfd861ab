"""Texts of Arrow batches: slices bounded in bytes, and words cut by a byte table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a worker treats at once.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most so many bytes of ``text``, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if len(sizes) > start:
        yield batch.slice(start)


def word_table(is_word: Callable[[int], bool]) -> np.ndarray:
    """A byte table: A-Z become lower case, bytes that belong to no word become blanks."""
    lower = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return np.array([b if is_word(b) else 32 for b in lower], dtype=np.uint8)


def split_words(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the offsets of each text's words. A null text has none."""
    texts = pc.fill_null(texts, "")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0]:ends[-1]] if data is not None else np.empty(0, np.uint8)
    plain = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(table[raw])])
    lists = pc.ascii_split_whitespace(plain)
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int64)))
    return flat.filter(real), before[lists.offsets.to_numpy()]
