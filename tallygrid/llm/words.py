"""Words of Arrow text columns as numpy arrays, for code that runs inside Spark's Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Rows are handled together up to so many bytes of text; one longer text is handled alone.
SLICE_BYTES = 2 << 20
MIX_A, MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Odd, so that it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", bytes_: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, in slices of about ``bytes_`` of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(lengths) // bytes_
        starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            yield batch.slice(a, b - a)


def filled(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts, "").cast(pa.large_string())


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets into them) of a large_string array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word ids, n + 1 offsets by text, distinct words) of the runs between white space.

    Arrow's ASCII white space is the space and U+0009 to U+000D.
    """
    lists = pc.ascii_split_whitespace(texts)
    flat, ends = lists.values, lists.offsets.to_numpy().astype(np.int64)
    flat, ends = flat.slice(ends[0], ends[-1] - ends[0]), ends - ends[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        flat, ends = flat.filter(pa.array(full)), np.concatenate(([0], np.cumsum(full)))[ends]
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), ends, coded.dictionary


def word_hashes(distinct: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.as_buffer()) for w in distinct), dtype=np.uint64, count=len(distinct))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(33))) * MIX_A
    x = (x ^ (x >> np.uint64(33))) * MIX_B
    return x ^ (x >> np.uint64(33))


class Runs:
    """Hashes of any run of consecutive symbols, from running sums of ``value * BASE ** place``."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        power = np.full(n, BASE, np.uint64)
        self.back = np.full(n + 1, BASE_INVERSE, np.uint64)
        if n:
            power[0] = 1
        self.back[0] = 1
        power, self.back = np.multiply.accumulate(power), np.multiply.accumulate(self.back)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power, dtype=np.uint64)))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def text_of(ends: np.ndarray) -> np.ndarray:
    """For each word, the index of its text."""
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends))


def per_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` by text."""
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[ends[1:]] - sums[ends[:-1]]
