"""Words as 64-bit hashes, whole batches at a time.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. Hashes are sums of byte codes times powers,
mixed; different words of a corpus share one with a chance of about 2**-64 each pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from siltstone.llm.common import column

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x41:0x5B] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie back to back in `data`, and the number of words of each text."""
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets) - 1, dtype=np.int64)
    word = _IS_WORD[data]
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    starts = np.flatnonzero(word & ~before)
    lengths = np.flatnonzero(word & ~after) + 1 - starts
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets) - 1, dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    inside = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), STEP, dtype=np.uint64))
    h = np.add.reduceat(_BYTE[data[word]] * powers[inside], first)
    return mixed(h), np.diff(np.searchsorted(starts, offsets))


def of_text(text: str | None) -> np.ndarray:
    """Hashes of one text's words, in order."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return word_hashes(data, np.array([0, len(data)]))[0]


def raw(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a batch's column `text`; nulls are empty."""
    texts = column(batch, "text").cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(texts) and texts.buffers()[2] else np.zeros(0, dtype=np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)
