"""Texts of an Arrow batch as flat numbered words; the words themselves stay in Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts, and where each text's begin (one number more than texts)."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat, starts = lists.values, np.asarray(lists.offsets, dtype=np.int64)
    real = np.asarray(pc.not_equal(flat, ""))
    before = np.concatenate([[0], np.cumsum(real)])
    return flat.filter(pa.array(real)), before[starts]


def numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each word its number in the array of distinct words, and that array."""
    if not len(words):
        return np.zeros(0, np.int64), words
    coded = words.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary


def slices(starts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive texts (from, to) with about ``most`` words together; a longer text goes alone."""
    low, n = 0, len(starts) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + most, side="right")) - 1)
        yield low, min(high, n)
        low = high


def joined(words: pa.Array, starts: np.ndarray, stay: np.ndarray) -> pa.Array:
    """Each text's words that stay, joined by one space."""
    before = np.concatenate([[0], np.cumsum(stay)])
    lists = pa.LargeListArray.from_arrays(pa.array(before[starts]), words.filter(pa.array(stay)))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
