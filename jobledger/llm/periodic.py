"""Periodic runs of words: branching tandem repeats over an enhanced suffix array, rotated and merged into runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from jobledger.llm.common import free, text_of
from jobledger.llm.wordseq import joined, numbered, slices, split_words

LEAST, EXPONENT = 6, 4
BATCH_WORDS = 1 << 18
RUNS = T.ArrayType(T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")]))


def suffix_array(codes: np.ndarray, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffixes of all texts in order (no two texts share a range), their places, and the ranks by 1, 2, 4, ... words.

    Prefix doubling; a round sorts only those suffixes that the one before left
    equal.  A rank is the first place of its group.
    """
    n = len(codes)
    key = text * (int(codes.max()) + 1) + codes
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[sa] = _starts(key[sa], np.arange(n))
    levels, width, places = [rank], 1, np.arange(n)
    while True:
        held = rank[sa[places]]
        alone = np.ones(len(places), bool)
        if len(places) > 1:
            same = held[1:] == held[:-1]
            alone[1:] &= ~same
            alone[:-1] &= ~same
        places = places[~alone]
        if not len(places):
            return sa, rank, levels
        own = sa[places]
        after = own + width
        second = np.where(after < ends[own], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        own = own[order]
        sa[places] = own
        rank = rank.copy()
        rank[own] = _starts(key[order], places)
        levels.append(rank)
        width *= 2


def _starts(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For sorted keys the place of the first equal one."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return places[np.flatnonzero(new)[np.cumsum(new) - 1]]


def common_prefixes(sa: np.ndarray, levels: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """For each place the number of words its suffix shares with the one before it (0 at the first)."""
    n = len(sa)
    lcp = np.zeros(n, np.int64)
    at = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    if not len(at):
        return lcp
    a, b = sa[at - 1].copy(), sa[at].copy()
    end = ends[a]
    done = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.maximum(a, b) < end
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        step = same.astype(np.int64) << k
        a += step
        b += step
        done += step
    lcp[at] = done
    return lcp


def nearest_smaller(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place with a positive value: the last place before with a smaller one, the next with one no larger."""
    n = len(lcp)
    before, after = np.arange(n) - 1, np.arange(n) + 1
    padded = np.append(lcp, 0)
    todo = np.flatnonzero(lcp > 0)
    while len(todo):
        todo = todo[padded[before[todo]] >= lcp[todo]]
        before[todo] = before[before[todo]]
    todo = np.flatnonzero(lcp > 0)
    while len(todo):
        todo = todo[padded[after[todo]] > lcp[todo]]
        after[todo] = after[after[todo]]
    return before, after


def tandems(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the branching tandem repeats: ``i`` and ``i + q`` share exactly ``q`` words.

    At each place with a positive LCP two parts of its interval meet: suffixes that
    share ``depth`` words before and from there.  Each suffix of the smaller part
    looks whether the one ``depth`` words on, or back, is in the other part.
    """
    before, after = nearest_smaller(lcp)
    at = np.flatnonzero(lcp > 0)
    low, high = before[at], after[at]
    left = at - low <= high - at
    size = np.where(left, at - low, high - at)
    found_i, found_q = [], []
    for low_k, high_k in slices(np.concatenate([[0], np.cumsum(size)]), 1 << 20):
        part = slice(low_k, high_k)
        own = np.repeat(np.arange(low_k, high_k), size[part])
        first = np.where(left[part], low[part], at[part])
        base = np.cumsum(size[part]) - size[part]
        place = np.repeat(first - base, size[part]) + np.arange(len(own))
        i, depth = sa[place], lcp[at[own]]
        from_, to = np.where(left[own], at[own], low[own]), np.where(left[own], high[own], at[own])
        on, back = i + depth, i - depth
        there = isa[np.minimum(on, len(isa) - 1)]
        hit = (on < ends[i]) & (there >= from_) & (there < to)
        found_i.append(i[hit])
        found_q.append(depth[hit])
        there = isa[np.maximum(back, 0)]
        hit = (back >= starts[i]) & (there >= from_) & (there < to)
        found_i.append(back[hit])
        found_q.append(depth[hit])
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_q)


def _rotated(codes: np.ndarray, low: int, i: int, q: int) -> int:
    """How far the square at ``i`` can be rotated left within its text: the start of its run."""
    step = 64
    while i > low:
        to = max(low, i - step)
        differ = np.flatnonzero(codes[to:i] != codes[to + q:i + q])
        if len(differ):
            return to + int(differ[-1]) + 1
        i, step = to, min(step * 4, 1 << 20)
    return i


def find_runs(codes: np.ndarray, offsets: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """For each text its runs as (start, length, period), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    n = len(codes)
    if n < max(2, least):
        return out
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts, ends = offsets[text], offsets[text + 1]
    sa, isa, levels = suffix_array(codes, text, ends)
    i, q = tandems(sa, isa, common_prefixes(sa, levels, ends), ends, starts)
    # The run ends with its last square, so ``exponent`` periods or more reach this far back; a few words tell most squares apart.
    room = np.minimum(i - (exponent - 2) * q, i + 2 * q - least) >= starts[i]
    i, q = i[room], q[room]
    if exponent > 2:
        held = (codes[i - 1] == codes[i - 1 + q]) & (codes[i - (exponent - 2) * q] == codes[i - (exponent - 3) * q])
        i, q = i[held], q[held]
    known: dict[int, list[tuple[int, int]]] = {}
    for a, p in sorted(zip(i.tolist(), q.tolist(), strict=True), key=lambda x: x[1]):
        end = a + 2 * p
        # A multiple of a period whose run covers the square makes the same run.
        if any(p % shorter == 0 and start <= a for start, shorter in known.get(end, ())):
            continue
        start = _rotated(codes, int(starts[a]), a, p)
        if end - start >= max(least, exponent * p):
            known.setdefault(end, []).append((start, p))
    for end, held in known.items():
        for start, p in held:
            k = int(text[start])
            out[k].append((start - int(offsets[k]), end - start, p))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of ``n`` words stay: each run keeps its first period."""
    stay = np.ones(n, bool)
    for start, length, period in runs:
        stay[start + period:start + length] = False
    return stay


def periodic_runs(df: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed",
                  least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """Adds the runs of each whole text (start, length, period in words) and the text with each run cut to one period.

    A run is a stretch of words with smallest period q, as long as possible, of
    ``least`` words and ``exponent`` periods or more.  Texts are taken in slices
    of a quarter of a million words (a longer text alone), sorted in one suffix array
    whose ranges never mix texts, so a task holds little besides its longest text.
    No shuffle; a task that is lost runs again on its rows.

    Null and empty texts have no runs and collapse to the empty text; the kept
    words are joined by one space.  Rows may repeat.  Columns of ``df`` named
    like the two that are added are replaced; other columns stay as they are.
    """
    kept = [c for c in df.columns if c not in (runs_col, collapsed_col)]
    text = free(df, "whole_text")
    rows = df.select(*[F.col(f"`{c}`") for c in kept], text_of(text_col).alias(text))
    schema = rows.drop(text).schema.add(runs_col, RUNS).add(collapsed_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = _batch(batch.column(len(kept)), least, exponent)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], *added], [*kept, runs_col, collapsed_col])

    return rows.mapInArrow(run, schema)


def _batch(texts: pa.Array, least: int, exponent: int) -> tuple[pa.Array, pa.Array]:
    """The runs of each text, and the texts without their repetitions."""
    words, offsets = split_words(texts)
    found: list[list[tuple[int, int, int]]] = []
    kept = [pa.array([], pa.large_string())]
    for low, high in slices(offsets, BATCH_WORDS):
        own = words.slice(offsets[low], offsets[high] - offsets[low])
        place = offsets[low:high + 1] - offsets[low]
        runs = find_runs(numbered(own)[0], place, least, exponent)
        stay = np.concatenate([np.zeros(0, bool), *(collapsed(r, n) for r, n in zip(runs, np.diff(place), strict=True))])
        kept.append(joined(own, place, stay))
        found += runs
    sizes = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
    flat = np.array([x for r in found for x in r], np.int64).reshape(-1, 3)
    rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(sizes), rows), pa.concat_arrays(kept).cast(pa.string())
