"""Substring de-duplication: documents meet on winnowed seeds, matches are extended both ways, repeats of a window or more go."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from jobledger.llm.common import collapsed, join_hot, text_of
from jobledger.llm.wordseq import joined, numbered, slices, split_words
from jobledger.session import materialise, settings

WINDOW, SEED = 13, 5
BATCH_WORDS = 1 << 18
LAST = (1 << 63) - 1
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct one is hashed once."""
    codes, distinct = numbered(words)
    return np.fromiter((xxhash.xxh64_intdigest(w.as_buffer()) for w in distinct), np.uint64, len(distinct))[codes]


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive words, by place of the first."""
    m = max(0, len(hashes) - width + 1)
    out = np.zeros(m, np.uint64)
    for j in range(width):
        out *= FACTOR
        out += hashes[j:m + j]
    return (out ^ (out >> np.uint64(29))) * FACTOR


def seeds(hashes: np.ndarray, offsets: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """The winnowed seeds of all texts: text, hash, and the first and last window that each stands for.

    Of the seeds within a window the one with the smallest hash stands for it, the
    first among equals.  That depends on nothing but the window's words, so equal windows
    have equal seeds at equal places, and every window has one.  Windows of one seed follow one another.
    """
    grams = rolling(hashes, seed)
    m = max(0, len(hashes) - window + 1)
    best, least = np.arange(m), grams[:m].copy()
    for j in range(1, window - seed + 1):
        later = grams[j:m + j]
        best = np.where(later < least, np.arange(j, m + j), best)
        least = np.minimum(least, later)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    real = np.flatnonzero(np.arange(m) + window <= offsets[text[:m] + 1])
    best, text = best[real], text[real]
    new = np.ones(len(real), bool)
    new[1:] = (best[1:] != best[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(real)) - 1 if len(at) else at
    return text[at], grams[best[at]], real[at], real[last]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys (the first weighs most), begin of each group of equal first keys in it, and group of each place."""
    order = np.lexsort(keys[::-1])
    own = keys[0][order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, and begin of each group of rows that agree in all of them."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(new)


def _elsewhere(o: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys that spread rows which need no partner any more."""
    with np.errstate(over="ignore"):
        x = (o.astype(np.uint64) * FACTOR) ^ at.astype(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * FACTOR
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _long(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.asarray(batch.column(column), dtype=np.int64)


def _first_rows(*keys: np.ndarray) -> np.ndarray:
    """One row for each value of the first key: the one with the smallest second key."""
    order, begin, _ = _groups(*keys)
    return np.sort(order[begin])


def _seed_rows(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Of copies within a batch the first id speaks for all.
            batch = batch.take(pa.array(_first_rows(_long(batch, 1), _long(batch, 0))))
            words, offsets = split_words(batch.column(2))
            found = []
            for low, high in slices(offsets, BATCH_WORDS):
                own = words.slice(offsets[low], offsets[high] - offsets[low])
                text, h, _, _ = seeds(word_hashes(own), offsets[low:high + 1] - offsets[low], window, seed)
                found.append((text + low, h.view(np.int64)))
            text, h = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            at = np.arange(len(text)) - np.searchsorted(text, np.arange(batch.num_rows))[text]
            # Of a seed that a text has several times the first one speaks for all.
            order, begin = _runs(h, text)
            text, h, at = (x[order[begin]] for x in (text, h, at))
            o, t = _long(batch, 0)[text], _long(batch, 1)[text]
            # A seed that two texts of this batch share needs no more proof: two of its rows tell the others, the rest go elsewhere.
            _, begin, group = _groups(h, text)
            size = np.diff(np.append(begin, len(h)))
            known = (size > 1)[group]
            place = np.arange(len(h)) - begin[group]
            key = np.where(place > 1, _elsewhere(o, at), h)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(o), pa.array(t), pa.array(at), pa.array(known)], ["k", "o", "t", "at", "known"])

    return run


def _unit_rows(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(_first_rows(_long(batch, 1), _long(batch, 0))))
            words, offsets = split_words(batch.column(2))
            parts = []
            for low, high in slices(offsets, BATCH_WORDS):
                own = words.slice(offsets[low], offsets[high] - offsets[low])
                place = offsets[low:high + 1] - offsets[low]
                hashes = word_hashes(own)
                text, h, from_, to = seeds(hashes, place, window, seed)
                first = np.searchsorted(text, np.arange(high - low + 1))
                lists = batch.column(3).slice(low, high - low)
                taken = np.asarray(lists.flatten(), dtype=np.int64) + np.repeat(first[:-1], np.asarray(pc.list_value_length(lists)))
                # All seeds of a text that are equal to a listed one.
                order, begin = _runs(text, h)
                group = np.empty(len(text), np.int64)
                group[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(text))))
                listed = np.zeros(len(begin), bool)
                listed[group[taken]] = True
                taken = np.flatnonzero(listed[group])
                text, h, from_, to = text[taken], h[taken], from_[taken], to[taken]
                size = to - from_ + 1
                begin = np.cumsum(size) - size
                places = np.repeat(from_ - begin, size) + np.arange(int(size.sum()))
                w = rolling(hashes, window)[places]
                parts.append((text + low, h.view(np.int64), from_ - place[text], size, w))
            if not parts:
                continue
            text, h, from_, size, w = (np.concatenate(x) for x in zip(*parts, strict=True))
            o, t = _long(batch, 0)[text], _long(batch, 1)[text]
            begin = np.cumsum(size) - size
            # First and last window name all words between; equal stretches of one text make one row with all their places.
            stretch = w[begin] * FACTOR ^ w[begin + size - 1] + size.astype(np.uint64)
            order, first = _runs(stretch, o, t)
            rows = order[first]
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(from_[order]))
            # Of equal stretches the first id's are compared; those of larger ids are repeats.
            _, start, group = _groups(stretch[rows], o[rows])
            repeat = o[rows] > o[rows][start][group]
            key = np.where(repeat, _elsewhere(o[rows], from_[rows]), h[rows])
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(w)).astype(np.int32)), pa.array(w.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(o[rows]), pa.array(t[rows]), places, lists.take(pa.array(rows)), pa.array(repeat)],
                ["k", "o", "t", "from", "w", "repeat"])

    return run


def _repeated_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by seed and id: places of the windows that an earlier id has too.

    Between batches only the distinct windows of the seed that goes on are held, each with its first id.
    """
    key, held_w, held_o = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        k, o, t = (_long(batch, c) for c in range(3))
        size = np.asarray(pc.list_value_length(batch.column(4))).astype(np.int64)
        w = np.asarray(batch.column(4).flatten(), dtype=np.int64)
        own = np.repeat(np.arange(len(k)), size)
        hit = np.asarray(batch.column(5).cast(pa.int8())).astype(bool)[own]
        # Rows known to repeat an earlier one are under keys of no meaning and are compared with nothing.
        open_ = np.flatnonzero(~hit)
        if key != k[0]:
            held_w, held_o = held_w[:0], held_o[:0]
        every_w, every_o = np.concatenate([held_w, w[open_]]), np.concatenate([held_o, o[own[open_]]])
        distinct, first, of = np.unique(every_w, return_index=True, return_inverse=True)
        hit[open_] = every_o[first][of][len(held_w):] < o[own[open_]]
        of_last = np.concatenate([np.full(len(held_w), k[0] == k[-1]), k[own[open_]] == k[-1]])
        keep = np.unique(of[of_last])
        key, held_w, held_o = k[-1], distinct[keep], every_o[first[keep]]
        inside = np.arange(len(own)) - (np.cumsum(size) - size)[own]
        rows, shift = own[hit], inside[hit]
        places = np.asarray(batch.column(3).flatten(), dtype=np.int64)
        often = np.asarray(pc.list_value_length(batch.column(3))).astype(np.int64)
        # Each hit at each place of its stretch.
        of_hit = np.repeat(np.arange(len(rows)), often[rows])
        nth = np.arange(len(of_hit)) - (np.cumsum(often[rows]) - often[rows])[of_hit]
        at = places[(np.cumsum(often) - often)[rows][of_hit] + nth] + shift[of_hit]
        yield pa.RecordBatch.from_arrays([pa.array(o[rows][of_hit]), pa.array(t[rows][of_hit]), pa.array(at)], ["o", "t", "at"])


def _with_keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rest = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    rows = df.select(F.struct(*rest).alias("row"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("o"), text_of(f"`{text_col}`").alias("text"))
    return rows.withColumn("t", F.xxhash64("text"))


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """For each text (``o``, ``t``: its id and a hash of it) with repeats, ``at``: the windows a smaller id has too, or ``copy``.

    1. Texts with the same words as one of a smaller id are copies: found by a digest, nothing else of them is needed.
    2. Seeds of all others meet by their hash.  A batch reports a seed that several of its texts share as known
       and sends two rows of it, so a passage in a third of all texts sends two rows a batch; a seed that a text repeats is one row.
    3. Around shared seeds the matches are extended both ways, over all windows that a seed stands for: their hashes meet by seed, sorted by id.
       What equals a stretch of a smaller id in the same batch is told at once and takes no part.
    """
    rows = _with_keys(df, id_col, text_col).select("o", "t", "text")
    with settings(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        digests = materialise(rows.select("o", "t", F.unhex(F.sha2(F.trim(collapsed(F.col("text"))), 256)).alias("digest")), "digests")
        classes = digests.groupBy("digest").agg(F.min("o").alias("first"), F.count("*").alias("n")).where("n > 1")
        copies = materialise(join_hot(digests, classes, "digest", "n").where("o > first").select("o", "t").distinct(), "copies")

        by_seed = Window.partitionBy("k")
        met = rows.select("o", "t", "text").mapInArrow(_seed_rows(window, seed), "k long, o long, t long, at long, known boolean")
        met = met.withColumn("other", F.min("t").over(by_seed) != F.max("t").over(by_seed)).where("known OR other")
        lists = met.groupBy("o", "t").agg(F.collect_set("at").alias("ats"))
        lists = materialise(lists.join(copies, ["o", "t"], "left_anti"), "seeds")

        near = rows.join(lists, ["o", "t"]).select("o", "t", "text", "ats")
        units = near.mapInArrow(_unit_rows(window, seed), "k long, o long, t long, from array<long>, w array<long>, repeat boolean")
        units = units.repartition("k").sortWithinPartitions("k", "o")
        hits = units.mapInArrow(_repeated_windows, "o long, t long, at long").groupBy("o", "t").agg(F.collect_set("at").alias("at"))
        hits = materialise(hits, "repeats")
    return hits.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """The columns of ``df`` but the text, and ``n_words``, ``removed`` (maximal repeats: start and end word) and ``kept``.

    A word goes if a window of ``window`` words that covers it also starts in a
    text with a smaller id; windows are judged on the input.  The kept words are joined by one space.

    Null texts are empty; texts shorter than a window stay.  A null id counts
    as the largest.  Rows with the same id never take words from each other.  Ids are whole
    numbers.  Columns of ``df`` named like the added ones are replaced.  An empty table gives an empty result.
    """
    marks = repeats(df, id_col, text_col, window, seed)
    rows = _with_keys(df, id_col, text_col).join(marks, ["o", "t"], "left").select("row", "text", "at", "copy")
    schema = rows.select("row").schema.add("n_words", "long").add("removed", SPANS).add("kept", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets = split_words(batch.column(1))
            sizes = np.diff(offsets)
            lists = pc.fill_null(batch.column(2), pa.scalar([], pa.list_(pa.int64())))
            number = np.asarray(pc.list_value_length(lists))
            starts = np.asarray(lists.flatten(), dtype=np.int64) + np.repeat(offsets[:-1], number)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
            gone = np.cumsum(edge)[:-1] > 0
            copy = np.asarray(pc.fill_null(batch.column(3), False).cast(pa.int8())).astype(bool) & (sizes >= window)
            gone |= np.repeat(copy, sizes)
            text = np.repeat(np.arange(len(sizes)), sizes)
            before = np.concatenate([[False], gone[:-1] & (text[1:] == text[:-1])]) if len(gone) else gone
            after = np.concatenate([gone[1:] & (text[1:] == text[:-1]), [False]]) if len(gone) else gone
            from_, to = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after)
            owner = text[from_]
            spans = pa.StructArray.from_arrays([pa.array(from_ - offsets[owner]), pa.array(to + 1 - offsets[owner])], ["start", "end"])
            cut = np.searchsorted(owner, np.arange(len(sizes) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(cut), spans), joined(words, offsets, ~gone).cast(pa.string())],
                ["row", "n_words", "removed", "kept"])

    added = ("n_words", "removed", "kept")
    rest = [F.col(f"row.`{c}`") for c in df.columns if c != text_col and c not in added]
    return rows.mapInArrow(run, schema).select(*rest, *added)
