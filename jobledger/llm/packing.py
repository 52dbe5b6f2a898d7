"""Best-fit packing by a grouping genetic algorithm on islands."""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from jobledger.llm.tokens import encoded
from jobledger.session import materialise

CAPACITY = 4096
GROUP = 4000
ISLANDS = 2
POPULATION = 6
GENERATIONS = 8
EPOCHS = 2


def id_bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def cut_pieces(df: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id",
               text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of each document: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``.

    A document is its ids and then ``end_id``; only one longer than ``capacity`` is cut.
    A null or empty text is the end id alone.  Rows that repeat give pieces of their own.
    """
    rows = df.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, parts in enumerate(encoded(batch.column(1).to_pylist(), tokenizer, id_bytes)):
                flat = b"".join([*parts, id_bytes([end_id])])
                for k, low in enumerate(range(0, len(flat), step)):
                    own = flat[low:low + step]
                    at.append(i), piece.append(k), start.append(low // 4), length.append(len(own) // 4), crc.append(zlib.crc32(own))
                    if with_ids:
                        ids.append(own)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return rows.mapInArrow(run, schema)


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: list[list[int]]) -> list[list[int]]:
    """Put each item in the fullest bin with room for it; ``bins`` grows in place."""
    free = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect_left(free, (sizes[i], -1))
        if at == len(free):
            bins.append([i])
            left, k = capacity - sizes[i], len(bins) - 1
        else:
            left, k = free.pop(at)
            bins[k].append(i)
            left -= sizes[i]
        if left:
            insort(free, (left, k))
    return bins


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones: what is free lies together."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def cross(mother: list[list[int]], father: list[list[int]], sizes: list[int], capacity: int, draw: random.Random) -> list[list[int]]:
    """The father's bins with well-filled whole bins of the mother injected.

    Bins of the father that hold a document of the injected ones are dissolved;
    their other documents are put back by best fit, longest first.
    """
    ranked = sorted(mother, key=lambda b: -sum(sizes[i] for i in b))
    given = [b for b in ranked[:max(1, len(ranked) // 2)] if draw.random() < 0.5] or ranked[:1]
    inside = {i for b in given for i in b}
    child, displaced = [list(b) for b in given], []
    for b in father:
        if inside.isdisjoint(b):
            child.append(list(b))
        else:
            displaced += [i for i in b if i not in inside]
    return best_fit(sorted(displaced, key=lambda i: -sizes[i]), sizes, capacity, child)


def mutate(bins: list[list[int]], sizes: list[int], capacity: int, draw: random.Random) -> list[list[int]]:
    """Dissolves the emptiest bin and some others and puts their documents back."""
    order = sorted(range(len(bins)), key=lambda k: sum(sizes[i] for i in bins[k]))
    gone = {order[0], *(draw.randrange(len(bins)) for _ in range(min(len(bins), 6)))}
    child = [list(b) for k, b in enumerate(bins) if k not in gone]
    return best_fit(sorted((i for k in gone for i in bins[k]), key=lambda i: -sizes[i]), sizes, capacity, child)


def evolve(sizes: list[int], capacity: int, seed: int, known: list[list[list[int]]], population: int = POPULATION,
           generations: int = GENERATIONS) -> list[list[int]]:
    """The best packing of one island; ``known`` are packings that it starts from (its own elite and a migrant).

    Full pieces are bins from the start.  Ends early at the lower bound, which best fit often meets at once.
    """
    draw, order = random.Random(seed), sorted(range(len(sizes)), key=lambda i: -sizes[i])
    full, rest = [[i] for i in order if sizes[i] >= capacity], [i for i in order if sizes[i] < capacity]
    least = -(-sum(sizes[i] for i in rest) // capacity)
    pool = [[b for b in p if sizes[b[0]] < capacity] for p in known]
    score = lambda p: fitness(p, sizes, capacity)
    if not pool:
        pool = [best_fit(rest, sizes, capacity, [])]
        if len(pool[0]) > least:
            for _ in range(population - 1):
                noisy = sorted(rest, key=lambda i: -sizes[i] * draw.uniform(0.8, 1.2))
                pool.append(best_fit(noisy, sizes, capacity, []))
    pool.sort(key=score, reverse=True)
    for _ in range(generations):
        if len(pool[0]) <= least:
            break
        children = []
        for _ in range(population // 2):
            mother, father = (max(draw.choices(pool, k=2), key=score) for _ in range(2))
            child = cross(mother, father, sizes, capacity, draw)
            children.append(mutate(child, sizes, capacity, draw) if draw.random() < 0.5 else child)
        pool = sorted(pool + children, key=score, reverse=True)[:population]
    return full + pool[0]


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, islands: int = ISLANDS, epochs: int = EPOCHS,
         population: int = POPULATION, generations: int = GENERATIONS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have a ``length`` between 1 and ``capacity``.

    The rows are dealt at random over groups of about ``group``, whatever they
    hold: no key decides, so copies and repeated rows spread evenly.  Each group
    is a packing problem of its own, small enough for one task and large enough
    that its last, part-filled sequence weighs little.  ``islands`` populations
    evolve on each; after an epoch every island gets its neighbour's elite and
    goes on.  The best packing of a group counts.  Sequences are numbered from
    group and bin; offsets follow the order within a bin.  An empty table gives
    an empty result; other columns stay, whatever their names (the two that are added are replaced).
    """
    rows = pieces.select(F.struct(*[F.col(f"`{c}`") for c in pieces.columns if c not in ("sequence_id", "offset")]).alias("row"),
                         F.col("length").cast("int").alias("n"), F.monotonically_increasing_id().alias("u"))
    rows = materialise(rows, "pieces")
    groups = max(1, -(-rows.count() // group))
    # ``u`` is stored, so a task that runs again deals the rows as before.
    rows = rows.withColumn("g", F.pmod(F.xxhash64("u"), F.lit(groups)).cast("int"))
    state = rows.select("g", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("i"), "u", "n",
                        F.array().cast("array<int>").alias("bins"))
    for epoch in range(epochs):
        state = _epoch(state, capacity, population, generations, epoch)
        if epoch + 1 < epochs:
            # Column ``bins`` has the bin of the own elite and of the neighbour's.
            kept = materialise(state, "elites")
            migrant = kept.select("g", ((F.col("i") + 1) % islands).alias("i"), "u", F.col("b").alias("m"))
            state = kept.join(migrant, ["g", "i", "u"]).select("g", "i", "u", "n", F.array("b", "m").alias("bins"))
    won = materialise(state, "elites")
    best = won.groupBy("g").agg(F.max(F.struct("score", "fill", (-F.col("i")).alias("i"))).alias("best"))
    won = won.join(best, "g").where(F.col("i") == -F.col("best.i"))
    placed = won.select("u", (F.col("g").cast("long") * (1 << 32) + F.col("b")).alias("sequence_id"), F.col("at").cast("long").alias("offset"))
    return rows.join(placed, "u").select("row.*", "sequence_id", "offset")


def _epoch(state: DataFrame, capacity: int, population: int, generations: int, epoch: int) -> DataFrame:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("u", ignore_index=True)
        sizes = pdf["n"].tolist()
        known = []
        for column in zip(*pdf["bins"], strict=True):
            bins: dict[int, list[int]] = {}
            for i, b in enumerate(column):
                bins.setdefault(b, []).append(i)
            known.append(list(bins.values()))
        bins = evolve(sizes, capacity, hash((epoch, *map(int, key))), known, population, generations)
        own, at = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int32)
        for b, held in enumerate(bins):
            place = 0
            for i in held:
                own[i], at[i] = b, place
                place += sizes[i]
        score, fill = fitness(bins, sizes, capacity)
        return pd.DataFrame({"g": pdf["g"], "i": pdf["i"], "u": pdf["u"], "n": pdf["n"], "b": own, "at": at, "score": score, "fill": fill})

    return state.groupBy("g", "i").applyInPandas(run, "g int, i int, u long, n int, b int, at int, score int, fill double")
