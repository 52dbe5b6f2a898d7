"""SimHash near-duplicates, found by multi-index hashing over fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from jobledger.llm.common import free, id_key, text_of, without
from jobledger.llm.components import components
from jobledger.session import materialise

SHINGLE = 5
DISTANCE = 4
SEGMENTS = (22, 21, 21)
# For a similarity of 0.8: two words of fingerprint, since at that similarity some 15 % of the bits differ.
WIDE_DISTANCE = 22
# Twelve segments in all: more than half the distance, so that no link is missed.
WIDE_SEGMENTS = (11, 11, 11, 11, 10, 10)
WIDE_WORDS = 2
BUCKET = 4096
PIVOTS = 4
CHUNK = 1 << 16


def _more(h: np.ndarray, j: int) -> np.ndarray:
    """The ``j``-th further 64-bit hash of each hash (the splitmix64 finaliser)."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * j) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str, shingle: int, words: int = 1) -> list[int]:
    """``words`` times 64 bits, each 1 if set in over half the shingle hashes; as signed numbers.

    The first word is taken over the hashes themselves, the others over hashes of those.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return [0] * words
    flat = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - shingle + 1)
    firsts, lasts = starts[:n].tolist(), (ends[shingle - 1:] if len(found) > shingle else ends[-1:]).tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros((words, 64), dtype=np.int64)
    for at in range(0, n, CHUNK):
        raw = b"".join([digest(flat[i:j], 42) for i, j in zip(firsts[at:at + CHUNK], lasts[at:at + CHUNK], strict=True)])
        first = np.frombuffer(raw, dtype=">u8")
        for k in range(words):
            own = _more(first.astype(np.uint64), k).astype(">u8") if k else first
            ones[k] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1).view(">i8")[:, 0].tolist()


def fingerprint_of(text: Column, shingle: int = SHINGLE, words: int = 1) -> Column:
    @F.pandas_udf("array<long>")
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t, shingle, words) for t in batch])

    return make(text)


def _names(words: int) -> list[str]:
    """Columns of the fingerprint's words; of one word it is its own key ``f``."""
    return ["f"] if words == 1 else [f"w{k}" for k in range(words)]


def _keyed(rows: DataFrame, words: int) -> DataFrame:
    """Replaces the array ``w`` by columns and adds the key ``f``; of several words, a hash of them."""
    if words == 1:
        return rows.withColumn("f", F.col("w")[0]).drop("w")
    names = _names(words)
    return rows.withColumns({n: F.col("w")[k] for k, n in enumerate(names)}).drop("w").withColumn("f", F.xxhash64(*names))


def _segments(bits: tuple[int, ...], names: list[str]) -> list[tuple[str, int, int]]:
    """Of each segment its word, lowest bit and width."""
    out = []
    for name in names:
        low = 0
        for width in bits:
            out.append((name, low, width))
            low += width
    return out


def _cut(word: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(word, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _ball(s: int, width: int, value: Column, tag: Column, flips: bool) -> Column:
    """What a fingerprint looks up around one segment: the segment, and those with one more bit set."""
    ball = F.array(F.struct(F.lit(s).alias("s"), (value + tag).alias("k"), F.lit(True).alias("same")))
    if not flips:
        return ball
    masks = F.filter(F.array(*[F.lit(1 << b).cast("long") for b in range(width)]), lambda m: value.bitwiseAND(m) == 0)
    return F.concat(ball, F.transform(masks, lambda m: F.struct(
        F.lit(s).alias("s"), (value + m + tag).alias("k"), F.lit(False).alias("same"))))


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a two-sided link matrix."""
    rows, cols = near.shape
    new_row, new_col, out = np.ones(rows, bool), np.ones(cols, bool), []
    for start in range(rows):
        if not new_row[start]:
            continue
        new_row[start], stack = False, [(0, start)]
        while stack:
            side, i = stack.pop()
            line, new = (near[i], new_col) if side == 0 else (near[:, i], new_row)
            for j in np.flatnonzero(line & new).tolist():
                out.append((i, j) if side == 0 else (j, i))
                stack.append((1 - side, j))
            new &= ~line
    return out


def _crowded(probes: DataFrame, table: DataFrame, crowds: DataFrame, distance: int, bucket: int, names: list[str]) -> DataFrame:
    """Links in buckets too full for a join: block against block, a spanning forest of each."""
    def blocks(df: DataFrame, own: str, other: str) -> DataFrame:
        n = F.ceil(F.col("n") / bucket).cast("int")
        most = F.ceil(F.col("most") / bucket).cast("int")
        columns = ["k", "t", "p", *dict.fromkeys(["f", *names])]
        return (df.join(crowds, "k").withColumn(own, F.pmod(F.xxhash64("f"), n if own == "t" else most).cast("int"))
                  .withColumn(other, F.explode(F.sequence(F.lit(0), (most if own == "t" else n) - 1)))
                  .select(*columns).toDF(*columns))

    def link(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        pairs = []
        if len(a) and len(b):
            differ = sum(np.bitwise_count(a[w].to_numpy().view(np.uint64)[:, None] ^ b[w].to_numpy().view(np.uint64)[None, :]).astype(np.int16)
                         for w in names)
            pairs = _forest(differ <= distance)
        return pd.DataFrame({"a": a["f"].to_numpy()[[i for i, _ in pairs]], "b": b["f"].to_numpy()[[j for _, j in pairs]]}, dtype="int64")

    keys = ["k", "t", "p"]
    return (blocks(probes, "p", "t").groupBy(*keys).cogroup(blocks(table, "t", "p").groupBy(*keys))
            .applyInPandas(link, "a long, b long").where("a <> b"))


def _differ(names: list[str], a: str, b: str) -> Column:
    """In how many bits two fingerprints differ."""
    return sum((F.bit_count(F.col(f"{a}.{n}").bitwiseXOR(F.col(f"{b}.{n}"))) for n in names), F.lit(0))


def _stars(table: DataFrame, own: list[str], names: list[str], distance: int) -> DataFrame:
    """Links to a few pivots of each bucket: rows in proportion to its entries, however dense it is."""
    pivots = [F.min(F.struct(F.xxhash64("f", F.lit(i)).alias("h"), *own)) for i in range(PIVOTS)]
    chosen = table.groupBy("k").agg(F.count("*").alias("n"), F.array_distinct(F.array(*pivots)).alias("pivots"))
    pairs = table.alias("t").join(chosen.where("n > 1"), "k").select("t.*", F.explode("pivots").alias("b"))
    pairs = pairs.select(F.struct(*own).alias("a"), "b").where((F.col("a.f") != F.col("b.f")) & (_differ(names, "a", "b") <= distance))
    return pairs.select(F.col("a.f").alias("a"), F.col("b.f").alias("b"))


def near_links(prints: DataFrame, distance: int = DISTANCE, bits: tuple[int, ...] = SEGMENTS, bucket: int = BUCKET,
               words: int = 1) -> DataFrame:
    """Links ``a, b`` that join the distinct fingerprints ``f`` within ``distance`` bits.

    Every fingerprint is entered in a table under each of its segments and looks
    up the ball of radius one around each: the segment itself and those with one
    more bit set (of two that differ in a bit, the one without it finds the
    other, so a pair meets once).  A match counts in its first close
    segment only, if the whole distance holds.  With more segments than half the
    distance no link can be missed; fewer are refused.

    Near copies lie close together, and all pairs of a large group would be a
    square.  So the entries of a bucket are first compared with a few pivots
    of it; what these stars connect is one part, and the search then gives links between
    different parts only.  No link is lost: those left out have both ends
    in one part already.

    Wider segments suit more fingerprints: a bucket holds N / 2^width on
    average.  A bucket with more than ``bucket`` entries (near copies that share
    a segment) is not joined: its blocks are compared pair by pair and give
    a spanning forest each, which keeps every link's two ends together without
    listing all pairs.
    """
    if sum(bits) != 64:
        raise ValueError("segments must add up to 64 bits")
    if 2 * len(bits) * words <= distance:
        raise ValueError("more segments than half the distance are needed, or links are missed")
    names = _names(words)
    entries, lookups = [], []
    for s, (name, low, width) in enumerate(_segments(bits, names)):
        tag, value = F.lit(s << 56).cast("long"), _cut(F.col(name), low, width)
        entries.append((value + tag).alias("k"))
        lookups.append(_ball(s, width, value, tag, distance > 0))
    own = list(dict.fromkeys(["f", *names]))
    stars = materialise(_stars(prints.select(*own, F.explode(F.array(*entries)).alias("k")), own, names, distance).distinct(), "stars")
    parts = components(stars, "a", "b")
    prints = prints.join(parts, prints.f == parts.node, "left").select(*own, F.coalesce("root", "f").alias("part"))
    table = prints.select(*own, "part", F.explode(F.array(*entries)).alias("k"))
    probes = prints.select(*own, "part", F.explode(F.concat(*lookups)).alias("e")).select(*own, "part", "e.*")
    full = materialise(table.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > bucket), "crowds")
    crowded = not full.isEmpty()
    cold_table, cold_probes = table, probes
    if crowded:
        most = probes.join(full, "k", "left_semi").groupBy("k").agg(F.count("*").alias("most"))
        full = materialise(full.join(most, "k"), "crowds")
        cold_table = table.join(full.select("k"), "k", "left_anti")
        cold_probes = probes.join(full.select("k"), "k", "left_anti")
    xor = {n: F.col(f"p.{n}").bitwiseXOR(F.col(f"t.{n}")) for n in names}
    condition = ((F.col("p.part") != F.col("t.part")) & (_differ(names, "p", "t") <= distance)
                 & (~F.col("p.same") | (F.col("p.f") < F.col("t.f"))))
    if not crowded:  # else the first close segment may be one that is not joined
        first = F.lit(None).cast("int")
        for s, (name, low, width) in reversed(list(enumerate(_segments(bits, names)))):
            first = F.when(F.bit_count(_cut(xor[name], low, width)) <= 1, s).otherwise(first)
        condition &= first == F.col("p.s")
    links = (cold_probes.alias("p").join(cold_table.alias("t"), (F.col("p.k") == F.col("t.k")) & condition)
             .select(F.col("p.f").alias("a"), F.col("t.f").alias("b")))
    links = links.union(stars)
    return links.union(_crowded(probes, table, full, distance, bucket, names)) if crowded else links


def _classes(rows: DataFrame, distance: int, bits: tuple[int, ...], bucket: int, words: int) -> DataFrame:
    """For each distinct fingerprint ``f`` of ``id, f`` rows the first row of its component."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("f").alias("f")))
    own = list(dict.fromkeys(["f", *_names(words)]))
    prints = materialise(rows.groupBy(*own).agg(first.alias("first"), F.count("*").alias("copies")), "prints")
    roots = components(near_links(prints.select(*own), distance, bits, bucket, words), "a", "b")
    prints = prints.select("f", "first", "copies")
    linked = prints.join(roots, prints.f == roots.node).select("f", "first", "copies", "root")
    heads = prints.join(roots.select("root").distinct(), prints.f == F.col("root")).select("f", "first", "copies", "root")
    linked = materialise(linked.union(heads), "linked")
    best = linked.groupBy("root").agg(F.min("first").alias("head"), F.sum("copies").alias("size"))
    whole = linked.join(best, "root").select("f", "head", "size")
    alone = prints.join(linked, "f", "left_anti").select("f", F.col("first").alias("head"), F.col("copies").alias("size"))
    return whole.union(alone)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = WIDE_DISTANCE,
                    bits: tuple[int, ...] = WIDE_SEGMENTS, bucket: int = BUCKET, words: int = WIDE_WORDS) -> DataFrame:
    """For every row its id, ``fingerprint``, ``component_id`` and ``component_size``.

    Words are lower-cased (A-Z) runs without white space; a shingle is
    ``shingle`` of them, repeats included; a shorter text is one shingle and one
    without words (null, empty) has fingerprint zero, linked like any other.
    By default texts of a similarity of 0.8 link: they share some 85 % of 128 bits.
    Components are taken over distinct fingerprints, so copies cost one row in
    the search; they meet again in one join by fingerprint, which adaptive
    execution splits.  ``component_id`` is the smallest id, null where all are null.
    """
    names = _names(words)
    rows = df.select(F.col(id_col).alias("id"), fingerprint_of(text_of(text_col), shingle, words).alias("w"))
    rows = _keyed(materialise(rows, "rows"), words)
    classes = _classes(rows, distance, bits, bucket, words)
    hexed = F.concat(*[F.lpad(F.lower(F.hex(n)), 16, "0") for n in names])
    return rows.join(classes, "f").select(F.col("id").alias(id_col), hexed.alias("fingerprint"),
                                          F.col("head.id").alias("component_id"), F.col("size").alias("component_size"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = WIDE_DISTANCE,
                     bits: tuple[int, ...] = WIDE_SEGMENTS, bucket: int = BUCKET, words: int = WIDE_WORDS) -> DataFrame:
    """The row with the smallest id of each component, with all columns; the text is shuffled once.

    Of rows with that id, the one with the smallest fingerprint key stays, and one of those.
    """
    own, mark = free(df, "own_id"), free(df, "own_print")
    keyed = df.withColumns({own: id_key(id_col), mark: fingerprint_of(text_of(text_col), shingle, words)})
    rows = materialise(keyed.select(F.col(id_col).alias("id"), F.col(own).alias("__id"), F.col(mark).alias("w")), "rows")
    rows = _keyed(rows.withColumn("__print", F.col("w")), words)
    classes = _classes(rows, distance, bits, bucket, words).where("size > 1")
    lost = (rows.join(classes, "f").where(~(F.col("id").eqNullSafe(F.col("head.id")) & (F.col("f") == F.col("head.f"))))
                .select(F.col("__id").alias(own), F.col("__print").alias(mark)).distinct())
    return without(keyed, lost, [own, mark])
