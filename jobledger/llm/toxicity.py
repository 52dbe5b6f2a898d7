"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared window by window.

A window is 16 words.  What is compressed is not their letters: a common stem of five letters is
shorter than a zstandard sequence, so it would save nothing.  Each word is written as three keys of eight bytes,
hashes of its first three letters, its first five and all of it, the same for every word and language.
A key that a dictionary holds then saves some five bytes, whatever follows the stem.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from jobledger.llm.common import free, text_of
from jobledger.llm.wordseq import numbered, split_words
from jobledger.session import materialise

WINDOW = 16
LEVEL = 3
ROWS = 6_000
WINDOWS = 30_000
# Letters behind each key of a word; 0 is the whole word.
KEYS = (3, 5, 0)
KEY = 8
COMMON_BYTES = 110_000
# The toxic dictionary is trained to this size; of its segments those stay that are LEAST times in toxic windows and RATIO times as dense there.
OWN_BYTES = 32_768
LEAST, RATIO = 8, 4
FEATURES = 5


@dataclass(frozen=True)
class Model:
    """Dictionaries and calibration; a few kilobytes, whatever it was trained on.

    ``toxic`` is what toxic text has of its own behind ``ordinary``.  Where ordinary text has more of its own, the
    two change places, and the weights say that what is saved speaks against a text.
    """

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary trained on ``samples``, in segments of a key; too few or too short ones are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples, k=KEY, d=KEY, steps=1).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


@lru_cache(maxsize=8)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)


def word_keys(words: pa.Array) -> np.ndarray:
    """The keys of each word, one row a word; each distinct beginning is hashed once."""
    codes, distinct = numbered(words)
    lower = pc.utf8_lower(distinct)
    columns = []
    for n in KEYS:
        own, parts = numbered(pc.utf8_slice_codeunits(lower, 0, n) if n else lower)
        columns.append(np.fromiter((xxhash.xxh64_intdigest(x.as_buffer(), n) for x in parts), np.uint64, len(parts))[own])
    return np.column_stack(columns)[codes] if len(distinct) else np.zeros((0, len(KEYS)), np.uint64)


def windows(texts: pa.Array) -> Iterator[list[bytes]]:
    """For each text its windows, the last one shorter; a text without words has an empty one."""
    words, offsets = split_words(texts)
    keys = word_keys(words)
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield [keys[at:min(at + WINDOW, high)].tobytes() for at in range(low, max(high, low + 1), WINDOW)]


def features(held: list[bytes], ordinary: bytes, toxic: bytes) -> tuple[float, ...]:
    """What the toxic dictionary behind the ordinary one saves: most, mean of the best three windows, mean, shares that save 4 and 8 bytes.

    With ordinary content in both, a window differs by what is toxic in it only.
    """
    plain, aware = _compressor(ordinary), _compressor(ordinary + toxic)
    saved = np.array([len(plain.compress(w)) - len(aware.compress(w)) for w in held])
    best = np.sort(saved)[-3:]
    return (float(best[-1]), float(best.mean()), float(saved.mean()), float((saved >= 4).mean()), float((saved >= 8).mean()))


def fit_weights(x: np.ndarray, y: np.ndarray, each: np.ndarray | None = None) -> tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
    """Logistic regression by Newton steps, on scaled columns; one class alone gives its smoothed share.

    ``each`` says how many rows each one stands for; only their ratios count.
    """
    each = np.ones(len(x)) if each is None else each / each.mean()
    means = np.average(x, axis=0, weights=each)
    scales = np.sqrt(np.average((x - means) ** 2, axis=0, weights=each)) + 1e-9
    design = np.column_stack([np.ones(len(x)), (x - means) / scales])
    w = np.zeros(design.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = (design * (each * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(h, design.T @ (each * (y - p)) - 1e-2 * w)
    return tuple(w), tuple(means), tuple(scales)


def log_loss(x: np.ndarray, y: np.ndarray, each: np.ndarray, weights: tuple, means: tuple, scales: tuple) -> float:
    """What a calibration leaves open about the labels of rows, each standing for as many as ``each`` says."""
    z = weights[0] + ((x - np.array(means)) / scales) @ np.array(weights[1:])
    return float(np.average(np.logaddexp(0, np.where(y == 1, -z, z)), weights=each))


def unexplained(samples: list[bytes], ordinary: bytes) -> list[bytes]:
    """The windows without the keys that the ordinary dictionary holds; windows with nothing left go."""
    known = {ordinary[i:i + KEY] for i in range(len(ordinary) - KEY + 1)}
    left = (b"".join(k for k in (w[i:i + KEY] for i in range(0, len(w), KEY)) if k not in known) for w in samples)
    return [w for w in left if w]


def telling(content: bytes, toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    """The keys in a toxic dictionary that are far denser in toxic than in ordinary windows.

    They are looked for at every byte: zstandard's header is of any length, and a segment may begin within a key.
    """
    counts = [dict(zip(*np.unique(np.frombuffer(b"".join(w), "<u8"), return_counts=True), strict=True)) for w in (toxic, ordinary)]
    size = [max(1, sum(len(x) for x in w)) for w in (toxic, ordinary)]
    held = np.unique(np.concatenate([np.frombuffer(content[at:at + (len(content) - at) // KEY * KEY], "<u8") for at in range(KEY)]))
    found = [(counts[0].get(k, 0), k) for k in held]
    kept = [(n, k) for n, k in found if n >= LEAST and n / size[0] >= RATIO * counts[1].get(k, 0) / size[1]]
    # zstandard never matches the last bytes of a dictionary, so these hold nothing.
    return b"".join(int(k).to_bytes(KEY, "little") for _, k in sorted(kept)) + bytes(2 * KEY)


def _pair(base: list[bytes], other: list[bytes]) -> tuple[bytes, bytes]:
    """The dictionary of windows of one label, and what windows of the other label have of their own behind it."""
    held = dictionary(base, COMMON_BYTES)
    return held, telling(dictionary(unexplained(other, held), OWN_BYTES), other, base)


def _windows_of(rows: DataFrame, most: int) -> list[bytes]:
    """At most ``most`` windows, chosen by a hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for held in windows(batch.column(0)) for w in held], pa.binary())], ["w"])

    cut = rows.select("text").mapInArrow(run, "w binary").select("w", F.xxhash64("w").alias("r"))
    return [bytes(r.w) for r in cut.orderBy("r", "w").limit(most).collect() if r.w]


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
          rows: int = ROWS, most_windows: int = WINDOWS) -> Model:
    """Dictionaries and calibration from at most ``rows`` labelled rows of each class, chosen by a hash of the id.

    Half of the rows train the dictionaries on windows of their texts, at most ``most_windows`` of
    each kind: the ordinary one on ordinary windows, the toxic one on
    what that leaves unexplained of toxic windows, without the segments that are as dense in ordinary ones.  The same is done with the labels
    changed about, and the pair counts whose calibration leaves less open.  The other half calibrates:
    its scores are fitted to labels, and a row counts for as many
    as its class has labelled rows for each chosen one, so a score is the
    probability among all labelled rows, whatever ``rows`` leaves out.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col).agg(F.max(label).alias("y"))
    sizes = known.agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")).first()
    stands = np.array([max(1.0, n / rows) for n in (sizes.n0, sizes.n1)])
    order = [F.xxhash64(F.col(id_col), F.lit("toxic")), F.col(id_col)]
    chosen = known.where("y = 1").orderBy(*order).limit(rows).union(known.where("y = 0").orderBy(*order).limit(rows))
    # Bounded by the two limits.
    found = df.select(id_col, text_of(text_col).alias("text")).join(F.broadcast(chosen), id_col)
    found = materialise(found.select("y", "text", (F.pmod(F.xxhash64("text"), F.lit(2)) == 0).alias("fit")), "toxic")
    own = found.where("fit").dropDuplicates(["text"])

    sizes = own.agg(F.sum("y").alias("na"), F.sum(1 - F.col("y")).alias("nb")).first()
    na, nb = sizes.na or 0, sizes.nb or 0
    if not na or not nb:
        na, nb = na * stands[1], nb * stands[0]
        share = (na + 1) / (na + nb + 2)
        return Model(b"", b"", (float(np.log(share / (1 - share))), *[0.0] * FEATURES), (0.0,) * FEATURES, (1.0,) * FEATURES)
    samples = [_windows_of(own.where(F.col("y") == y), most_windows) for y in (0, 1)]
    pairs = [_pair(samples[y], samples[1 - y]) for y in (0, 1)]

    @F.pandas_udf("array<array<double>>")
    def rate(texts: pd.Series) -> pd.Series:
        held = windows(pa.array(texts, pa.string()))
        return pd.Series([[list(features(w, *pair)) for pair in pairs] for w in held])

    rated = found.where("not fit").select("y", rate("text").alias("x")).collect() or own.select("y", rate("text").alias("x")).collect()
    y = np.array([r.y for r in rated])
    fits = [fit_weights(np.array([r.x[side] for r in rated]), y.astype(float), stands[y]) for side in (0, 1)]
    losses = [log_loss(np.array([r.x[side] for r in rated]), y, stands[y], *fit) for side, fit in enumerate(fits)]
    best = int(np.argmin(losses))
    return Model(*pairs[best], *fits[best])


def score(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """Adds the calibrated probability that each whole text is toxic.

    Nothing but the text counts.  Empty and null texts get the score of a text in
    which no window saves anything; repeated texts get one score.  A column of ``df`` named like the added one is replaced.
    """
    ordinary, toxic, weights, means, scales = model.ordinary, model.toxic, np.array(model.weights), np.array(model.means), np.array(model.scales)
    kept = [c for c in df.columns if c != out]
    text = free(df, "whole_text")
    rows = df.select(*[F.col(f"`{c}`") for c in kept], text_of(text_col).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(w, ordinary, toxic) for w in windows(batch.column(len(kept)))]).reshape(batch.num_rows, -1)
            p = 1 / (1 + np.exp(-(weights[0] + ((x - means) / scales) @ weights[1:])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(p, pa.float64())], [*kept, out])

    return rows.mapInArrow(run, rows.drop(text).schema.add(out, "double")).select(*[F.col(f"`{c}`") for c in (df.columns if out in df.columns else [*kept, out])])
