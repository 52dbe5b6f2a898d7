"""Token counts and ids: batch encoding inside Arrow functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BATCH_BYTES = 1 << 18
PIECE_CHARS = 1 << 20
MEMORY = 1_500_000
MARKS = ".,;:!?"

_LOADED: dict[str, object] = {}
_KNOWN: dict[tuple[str, str], dict[str, object]] = {}


def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Encodes texts without begin, end or added special tokens; loaded once in a worker."""
    if path not in _LOADED:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _LOADED[path] = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        elif path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            piece = SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: piece.encode(texts, num_threads=1)
        else:
            raise ValueError(f"no library for {path}")
    return _LOADED[path]


def word_wise(path: str) -> bool:
    """Whether spaces and line ends always part tokens and are none themselves.

    True of a vocabulary whose splitter drops white space; texts may then be cut
    at any space and put together again.  Checked on the tokenizer itself.
    """
    if not path.endswith(".json"):
        return False
    encode = encoder(path)
    probe = ["a b\n c's  2 3.\n", "a", "b", "c's", "2", "3."]
    whole, *parts = encode(probe)
    return whole == [i for p in parts for i in p]


def balanced(texts: list[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Batches of about ``most`` bytes (characters count up to four), so that one long text is a batch of its own."""
    batch, size = [], 0
    for text in texts:
        if batch and size + len(text) > most:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += len(text)
    if batch:
        yield batch


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """A text cut at spaces or line ends into pieces of ``most`` characters, longer only where there is no such place."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(" ", at, at + most), text.rfind("\n", at, at + most))
        if cut <= at:
            found = [i for i in (text.find(" ", at + most), text.find("\n", at + most)) if i >= 0]
            if not found:
                break
            cut = min(found)
        yield text[at:cut]
        at = cut
    yield text[at:]


@lru_cache(maxsize=8)
def splitting(path: str) -> tuple[bool, str]:
    """Whether the tokenizer lower-cases ASCII letters, and which marks its splitter parts from letters before them, whatever follows.

    Asked of its own normaliser and splitter; a tokenizer without these does neither.
    """
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    normal = model.normalizer.normalize_str if model.normalizer else str
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    lowers = normal(letters) == letters.lower() and all(normal(c) == c.lower() for c in letters)
    if not model.pre_tokenizer:
        return lowers, ""

    def parts(text: str) -> bool:
        return any(start == 2 for _, (start, _) in model.pre_tokenizer.pre_tokenize_str(normal(text)))

    return lowers, "".join(m for m in MARKS if all(parts(f"ab{m}{more}") for more in ("", *MARKS)))


def _apart(word: str, lowers: bool, marks: str) -> tuple[str, str] | None:
    """ASCII letters, in lower case where the tokenizer makes them so, and the marks behind them that it parts from them; None for any other word."""
    core = word.rstrip(marks) if marks else word
    return (core.lower() if lowers else core, word[len(core):]) if core.isascii() and core.isalpha() else None


def _encode_words(words: list[str], path: str, keep: Callable) -> list:
    """``keep(ids)`` of each word; many words go through the tokenizer as one text with a separator between.

    The separator is one token and in none of the words, so its id tells where they end.
    """
    encode, mark = encoder(path), "|"
    sign = encode([mark])[0]
    out: dict[str, object] = {}
    joined = [w for w in words if w and mark not in w] if len(sign) == 1 else []
    for batch in balanced(joined, 1 << 14):
        ids = np.asarray(encode([f" {mark} ".join(batch)])[0])
        cuts = np.flatnonzero(ids == sign[0])
        if len(cuts) == len(batch) - 1:
            out.update(zip(batch, map(keep, _between(ids, cuts)), strict=True))
    rest = [w for w in words if w not in out]
    for batch in balanced(rest):
        out.update(zip(batch, map(keep, encode(batch)), strict=True))
    return [out[w] for w in words]


def _between(ids: np.ndarray, cuts: np.ndarray) -> Iterator[np.ndarray]:
    start = 0
    for cut in [*cuts.tolist(), len(ids)]:
        yield ids[start:cut]
        start = cut + 1


def _learn(fresh: set[str], known: dict[str, object], path: str, keep: Callable) -> None:
    """Add words to the memory; one that differs by case or marks behind it from another is put together from that."""
    how = splitting(path)
    parts = {w: a for w in fresh if (a := _apart(w, *how)) and a != (w, "")}
    wanted = (fresh - parts.keys()) | {x for a in parts.values() for x in a if x not in known}
    todo = list(wanted)
    known.update(zip(todo, _encode_words(todo, path, keep), strict=True))
    known.update((w, known[core] + known[marks]) for w, (core, marks) in parts.items())


def encoded(texts: list[str], path: str, keep: Callable) -> Iterator[list]:
    """For each text a list of ``keep(ids)``, in order, over its words or else for the text as a whole.

    Texts are taken in batches of balanced bytes.  Where words can be encoded
    apart, each distinct word of a worker is encoded once and remembered
    (``MEMORY`` words at most, some 250 MB; then the memory starts afresh, which
    changes the time but no result).  ``keep`` gives something that adds up.
    """
    if not word_wise(path):
        for batch in balanced(texts):
            yield from ([keep(ids)] for ids in encoder(path)(batch))
        return
    known = _KNOWN.setdefault((path, keep.__name__), {})
    for batch in balanced(texts):
        split = [[w for piece in pieces(t) for w in piece.replace("\n", " ").split(" ")] if len(t) > PIECE_CHARS
                 else t.replace("\n", " ").split(" ") for t in batch]
        every = set().union(*split)
        fresh = every.difference(known)
        if len(known) + len(fresh) > MEMORY and known:
            known.clear()
            fresh = every
        if fresh:
            _learn(fresh, known, path, keep)
        for found in split:
            yield list(map(known.__getitem__, found))


def count_tokens(df: DataFrame, tokenizer: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """The columns of ``df`` but the text, and the number of tokens of each whole text.

    Only lengths leave the Arrow function.  A null or empty text has none; rows
    may repeat.  ``tokenizer`` is a path every executor can read.  A column of
    ``df`` named like the added one is replaced.
    """
    kept = [c for c in df.columns if c not in (text_col, out)]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = rows.drop("__text").schema.add(out, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            counts = [sum(n) for n in encoded(texts, tokenizer, len)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(counts, pa.int64())], [*kept, out])

    return rows.mapInArrow(run, schema)
