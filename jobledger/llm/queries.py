"""The registered queries of the training-data operators and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobledger.llm import exact, mixing, packing, periodic, pii, quality, sharding, simhash, substring, tokens, toxicity, urlrules, whitening
from jobledger.llm.common import let, read, text_of, words

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "word_bpe_49k.json"
LISTS = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all sources: a row for each place a document takes in it."""
    rows = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("size")), size=F.col("size"))
    return rows.select("doc_id", "source", "mix.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(
        read(spark, sf_dir, "documents"), shingle=4, distance=simhash.DISTANCE, bits=simhash.SEGMENTS, words=1)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pii.find_spans(docs, pii.train(docs))
    spans = {k: F.col(f"pii.{k}") for k in pii.KINDS}
    base = F.array_join(F.concat(*[pii.listed(spans[k], k) for k in pii.KINDS]), ",")

    def every(i: int, kind: str) -> Column:
        added = F.filter("pii.added", lambda x: x["kind"] == i)
        bare = lambda xs: F.transform(xs, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
        return pii.listed(F.array_sort(F.concat(bare(spans[kind]), bare(added))), kind)

    return rows.select(
        "doc_id", *[F.size(spans[k]).cast("long").alias(f"n_{k}") for k in pii.KINDS], F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.concat(*[every(i, k) for i, k in enumerate(pii.KINDS)]), ",").alias("spans"))


def op4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    model = toxicity.train(docs, read(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard, and the one it would have if the first shard were lost."""
    names = sharding.shard_names()
    rows = read(spark, sf_dir, "documents").select("doc_id")
    rows = sharding.place(rows, F.col("doc_id"), names)
    rows = sharding.place(rows, F.col("doc_id"), names[1:], shard_col="shard_without_first")
    return rows.select("doc_id", "slot", "shard", "shard_without_first")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rules = quality.train(docs, read(spark, sf_dir, "labels"))
    q = F.col("quality")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    return quality.judge(docs.select("doc_id", "text"), rules).select("doc_id", *[q[n].alias(n) for n in names])


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return packing.pack(pieces)


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = tokens.count_tokens(docs, public_tokenizers.path(TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urlrules.filter_urls(pages, LISTS).drop("url")


def op11_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words, how many of them an earlier one has in 13 or more together, and a digest of the rest."""
    rows = substring.drop_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, span: n + span["end"] - span["start"])
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the eight leading components, with the figures of the fit."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """Documents whose checksum is divisible by ten repeat a stretch of their words from a word on, as the contract has it."""
    h, n = F.crc32(F.col("doc_id").cast("string")), F.size("w")
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")

    def filled(w: Column, a: Column, p: Column) -> Column:
        place = F.sequence(F.lit(0), F.size(w) - 1)
        return F.array_join(F.transform(place, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    docs = docs.withColumn("w", F.when(h % 10 == 0, words(text_of())))
    periodic_text = let(F.struct(F.col("w").alias("w"), a.alias("a"), p.alias("p")), lambda x: filled(x["w"], x["a"], x["p"]))
    return docs.select("doc_id", F.when(n > 0, periodic_text).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's longest periodic run, and digests of all runs and of the text without their repetitions."""
    rows = periodic.periodic_runs(_with_periods(read(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    length, period = F.col("longest.length"), -F.col("longest.p")
    return rows.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.s")).alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_mixing, op2_simhash, op3_pii, op4_exact, op5_toxicity, op6_sharding, op7_quality, op8_packing, op9_tokens, op10_urls,
    op11_substring, op12_whitening, op13_runs)}

CHECKS: dict[str, str] = {
    "op4_exact": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY body ORDER BY doc_id) = 1 AS kept, sha256(body) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY body)""",
}
