"""Personal data: fixed patterns, and wider candidates judged by boosted trees."""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from jobledger.llm.common import free, let, text_of
from jobledger.session import materialise

KINDS = ("email", "ip", "card", "phone")
# Possessive, so that no text can exhaust the matcher's stack, and anchored to where a run starts, so that a long
# run is read once; what they find is what the plain greedy patterns find.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# High recall: what may be an address or a number, well formed or not.
WIDER = {
    "email": r"[^\s@,;:<>()\[\]\"']{1,64}+\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9-]{1,63}+(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z0-9-]{1,63}+)*+",
    "ip": r"(?<![0-9.])[0-9]++(?:\.[0-9]++){2,}+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){10,24}+",
    "phone": r"(?<![0-9])[+(]?[0-9](?:[ ().-]{0,2}+[0-9]){6,15}+",
}
IP_PARTS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.|$)){4}$"
FEATURES = ("kind", "chars", "digits", "marks", "dots", "plus", "at", "groups", "longest", "largest", "checksum",
            "letter_before", "letter_after", "letters_near", "digits_near")
PRECISION = 0.99
TREES, DEPTH = 10, 3


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as ``s, start, end`` in code points, end exclusive.

    Spark gives matches without their places; the pieces between them give those.
    """
    none = F.array().cast("array<struct<s:string,start:int,end:int>>")

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
        pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("s"))
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["g"]
            end = begin + F.length(x["s"])
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
                x["s"].alias("s"), begin.alias("start"), end.alias("end")))).alias("out"))

        return F.when(F.size(found) == 0, none).otherwise(F.aggregate(pairs, start, step, lambda acc: acc["out"]))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), placed)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a digit string ends in 0."""
    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))
    return total % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x["s"]))
    return {"email": F.lit(True), "ip": x["s"].rlike(IP_PARTS), "phone": n.between(9, 15),
            "card": F.when(n.between(13, 19), luhn(_digits(x["s"]))).otherwise(False)}[kind]


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of the fixed pattern; one that fails is dropped, and its text not searched again."""
    gate = {"email": "@", "ip": ".", "card": "", "phone": "+"}[kind]
    found = F.filter(matches(text, PATTERNS[kind]), lambda x: _valid(kind, x))
    return F.when(F.contains(text, F.lit(gate)), found).otherwise(F.array().cast("array<struct<s:string,start:int,end:int>>"))


def candidates(text: Column) -> Column:
    """Spans of all generators, overlapping ones too, with what the trees look at."""
    out = []
    for k, kind in enumerate(KINDS):
        gate = F.lit(True) if kind != "email" else F.contains(text, F.lit("@")) | text.rlike(r"[(\[]at[)\]]")
        found = F.when(gate, matches(text, WIDER[kind])).otherwise(F.array().cast("array<struct<s:string,start:int,end:int>>"))
        out.append(F.transform(found, _described(text, k)))
    return F.concat(*out)


def _described(text: Column, kind: int):
    def one(x: Column) -> Column:
        s = x["s"]
        before, after = F.substring(text, F.greatest(x["start"] - 11, F.lit(1)), F.least(x["start"], F.lit(12))), F.substring(text, x["end"] + 1, 1)
        count = lambda t, what: F.length(t) - F.length(F.regexp_replace(t, what, ""))
        groups = F.filter(F.split(s, "[^0-9]+"), lambda g: g != "")
        number = {
            "kind": F.lit(kind), "chars": F.length(s), "digits": count(s, "[0-9]"), "marks": count(s, r"[ ()-]"), "dots": count(s, r"\."),
            "plus": F.startswith(s, F.lit("+")), "at": F.contains(s, F.lit("@")), "groups": F.size(groups),
            "longest": F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)),
            "largest": F.coalesce(F.array_max(F.transform(groups, lambda g: F.substring(g, 1, 4).cast("int"))), F.lit(0)),
            "checksum": F.when(F.length(_digits(s)).between(13, 19), luhn(_digits(s))).otherwise(False),
            "letter_before": F.substring(text, x["start"], F.least(x["start"], F.lit(1))).rlike(r"\p{L}$"), "letter_after": after.rlike(r"^\p{L}"),
            "letters_near": count(before, r"\p{L}"), "digits_near": count(before, "[0-9]"),
        }
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), *[number[f].cast("double").alias(f) for f in FEATURES])

    return one


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def tree_expression(model: GBTClassificationModel, value) -> Column:
    """The margin of boosted trees as one Spark conditional expression; ``value(i)`` is feature ``i``."""
    def read(lines: list[tuple[int, str]], at: int) -> tuple[Column, int]:
        text = lines[at][1]
        if text.startswith("Predict:"):
            return F.lit(float(text.split(":")[1])), at + 1
        i, cut = re.match(r"If \(feature (\d+) <= (\S+)\)", text).groups()
        low, at = read(lines, at + 1)
        high, at = read(lines, at + 1)  # the line between is the Else
        return F.when(value(int(i)) <= float(cut), low).otherwise(high), at

    total = F.lit(0.0)
    for weight, tree in zip(model.treeWeights, model.trees, strict=True):
        body = [(len(x) - len(x.lstrip()), x.strip()) for x in tree.toDebugString.splitlines()[1:] if x.strip()]
        total = total + F.lit(float(weight)) * read(body, 0)[0]
    return total


def train(df: DataFrame, text_col: str = "text", precision: float = PRECISION, trees: int = TREES,
          depth: int = DEPTH) -> tuple[GBTClassificationModel, list[float]] | None:
    """Boosted trees and a threshold for each kind, from all candidates of all texts.

    A candidate is right if a span of the fixed patterns of its kind lies within it.  Two
    thirds train the trees; the others calibrate: a kind's threshold is the
    lowest margin from which the share of right ones is ``precision`` or more,
    counted by margins rounded to hundredths.  None if a class is missing.
    """
    rows = df.select(text_of(text_col).alias("text"))
    held = rows.select(candidates(F.col("text")).alias("c"), F.array(*[base_spans(F.col("text"), k) for k in KINDS]).alias("b"))
    right = F.exists(F.get("b", F.col("x.kind").cast("int")), lambda s: _overlaps(s, F.col("x"))).cast("double")
    each = held.select("b", F.explode("c").alias("x")).select(right.alias("label"), "x.*")
    each = materialise(each, "candidates")
    each = VectorAssembler(inputCols=list(FEATURES), outputCol="v").transform(each)
    fold = F.pmod(F.xxhash64(*FEATURES, "start", "end"), F.lit(3))
    fit = each.where(fold > 0)
    if fit.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(featuresCol="v", labelCol="label", maxIter=trees, maxDepth=depth, seed=7).fit(fit.select("label", "v"))
    margin = tree_expression(model, lambda i: F.col(FEATURES[i]))
    counted = each.where(fold == 0).groupBy("kind", F.round(margin, 2).alias("m")).agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect()
    cuts = []
    for k in range(len(KINDS)):
        right_, all_, cut = 0.0, 0, float("inf")
        for row in sorted((r for r in counted if r.kind == k), key=lambda r: -r.m):
            right_, all_ = right_ + row.p, all_ + row.n
            if all_ >= 10 and right_ >= precision * all_:
                cut = row.m
        cuts.append(cut)
    return model, cuts


def find_spans(df: DataFrame, model: tuple[GBTClassificationModel, list[float]] | None, text_col: str = "text", out: str = "pii") -> DataFrame:
    """Adds the struct ``out``: per kind the array of base spans, and ``added``: those that the trees select besides.

    A candidate counts if its margin reaches its kind's threshold and it overlaps
    no base span; of overlapping ones the first kind and start stays.  All in
    one pass over each whole text, without a shuffle.  A null or empty text has no spans.
    """
    text, base, more = free(df, "__text"), free(df, "__base"), free(df, "__more")
    rows = df.withColumn(text, text_of(text_col))
    rows = rows.withColumn(base, F.struct(*[base_spans(F.col(text), k).alias(k) for k in KINDS]))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    added = none
    if model is not None:
        trees, cuts = model
        taken = F.concat(*[F.col(f"{base}.{k}") for k in KINDS])

        def chosen(x: Column) -> Column:
            margin = tree_expression(trees, lambda i: x[FEATURES[i]])
            cut = F.element_at(F.array(*[F.lit(c) for c in cuts]), x["kind"].cast("int") + 1)
            return ~F.exists(taken, lambda b: _overlaps(b, x)) & (F.round(margin, 2) >= cut)

        def first(acc: Column, x: Column) -> Column:
            return F.when(F.exists(acc, lambda a: _overlaps(a, x)), acc).otherwise(F.concat(acc, F.array(
                F.struct(x["kind"].cast("int").alias("kind"), x["start"].alias("start"), x["end"].alias("end")))))

        rows = rows.withColumn(more, F.filter(candidates(F.col(text)), chosen))
        added = F.aggregate(F.col(more), none, first)
    return rows.withColumn(out, F.struct(F.col(f"{base}.*"), added.alias("added"))).drop(text, base, more)


def listed(spans: Column, kind: str) -> Column:
    """``kind:start:end`` of each span."""
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))


def redact(df: DataFrame, model: tuple[GBTClassificationModel, list[float]] | None, text_col: str = "text") -> DataFrame:
    """The rows with every span, base or added, replaced by its kind in brackets."""
    out = free(df, "__pii")
    rows = find_spans(df, model, text_col, out)
    every = F.concat(*[F.transform(F.col(f"{out}.{k}"), _with_kind(i)) for i, k in enumerate(KINDS)], F.col(f"{out}.added"))
    ordered = F.array_sort(F.transform(every, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    text = F.col(text_col)

    def step(acc: Column, x: Column) -> Column:
        name = F.element_at(F.array(*[F.lit(f"[{k}]") for k in KINDS]), x["kind"] + 1)
        piece = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], piece, name).alias("out"))

    whole = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return rows.withColumn(text_col, F.when(text.isNotNull(), whole)).drop(out)


def _with_kind(kind: int):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
