"""Quality rules: decision lists learned by sequential covering, as Spark conditional expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from jobledger.llm.common import free, let, text_of, words
from jobledger.session import materialise

SYMBOLS = "[#*$%&|<>]"
SAMPLE = 20_000
STEPS = 15
PRECISION = 0.97
SUPPORT = 10
LITERALS = 4


def _repeats(found: Column) -> Column:
    """Words in a window of three that the text has twice or more.

    Windows are hashed and sorted with their place, so equal ones are
    neighbours: n log n within a row, and nothing is shuffled.
    """
    marks = F.transform(F.sequence(F.lit(0), F.size(found) - 3), lambda i: F.xxhash64(
        F.element_at(found, i + 1), F.element_at(found, i + 2), F.element_at(found, i + 3)))

    def places(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ordered, lambda o: F.sort_array(F.transform(
            F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda k: (
                F.coalesce(F.get(o, k - 1)["h"] == F.get(o, k)["h"], F.lit(False))
                | F.coalesce(F.get(o, k + 1)["h"] == F.get(o, k)["h"], F.lit(False)))),
            lambda k: F.get(o, k)["i"])))

    covered = lambda p: F.aggregate(p, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(
        i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    count = let(marks, lambda m: F.when(F.size(F.array_distinct(m)) == F.size(m), F.lit(0)).otherwise(covered(places(m))))
    return F.when(F.size(found) < 3, F.lit(0)).otherwise(count).cast("long")


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def with_statistics(df: DataFrame, text_col: str = "text", out: str = "stats") -> DataFrame:
    """Adds the struct ``out`` of counts over each whole text; a null text counts as empty."""
    text, found = free(df, "__text"), free(df, "__words")
    rows = df.withColumn(text, text_of(text_col)).withColumn(found, words(F.col(text)))
    t, w = F.col(text), F.col(found)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return rows.withColumn(out, F.struct(
        F.size(w).cast("long").alias("n_words"),
        (F.length(F.array_join(w, ""))).cast("long").alias("word_chars"),
        _count(t, SYMBOLS).alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeats(w).alias("n_repeat_words"),
        _count(t, r"\p{Lu}+").alias("n_upper"),
        _count(t, "[.,;:!?]+").alias("n_marks"),
        _count(t, r"\p{Nd}+").alias("n_digits"),
        F.size(lines).cast("long").alias("n_lines"))).drop(text, found)


def features(stats: str = "stats") -> dict[str, Column]:
    """The statistics that rules may test; each is a ratio or a count, zero for an empty text."""
    s = lambda name: F.col(f"{stats}.{name}")
    per = lambda a, b: F.coalesce(s(a) / F.nullif(s(b), F.lit(0)), F.lit(0.0))
    return {
        "n_words": s("n_words").cast("double"), "word_length": per("word_chars", "n_words"),
        "symbols": per("n_symbols", "word_chars"), "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"), "upper": per("n_upper", "word_chars"),
        "marks": per("n_marks", "n_words"), "digits": per("n_digits", "word_chars"), "line_words": per("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    bin: int
    threshold: float

    def holds(self, values: dict[str, Column]) -> Column:
        return values[self.feature] > self.threshold if self.above else values[self.feature] <= self.threshold

    def holds_binned(self) -> Column:
        return F.col(self.feature) > self.bin if self.above else F.col(self.feature) <= self.bin


Rule = tuple[Literal, ...]


def _between(seen: list[float]) -> list[float]:
    """Cuts between neighbouring values, a quarter of the way: a rule at the edge of a class leaves it some room."""
    return [a + (b - a) / 4 for a, b in zip(seen, seen[1:], strict=False)]


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many cuts a value lies above."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: value > c))


def _all(rule: Rule) -> Column:
    test = F.lit(True)
    for literal in rule:
        test = test & literal.holds_binned()
    return test


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    """Add the literal of greatest FOIL gain until no good document is left or nothing helps."""
    rule: Rule = ()
    while len(rule) < LITERALS:
        unfolded = rows.where(_all(rule)).select("bad", "n", F.explode(F.array(*[
            F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in cuts])).alias("x"))
        counts = unfolded.groupBy("x.feature", "x.bin").agg(
            F.sum(F.col("bad") * F.col("n")).alias("p"), F.sum((1 - F.col("bad")) * F.col("n")).alias("m")).collect()
        table = {f: [[0, 0] for _ in range(len(c) + 1)] for f, c in cuts.items()}
        for row in counts:
            table[row.feature][row.bin] = [row.p, row.m]
        p0, m0 = (sum(x[k] for x in next(iter(table.values()))) for k in (0, 1))
        if not p0 or not m0:
            return rule
        base, best = math.log2(p0 / (p0 + m0)), (0.0, None)
        for f, own in table.items():
            p = m = 0
            for b, (x, y) in enumerate(own[:-1]):
                p, m = p + x, m + y
                for above, pp, mm in ((False, p, m), (True, p0 - p, m0 - m)):
                    if pp:
                        gain = pp * (math.log2(pp / (pp + mm)) - base)
                        best = max(best, (gain, Literal(f, above, b, cuts[f][b])), key=lambda g: g[0])
        if best[1] is None:
            return rule
        rule = (*rule, best[1])
    return rule


def _worth(rows: DataFrame, rule: Rule) -> list[tuple[int, int]]:
    """Bad and good documents under each beginning of a rule, in one pass."""
    aggs = []
    for k in range(1, len(rule) + 1):
        here = F.when(_all(rule[:k]), F.col("n")).otherwise(0)
        aggs += [F.sum(here * F.col("bad")), F.sum(here * (1 - F.col("bad")))]
    row = rows.agg(*aggs).first() if aggs else ()
    return [(row[k] or 0, row[k + 1] or 0) for k in range(0, len(row), 2)]


def learn_rules(labelled: DataFrame, label: str, stats: str = "stats", precision: float = PRECISION,
                support: int = SUPPORT, most_rules: int = 12) -> list[Rule]:
    """An ordered list of conjunctions that reject, from rows with ``stats`` and a 0/1 label (0: bad).

    Two thirds of the rows grow a rule; the others prune it to its best
    beginning and must agree that it is right in ``precision`` of the cases.
    Statistics are cut between their quantiles and counted by cut, so what reaches
    the driver is one count for each feature and cut, however many rows there
    are.  Rows without a label are ignored; without bad or good ones no rule
    comes out.  ``most_rules`` only ends a list that keeps finding rules.
    """
    values = features(stats)
    rows = labelled.where(F.col(label).isNotNull()).select(
        *[v.alias(f) for f, v in values.items()], (F.col(label) == 0).cast("int").alias("bad"),
        (F.pmod(F.xxhash64(stats), F.lit(3)) == 0).alias("prune"))
    rows = materialise(rows, "labelled")
    steps = [k / (STEPS + 1) for k in range(1, STEPS + 1)]
    found = rows.groupBy("bad").agg(*[F.percentile_approx(f, steps, 1000).alias(f) for f in values]).collect()
    if len(found) < 2:
        return []
    cuts = {f: _between(sorted({float(x) for row in found for x in row[f] or []})) for f in values}
    binned = rows.select("bad", "prune", *[
        _bin(F.col(f), cuts[f]).alias(f) for f in cuts])
    binned = materialise(binned.groupBy(*binned.columns).agg(F.count("*").alias("n")), "binned")
    rules: list[Rule] = []
    left = binned
    while len(rules) < most_rules:
        rule = _grow(left.where("not prune"), cuts)
        worth = _worth(left.where("prune"), rule)
        scored = [((p - m) / (p + m), -k, p, m) for k, (p, m) in enumerate(worth) if p + m]
        if not scored:
            break
        _, k, p, m = max(scored)
        if p < support or p < precision * (p + m):
            break
        rules.append(rule[:1 - k])
        left = left.where(~_all(rules[-1]))
    return rules


def verdict(rules: list[Rule], stats: str = "stats") -> Column:
    """The number of the first rule that rejects a row, from 1; null if none does."""
    values, chosen = features(stats), F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        test = F.lit(True)
        for literal in rule:
            test = test & literal.holds(values)
        chosen = F.when(test, F.lit(k)).otherwise(chosen)
    return chosen


def base_failed(stats: str = "stats") -> Column:
    n, repeated = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < 50) | (100 * repeated > 50 * n)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
          sample: int = SAMPLE) -> list[Rule]:
    """Rules from at most ``sample`` labelled rows, chosen by a hash of the id; the sample is broadcast, the texts stay."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label).alias("__label"))
    chosen = chosen.orderBy(F.xxhash64(F.col(id_col), F.lit("quality")), id_col).limit(sample)
    rows = df.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    return learn_rules(with_statistics(rows.select("__label", text_col), text_col).select("__label", "stats"), "__label")


def judge(df: DataFrame, rules: list[Rule], text_col: str = "text", out: str = "quality") -> DataFrame:
    """Adds the struct ``out``: the counts, ``rule``, ``base_failed`` and ``kept``."""
    stats = free(df, "__stats")
    return with_statistics(df, text_col, stats).withColumn(out, F.struct(
        F.col(f"{stats}.*"), verdict(rules, stats).alias("rule"), base_failed(stats).alias("base_failed"),
        (~base_failed(stats) & verdict(rules, stats).isNull()).alias("kept"))).drop(stats)


def keep_good(df: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows that pass, with their columns.

    Unfolding the verdict rather than filtering by it keeps the optimiser from
    moving the condition below the statistics, which it would then take once
    for each mention.
    """
    out = free(df, "__quality")
    passed = F.filter(F.array(F.col(out)), lambda q: q["kept"])
    return judge(df, rules, text_col, out).withColumn(out, F.explode(passed)).drop(out)
