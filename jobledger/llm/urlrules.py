"""URL filters from association rules over URL tokens, matched through an inverted index."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from jobledger.session import materialise

SUPPORT = 0.01
CONFIDENCE = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def listed(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (``host/path``) that fits a URL: its host and all below it, and paths that start with its path."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        chosen = F.when(fits, F.lit(rule)).otherwise(chosen)
    return chosen


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: parts of the host and of the path and query names; numbers tell nothing and are left out.

    Sorted, so that equal sets are equal arrays.
    """
    def tagged(tag: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda p: p.rlike("[^0-9]")), lambda p: F.concat(F.lit(tag), p))

    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    return F.array_sort(F.array_distinct(F.concat(
        tagged("host:", F.split(host, "[.-]")), tagged("path:", F.split(path, "[/._-]")), tagged("ask:", names))))


def together(rows: DataFrame, tokens: str, label: str, support: float = SUPPORT) -> DataFrame:
    """(token, rep) for frequent tokens that occur in exactly the labelled rows of another one, ``rep``.

    Tokens agree when the number and two sums over hashes of their rows do.  Frequent tokens are at most the mean number of tokens
    of a row over ``support``, whatever the input.
    """
    known = rows.where(F.col(label).isNotNull()).select(F.col(tokens).alias("tokens"), F.monotonically_increasing_id().alias("row"))
    least = known.count() * support
    h = F.xxhash64("row")
    seen = known.select(F.explode(F.array_distinct("tokens")).alias("token"), h.alias("h")).groupBy("token").agg(
        F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64("h")).alias("mixed"))
    same = seen.where(F.col("n") >= least).groupBy("n", "total", "mixed").agg(F.array_sort(F.collect_list("token")).alias("held"))
    return same.select(F.explode(F.slice("held", 2, 1 << 30)).alias("token"), F.col("held")[0].alias("rep"))


def mine(rows: DataFrame, tokens: str, label: str, support: float = SUPPORT, confidence: float = CONFIDENCE,
         twins: DataFrame | None = None) -> DataFrame:
    """Rules ``tokens -> label`` (``tokens, label, confidence, support``), mined by FP-growth.

    All labelled rows are mined: each task sums its own into prefix trees, so equal
    baskets are one path.  ``support`` bounds
    the frequent combinations, and so the rules, whatever the input; rules
    below ``confidence`` go, those of many tokens stay.  Of tokens that always occur together
    (``twins``, see ``together``) one stands for all: a template of forty of them is one item, not 2^40 combinations.
    """
    mark = "label:"
    gone = [r.token for r in twins.select("token").collect()] if twins is not None else []
    own = F.array_except(tokens, F.array(*[F.lit(t) for t in gone])) if gone else F.col(tokens)
    baskets = rows.where(F.col(label).isNotNull()).select(F.array_union(own, F.array(F.concat(F.lit(mark), label))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    target = F.element_at("consequent", 1)
    own = F.filter("antecedent", lambda x: x.startswith(mark))
    return model.associationRules.where(target.startswith(mark) & (F.size(own) == 0)).select(
        F.array_sort("antecedent").alias("tokens"), F.substring(target, len(mark) + 1, 1 << 20).alias("label"), "confidence", "support")


def represented(sets: DataFrame, twins: DataFrame) -> DataFrame:
    """Distinct token sets, and the same with each token's representative: a set that has one of twins fits rules on any of them."""
    each = sets.select("tokens", F.explode("tokens").alias("token")).join(twins, "token", "left")
    return each.groupBy("tokens").agg(F.array_sort(F.collect_set(F.coalesce("rep", "token"))).alias("reps"))


def index(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """Each rule once, under the rarest of its tokens (``token``)."""
    worth = rules.select("*", F.explode("tokens").alias("token")).join(counts, "token", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))
    return worth.groupBy("tokens", "label", "confidence", "support").agg(rarest.alias("rarest")).select(
        F.col("rarest.token").alias("token"), F.col("tokens").alias("needs"), "label", "confidence", "support")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The best rule for each distinct token set that one fits: ``tokens, best``.

    A set meets only the rules entered under one of its tokens, and the join
    lets those through that it holds in full.  Greatest confidence wins, then support, then
    fewer tokens, then the order of their names.
    """
    counts = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    entries = index(rules, counts)
    asked = sets.select("tokens", F.explode("tokens").alias("token"))
    held = F.size(F.array_except("needs", "tokens")) == 0
    best = F.max(F.struct("confidence", "support", (-F.size("needs")).alias("short"), "label", "needs"))
    return asked.join(entries, "token").where(held).groupBy("tokens").agg(best.alias("best"))


def filter_urls(df: DataFrame, lists: dict[str, str], url_col: str = "url", default: str = "allow", **options) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row.

    ``lists`` maps rules (``host/path``) to block or allow.  URLs that one fits
    have its verdict and are the labels from which rules over tokens are
    mined; these judge the others, and ``default`` those that no rule fits.
    Distinct token sets are judged once and joined back: numbers are one token,
    so there are far fewer of them than URLs.  A null or malformed URL has an
    empty host and path and no tokens.  Columns of ``df`` with the names that are added are replaced.
    """
    added = ("host", "path", "rule", "verdict")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in added]
    rows = df.select(F.struct(*kept).alias("row"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"),
                     path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("rule", listed(F.col("host"), F.col("path"), lists))
    rows = rows.withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    known = F.create_map(*[F.lit(x) for pair in lists.items() for x in pair])[F.col("rule")] if lists else F.lit(None).cast("string")
    rows = materialise(rows.withColumn("known", known).drop("url"), "urls")
    twins = materialise(together(rows, "tokens", "known", options.get("support", SUPPORT)), "twins")
    rules = materialise(mine(rows, "tokens", "known", twins=twins, **options), "rules")
    sets = rows.where(F.col("known").isNull() & (F.size("tokens") > 0)).select("tokens").distinct()
    sets = materialise(represented(sets, twins), "sets")
    judged = match(sets.select(F.col("reps").alias("tokens")).distinct(), rules)
    judged = sets.join(judged.withColumnRenamed("tokens", "reps"), "reps").select("tokens", "best")
    out = rows.join(judged, "tokens", "left")
    return out.select("row.*", "host", "path", "rule",
                      F.coalesce("known", F.col("best.label"), F.lit(default)).alias("verdict"))
