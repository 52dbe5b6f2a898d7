"""Mixing sources to target weights by Pfair scheduling of source blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from jobledger.llm.common import text_of
from jobledger.session import materialise

BLOCK_CHARS = 1 << 16
QUANTUM = 1000
TEMPERATURE = 0.7
BUCKETS = 1024
UNITS = 1 << 30
TOO_MANY = "more sources than slots in a period: raise quantum"


def schedule(sources: DataFrame, quantum: int = QUANTUM) -> DataFrame:
    """EDF schedule of one period, a row for each source.

    ``sources`` has ``key``, ``weight`` and ``n_blocks``.  A period has
    ``quantum`` slots; a source gets one slot and its share of the others by
    largest remainder, ``quota`` in all.  Block ``k`` of a source is released
    at ``floor(k * quantum / quota)`` and due at ``ceil((k + 1) * quantum /
    quota)``; each slot takes the released block that is due first.  The quotas
    fill the period, so every block runs within its window and all windows end
    with the period, and the next one repeats it.  Quotas are rounded, so what
    they differ from the weights adds up over periods; ``timetable`` has none.

    Returns ``key``, ``quota``, ``slots`` (of its blocks in a period),
    ``n_blocks``, ``length`` (slots until every source has been used up once)
    and ``served`` (its blocks until then).  The state is one row of at most
    ``quantum`` numbers and sources, which is checked; it does not grow with
    the documents.
    """
    everything = Window.partitionBy()
    share = F.col("weight") / F.sum("weight").over(everything)
    spare = (F.lit(quantum) - F.count("*").over(everything)) * share
    part = sources.withColumn("_spare", spare)
    part = part.withColumns({
        "_base": F.floor("_spare").cast("int"),
        "_rank": F.row_number().over(Window.orderBy((F.floor("_spare") - F.col("_spare")), "key"))})
    rest = F.lit(quantum) - F.sum(F.col("_base") + 1).over(everything)
    part = part.withColumn("quota", F.col("_base") + 1 + (F.col("_rank") <= rest).cast("int"))
    row = part.agg(
        F.sort_array(F.collect_list(F.struct("key", "quota", "n_blocks"))).alias("s"), F.count("*").alias("n"))
    row = row.where(F.col("n") > 0).withColumn(
        "s", F.when(F.col("n") > quantum, F.raise_error(F.lit(TOO_MANY)).cast(row.schema["s"].dataType)).otherwise(F.col("s")))
    picks = f"""aggregate(sequence(0, {quantum - 1}),
        named_struct('k', transform(s, x -> 0), 'picks', cast(array() as array<int>)),
        (a, t) -> transform(array(array_min(filter(
            transform(s, (x, i) -> named_struct(
                'due', ceil((a.k[i] + 1) * {quantum} / x.quota), 'i', i, 'free', floor(a.k[i] * {quantum} / x.quota))),
            c -> c.free <= t)).i),
          b -> named_struct('k', transform(a.k, (k, i) -> if(i = b, k + 1, k)), 'picks', concat(a.picks, array(b))))[0]
        ).picks"""
    # Stored, so that the optimiser can't move the fold into the expression that reads it slot by slot.
    row = materialise(row.withColumn("picks", F.expr(picks)), "period")
    row = row.withColumn("s", F.expr(f"""transform(s, (x, i) -> named_struct('key', x.key, 'quota', x.quota,
        'n_blocks', x.n_blocks, 'slots', filter(sequence(0, {quantum - 1}), t -> picks[t] = i)))"""))
    row = row.withColumn("length", F.expr(f"""array_max(transform(s, x ->
        (x.n_blocks - 1) div x.quota * {quantum} + x.slots[cast((x.n_blocks - 1) % x.quota as int)] + 1))"""))
    served = f"(length div {quantum}) * x.quota + size(filter(x.slots, t -> t < length % {quantum}))"
    return row.select("length", F.explode("s").alias("x")).select("x.*", "length", F.expr(served).alias("served"))


def timetable(sources: DataFrame, quantum: int = QUANTUM) -> DataFrame:
    """EDF schedule of the whole mixture by the weights themselves, a row for each source.

    ``sources`` has ``key``, ``weight`` and ``n_blocks``; a null weight is a share of
    one in ``quantum``, and the others share the rest.  Shares are whole numbers ``w`` of
    ``d`` in all (about 2^30), so windows are exact: block ``k`` is released at
    ``floor(k * d / w)`` and due at ``ceil((k + 1) * d / w)``; each slot takes the
    released block that is due first.  The shares fill all slots, so every block
    runs within its window: at any slot a source is less than one block
    ahead of or behind its weight.

    Returns ``key``, ``w``, ``d``, ``n_blocks``, ``length`` (slots until every source has been
    used up once), ``slots`` (of its blocks until then) and ``served`` (how many).
    The state is one row: at most ``quantum`` sources, which is checked, and one number
    for each slot, that is for each block of the mixture.
    """
    everything = Window.partitionBy()
    unnamed = F.count_if(F.col("weight").isNull()).over(everything) / quantum
    share = F.when(F.col("weight").isNull(), F.lit(1.0) / quantum).otherwise(
        F.greatest(F.lit(0.0), 1 - unnamed) * F.col("weight") / F.sum("weight").over(everything))
    part = sources.withColumn("w", F.greatest(F.round(share * UNITS), F.lit(1)).cast("long"))
    row = part.agg(F.sort_array(F.collect_list(F.struct("key", "w", "n_blocks"))).alias("s"), F.sum("w").alias("d"), F.count("*").alias("n"))
    row = row.where(F.col("n") > 0).withColumn(
        "s", F.when(F.col("n") > quantum, F.raise_error(F.lit(TOO_MANY)).cast(row.schema["s"].dataType)).otherwise(F.col("s")))
    row = row.withColumn("most", F.expr("array_max(transform(s, x -> (x.n_blocks * d + x.w - 1) div x.w))"))
    # Slots are appended by ``quantum``, so that no long array is copied for each of them.
    picks = f"""aggregate(sequence(0L, most - 1, {quantum}L),
        named_struct('k', transform(s, x -> 0L), 'out', cast(array() as array<array<int>>)),
        (acc, low) -> transform(array(aggregate(sequence(low, least(low + {quantum}, most) - 1),
            named_struct('k', acc.k, 'picks', cast(array() as array<int>)),
            (a, t) -> transform(array(array_min(filter(
                transform(s, (x, i) -> named_struct(
                    'due', ((a.k[i] + 1) * d + x.w - 1) div x.w, 'i', i, 'free', (a.k[i] * d) div x.w)),
                c -> c.free <= t)).i),
              b -> named_struct('k', transform(a.k, (k, i) -> if(i = b, k + 1, k)), 'picks', concat(a.picks, array(b))))[0])),
          e -> named_struct('k', e.k, 'out', concat(acc.out, array(e.picks))))[0],
        acc -> flatten(acc.out))"""
    row = materialise(row.withColumn("picks", F.expr(picks)), "timetable")
    taken = row.select(F.posexplode("picks").alias("t", "i")).groupBy("i").agg(F.sort_array(F.collect_list("t")).alias("slots"))
    each = row.select("d", F.posexplode("s").alias("i", "x")).join(taken, "i").select("x.*", "d", "slots")
    each = each.withColumn("length", F.max(F.expr("slots[cast(n_blocks - 1 as int)] + 1")).over(everything))
    return each.withColumn("served", F.expr("size(filter(slots, t -> t < length))"))


def mix(df: DataFrame, weights: dict[str, float] | None = None, repeat: bool = True, id_col: str = "doc_id",
        source_col: str = "source", size: Column | None = None, block_size: int = BLOCK_CHARS,
        quantum: int = QUANTUM, temperature: float = TEMPERATURE, buckets: int = BUCKETS) -> DataFrame:
    """Every row of ``df`` with its place in the mixture, in the added struct ``mix``.

    ``weights`` are target shares of the mixture by source; without them a
    source weighs its size to the power ``temperature``.  A source that is not
    named, or has no positive weight, still gets one slot in ``quantum``: no
    row is dropped.  The mixture ends when each source has been used up once;
    with ``repeat`` the others start again meanwhile (``epoch`` 1, 2, ...), which
    is how the target is met.  Without it each row occurs once, and a source
    that is used up leaves its slots empty.

    ``mix`` has ``slot``, ``release``, ``deadline``, ``block``, ``epoch`` and ``start``
    (place within its source).  A block is ``block_size`` of ``size`` (characters
    of the whole text by default; each row counts one at least); a row
    belongs to the block in which it starts.  Read by ``slot, start`` the rows
    are the mixture.  The last block of an epoch may be shorter.

    Rows of a source follow a hash of their id (equal ids: any order); null
    sources are a source of their own; null texts and ids are allowed.  A
    source is cut into ``buckets`` by that hash and place sums are taken over
    buckets first, so one source with a third of all rows is spread over as
    many tasks.  Columns may have any name but ``mix``.  An empty table gives
    an empty result.
    """
    size = F.length(text_of()) if size is None else size
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    hashed = F.xxhash64(F.col(id_col).cast("string"), F.lit("mix"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), key.alias("key"), hashed.alias("hash"),
                     F.greatest(F.coalesce(size, F.lit(0)), F.lit(1)).cast("long").alias("size"))
    rows = rows.withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("int"))
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("here"))
    along = Window.partitionBy("key").orderBy("bucket")
    sums = sums.select("key", "bucket", (F.sum("here").over(along) - F.col("here")).alias("before"), "here")
    totals = sums.groupBy("key").agg(F.sum("here").alias("total"))
    weight = F.pow(F.col("total"), F.lit(temperature))
    if weights is not None:
        named = F.create_map(*[F.lit(x) for name, w in weights.items() for x in (f"={name}", float(w))])
        weight = named[F.col("key")] if weights else F.lit(None).cast("double")
        weight = F.when(weight > 0, weight)
    plan = timetable(totals.select("key", weight.alias("weight"),
                                  F.ceil(F.col("total") / block_size).cast("long").alias("n_blocks")), quantum)
    upto = Window.partitionBy("key", "bucket").orderBy("hash")
    placed = rows.join(sums.drop("here"), ["key", "bucket"]).withColumn(
        "start", F.col("before") + F.sum("size").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.withColumn("first", F.expr(f"start div {block_size}"))
    # One row for each source, of which there are ``quantum`` at most; their slots are a number for each block of the mixture.
    placed = placed.join(F.broadcast(plan), "key")
    times = F.expr("(served - first + n_blocks - 1) div n_blocks") if repeat else F.lit(1)
    placed = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), (times - 1).cast("int"))))
    placed = placed.withColumn("block", F.col("epoch") * F.col("n_blocks") + F.col("first"))
    return placed.select("row.*", F.struct(
        F.expr("slots[cast(block as int)]").cast("long").alias("slot"),
        F.expr("block * d div w").alias("release"), F.expr("((block + 1) * d + w - 1) div w").alias("deadline"),
        "block", F.col("epoch").cast("int").alias("epoch"), "start").alias("mix"))


def mixed_rows(df: DataFrame, **options) -> DataFrame:
    """The mixture itself, with the columns of ``df``: files follow the slots, and rows within a file too."""
    rows = mix(df, **options)
    order = [F.col("mix.slot"), F.col("mix.start")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("mix")
