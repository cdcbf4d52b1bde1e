"""Mixing sources to target weights by hash thresholds.

A document is in the mix if its hash lies below its source's threshold.  The threshold
is found from sums of sizes by source and hash bucket: the bucket in which the budget
runs out is the only one looked into further, until it holds a single hash.  No row is
sorted, and a smaller budget always takes a part of what a larger one takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.llm.frames import _quoted, hidden, small_enough
from seamline.plans.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_BITS = 12
HASH_BITS = 60


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``id, source, size, hash`` of every row, stored; size is the number of words."""
    text = F.col(_quoted(text_col)).cast("string")
    source = F.col(_quoted(source_col)).cast("string")
    rows = df.select(
        F.col(_quoted(id_col)).alias("id"),
        source.alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        row_hash(F.col(_quoted(id_col)), text).alias("hash"),
    )
    return stage(rows, "mix-sizes")


def row_hash(id_: Column, text: Column) -> Column:
    """The first 60 bits of an MD5 of id and text, the same in every run and engine."""
    both = F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, HASH_BITS // 4), 16, 10).cast("long")


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source))


def _ranked(sources: DataFrame) -> DataFrame:
    """Places of the sources by code point, null last, without sorting in one task."""
    order = [F.col("source").isNull(), F.col("source")]
    spread = stage(
        sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-sources"
    )
    counts = sorted(spread.groupBy("part").count().collect())  # a row for each partition
    before, total = [], 0
    for part, n in counts:
        before += [F.lit(part), F.lit(total)]
        total += n
    if not counts:
        return spread.withColumn("place", F.lit(0).cast("long")).drop("part")
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return spread.withColumn("place", within + F.create_map(*before)[F.col("part")]).drop("part")


def targets(
    rows: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``key, source, source_size, target`` of every source.

    Weights go to the sources by code point, null last, and repeat.  All targets
    together are ``share`` of all sizes; a target stops at ``most`` times its source and
    the excess goes to the others by weight.  Each round is one sum over the sources.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.pmod(F.col("place"), F.lit(len(weights))) + 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), place.cast("int"))
    sources = stage(_ranked(sizes).withColumn("weight", weight), "mix-weights")
    cap = F.col("source_size") * F.lit(float(most))
    level = 0.0
    while True:
        over = F.col("weight") * F.lit(level) > cap
        total, capped, open_ = sources.agg(
            F.sum("source_size"), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if not open_:
            break
        new = max(((total or 0) * share - (capped or 0.0)) / open_, 0.0)
        if new <= level:
            break
        level = new
    target = F.least(F.col("weight") * F.lit(level), cap)
    return sources.select(_key(F.col("source")).alias("key"), "source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each source its whole passes and the hash up to which one more is taken.

    ``budgets``: ``key, source_size, target``.  Adds ``passes`` and ``below``: rows with
    a hash under ``below`` count once more.  The hash at the border is taken if the sum
    then comes closer to the target.  Rows with the same hash are taken together.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = budgets.withColumn("passes", passes.cast("long")).withColumns({
        "rest": F.col("target") - F.col("passes") * F.col("source_size"),
        "prefix": F.lit(0).cast("long"),
        "under": F.lit(0).cast("long"),
        "border": F.lit(0).cast("long"),
        "open": F.lit(True),
    })
    keyed = rows.select(_key(F.col("source")).alias("key"), "size", "hash")
    for done in range(0, HASH_BITS, BUCKET_BITS):
        state = stage(state, "mix-thresholds")
        if state.filter("open").isEmpty():
            break
        left = HASH_BITS - done - BUCKET_BITS
        open_ = state.filter("open").select("key", "prefix", "rest", "under")
        inside = keyed.join(open_, "key").filter(
            F.shiftrightunsigned("hash", HASH_BITS - done) == F.col("prefix")
        )
        histogram = inside.groupBy("key", "rest", "under", F.shiftrightunsigned("hash", left).alias("bucket")).agg(
            F.sum("size").alias("words"),
            F.min("hash").alias("low"),
            F.max("hash").alias("high"),
        )
        running = F.sum("words").over(Window.partitionBy("key").orderBy("bucket"))
        # The budget runs out in the first bucket whose running sum reaches it.
        found = (
            histogram.withColumn("through", F.col("under") + running)
            .filter(F.col("through") >= F.col("rest"))
            .groupBy("key")
            .agg(F.min_by(F.struct("bucket", "through", "words", "low", "high"), "bucket").alias("f"))
        )
        closed = F.col("f.low") == F.col("f.high")
        before = F.col("f.through") - F.col("f.words")
        nearer = (F.col("f.through") - F.col("rest")) <= (F.col("rest") - before)
        hit = F.col("open") & F.col("f").isNotNull()
        state = state.join(found, "key", "left").select(
            "key", "source_size", "target", "passes", "rest",
            F.when(hit, F.col("f.bucket")).otherwise(F.col("prefix")).alias("prefix"),
            F.when(hit, before).otherwise(F.col("under")).alias("under"),
            F.when(
                F.col("open"),
                F.when(hit, F.when(closed & nearer, F.col("f.high") + 1).otherwise(F.col("f.low")))
                .otherwise(F.lit(1 << HASH_BITS)),
            ).otherwise(F.col("border")).alias("border"),
            (hit & ~closed).alias("open"),
        )
    state = stage(state, "mix-thresholds")
    return state.select(
        "key", "source_size", "target", "passes",
        F.when(F.col("rest") > 0, F.col("border")).otherwise(F.lit(0)).alias("below"),
    )


def _with_thresholds(rows: DataFrame, borders: DataFrame, source: Column) -> DataFrame:
    hint = F.broadcast if small_enough(borders, 256) else (lambda t: t)
    return rows.withColumn("key", _key(source)).join(hint(borders), "key")


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """One row per row: its id, ``size``, ``source_size``, ``target`` and ``taken``.

    ``taken`` is the size times the passes the mix makes over the row, 0 to ``most``
    rounded up.  A null text has size 0; null is a source of its own, as is the empty
    string.  Null ids and repeated rows are hashed like others; rows equal in id and
    text are taken together.  Other columns are not read.  An empty table, or one
    without words, gives rows with target and taken 0.  The same input gives the same
    result, in whatever order its rows are read.
    """
    rows = sized(df, id_col, text_col, source_col)
    borders = thresholds(rows, targets(rows, weights, share, most))
    once_more = (F.col("hash") < F.col("below")).cast("long")
    return _with_thresholds(rows, borders, F.col("source")).select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("passes") + once_more)).alias("taken"),
    )


def take(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """The mix itself: each row of ``df``, all columns whatever their names, as often as ``mix`` takes it.

    Texts are not shuffled while the sources' thresholds are few enough to broadcast.
    """
    columns = df.columns
    df, id_col, text_col, source_col = hidden(df, id_col, text_col, source_col)
    rows = sized(df, id_col, text_col, source_col)
    borders = thresholds(rows, targets(rows, weights, share, most))
    borders = borders.select(F.col("key").alias("__mix_key"), "passes", "below")
    borders = borders.select("__mix_key", F.struct("passes", "below").alias("__mix"))
    hint = F.broadcast if small_enough(borders, 256) else (lambda t: t)
    hashed = row_hash(F.col(_quoted(id_col)), F.col(_quoted(text_col)).cast("string"))
    times = F.col("__mix.passes") + (hashed < F.col("__mix.below")).cast("long")
    joined = df.withColumn("__mix_key", _key(F.col(_quoted(source_col)).cast("string"))).join(hint(borders), "__mix_key")
    copies = F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)).otherwise(
        F.array().cast("array<bigint>")
    )
    return joined.withColumn("__mix_copy", F.explode(copies)).select(*df.columns).toDF(*columns)
