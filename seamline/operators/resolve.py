"""Which service serves a call path: longest-prefix wildcard match."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.fixed import PARAM
from seamline.functions.paths import route_segments
from seamline.plans.staging import stage

_SAME_METHOD = 1000  # fixed value: what an equal method adds to the matched length
_WILD, _LITERAL = "w", "l"
_BUCKETS = 1 << 20  # bounds the set of route keys that all tasks get
_MASKS = 4096  # masks tried in one pass over the calls


def _mask(segments: Column) -> Column:
    letters = F.transform(segments, lambda s: F.when(s == PARAM, F.lit(_WILD)).otherwise(F.lit(_LITERAL)))
    return F.array_join(letters, "")


def _key(mask: Column, segments: Column) -> Column:
    return F.concat(mask, F.lit("/"), F.array_join(segments, "/"))


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(_BUCKETS))


def route_table(routes: DataFrame) -> DataFrame:
    """One row per distinct route: ``(mask, key, by_method, first)``.

    ``routes(method, path, service, ord)``.  The mask has one letter per segment,
    ``w`` for a wildcard and ``l`` for a literal; the key is the mask and the segments.
    Only the first route of a key and method can win, so a key needs one entry per
    method and no more.
    """
    segments = F.col("segments")
    keyed = (
        routes.withColumn("segments", route_segments(F.col("path")))
        .filter("segments IS NOT NULL")
        .withColumn("mask", _mask(segments))
        .select("mask", _key(F.col("mask"), segments).alias("key"), "method", F.struct("ord", "service").alias("route"))
    )
    per_method = keyed.groupBy("mask", "key", "method").agg(F.min("route").alias("route"))
    return per_method.groupBy("mask", "key").agg(
        F.map_from_entries(F.collect_list(F.struct("method", "route"))).alias("by_method"),
        F.min("route").alias("first"),
    )


def _mask_blocks(table: DataFrame) -> Iterator[list[str]]:
    """The masks of all routes, shortest first, as many at a time as one pass tries."""
    masks = table.select("mask").distinct().orderBy(F.length("mask"), "mask").toLocalIterator()
    while block := [row["mask"] for row in islice(masks, _MASKS)]:
        yield block


def _masked_keys(segments: Column, masks: list[str]) -> Column:
    """The keys that routes of these masks must have to serve a call."""
    every = F.split(F.lit(",".join(masks)), ",")
    fitting = F.filter(every, lambda mask: F.length(mask) <= F.size(segments))

    def key(mask: Column) -> Column:
        first = F.slice(segments, F.lit(1), F.length(mask))
        wild = lambda i: F.substr(mask, i + 1, F.lit(1)) == F.lit(_WILD)
        return _key(mask, F.transform(first, lambda s, i: F.when(wild(i), F.lit(PARAM)).otherwise(s)))

    return F.transform(fitting, key)


def resolve_routes(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Add ``target`` to distinct ``calls(method, path)``; calls nobody serves are left out.

    A route serves a call if its segments are a prefix of the call's, where a
    wildcard of the route stands for any one segment.  The longest wins, one with
    the call's method before all others, and the first among equals.

    Masking a call's first segments the way a route is masked makes this an equality
    join on one key.  All masks of a call are tried where the call is read, and of the
    keys made only those go on whose bucket holds a route; the set of buckets has a fixed
    size, whatever the number of routes.  Of a call no more is shuffled than the
    routes that serve it, and a few keys that share a bucket with others.
    """
    table = stage(route_table(routes), "route-table")
    buckets = table.select(_bucket(F.col("key")).alias("bucket")).distinct()
    wanted = (
        calls.select("method", "path")
        .distinct()
        .withColumn("segments", route_segments(F.col("path")))
        .filter("segments IS NOT NULL")
    )
    passes = [
        wanted.select("method", "path", F.explode(_masked_keys(F.col("segments"), masks)).alias("key"))
        for masks in _mask_blocks(table)
    ]
    keyed = reduce(DataFrame.unionAll, passes) if passes else wanted.select("method", "path", F.lit("").alias("key")).limit(0)
    likely = keyed.withColumn("bucket", _bucket(F.col("key"))).join(F.broadcast(buckets), "bucket", "left_semi")
    candidates = likely.drop("bucket").join(table, "key")
    own = F.try_element_at("by_method", F.upper("method"))
    best = F.coalesce(own, F.col("first"))
    score = F.length("mask") + F.when(own.isNotNull(), _SAME_METHOD).otherwise(0)
    return candidates.groupBy("method", "path").agg(
        F.min_by(best["service"], F.struct(-score, best["ord"])).alias("target")
    )
