"""What changed between the stored contracts and a fresh extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline import schema

# What identifies a fact; everything else about it can change.
_DETAIL = ["line", "schema", "message"]


def _keyed(facts: DataFrame, sign: int) -> DataFrame:
    """``(service, section, fact, detail, n)`` with a signed count."""
    columns = sorted({c for section in schema.SECTIONS.values() for c in section})
    fact = F.to_json(F.struct(*[c for c in columns if c not in _DETAIL]))
    detail = F.to_json(F.struct(*[c for c in columns if c in _DETAIL]))
    return (
        facts.select("service", "section", fact.alias("fact"), detail.alias("detail"))
        .groupBy("service", "section", "fact", "detail")
        .agg((F.count("*") * sign).alias("n"))
    )


def contract_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(service, section, fact, change, removed, added)``; empty if nothing drifted.

    Facts are counted, so repeated ones are compared as often as they occur.
    Counting happens before the shuffle and no two rows are ever paired.
    """
    difference = (
        _keyed(old, -1)
        .unionByName(_keyed(new, 1))
        .groupBy("service", "section", "fact", "detail")
        .agg(F.sum("n").alias("n"))
        .filter("n != 0")
    )
    counted = difference.groupBy("service", "section", "fact").agg(
        F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("removed"),
        F.sum(F.greatest(F.col("n"), F.lit(0))).alias("added"),
    )
    change = (
        F.when(F.col("removed") == 0, "added").when(F.col("added") == 0, "removed").otherwise("changed")
    )
    return counted.select("service", "section", "fact", change.alias("change"), "removed", "added")
