"""HTTP calls made by front-end sources, found by pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from seamline import fixed
from seamline.functions.paths import (
    file_order,
    frontend_path,
    match_path,
    method_or_default,
    ord_key,
)
from seamline.operators.resolve import resolve_routes
from seamline.operators.search import search_rows
from seamline.plans.staging import small, stage
from seamline.schema import struct_type

_FILE = ["service", "path"]

# Order in which the call patterns of a file enter the document.
_CALL_ORDER = {"wrapper": 0, "request": 1, "api_fetch": 2, "template_fetch": 3}

# What the names in a file are bound by, and what the operators read with them.
BINDING_KINDS = ("env_constant", "env_access", "runtime_config")
TARGET_KINDS = ("definition", *BINDING_KINDS)
API_FETCH_KINDS = ("api_fetch", *TARGET_KINDS)
TEMPLATE_FETCH_KINDS = ("template_fetch", *BINDING_KINDS)
ALL_KINDS = ("definition", "wrapper", "request", "api_fetch", "template_fetch", "env_constant", "env_access", "runtime_config")
_MATCHES = "service string, path string, kind string, pos int, line int, name string, method string, route string"


def frontend_matches(files: DataFrame, kinds: tuple[str, ...] = ALL_KINDS) -> DataFrame:
    """``(service, path, kind, pos, line, name, method, route)``: every match in every file.

    One pass over the texts, which go no further than this; all that follows
    works on these short rows.  A file's own ``apiFetch`` wrapper is the match
    ``definition``, with its base and the prefix of its fallback URL.  Only matches of
    ``kinds`` are looked for.
    """
    schema = struct_type(_MATCHES)
    arrow_schema = to_arrow_schema(schema)

    def searched(batches):
        return search_rows(batches, kinds, arrow_schema)

    return files.filter(F.col("content").isNotNull()).select("service", "path", "content").mapInArrow(searched, schema)


def _last_name(base: Column) -> Column:
    return F.substring_index(base, ".", -1)


def _ord() -> Column:
    place = F.create_map(*[F.lit(x) for pair in _CALL_ORDER.items() for x in pair])
    return ord_key(0, file_order(F.col("path")), place[F.col("kind")], F.col("pos"))


def _named_calls(matches: DataFrame, wrappers: DataFrame, kind: str, dim_kind: str, caller) -> DataFrame:
    known = wrappers.filter(F.col("kind") == dim_kind).select("name", "target", "prefix")
    return (
        matches.filter(F.col("kind") == kind)
        .join(known, "name")
        .select(
            "service",
            _ord().alias("ord"),
            "target",
            method_or_default(F.col("method")).alias("method"),
            frontend_path(F.concat("prefix", "route")).alias("path"),
            F.concat_ws("::", "path", caller).alias("caller"),
            "line",
        )
    )


def wrapper_calls(matches: DataFrame, wrappers: DataFrame) -> DataFrame:
    """``wrapper.verb(event, '/path')`` on a known wrapper object."""
    caller = F.concat_ws(".", "name", F.lower("method"))
    return _named_calls(matches, wrappers, "wrapper", "object", caller)


def request_calls(matches: DataFrame, wrappers: DataFrame) -> DataFrame:
    """``xRequest(event, '/path', {method})`` of a known function."""
    return _named_calls(matches, wrappers, "request", "function", F.col("name"))


def env_bindings(matches: DataFrame, env: DataFrame) -> DataFrame:
    """``(service, path, key, target)``: what names in a file stand for which service.

    A constant set from a known environment name comes first (the last such line
    counts), then known names used directly, then known runtime configuration keys.
    """
    name = F.col("name")
    # A known name is found inside a longer one too, so all beginnings of a name
    # are looked up; files share their names, so each is looked up once.
    accessed = matches.filter("kind = 'env_access'").select("name").distinct()
    beginnings = F.transform(F.sequence(F.lit(1), F.length(name)), lambda n: F.left(name, n))
    inside = (
        accessed.select(name.alias("found"), F.explode(beginnings).alias("env"))
        .join(env, "env")
        .select(F.lit("env_access").alias("kind"), "found", "env", "target")
    )
    exact = env.select(
        F.explode(F.array(F.lit("env_constant"), F.lit("runtime_config"))).alias("kind"),
        F.col("env").alias("found"), "env", "target",
    )
    is_constant, is_access = F.col("kind") == "env_constant", F.col("kind") == "env_access"
    spelled = F.array(
        F.col("env"), F.concat(F.lit("process.env."), "env"), F.concat(F.lit("import.meta.env."), "env")
    )
    keys = F.when(is_constant, F.array(name)).when(is_access, spelled).otherwise(F.array("env"))
    rank = F.when(is_constant, 0).when(is_access, 1).otherwise(2)
    at = F.when(is_constant, -F.col("pos")).otherwise(F.col("pos"))
    return (
        matches.filter(F.col("kind").isin("env_constant", "env_access", "runtime_config"))
        .withColumn("found", F.when(is_constant, F.col("route")).otherwise(name))
        .join(small(exact.unionByName(inside)), ["kind", "found"])
        .select(*_FILE, F.explode(keys).alias("key"), F.struct(rank, at).alias("place"), "target")
        .repartition(*_FILE)  # serves the grouping, the maps and the joins by file
        .groupBy(*_FILE, "key")
        .agg(F.min_by("target", "place").alias("target"))
    )


def _binding_maps(bindings: DataFrame) -> DataFrame:
    """One map per file; its size is that of the names in the file."""
    return bindings.groupBy(*_FILE).agg(
        F.map_from_entries(F.collect_list(F.struct("key", "target"))).alias("bound")
    )


def fetch_targets(matches: DataFrame, bindings: DataFrame) -> DataFrame:
    """``(service, path, base, target, prefix)`` of files that define ``apiFetch``."""
    base = F.col("name")
    return (
        matches.filter("kind = 'definition'")
        .join(_binding_maps(bindings), _FILE, "left")
        .select(
            *_FILE,
            base.alias("base"),
            F.coalesce(
                F.try_element_at("bound", _last_name(base)), F.try_element_at("bound", base)
            ).alias("target"),
            F.coalesce("route", F.lit("")).alias("prefix"),
        )
    )


def api_fetch_calls(matches: DataFrame, targets: DataFrame) -> DataFrame:
    """``apiFetch('/path', {method})``; ``target`` is null where the file has none."""
    return (
        matches.filter("kind = 'api_fetch'")
        .join(targets, _FILE, "left")
        .select(
            "service",
            _ord().alias("ord"),
            "target",
            method_or_default(F.col("method")).alias("method"),
            frontend_path(F.concat(F.coalesce("prefix", F.lit("")), "route")).alias("path"),
            F.concat_ws("::", "path", F.lit("apiFetch")).alias("caller"),
            "line",
        )
    )


def template_fetch_calls(matches: DataFrame, bindings: DataFrame, env: DataFrame) -> DataFrame:
    """``fetch(`${BASE}/path`)``; ``target`` is null where no name gives it away."""
    base = F.col("name")
    known = env.select(F.col("env").alias("last_name"), F.col("target").alias("env_target"))
    return (
        matches.filter("kind = 'template_fetch'")
        .withColumn("last_name", _last_name(base))
        .join(_binding_maps(bindings), _FILE, "left")
        .join(known, "last_name", "left")
        .select(
            "service",
            _ord().alias("ord"),
            F.coalesce(
                F.try_element_at("bound", base),
                F.try_element_at("bound", F.col("last_name")),
                F.col("env_target"),
            ).alias("target"),
            method_or_default(F.col("method")).alias("method"),
            frontend_path(F.col("route")).alias("path"),
            F.concat_ws("::", "path", F.lit("fetch")).alias("caller"),
            "line",
        )
    )


def with_routed_targets(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Look up the calls without a target in the served routes; drop those in neither."""
    calls = stage(calls, "fetch-calls")
    known = calls.filter("target IS NOT NULL")
    open_calls = calls.filter("target IS NULL").drop("target")
    resolved = resolve_routes(open_calls, routes)
    return known.unionByName(open_calls.join(resolved, ["method", "path"]))


def first_of_each(calls: DataFrame) -> DataFrame:
    """First call per (service, target, method, path, caller)."""
    return (
        calls.groupBy("service", "target", "method", "path", "caller")
        .agg(F.min(F.struct("ord", "line")).alias("first"))
        .select(
            "service",
            "first.ord",
            "target",
            "method",
            "path",
            match_path(F.col("path")).alias("norm_path"),
            "caller",
            "first.line",
        )
    )


def frontend_consumers(
    matches: DataFrame, wrappers: DataFrame, env: DataFrame, routes: DataFrame
) -> DataFrame:
    """All calls of the front-end sources, each once."""
    bindings = env_bindings(matches, env)
    fetches = api_fetch_calls(matches, fetch_targets(matches, bindings)).unionByName(
        template_fetch_calls(matches, bindings, env)
    )
    calls = (
        wrapper_calls(matches, wrappers)
        .unionByName(request_calls(matches, wrappers))
        .unionByName(with_routed_targets(fetches, routes))
    )
    return first_of_each(calls)
