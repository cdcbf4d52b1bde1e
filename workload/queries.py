"""The registered queries, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline import schema
from seamline.functions import paths
from seamline.functions.paths import ord_key
from seamline.operators import (
    clients, drift, frontend, impact, publishers, resolve, routes, schemas, settings, subscribers,
    validate,
)
from seamline.operators.syntax import py_nodes
from seamline.plans import extract
from seamline.plans.staging import shared_dir, small, stage
from seamline.sources import contracts, files
from workload import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# ---------------------------------------------------------------- impact


def _endpoint_facts(spark, sf_dir):
    return inputs.facts(spark, sf_dir, schema.HTTP_PROVIDERS, schema.HTTP_CONSUMERS)


def _all_facts(spark, sf_dir):
    return inputs.with_headers(inputs.facts(spark, sf_dir))


def _topic_facts(spark, sf_dir):
    return inputs.facts(spark, sf_dir, schema.TOPICS_PUBLISHED, schema.TOPICS_SUBSCRIBED)


@query
def endpoint_impact(spark, sf_dir):
    asked = inputs.endpoint_questions(spark, sf_dir)
    return impact.endpoint_impact(_endpoint_facts(spark, sf_dir), asked).drop("ord")


@query
def endpoint_questions(spark, sf_dir):
    return impact.endpoint_questions(inputs.endpoint_questions(spark, sf_dir))


@query
def endpoint_consumer_counts(spark, sf_dir):
    asked = inputs.endpoint_questions(spark, sf_dir)
    return impact.endpoint_counts(_endpoint_facts(spark, sf_dir), asked)


@query
def endpoint_unindexed(spark, sf_dir):
    return impact.endpoint_counts(
        _all_facts(spark, sf_dir),
        inputs.endpoint_questions(spark, sf_dir),
        inputs.known_services(spark, sf_dir),
    ).select("question", "unindexed")


@query
def unindexed_services(spark, sf_dir):
    return impact.unindexed_services(_all_facts(spark, sf_dir), inputs.known_services(spark, sf_dir))


@query
def discover_services(spark, sf_dir):
    return impact.discover_services(inputs.facts(spark, sf_dir))


@query
def topic_impact(spark, sf_dir):
    asked = inputs.topic_questions(spark, sf_dir)
    return impact.topic_impact(_topic_facts(spark, sf_dir), asked).drop("ord")


@query
def topic_counts(spark, sf_dir):
    asked = inputs.topic_questions(spark, sf_dir)
    return impact.topic_counts(_topic_facts(spark, sf_dir), asked)


@query
def orphans_published_only(spark, sf_dir):
    return impact.orphan_topics(_topic_facts(spark, sf_dir), "publisher")


@query
def orphans_subscribed_only(spark, sf_dir):
    return impact.orphan_topics(_topic_facts(spark, sf_dir), "subscriber")


@query
def subscriptions_no_handler(spark, sf_dir):
    return impact.subscriptions_without_handler(_topic_facts(spark, sf_dir)).drop("ord")


@query
def service_status(spark, sf_dir):
    return impact.status(inputs.with_headers(inputs.facts(spark, sf_dir)))


# ---------------------------------------------------------------- paths and routes


def _consumer_paths(spark, sf_dir):
    return inputs.consumers(spark, sf_dir).select("l_orderkey", "line", "path")


@query
def path_norm_match(spark, sf_dir):
    return _consumer_paths(spark, sf_dir).withColumn("normal", paths.match_path(F.col("path")))


@query
def path_norm_router(spark, sf_dir):
    return _consumer_paths(spark, sf_dir).withColumn("normal", paths.router_path(F.col("path")))


@query
def path_norm_frontend(spark, sf_dir):
    return _consumer_paths(spark, sf_dir).withColumn("normal", paths.frontend_path(F.col("path")))


@query
def path_norm_route(spark, sf_dir):
    after_scheme = F.regexp_replace("url", "^https?:", "")
    return inputs.table(spark, sf_dir, "pages").select(
        "page_id", paths.route_path(after_scheme).alias("normal")
    )


@query
def file_to_module(spark, sf_dir):
    path = F.expr(
        "concat('app/', lower(p_type), '/', replace(p_name, ' ', '_'), "
        "CASE p_size % 3 WHEN 0 THEN '.py' WHEN 1 THEN '/__init__.py' ELSE '/x.pyi' END)"
    )
    return inputs.table(spark, sf_dir, "part").select("p_partkey", paths.file_module(path).alias("module"))


@query
def resolve_routes(spark, sf_dir):
    calls = inputs.page_calls(spark, sf_dir).unionByName(
        inputs.consumers(spark, sf_dir).select("method", "path")
    )
    served = inputs.providers(spark, sf_dir).select(
        "method", "path", "service",
        F.struct(F.lit(4).alias("rank"), F.col("p_partkey").alias("page_id")).alias("ord"),
    )
    return resolve.resolve_routes(calls, inputs.page_routes(spark, sf_dir).unionByName(served))


# ---------------------------------------------------------------- front end


def _searched(spark, sf_dir, kinds):
    return frontend.frontend_matches(files.frontend_files(inputs.front_files(spark, sf_dir)), kinds)


def _matches(spark, sf_dir, kinds):
    """Searched once for what reads the matches several times."""
    return stage(_searched(spark, sf_dir, kinds), "frontend-matches", "kind")


def _front_env(spark):
    return extract.env_side(inputs.env_dim(spark), "frontend")


@query
def scan_frontend_files(spark, sf_dir):
    return files.frontend_files(inputs.front_files(spark, sf_dir)).select("service", "path")


@query
def fe_wrapper_calls(spark, sf_dir):
    return frontend.wrapper_calls(_searched(spark, sf_dir, ("wrapper",)), small(inputs.wrapper_dim(spark))).drop("ord")


@query
def fe_request_calls(spark, sf_dir):
    return frontend.request_calls(_searched(spark, sf_dir, ("request",)), small(inputs.wrapper_dim(spark))).drop("ord")


@query
def fe_env_bindings(spark, sf_dir):
    return frontend.env_bindings(_matches(spark, sf_dir, frontend.BINDING_KINDS), _front_env(spark))


@query
def fe_apifetch_target(spark, sf_dir):
    matches = _matches(spark, sf_dir, frontend.TARGET_KINDS)
    return frontend.fetch_targets(matches, frontend.env_bindings(matches, _front_env(spark)))


@query
def fe_apifetch_calls(spark, sf_dir):
    matches = _matches(spark, sf_dir, frontend.API_FETCH_KINDS)
    targets = frontend.fetch_targets(matches, frontend.env_bindings(matches, _front_env(spark)))
    calls = frontend.api_fetch_calls(matches, targets)
    return frontend.with_routed_targets(calls, inputs.front_routes(spark, sf_dir)).drop("ord")


@query
def fe_template_fetch(spark, sf_dir):
    matches, env = _matches(spark, sf_dir, frontend.TEMPLATE_FETCH_KINDS), _front_env(spark)
    calls = frontend.template_fetch_calls(matches, frontend.env_bindings(matches, env), env)
    return frontend.with_routed_targets(calls, inputs.front_routes(spark, sf_dir)).drop("ord")


@query
def fe_consumers_dedup(spark, sf_dir):
    found = extract.extract_frontend(
        inputs.front_files(spark, sf_dir), inputs.env_dim(spark), inputs.wrapper_dim(spark),
        inputs.front_routes(spark, sf_dir),
    )
    return impact.section(found, schema.HTTP_CONSUMERS).drop("ord", "norm_path")


# ---------------------------------------------------------------- back end


def _parsed(spark, sf_dir, scanned=None, kinds=None, columns=None):
    return py_nodes(files.python_files(inputs.python_files(spark, sf_dir)), scanned, kinds, columns)


def _nodes(spark, sf_dir, scanned, kinds):
    """Parsed once for what reads them several times."""
    return stage(_parsed(spark, sf_dir, scanned, kinds), "py-nodes", "kind")


@query
def scan_python_files(spark, sf_dir):
    found = files.python_files(inputs.python_files(spark, sf_dir)).withColumn(
        "has_client", F.contains("content", F.lit("httpx"))
    )
    in_routes = files.route_files(found).select("service", "path", F.lit("routes").alias("scan"))
    in_clients = files.client_files(found).select("service", "path", F.lit("clients").alias("scan"))
    return in_routes.unionByName(in_clients)


@query
def read_source_tree(spark, sf_dir):
    root = files.file_location(spark, f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}")
    inputs.source_tree(spark, sf_dir, root)
    return files.read_source_files(spark, root, (".py",), ("node_modules",))


@query
def app_root(spark, sf_dir):
    return files.app_roots(inputs.nested_python_files(spark, sf_dir))


@query
def app_root_files(spark, sf_dir):
    return files.at_app_root(inputs.nested_python_files(spark, sf_dir)).select(
        "service", "path"
    )


@query
def py_node_counts(spark, sf_dir):
    return _parsed(spark, sf_dir, columns=("service", "kind")).groupBy("service", "kind").agg(F.count("*").alias("n"))


@query
def py_settings_class(spark, sf_dir):
    return settings.publisher_settings(_parsed(spark, sf_dir, settings.in_settings_file(), settings.KINDS))


@query
def py_settings_any(spark, sf_dir):
    existing = inputs.python_files(spark, sf_dir).select("service", "path")
    return settings.route_settings(_nodes(spark, sf_dir, settings.in_settings_files(), settings.KINDS), existing)


@query
def py_event_schemas(spark, sf_dir):
    return schemas.event_schemas(_parsed(spark, sf_dir, schemas.in_schema_file(), schemas.KINDS)).drop("ord")


def _route_scan(spark, sf_dir, kinds=routes.KINDS):
    scanned = files.in_routes() | settings.in_settings_files()
    return _nodes(spark, sf_dir, scanned, {*kinds, *settings.KINDS})


def _route_inputs(spark, sf_dir, *kinds):
    nodes = _route_scan(spark, sf_dir, kinds)
    existing = inputs.python_files(spark, sf_dir).select("service", "path")
    return routes.route_nodes(nodes), settings.route_settings(nodes, existing)


@query
def py_routers(spark, sf_dir):
    return routes.routers(*_route_inputs(spark, sf_dir, "module", "assign"))


@query
def py_imports(spark, sf_dir):
    nodes, _ = _route_inputs(spark, sf_dir, "module", "import")
    return routes.imports(nodes).drop("file", "place")


@query
def py_includes(spark, sf_dir):
    return routes.includes(*_route_inputs(spark, sf_dir, "module", "call")).drop("node_id")


@query
def py_decorators(spark, sf_dir):
    nodes, _ = _route_inputs(spark, sf_dir, "module", "call")
    return routes.decorators(nodes).drop("file", "node_id")


def _providers(spark, sf_dir):
    nodes = _route_scan(spark, sf_dir)
    existing = inputs.python_files(spark, sf_dir).select("service", "path")
    return routes.http_providers(nodes, settings.route_settings(nodes, existing))


@query
def route_full_paths(spark, sf_dir):
    return _providers(spark, sf_dir).drop("ord", "norm_path")


@query
def subscribers_from_routes(spark, sf_dir):
    return subscribers.topics_subscribed(_providers(spark, sf_dir)).drop("ord")


def _topics(nodes):
    return publishers.resolve_topics(
        publishers.publish_sites(nodes), settings.publisher_settings(nodes)
    )


def _publisher_scan(spark, sf_dir):
    scanned = publishers.in_publishers() | settings.in_settings_file() | schemas.in_schema_file()
    return _nodes(spark, sf_dir, scanned, {*publishers.KINDS, *settings.KINDS, *schemas.KINDS})


@query
def publish_sites(spark, sf_dir):
    sites = publishers.publish_sites(_parsed(spark, sf_dir, publishers.in_publishers(), publishers.KINDS))
    return sites.select("service", "path", "function", "line", F.col("topic.kind").alias("topic_kind"))


@query
def publish_warnings(spark, sf_dir):
    topics = _topics(_publisher_scan(spark, sf_dir))
    return publishers.topic_warnings(topics).drop("ord")


@query
def publish_schema(spark, sf_dir):
    nodes = _publisher_scan(spark, sf_dir)
    made = publishers.function_schemas(nodes, schemas.event_schemas(nodes))
    return publishers.topics_published(_topics(nodes), made).drop("ord")


def _client_inputs(spark, sf_dir, scanned=None):
    nodes = _nodes(spark, sf_dir, files.in_clients() if scanned is None else scanned, clients.KINDS)
    return nodes, clients.client_nodes(nodes), extract.env_side(inputs.env_dim(spark), "backend")


@query
def client_targets(spark, sf_dir):
    _, own, env = _client_inputs(spark, sf_dir)
    return clients.class_targets(own, env).select("service", "path", "target")


@query
def client_local_strings(spark, sf_dir):
    _, own, _ = _client_inputs(spark, sf_dir)
    return clients.local_strings(own).select(
        "service", "variable",
        F.coalesce("bound.text", F.array_join("bound.parts", "")).alias("text"),
    )


@query
def client_calls(spark, sf_dir):
    _, own, env = _client_inputs(spark, sf_dir)
    targets, strings = clients.class_targets(own, env), clients.local_strings(own)
    return clients.direct_calls(own, targets, strings, env).drop("ord", "norm_path")


@query
def client_wrapper_calls(spark, sf_dir):
    _, own, env = _client_inputs(spark, sf_dir)
    targets, wrappers = clients.class_targets(own, env), clients.same_class_wrappers(own)
    return clients.wrapper_calls(own, targets, wrappers, env).drop("ord", "norm_path")


@query
def client_singleton_calls(spark, sf_dir):
    nodes, own, env = _client_inputs(spark, sf_dir, F.lit(True))  # the calls are in any file
    known = clients.singletons(own, clients.class_targets(own, env))
    calls = clients.singleton_calls(nodes, known, clients.proxy_methods(own), env)
    return clients.split_methods(calls)[0].drop("ord", "norm_path")


@query
def extract_summary(spark, sf_dir):
    return extract.extraction_summary(
        extract.extract_backend(inputs.python_files(spark, sf_dir), inputs.env_dim(spark))
    )


def _services(spark, sf_dir):
    fronts = inputs.front_files(spark, sf_dir).select("service").distinct()
    return fronts.withColumn("kind", F.lit("frontend"))


@query
def extract_all(spark, sf_dir):
    source = inputs.python_files(spark, sf_dir).unionByName(inputs.front_files(spark, sf_dir))
    services, env, wrappers = _services(spark, sf_dir), inputs.env_dim(spark), inputs.wrapper_dim(spark)
    return extract.extract(source, services, env, wrappers).drop("ord", "norm_path")


@query
def extract_by_kind(spark, sf_dir):
    source = inputs.python_files(spark, sf_dir).unionByName(inputs.front_files(spark, sf_dir))
    kinds = [
        files.of_kind(source, _services(spark, sf_dir), kind).select("service", "path", F.lit(kind).alias("kind"))
        for kind in ("backend", "frontend")
    ]
    return kinds[0].unionByName(kinds[1])


@query
def fe_against_stored(spark, sf_dir):
    served = inputs.front_routes(spark, sf_dir).withColumn(
        "ord", ord_key(0, F.array().cast("array<string>"), F.col("ord.rank"), F.col("ord.place"))
    )
    root = f"{shared_dir(spark)}/contracts-{uuid.uuid4().hex}"
    stored = contracts.tagged(served, schema.HTTP_PROVIDERS)
    contracts.save_contracts(stored.unionByName(contracts.header(stored)), root)
    found = extract.extract(
        inputs.front_files(spark, sf_dir), _services(spark, sf_dir), inputs.env_dim(spark),
        inputs.wrapper_dim(spark), contracts.load_contracts(spark, root),
    )
    return impact.section(found, schema.HTTP_CONSUMERS).drop("ord", "norm_path")


# ---------------------------------------------------------------- contracts


@query
def contract_documents(spark, sf_dir):
    return contracts.document_items(inputs.with_headers(inputs.facts(spark, sf_dir))).drop("ord")


@query
def show_contract(spark, sf_dir):
    return contracts.show_contract(inputs.with_headers(inputs.facts(spark, sf_dir)), "svc-3")


def _plain(rows):
    return rows.filter(F.col("section") != schema.SERVICE).drop("ord", "norm_path")


@query
def save_load_roundtrip(spark, sf_dir):
    root = f"{shared_dir(spark)}/contracts-{spark.sql('SELECT uuid()').first()[0]}"
    whole = inputs.with_headers(inputs.facts(spark, sf_dir))
    contracts.save_contracts(whole, root)
    # Saving a service again replaces it: providers only, from here on.
    again = inputs.facts(spark, sf_dir, schema.HTTP_PROVIDERS).filter("service = 'svc-2'")
    contracts.save_contracts(inputs.with_headers(again), root)
    return _plain(contracts.load_contracts(spark, root))


@query
def fact_positions(spark, sf_dir):
    placed = contracts.with_positions(inputs.facts(spark, sf_dir))
    return placed.select(
        "service", "section", F.coalesce("topic", "path", "class_name", "file").alias("about"), "line", "position", "item"
    )


@query
def documents_written_and_read(spark, sf_dir):
    root = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    thousand = F.expr("ord.seq[0] div 1000").cast("string")  # documents stay small as the tables grow
    rows = inputs.facts(spark, sf_dir).withColumn("service", F.concat_ws("-", "service", thousand))
    contracts.write_documents(inputs.with_headers(rows), root)
    return _plain(contracts.load_documents(spark, root))


@query
def orphan_check(spark, sf_dir):
    return impact.orphan_check(_topic_facts(spark, sf_dir))


@query
def load_one_contract(spark, sf_dir):
    root = f"{shared_dir(spark)}/contracts-{uuid.uuid4().hex}"
    contracts.save_contracts(inputs.with_headers(inputs.facts(spark, sf_dir)), root)
    return _plain(contracts.load_one(spark, root, "svc-3"))


@query
def load_last_wins(spark, sf_dir):
    rows = inputs.with_headers(inputs.facts(spark, sf_dir, schema.TOPICS_PUBLISHED))
    first = rows.withColumn("repo", F.concat(F.lit("a-"), "service"))
    second = rows.withColumn("repo", F.concat(F.lit("b-"), "service")).withColumn(
        "line", F.col("line") + 1000
    )
    both = first.unionByName(second.filter("service != 'svc-1'"))
    return _plain(contracts.last_repository(both)).select("service", "topic", "publisher", "line")


@query
def documents_to_facts(spark, sf_dir):
    return contracts.documents_to_facts(inputs.raw_documents(spark, sf_dir)).select(
        "repo", "service", "section", "ord.seq", "method", "path", "target", "topic", "schema", "line"
    ).withColumn("seq", F.get("seq", F.lit(0)))


@query
def validate_contracts(spark, sf_dir):
    return validate.contract_validity(inputs.raw_documents(spark, sf_dir))


@query
def contract_violations(spark, sf_dir):
    return validate.contract_violations(inputs.raw_documents(spark, sf_dir))


@query
def contract_drift(spark, sf_dir):
    old = inputs.providers(spark, sf_dir)
    kind = F.col("p_partkey") % 10
    new = old.filter(kind != 0).withColumn("line", F.when(kind == 1, F.col("line") + 1).otherwise(F.col("line")))
    extra = old.filter(kind == 2).withColumn("handler", F.concat("handler", F.lit("_new")))
    twice = old.filter(kind == 3)
    return drift.contract_drift(
        contracts.tagged(old, schema.HTTP_PROVIDERS),
        contracts.tagged(new.unionByName(extra).unionByName(twice), schema.HTTP_PROVIDERS),
    )
