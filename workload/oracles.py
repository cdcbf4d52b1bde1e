"""Expected results as DuckDB SQL, from the columns of the given tables."""

from __future__ import annotations

PROVIDERS = """providers AS (
  SELECT 'svc-' || p_partkey % 7 AS service,
    ['GET', 'POST', 'PUT', 'PATCH', 'DELETE'][p_size % 5 + 1] AS method,
    '/api/v1/' || lower(p_type) || '/' || replace(lower(p_brand), '#', '-') || '/{part_id}' AS path,
    'app/api/endpoints/' || lower(p_type) || '.py::handle_' || p_partkey AS handler,
    p_size AS line, p_partkey
  FROM part)"""
CONSUMERS = """consumers AS (
  SELECT 'front-' || l_suppkey % 5 AS service, 'svc-' || p_partkey % 7 AS target,
    ['GET', 'POST', 'PUT', 'PATCH', 'DELETE'][p_size % 5 + 1] AS method,
    '/api/v1/' || lower(p_type) || '/' || replace(lower(p_brand), '#', '-') || '/'
      || ['{id}', '${id}', '[id]'][l_linenumber % 3 + 1]
      || CASE WHEN l_linenumber % 4 = 0 THEN '/' ELSE '' END AS path,
    'src/o' || l_orderkey || '.ts::apiFetch' AS caller, l_linenumber AS line, l_orderkey
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
PUBLISHED = """published AS (
  SELECT 'svc-' || event_id % 7 AS service, event_type || '.' || user_id % 50 AS topic,
    CASE WHEN value >= 35 THEN 'Ev' || event_id % 9 END AS schema,
    'app/services/' || event_type || '.py::publish_' || event_id % 100 AS publisher,
    CAST(event_id % 500 AS INT) AS line, event_id
  FROM events)"""
SUBSCRIBED = """subscribed AS (
  SELECT 'svc-' || o_orderkey % 7 AS service,
    ['signup', 'purchase', 'error', 'click', 'refund'][o_orderkey % 5 + 1] || '.' || o_custkey % 60 AS topic,
    CASE WHEN o_orderstatus != 'P' THEN 'app/api/events.py::on_' || o_orderkey END AS handler,
    CASE WHEN o_orderstatus != 'P' THEN CAST(o_orderkey % 900 AS INT) END AS line, o_orderkey
  FROM orders)"""
EVENT_CLASSES = """event_classes AS (
  SELECT 'svc-' || c_custkey % 7 AS service, 'Event' || c_custkey AS class_name,
    'app/schemas/events.py' AS file, CAST(c_custkey AS INT) AS line FROM customer)"""
WARNINGS = """warnings AS (
  SELECT 'svc-' || s_suppkey % 9 AS service, 'dynamic_topic' AS kind,
    'app/services/s' || s_suppkey || '.py' AS file, CAST(s_suppkey AS INT) AS line,
    'topic is a dynamic expression (' || s_name || ')' AS message FROM supplier)"""
ALL_FACTS = ", ".join([PROVIDERS, CONSUMERS, PUBLISHED, SUBSCRIBED, EVENT_CLASSES, WARNINGS])
QUESTIONS = """questions AS (
  SELECT DISTINCT ' ' || lower(method) || '   ' || path AS question, method, path FROM providers
  UNION ALL SELECT 'GET /nothing/' || lower(r_name), 'GET', '/nothing/' || lower(r_name) FROM region)"""
KNOWN = """known AS (
  SELECT DISTINCT 'svc-' || n_nationkey % 10 AS service FROM nation
  UNION SELECT 'front-' || n_nationkey % 8 FROM nation)"""
SERVED = r"""served AS (
  SELECT method, regexp_replace(path, '\{[^}]*\}', '{param}', 'g') AS normal, 'provider' AS role,
    service, CAST(NULL AS VARCHAR) AS target, handler AS place, line FROM providers
  UNION ALL
  SELECT method, regexp_replace(path, '\{[^}]*\}', '{param}', 'g'), 'consumer',
    service, target, caller, line FROM consumers)"""
ASKED = r"""asked AS (
  SELECT question, method, regexp_replace(path, '\{[^}]*\}', '{param}', 'g') AS normal FROM questions)"""
ENDPOINTS = f"{PROVIDERS}, {CONSUMERS}, {QUESTIONS}, {SERVED}, {ASKED}"
INDEXED = """indexed AS (
  SELECT service FROM providers UNION SELECT service FROM consumers UNION SELECT service FROM published
  UNION SELECT service FROM subscribed UNION SELECT service FROM event_classes
  UNION SELECT service FROM warnings)"""
COUNTED = """counted AS (
  SELECT question, count(*) FILTER (role = 'provider') AS providers,
    count(*) FILTER (role = 'consumer') AS consumers
  FROM asked LEFT JOIN served USING (method, normal) GROUP BY question)"""
TOPICS = f"""{PUBLISHED}, {SUBSCRIBED}, sites AS (
  SELECT topic, 'publisher' AS role, service, publisher AS place, schema, line FROM published
  UNION ALL SELECT topic, 'subscriber', service, handler, NULL, line FROM subscribed),
asked AS (SELECT DISTINCT topic FROM sites UNION SELECT r_name FROM region)"""


def orphans(role: str) -> str:
    return f"""WITH {TOPICS}
SELECT topic, service, count(*) AS sites FROM sites
WHERE role = '{role}' AND topic NOT IN (SELECT topic FROM sites WHERE role != '{role}')
GROUP BY topic, service"""


ORACLES: dict[str, str] = {}
ORACLES["endpoint_impact"] = f"""WITH {ENDPOINTS}
SELECT question, role, service, target, place, line, place || ':' || line AS location
FROM served JOIN asked USING (method, normal)"""
ORACLES["endpoint_questions"] = f"""WITH {PROVIDERS}, {QUESTIONS}
SELECT question, method, path, regexp_replace(path, '\\{{[^}}]*\\}}', '{{param}}', 'g') AS norm_path,
  true AS valid FROM questions
UNION ALL SELECT '/' || replace(r_name, ' ', '-'), NULL, NULL, NULL, false FROM region"""
ORACLES["endpoint_consumer_counts"] = f"""WITH {ENDPOINTS}, {COUNTED}
SELECT question, providers, consumers FROM counted"""
ORACLES["endpoint_unindexed"] = f"""WITH {ALL_FACTS}, {QUESTIONS}, {SERVED}, {ASKED}, {COUNTED}, {INDEXED}, {KNOWN}
SELECT question, CASE WHEN consumers > 0 THEN 0 ELSE (
  SELECT count(*) FROM known WHERE service NOT IN (SELECT service FROM indexed)) END AS unindexed
FROM counted"""
ORACLES["unindexed_services"] = f"""WITH {ALL_FACTS}, {INDEXED}, {KNOWN}
SELECT service FROM known WHERE service NOT IN (SELECT service FROM indexed)"""
ORACLES["discover_services"] = f"""WITH {ALL_FACTS}, {INDEXED}
SELECT service FROM indexed"""
ORACLES["topic_impact"] = f"""WITH {TOPICS}
SELECT topic, role, service, place, schema, line,
  coalesce(place, 'None') || ':' || coalesce(CAST(line AS VARCHAR), 'None') AS location
FROM sites"""
ORACLES["topic_counts"] = f"""WITH {TOPICS}
SELECT topic, count(*) FILTER (role = 'publisher') AS publishers,
  count(*) FILTER (role = 'subscriber') AS subscribers
FROM asked LEFT JOIN sites USING (topic) GROUP BY topic"""
ORACLES["orphans_published_only"] = orphans("publisher")
ORACLES["orphans_subscribed_only"] = orphans("subscriber")
ORACLES["subscriptions_no_handler"] = f"""WITH {SUBSCRIBED}
SELECT service, topic, line FROM subscribed WHERE handler IS NULL"""
ORACLES["service_status"] = f"""WITH {ALL_FACTS}, tagged AS (
  SELECT service, 'p' AS s FROM providers UNION ALL SELECT service, 'c' FROM consumers
  UNION ALL SELECT service, 't' FROM published UNION ALL SELECT service, 'u' FROM subscribed
  UNION ALL SELECT service, 'e' FROM event_classes UNION ALL SELECT service, 'w' FROM warnings)
SELECT service, count(*) FILTER (s = 'p') AS providers, count(*) FILTER (s = 'c') AS consumers,
  count(*) FILTER (s = 't') AS publishes, count(*) FILTER (s = 'u') AS subscribes,
  count(*) FILTER (s = 'e') AS schemas, count(*) FILTER (s = 'w') AS warnings
FROM tagged GROUP BY service"""

# ---------------------------------------------------------------- paths and routes

ORACLES["path_norm_match"] = rf"""WITH {CONSUMERS}
SELECT l_orderkey, line, path, regexp_replace(path, '\{{[^}}]*\}}', '{{param}}', 'g') AS normal
FROM consumers"""
_ROUTER = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  path, '\{[^}]+\}', '{param}', 'g'), '\[[^\]]+\]', '{param}', 'g'),
  '\$\{[^}]+\}', '{param}', 'g'), '(.)/$', '\1')"""
ORACLES["path_norm_router"] = f"""WITH {CONSUMERS}
SELECT l_orderkey, line, path, {_ROUTER} AS normal FROM consumers"""
ORACLES["path_norm_frontend"] = rf"""WITH {CONSUMERS}
SELECT l_orderkey, line, path, regexp_replace(regexp_replace(regexp_replace(
  path, '\$\{{[^}}]+\}}', '{{param}}', 'g'), '\[[^\]]+\]', '{{param}}', 'g'), '(.)/$', '\1') AS normal
FROM consumers"""
ORACLES["path_norm_route"] = r"""SELECT page_id, regexp_replace(regexp_replace(
  '/' || regexp_replace(url, '^https?:', ''), '/+', '/', 'g'), '(.)/$', '\1') AS normal FROM pages"""
ORACLES["file_to_module"] = """SELECT p_partkey,
  'app.' || lower(p_type) || '.' || replace(p_name, ' ', '_')
  || CASE p_size % 3 WHEN 2 THEN '.x.pyi' ELSE '' END AS module FROM part"""
ORACLES["resolve_routes"] = rf"""WITH {PROVIDERS}, {CONSUMERS}, addresses AS (
  SELECT page_id, html, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS page,
    regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS section FROM pages),
routes AS (
  SELECT 0 AS rank, page_id, 'GET' AS method, '/' || section AS path, 'section-' || section AS service FROM addresses
  UNION ALL SELECT 1, page_id, 'POST', '/' || section || '/{{id}}', 'item-' || section FROM addresses
  UNION ALL SELECT 2, page_id, 'PUT', '/{{any}}/[id]/', 'fallback' FROM addresses
  UNION ALL SELECT 3, page_id, CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END, page, 'page-' || page_id % 5 FROM addresses
  UNION ALL SELECT 4, p_partkey, method, path, service FROM providers),
firsts AS (
  SELECT method, path, arg_min(service, rank::BIGINT * 1000000000 + page_id) AS service,
    min(rank::BIGINT * 1000000000 + page_id) AS ord FROM routes GROUP BY method, path),
served AS (
  SELECT method, service, ord, string_split(trim({_ROUTER}, '/'), '/') AS r FROM firsts),
calls AS (
  SELECT DISTINCT method, path FROM (
    SELECT ['GET', 'post', 'DELETE'][page_id % 3 + 1] AS method,
      unnest(list_concat([page], regexp_extract_all(html, 'href="(/[^"]*)"', 1))) AS path
    FROM addresses) UNION SELECT method, path FROM consumers),
asked AS (
  SELECT method, path, string_split(trim({_ROUTER}, '/'), '/') AS c FROM calls),
scored AS (
  SELECT a.method, a.path, s.service, s.ord,
    len(r) + CASE WHEN s.method = upper(a.method) THEN 1000 ELSE 0 END AS score
  FROM asked a JOIN served s
    ON len(r) <= len(c) AND r != [''] AND c != ['']
    AND list_bool_and(list_transform(range(1, len(r) + 1), lambda i: r[i] = '{{param}}' OR r[i] = c[i])))
SELECT method, path, service AS target FROM scored
QUALIFY row_number() OVER (PARTITION BY method, path ORDER BY score DESC, ord) = 1"""

# ---------------------------------------------------------------- front end

FRONT = """files AS (
  SELECT o_orderkey AS k, o_custkey AS c, 'front-' || o_custkey % 5 AS service,
    'src/f' || o_orderkey || ['.ts', '.tsx', '.vue', '.js', '.md', '.mjs'][o_orderkey % 6 + 1] AS path,
    CAST(o_orderkey % 4 AS INT) AS top, ['orders', 'billing', 'stock', NULL][o_orderkey % 4 + 1] AS api,
    o_orderkey % 5 != 0 AS wrapped
  FROM orders WHERE o_orderkey % 13 != 0 AND o_orderkey % 17 != 0 AND o_orderkey % 6 != 4)"""
WRAPPER = """wrapper_calls AS (
  SELECT service, 'orders' AS target, 'GET' AS method, '/api/v1/orders/{param}' AS path,
    path || '::ordersApi.get' AS caller, top + 5 AS line FROM files
  UNION ALL SELECT service, 'orders', 'GET', '/api/v1/orders/{param}', path || '::ordersApi.get', top + 19 FROM files
  UNION ALL SELECT service, 'orders', 'POST', '/api/v1/orders/{param}/lines', path || '::ordersApi.post', top + 6 FROM files)"""
REQUEST = """request_calls AS (
  SELECT service, 'billing' AS target, 'POST' AS method, '/api/v2/bills/' || c AS path,
    path || '::billingRequest' AS caller, top + 7 AS line FROM files
  UNION ALL SELECT service, 'billing', 'GET', '/api/v2/bills', path || '::billingRequest', top + 8 FROM files)"""
# Without a wrapper, or with one for an unknown name, calls are routed.
API_FETCH = """api_fetch_calls AS (
  SELECT service, CASE WHEN NOT wrapped THEN 'items-1' WHEN api IS NULL THEN 'legacy-' || k % 3 ELSE api END AS target,
    'DELETE' AS method, CASE WHEN wrapped THEN '/v' || k % 3 ELSE '' END || '/items/' || k AS path,
    path || '::apiFetch' AS caller, top + 9 AS line FROM files
  UNION ALL SELECT service, api, 'GET', '/v' || k % 3 || '/orders/{order_id}/x', path || '::apiFetch', top + 12
  FROM files WHERE wrapped AND api IS NOT NULL)"""
TEMPLATE = """template_calls AS (
  SELECT service, api AS target, 'GET' AS method, '/raw/{param}' AS path,
    path || '::fetch' AS caller, top + 13 AS line FROM files WHERE api IS NOT NULL
  UNION ALL SELECT service, 'stock', 'PATCH', '/stock/' || k % 10, path || '::fetch', top + 14 FROM files
  UNION ALL SELECT service, (
      SELECT 'svc-' || min(n_nationkey) FROM nation WHERE n_nationkey % 3 = 1 AND n_nationkey % 2 = 0),
    'GET', '/api/v1/routes/{param}', path || '::fetch', top + 15 FROM files
  UNION ALL SELECT service, 'orders', 'GET', '/late', path || '::fetch', top + 18 FROM files)"""
ORACLES["scan_frontend_files"] = f"WITH {FRONT} SELECT service, path FROM files"
ORACLES["fe_wrapper_calls"] = f"WITH {FRONT}, {WRAPPER} SELECT * FROM wrapper_calls"
ORACLES["fe_request_calls"] = f"WITH {FRONT}, {REQUEST} SELECT * FROM request_calls"
ORACLES["fe_apifetch_calls"] = f"WITH {FRONT}, {API_FETCH} SELECT * FROM api_fetch_calls"
ORACLES["fe_template_fetch"] = f"WITH {FRONT}, {TEMPLATE} SELECT * FROM template_calls"
ORACLES["fe_env_bindings"] = f"""WITH {FRONT}, used AS (
  SELECT service, path, unnest(['VITE_ORDERS_URL', 'VITE_BILLING_URL', 'VITE_STOCK_URL'][top + 1:top + 1]) AS env, api AS target
  FROM files WHERE api IS NOT NULL
  UNION ALL SELECT service, path, 'STOCK_API_URL', 'stock' FROM files)
SELECT service, path, 'API_URL' AS key, api AS target FROM files WHERE api IS NOT NULL
UNION ALL SELECT service, path, unnest([env, 'process.env.' || env, 'import.meta.env.' || env]), target FROM used
UNION ALL SELECT service, path, 'ordersApiUrl', 'orders' FROM files"""
ORACLES["fe_apifetch_target"] = f"""WITH {FRONT}
SELECT service, path, 'API_URL' AS base, api AS target, '/v' || k % 3 AS prefix FROM files WHERE wrapped"""
ORACLES["fe_consumers_dedup"] = f"""WITH {FRONT}, {WRAPPER}, {REQUEST}, {API_FETCH}, {TEMPLATE}, calls AS (
  SELECT * FROM wrapper_calls UNION ALL SELECT * FROM request_calls
  UNION ALL SELECT * FROM api_fetch_calls UNION ALL SELECT * FROM template_calls)
SELECT service, target, method, path, caller, min(line) AS line FROM calls
GROUP BY service, target, method, path, caller"""

# ---------------------------------------------------------------- back end

CUSTOMERS = """services AS (
  SELECT c_custkey AS k, 'svc-' || c_custkey AS service, lower(c_mktsegment) AS seg, c_nationkey AS n,
    CASE WHEN c_custkey % 3 = 0 THEN 'app/config.py' ELSE 'app/core/config.py' END AS config,
    ['orders', 'billing', 'stock', NULL][c_custkey % 4 + 1] AS api
  FROM customer)"""


def listed(rows: str) -> str:
    """SQL for the union of ``SELECT … FROM services`` lines."""
    return " UNION ALL ".join(f"SELECT {row.strip()}" for row in rows.strip().splitlines())


_FILES = """python_files AS (
  SELECT service, unnest([config, 'app/schemas/events.py', 'app/api/endpoints/orders.py', 'app/api/api.py',
    'app/main.py', 'app/extra/__init__.py', 'app/services/publisher.py', 'app/services/client.py',
    'app/api/use.py']) AS path FROM services
  UNION ALL SELECT service, 'app/extra.py' FROM services WHERE k % 6 = 0)"""
ORACLES["scan_python_files"] = f"""WITH {CUSTOMERS}, {_FILES}
SELECT service, path, 'routes' AS scan FROM python_files
UNION ALL SELECT service, 'app/services/client.py', 'clients' FROM services"""
ORACLES["read_source_tree"] = """WITH own AS (
  SELECT 'svc-' || s_suppkey AS service, unnest([
    {'path': 'app/main.py', 'content': 'x = ' || s_suppkey || chr(10)}, {'path': 'app/__init__.py', 'content': ''},
    {'path': 'app/api/_private.py', 'content': '# ' || s_name}, {'path': '.github/run.py', 'content': '1'},
    {'path': 'a b+c%20.py', 'content': 'é'}]) AS f FROM supplier)
SELECT service, f.path AS path, f.content AS content, CAST(NULL AS VARCHAR) AS reason FROM own
UNION ALL SELECT 'large', 'app/d' || p_partkey % 10 || '/p' || p_partkey || '/__init__.py', p_name, NULL FROM part"""
ORACLES["app_root"] = f"""WITH {CUSTOMERS}
SELECT service, CASE WHEN k % 2 = 1 THEN service || '/' ELSE '' END AS app_root FROM services"""
# Counted by hand from the templates; ``loop``, ``shadow``, ``broken`` and
# ``unmounted`` are the variants a service can have.
ORACLES["app_root_files"] = f"""WITH {CUSTOMERS}
SELECT service, unnest([config, 'app/schemas/events.py', 'app/api/endpoints/orders.py', 'app/api/api.py',
  'app/main.py', 'app/extra/__init__.py', 'app/api/_private.py', 'app/services/publisher.py',
  'app/services/client.py', 'app/api/use.py',
  CASE WHEN k % 6 = 0 THEN 'app/extra.py' ELSE 'scripts/extra.py' END]) AS path FROM services"""
ORACLES["py_node_counts"] = f"""WITH {CUSTOMERS}, variants AS (
  SELECT service, (k % 7 = 0)::INT AS loop, (k % 6 = 0)::INT AS shadow, (k % 11 = 0)::INT AS broken,
    (k % 5 = 1)::INT AS unmounted FROM services),
counted AS (
  SELECT service, 'module' AS kind, 10 + shadow - broken AS n FROM variants
  UNION ALL SELECT service, 'error', broken FROM variants
  UNION ALL SELECT service, 'import', 15 + loop + shadow - broken FROM variants
  UNION ALL SELECT service, 'class', 6 - broken FROM variants
  UNION ALL SELECT service, 'function', 23 + shadow - broken FROM variants
  UNION ALL SELECT service, 'annotated', 4 - 4 * broken FROM variants
  UNION ALL SELECT service, 'assign', 17 + shadow - 4 * broken FROM variants
  UNION ALL SELECT service, 'call', 47 + loop + 2 * shadow - broken - unmounted FROM variants
  UNION ALL SELECT service, 'fstring', 2 FROM variants)
SELECT service, kind, n FROM counted WHERE n > 0"""
ORACLES["py_settings_class"] = f"""WITH {CUSTOMERS}, found AS ({listed('''
service, k, 'API_PREFIX' AS name, '/api/v' || n % 4 AS sval FROM services
service, k, 'ORDER_TOPIC', seg || '.order.' || k % 100 FROM services
service, k, 'RETRY_TOPIC', seg || '.retry' FROM services
''')})
SELECT service, name, sval FROM found WHERE k % 3 != 0 AND k % 11 != 0"""
ORACLES["py_settings_any"] = f"""WITH {CUSTOMERS}, found AS ({listed('''
service, k, 'API_PREFIX' AS name, '/api/v' || n % 4 AS sval FROM services
service, k, 'ORDER_TOPIC', seg || '.order.' || k % 100 FROM services
service, k, 'RETRY_TOPIC', 'shadow.' || k FROM services
''')})
SELECT service, name, sval FROM found WHERE k % 11 != 0"""
ORACLES["py_event_schemas"] = f"""WITH {CUSTOMERS}, found AS ({listed('''
service, 'OrderPlaced' AS class_name, 5 AS line FROM services
service, 'Customer' || k % 7 || 'Event', 9 FROM services
service, 'Inner', 10 FROM services
''')})
SELECT service, class_name, 'app/schemas/events.py' AS file, line FROM found"""
ORACLES["py_routers"] = f"""WITH {CUSTOMERS}
{listed('''
service, 'app.api.endpoints.orders' AS module, 'router' AS router, '/' || seg AS prefix FROM services
service, 'app.api.api', 'api_router', '' FROM services
service, 'app.extra', 'router', '' FROM services
''')}"""
ORACLES["py_imports"] = f"""WITH {CUSTOMERS}, found AS ({listed('''
service, k, 'app.api.endpoints.orders' AS module, 'APIRouter' AS alias, 'fastapi.APIRouter' AS from_module, 'router' AS from_router FROM services
service, k, 'app.api.api', 'APIRouter', 'fastapi.APIRouter', 'router' FROM services
service, k, 'app.api.api', 'orders', 'app.api.endpoints.orders', 'router' FROM services
service, k, 'app.api.api', 'settings', 'app.core.config.settings', 'router' FROM services
service, k, 'app.main', 'FastAPI', 'fastapi.FastAPI', 'router' FROM services
service, k, 'app.main', 'api_router', 'app.api.api', 'api_router' FROM services
service, k, 'app.main', 'settings', 'app.core.config.settings', 'router' FROM services
service, k, 'app.extra', 'APIRouter', 'fastapi.APIRouter', 'router' FROM services
service, k, 'app.schemas.events', 'BaseModel', 'pydantic.BaseModel', 'router' FROM services
service, k, 'app.services.publisher', 'settings', 'app.core.config.settings', 'router' FROM services
service, k, 'app.services.publisher', 'OrderPlaced', 'app.schemas.events.OrderPlaced', 'router' FROM services
service, k, 'app.services.client', 'settings', 'app.core.config.settings', 'router' FROM services
service, k, 'app.api.use', 'orders_client', 'app.services.client.orders_client', 'router' FROM services
''')}
  UNION ALL SELECT service, k, 'app.api.endpoints.orders', 'api_router', 'app.api.api', 'api_router' FROM services WHERE k % 7 = 0
  UNION ALL SELECT service, k, CASE WHEN k % 3 = 0 THEN 'app.config' ELSE 'app.core.config' END, 'BaseSettings', 'pydantic.BaseSettings', 'router' FROM services WHERE k % 11 != 0)
SELECT service, module, alias, from_module, from_router FROM found"""
_PREFIX = "CASE WHEN k % 11 = 0 THEN '' ELSE '/api/v' || n % 4 END"
ORACLES["py_includes"] = f"""WITH {CUSTOMERS}
{listed('''
service, 'app.api.api' AS module, 'api_router' AS parent_router, 'orders' AS alias, '/n' || n AS prefix FROM services
service, 'app.api.api', 'api_router', 'orders', '/second' FROM services
''')}
UNION ALL SELECT service, 'app.api.endpoints.orders', 'router', 'api_router', '/loop' FROM services WHERE k % 7 = 0
UNION ALL SELECT service, 'app.main', 'app', 'api_router', {_PREFIX} FROM services WHERE k % 5 != 1"""
_ORDERS = "app/api/endpoints/orders.py"
_DECORATED = f"""decorated AS ({listed(f'''
service, '{_ORDERS}' AS path, 'app.api.endpoints.orders' AS module, 'GET' AS method, '/orders/{{order_id}}' AS route, 'get_order' AS function, 9 AS line FROM services
service, '{_ORDERS}', 'app.api.endpoints.orders', 'POST', '/events/' || seg || '.shipped.' || k % 50, 'on_shipped', 14 FROM services
service, '{_ORDERS}', 'app.api.endpoints.orders', 'DELETE', '//orders//' || k || '/', 'change', 20 FROM services
service, '{_ORDERS}', 'app.api.endpoints.orders', 'PUT', '/orders', 'change', 20 FROM services
service, CASE WHEN k % 6 = 0 THEN 'app/extra.py' ELSE 'app/extra/__init__.py' END, 'app.extra', 'GET', CASE WHEN k % 6 = 0 THEN '/shadow/' ELSE '/extra/' END || k, 'extra', 6 FROM services
''')})"""
ORACLES["py_decorators"] = f"""WITH {CUSTOMERS}, {_DECORATED}
SELECT service, path, module, 'router' AS router, method, route, function, line FROM decorated"""
_FULL = f"""full_paths AS (
  SELECT service, method, regexp_replace(regexp_replace('/' || CASE
      WHEN module = 'app.extra' THEN ''
      WHEN k % 7 = 0 THEN '/loop/n' || n || '/' || seg
      WHEN k % 5 = 1 THEN '/n' || n || '/' || seg
      ELSE {_PREFIX} || '/n' || n || '/' || seg END || route, '/+', '/', 'g'), '(.)/$', '\\1') AS path,
    path || '::' || function AS handler, line
  FROM decorated JOIN services USING (service))"""
ORACLES["route_full_paths"] = f"""WITH {CUSTOMERS}, {_DECORATED}, {_FULL}
SELECT service, method, path, handler, line FROM full_paths"""
ORACLES["subscribers_from_routes"] = f"""WITH {CUSTOMERS}
SELECT service, seg || '.shipped.' || k % 50 AS topic, '{_ORDERS}::on_shipped' AS handler, 14 AS line FROM services"""
_PUBLISHER = "app/services/publisher.py"
ORACLES["publish_sites"] = f"""WITH {CUSTOMERS}, found AS ({listed('''
service, 'publish_literal' AS function, 6 AS line, 'str' AS topic_kind FROM services
service, 'publish_setting', 11, 'attr' FROM services
service, 'publish_missing', 18, 'attr' FROM services
service, 'publish_dynamic', 23, 'name' FROM services
service, 'inner', 23, 'name' FROM services
''')})
SELECT service, '{_PUBLISHER}' AS path, function, line, topic_kind FROM found"""
_UNRESOLVED = (
    "|| ' could not be resolved — inline a literal at the publish site or add a literal default "
    "in app/core/config.py'"
)
_HAS_DEFAULT = "k % 3 != 0 AND k % 11 != 0"
ORACLES["publish_warnings"] = f"""WITH {CUSTOMERS}, found AS ({listed(f'''
service, 'unresolved_settings_topic' AS kind, 18 AS line, 'topic=settings.NO_SUCH_' || k % 9 {_UNRESOLVED} AS message FROM services
service, 'unresolved_settings_topic', 11, 'topic=settings.ORDER_TOPIC' {_UNRESOLVED} FROM services WHERE NOT ({_HAS_DEFAULT})
service, 'dynamic_topic', 23, 'topic is a dynamic expression (Name(id=''name'', ctx=Load()))' FROM services
service, 'dynamic_topic', 23, 'topic is a dynamic expression (Name(id=''name'', ctx=Load()))' FROM services
''')})
SELECT service, kind, '{_PUBLISHER}' AS file, line, message FROM found"""
ORACLES["publish_schema"] = f"""WITH {CUSTOMERS}
SELECT service, seg || '.created.' || k % 20 AS topic, CAST(NULL AS VARCHAR) AS schema,
  '{_PUBLISHER}::publish_literal' AS publisher, 6 AS line FROM services
UNION ALL SELECT service, seg || '.order.' || k % 100, 'OrderPlaced', '{_PUBLISHER}::publish_setting', 11
FROM services WHERE {_HAS_DEFAULT}"""
_CLIENT = "app/services/client.py"
ORACLES["client_targets"] = f"""WITH {CUSTOMERS}
SELECT service, '{_CLIENT}' AS path, api AS target FROM services WHERE api IS NOT NULL"""
ORACLES["client_local_strings"] = f"""WITH {CUSTOMERS}
{listed('''
service, 'url' AS variable, '/local/{customer}/{param}/' || k AS text FROM services
service, 'url', '/built/' || seg FROM services
''')}"""
_DIRECT = f"""direct AS ({listed(f'''
service, api AS target, 'GET' AS method, '/api/orders/{{order_id}}' AS path, '{_CLIENT}::OrdersClient.get_order' AS caller, 18 AS line FROM services
service, api, 'PUT', '/local/{{customer}}/{{param}}/' || k, '{_CLIENT}::OrdersClient.local', 23 FROM services
service, api, 'PATCH', '/built/' || seg, '{_CLIENT}::OrdersClient.unpacked', 28 FROM services
service, 'billing', 'DELETE', '/bills/{{b}}', '{_CLIENT}::direct', 38 FROM services
''')})"""
ORACLES["client_calls"] = f"""WITH {CUSTOMERS}, {_DIRECT} SELECT * FROM direct WHERE target IS NOT NULL"""
ORACLES["client_wrapper_calls"] = f"""WITH {CUSTOMERS}
SELECT service, api AS target, 'POST' AS method, '/orders' AS path,
  '{_CLIENT}::OrdersClient.create' AS caller, 31 AS line FROM services WHERE api IS NOT NULL"""
ORACLES["client_singleton_calls"] = f"""WITH {CUSTOMERS}, found AS ({listed('''
service, api AS target, 'PATCH' AS method, '/x/' || k AS path, 'handler' AS function, 5 AS line FROM services
service, api, 'GET', '/{kind}/y', 'handler', 7 FROM services
service, api, 'DELETE', '/module', '<module>', 10 FROM services
''')})
SELECT service, target, method, path, 'app/api/use.py::' || function AS caller, line
FROM found WHERE target IS NOT NULL"""
# Providers 5; one direct call everywhere, and seven more calls where the client's target is known.
ORACLES["extract_summary"] = f"""WITH {CUSTOMERS}
SELECT service, 5 AS providers, CASE WHEN api IS NULL THEN 1 ELSE 8 END AS consumers,
  CASE WHEN {_HAS_DEFAULT} THEN 2 ELSE 1 END AS publishes, 1 AS subscribes, 3 AS schemas,
  CASE WHEN {_HAS_DEFAULT} THEN 3 ELSE 4 END + CASE WHEN api IS NULL THEN 0 ELSE 1 END AS warnings
FROM services"""

_KINDS = [
    ("http_providers", "route_full_paths", ["method", "path", "handler"]),
    ("topics_published", "publish_schema", ["topic", "schema", "publisher"]),
    ("http_consumers", "client_calls", ["target", "method", "path", "caller"]),
    ("http_consumers", "client_wrapper_calls", ["target", "method", "path", "caller"]),
    ("http_consumers", "client_singleton_calls", ["target", "method", "path", "caller"]),
    ("topics_subscribed", "subscribers_from_routes", ["topic", "handler"]),
    ("event_schemas", "py_event_schemas", ["class_name", "file"]),
    ("extraction_warnings", "publish_warnings", ["kind", "file", "message"]),
]
_COLUMNS = [
    "method", "path", "handler", "target", "caller", "topic", "schema", "publisher",
    "class_name", "file", "kind", "message",
]


def long_rows(section: str, source: str, columns: list[str]) -> str:
    """SQL for the rows of one section in the long table."""
    given = ", ".join(c if c in columns else f"CAST(NULL AS VARCHAR) AS {c}" for c in _COLUMNS)
    return f"SELECT service, '{section}' AS section, {given}, CAST(line AS BIGINT) AS line FROM {source}"


_NO_ROUTES = f"""front_calls AS (
  SELECT * FROM wrapper_calls UNION ALL SELECT * FROM request_calls
  UNION ALL SELECT * FROM api_fetch_calls WHERE target NOT LIKE 'items-%' AND target NOT LIKE 'legacy-%'
  UNION ALL SELECT * FROM template_calls WHERE path != '/api/v1/routes/{{param}}'),
front_firsts AS (
  SELECT service, target, method, path, caller, min(line) AS line FROM front_calls
  GROUP BY service, target, method, path, caller)"""
_ODD_METHOD = f"""odd_method AS ({CUSTOMERS.replace("services AS", "WITH services AS", 1)}
  SELECT service, 'unknown_method' AS kind, 'app/api/use.py' AS file, 11 AS line,
    'call with unknown HTTP method TRACE' AS message FROM services WHERE api IS NOT NULL)"""
_EXTRACTED = " UNION ALL ".join(
    [long_rows(section, f"({ORACLES[source]})", columns) for section, source, columns in _KINDS]
    + [long_rows("extraction_warnings", "odd_method", ["kind", "file", "message"])]
    + [long_rows("http_consumers", "front_firsts", ["target", "method", "path", "caller"])]
    + [long_rows("service", "(SELECT DISTINCT service, NULL AS line FROM (SELECT service FROM every_front UNION "
       "SELECT 'svc-' || c_custkey FROM customer))", [])]
)
ORACLES["extract_all"] = f"""WITH {FRONT}, {WRAPPER}, {REQUEST}, {API_FETCH}, {TEMPLATE}, {_NO_ROUTES}, {_ODD_METHOD},
every_front AS (SELECT DISTINCT 'front-' || o_custkey % 5 AS service FROM orders)
{_EXTRACTED}"""
ORACLES["extract_by_kind"] = f"""WITH {CUSTOMERS}
SELECT service, unnest([config, 'app/schemas/events.py', 'app/api/endpoints/orders.py', 'app/api/api.py',
  'app/main.py', 'app/extra/__init__.py', 'app/api/_private.py', 'app/services/publisher.py',
  'app/services/client.py', 'app/api/use.py',
  CASE WHEN k % 6 = 0 THEN 'app/extra.py' ELSE 'scripts/extra.py' END]) AS path, 'backend' AS kind FROM services
UNION ALL SELECT 'front-' || o_custkey % 5,
  CASE WHEN o_orderkey % 13 = 0 THEN 'src/node_modules/' WHEN o_orderkey % 17 = 0 THEN 'dist/' ELSE 'src/' END
  || 'f' || o_orderkey || ['.ts', '.tsx', '.vue', '.js', '.md', '.mjs'][o_orderkey % 6 + 1], 'frontend' FROM orders"""
# Stored routes are in the order of their services' names.
ORACLES["fe_against_stored"] = ORACLES["fe_consumers_dedup"].replace(
    "'svc-' || min(n_nationkey)", "min('svc-' || n_nationkey)"
)

# ---------------------------------------------------------------- contracts

_ITEMS = {
    "provides.http": ("providers", ["method", "path", "handler", "line"]),
    "provides.topics_published": ("published", ["topic", "schema", "publisher", "line"]),
    "consumes.http": ("consumers", ["target", "method", "path", "caller", "line"]),
    "consumes.topics_subscribed": ("subscribed", ["topic", "handler", "line"]),
    "event_schemas": ("event_classes", ["class_name", "file", "line"]),
    "_extraction_warnings": ("warnings", ["kind", "file", "line", "message"]),
}
_DOCUMENT = " UNION ALL ".join(
    f"SELECT service, '{place}' AS location, CAST(json_object("
    + ", ".join(f"'{c}', {c}" for c in columns)
    + f") AS VARCHAR) AS item FROM {source}"
    for place, (source, columns) in _ITEMS.items()
)
_HEADERS = """ UNION ALL SELECT DISTINCT service, '' AS location,
  CAST(json_object('service', service, 'extractor_version', '0.1.0') AS VARCHAR)
FROM (SELECT service FROM providers UNION SELECT service FROM consumers UNION SELECT service FROM published
  UNION SELECT service FROM subscribed UNION SELECT service FROM event_classes UNION SELECT service FROM warnings)"""
ORACLES["contract_documents"] = f"WITH {ALL_FACTS} {_DOCUMENT} {_HEADERS}"
ORACLES["show_contract"] = f"""WITH {ALL_FACTS}, items AS ({_DOCUMENT} {_HEADERS})
SELECT * FROM items WHERE service = 'svc-3'"""
_SECTION_NAMES = {
    "providers": "http_providers", "consumers": "http_consumers", "published": "topics_published",
    "subscribed": "topics_subscribed", "event_classes": "event_schemas",
    "warnings": "extraction_warnings",
}
_LONG = " UNION ALL ".join(long_rows(_SECTION_NAMES[source], source, columns) for source, columns in _ITEMS.values())
ORACLES["load_one_contract"] = f"""WITH {ALL_FACTS}, facts AS ({_LONG})
SELECT * FROM facts WHERE service = 'svc-3'"""
_PLACES = " UNION ALL ".join(
    f"SELECT service, {rank} AS rank, '{_SECTION_NAMES[source]}' AS section, {about} AS about, line, "
    f"row_number() OVER (PARTITION BY service ORDER BY {order}) - 1 AS item FROM {source}"
    for rank, (source, about, order) in enumerate([
        ("providers", "path", "p_partkey"), ("published", "topic", "event_id"),
        ("consumers", "path", "l_orderkey, line, method, path, target"), ("subscribed", "topic", "o_orderkey"),
        ("event_classes", "class_name", "line"), ("warnings", "file", "line"),
    ])
)
_KEYS = {"providers": "p_partkey", "published": "event_id", "consumers": "l_orderkey", "subscribed": "o_orderkey",
         "event_classes": "line", "warnings": "line"}
_THOUSANDS = " UNION ALL ".join(
    long_rows(_SECTION_NAMES[source], f"(SELECT * REPLACE (service || '-' || {_KEYS[source]} // 1000 AS service) FROM {source})", columns)
    for source, columns in _ITEMS.values()
)
ORACLES["documents_written_and_read"] = f"""WITH {ALL_FACTS} {_THOUSANDS}"""
ORACLES["orphan_check"] = f"""WITH {TOPICS}, topics AS (
  SELECT bool_or(role = 'publisher') AS p, bool_or(role = 'subscriber') AS s,
    count(*) FILTER (role = 'subscriber' AND place IS NULL) AS unhandled FROM sites GROUP BY topic),
counted AS (
  SELECT count(*) FILTER (p AND NOT s) AS published_only, count(*) FILTER (s AND NOT p) AS subscribed_only,
    sum(unhandled)::BIGINT AS unhandled FROM topics)
SELECT *, published_only + subscribed_only + unhandled = 0 AS clean FROM counted"""
ORACLES["fact_positions"] = f"""WITH {ALL_FACTS}, placed AS ({_PLACES}),
sizes AS (SELECT service, rank, count(*) AS n FROM placed GROUP BY service, rank)
SELECT service, section, about, CAST(line AS BIGINT) AS line, item, item + (
  SELECT coalesce(sum(n), 0) FROM sizes s WHERE s.service = p.service AND s.rank < p.rank)::BIGINT AS position
FROM placed p"""
ORACLES["save_load_roundtrip"] = f"""WITH {ALL_FACTS}, facts AS ({_LONG})
SELECT * FROM facts WHERE service != 'svc-2' OR section = 'http_providers'"""
ORACLES["load_last_wins"] = f"""WITH {PUBLISHED}
SELECT service, topic, publisher, CASE WHEN service = 'svc-1' THEN line ELSE line + 1000 END AS line
FROM published"""
ORACLES["documents_to_facts"] = """WITH found AS (
  SELECT p_partkey AS k, CASE p_partkey % 12 WHEN 0 THEN 'svc-' ELSE 'full-' END || p_partkey AS service,
    unnest(CASE p_partkey % 12 WHEN 0 THEN [
      {'section': 'service', 'seq': 0, 'method': NULL, 'path': NULL, 'target': NULL, 'topic': NULL, 'schema': NULL, 'line': NULL},
      {'section': 'http_providers', 'seq': 0, 'method': 'GET', 'path': '/p/' || p_partkey, 'target': NULL, 'topic': NULL, 'schema': NULL, 'line': p_partkey::INT}]
    ELSE [
      {'section': 'service', 'seq': 0, 'method': NULL, 'path': NULL, 'target': NULL, 'topic': NULL, 'schema': NULL, 'line': NULL},
      {'section': 'topics_published', 'seq': 0, 'method': NULL, 'path': NULL, 'target': NULL, 'topic': 't' || p_partkey, 'schema': 'E', 'line': p_partkey::INT},
      {'section': 'topics_published', 'seq': 1, 'method': NULL, 'path': NULL, 'target': NULL, 'topic': 'u', 'schema': 'S', 'line': 2},
      {'section': 'http_consumers', 'seq': 0, 'method': 'PUT', 'path': '/a', 'target': 'x', 'topic': NULL, 'schema': NULL, 'line': 3},
      {'section': 'topics_subscribed', 'seq': 0, 'method': NULL, 'path': NULL, 'target': NULL, 'topic': 't' || p_partkey, 'schema': NULL, 'line': NULL}] END) AS f
  FROM part WHERE p_partkey % 12 IN (0, 11))
SELECT 'repo-' || k AS repo, service, f.section, f.seq, f.method, f.path, f.target, f.topic, f.schema, f.line FROM found"""
# kind of document -> its violations (location, position, rule)
_BROKEN = [
    (1, "document", "NULL", "not JSON"),
    (2, "service", "NULL", "missing"),
    (3, "service", "NULL", "not a string"),
    (3, "extractor_version", "NULL", "null"),
    (4, "provides.http.method", "1", "unknown method"),
    (4, "provides.http.path", "1", "not a string"),
    (4, "provides.http.handler", "1", "missing"),
    (4, "provides.http.line", "1", "not an integer"),
    (5, "provides.http", "NULL", "not a list"),
    (6, "consumes.topics_subscribed", "1", "unknown field"),
    (7, "consumes.topics_subscribed.topic", "1", "missing"),
    (7, "consumes.topics_subscribed.line", "1", "not an integer"),
    (8, "provides", "NULL", "not an object"),
    (8, "event_schemas", "1", "not an object"),
    (9, "document", "NULL", "not an object"),
    (10, "_extraction_warnings.line", "0", "null"),
]
_VIOLATIONS = "violations AS (" + " UNION ALL ".join(
    f"SELECT 'repo-' || p_partkey AS repo, '{location}' AS location, CAST({pos} AS INT) AS pos, "
    f"'{rule}' AS rule FROM part WHERE p_partkey % 12 = {kind}"
    for kind, location, pos, rule in _BROKEN
) + ")"
ORACLES["contract_violations"] = f"WITH {_VIOLATIONS} SELECT * FROM violations"
ORACLES["validate_contracts"] = f"""WITH {_VIOLATIONS}, counted AS (
  SELECT 'repo-' || p_partkey AS repo, count(location) AS violations
  FROM part LEFT JOIN violations ON repo = 'repo-' || p_partkey GROUP BY p_partkey)
SELECT repo, violations, violations = 0 AS valid FROM counted"""
ORACLES["contract_drift"] = f"""WITH {PROVIDERS}, changes AS (
  SELECT service, handler, method, path, 'removed' AS change, 1 AS removed, 0 AS added FROM providers WHERE p_partkey % 10 = 0
  UNION ALL SELECT service, handler, method, path, 'changed', 1, 1 FROM providers WHERE p_partkey % 10 = 1
  UNION ALL SELECT service, handler || '_new', method, path, 'added', 0, 1 FROM providers WHERE p_partkey % 10 = 2
  UNION ALL SELECT service, handler, method, path, 'added', 0, 1 FROM providers WHERE p_partkey % 10 = 3)
SELECT service, 'http_providers' AS section,
  CAST(json_object('handler', handler, 'method', method, 'path', path) AS VARCHAR) AS fact,
  change, removed, added FROM changes"""
