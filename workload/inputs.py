"""Inputs derived from the given tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline import schema
from seamline.functions.paths import match_path, ord_key
from seamline.sources.contracts import header, tagged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, a_task: int) -> DataFrame:
    """Use all cores for the text made from ``rows``, even if they are in few files.

    A task gets at most about ``a_task`` rows, so that what it makes of them can be sorted in memory.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-rows.count() // a_task))
    return rows.repartition(tasks) if len(rows.inputFiles()) < tasks else rows


# ---------------------------------------------------------------- facts


def _order(*columns: str) -> Column:
    return ord_key(0, F.array().cast("array<string>"), *[F.col(c) for c in columns])


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(
        "concat('svc-', p_partkey % 7) AS service",
        "element_at(array('GET', 'POST', 'PUT', 'PATCH', 'DELETE'), p_size % 5 + 1) AS method",
        "concat('/api/v1/', lower(p_type), '/', replace(lower(p_brand), '#', '-'), '/{part_id}') AS path",
        "concat('app/api/endpoints/', lower(p_type), '.py::handle_', p_partkey) AS handler",
        "p_size AS line",
        "p_partkey",
    )
    return rows.withColumn("ord", _order("p_partkey")).withColumn(
        "norm_path", match_path(F.col("path"))
    )


def consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spread(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"
    ), 250_000)
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.expr("concat('front-', l_suppkey % 5)").alias("service"),
        F.expr("concat('svc-', p_partkey % 7)").alias("target"),
        F.expr(
            "element_at(array('GET', 'POST', 'PUT', 'PATCH', 'DELETE'), p_size % 5 + 1)"
        ).alias("method"),
        F.concat(
            F.expr("concat('/api/v1/', lower(p_type), '/', replace(lower(p_brand), '#', '-'), '/')"),
            F.element_at(
                F.array(F.lit("{id}"), F.lit("${id}"), F.lit("[id]")),
                F.col("l_linenumber") % 3 + 1,
            ),
            F.when(F.col("l_linenumber") % 4 == 0, "/").otherwise(""),
        ).alias("path"),
        F.expr("concat('src/o', l_orderkey, '.ts::apiFetch')").alias("caller"),
        F.col("l_linenumber").alias("line"),
        "l_orderkey",
    )
    return rows.withColumn("ord", _order("l_orderkey", "line")).withColumn(
        "norm_path", match_path(F.col("path"))
    )


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr(
        "concat('svc-', event_id % 7) AS service",
        "concat(event_type, '.', user_id % 50) AS topic",
        "CASE WHEN value >= 35 THEN concat('Ev', event_id % 9) END AS schema",
        "concat('app/services/', event_type, '.py::publish_', event_id % 100) AS publisher",
        "CAST(event_id % 500 AS INT) AS line",
        "event_id",
    )
    return rows.withColumn("ord", _order("event_id"))


def subscribed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(
        "concat('svc-', o_orderkey % 7) AS service",
        "concat(element_at(array('signup', 'purchase', 'error', 'click', 'refund'), "
        "CAST(o_orderkey % 5 AS INT) + 1), '.', o_custkey % 60) AS topic",
        "CASE WHEN o_orderstatus != 'P' THEN concat('app/api/events.py::on_', o_orderkey) END AS handler",
        "CASE WHEN o_orderstatus != 'P' THEN CAST(o_orderkey % 900 AS INT) END AS line",
        "o_orderkey",
    )
    return rows.withColumn("ord", _order("o_orderkey"))


def event_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr(
        "concat('svc-', c_custkey % 7) AS service",
        "concat('Event', c_custkey) AS class_name",
        "'app/schemas/events.py' AS file",
        "CAST(c_custkey AS INT) AS line",
    )
    return rows.withColumn("ord", _order("line"))


def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").selectExpr(
        "concat('svc-', s_suppkey % 9) AS service",
        "'dynamic_topic' AS kind",
        "concat('app/services/s', s_suppkey, '.py') AS file",
        "CAST(s_suppkey AS INT) AS line",
        "concat('topic is a dynamic expression (', s_name, ')') AS message",
    )
    return rows.withColumn("ord", _order("line"))


_SECTIONS = {
    schema.HTTP_PROVIDERS: providers,
    schema.HTTP_CONSUMERS: consumers,
    schema.TOPICS_PUBLISHED: published,
    schema.TOPICS_SUBSCRIBED: subscribed,
    schema.EVENT_SCHEMAS: event_classes,
    schema.EXTRACTION_WARNINGS: warnings,
}


def facts(spark: SparkSession, sf_dir: str, *sections: str) -> DataFrame:
    """The long fact table, of some sections or all."""
    parts = [tagged(_SECTIONS[s](spark, sf_dir), s) for s in sections or _SECTIONS]
    return reduce(DataFrame.unionByName, parts)


def with_headers(rows: DataFrame) -> DataFrame:
    return rows.unionByName(header(rows))


def endpoint_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question per served endpoint, sloppily typed, and some without an answer."""
    served = providers(spark, sf_dir).select("method", "path").distinct()
    asked = served.select(F.concat(F.lit(" "), F.lower("method"), F.lit("   "), "path").alias("question"))
    regions = table(spark, sf_dir, "region")
    unserved = regions.selectExpr("concat('GET /nothing/', lower(r_name)) AS question")
    malformed = regions.selectExpr("concat('/', replace(r_name, ' ', '-')) AS question")
    return asked.unionByName(unserved).unionByName(malformed)


def topic_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        published(spark, sf_dir).select("topic").distinct()
        .unionByName(subscribed(spark, sf_dir).select("topic").distinct())
        .unionByName(table(spark, sf_dir, "region").selectExpr("r_name AS topic"))
        .distinct()
    )


def known_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    return (
        nations.selectExpr("concat('svc-', n_nationkey % 10) AS service", "'backend' AS kind")
        .unionByName(nations.selectExpr("concat('front-', n_nationkey % 8) AS service", "'frontend' AS kind"))
        .distinct()
    )


# ---------------------------------------------------------------- routes and calls


def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes from page addresses: sections, wildcards in them, and each page."""
    pages = table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("page"),
        F.regexp_extract("url", r"^https?://[^/]+/([^/?#]*)", 1).alias("section"),
        "page_id",
    )
    section, number = F.col("section"), F.col("page_id")
    kinds = [
        (0, F.lit("GET"), F.concat(F.lit("/"), section), F.concat(F.lit("section-"), section)),
        (1, F.lit("POST"), F.concat(F.lit("/"), section, F.lit("/{id}")), F.concat(F.lit("item-"), section)),
        (2, F.lit("PUT"), F.lit("/{any}/[id]/"), F.lit("fallback")),
        (
            3,
            F.when(number % 2 == 0, "GET").otherwise("POST"),
            F.col("page"),
            F.concat(F.lit("page-"), number % 5),
        ),
    ]
    return pages.select(
        "page_id",
        F.explode(F.array(*[
            F.struct(
                F.lit(rank).alias("rank"), method.alias("method"),
                path.alias("path"), service.alias("service"),
            )
            for rank, method, path, service in kinds
        ])).alias("r"),
    ).select("r.method", "r.path", "r.service", F.struct("r.rank", "page_id").alias("ord"))


def page_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls to each page's address and to everything it links to."""
    pages = table(spark, sf_dir, "pages")
    own = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)
    links = F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))
    method = F.element_at(
        F.array(F.lit("GET"), F.lit("post"), F.lit("DELETE")), (F.col("page_id") % 3 + 1).cast("int")
    )
    return pages.select(
        method.alias("method"), F.explode(F.concat(F.array(own), links)).alias("path")
    )


# ---------------------------------------------------------------- source text


def fill(template: str, **values: Column) -> Column:
    """Text of a template with ``@NAME@`` replaced by columns; null if one of them is, used or not."""
    pieces = re.split(f"@({'|'.join(values)})@", template)
    unused = [value.isNotNull() for name, value in values.items() if name not in pieces[1::2]]
    text = F.concat(*[
        values[piece].cast("string") if number % 2 else F.lit(piece) for number, piece in enumerate(pieces)
    ])
    return F.when(reduce(Column.__and__, unused), text) if unused else text


_FRONT_HEAD = """import { ref } from 'vue'
const API_URL = import.meta.env.VITE_@ENV@_URL || 'https://api.example.com/v@K3@/'
@WRAPPER@
export async function load(event, id) {
  const a = await ordersApi.get(event, '/orders/${id}')
  const b = await ordersApi.post(event, `/orders/[id]/lines/`, body)
  const c = await billingRequest<Bill>(event, '/bills/@C@', { method: 'POST', body })
  const d = await billingRequest(event, "/bills/")
  const e = await apiFetch<Item[]>('/items/@K@', {
    method: 'DELETE',
  })
  const f = await apiFetch('/orders/{order_id}/x')
  const g = await fetch(`${API_URL}/raw/${id}`, { headers: {}, method: 'PUT' })
  const h = await fetch(`${process.env.STOCK_API_URL}/stock/@K10@`, { method: 'PATCH' })
  const i = await fetch(`${elsewhere}/api/v1/routes/${id}`)
  const j = await unknownApi.get(event, '/nope')
  const k = useRuntimeConfig().ordersApiUrl
  const l = await fetch(`${k.ordersApiUrl}/late`)
  const m = await ordersApi.get(event, '/orders/${id}')
}
"""
_WRAPPER = "const apiFetch = (endpoint, options) => fetch(`${API_URL}${endpoint}`, options)"


def front_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One front-end file per order; some in skipped directories or of other kinds."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    directory = F.when(k % 13 == 0, "src/node_modules/").when(k % 17 == 0, "dist/").otherwise("src/")
    extension = F.element_at(
        F.array(*[F.lit(e) for e in (".ts", ".tsx", ".vue", ".js", ".md", ".mjs")]),
        (k % 6 + 1).cast("int"),
    )
    env = F.element_at(
        F.array(*[F.lit(e) for e in ("ORDERS", "BILLING", "STOCK", "NOBODY")]),
        (k % 4 + 1).cast("int"),
    )
    body = fill(
        _FRONT_HEAD,
        WRAPPER=F.when(k % 5 == 0, "// no wrapper here").otherwise(_WRAPPER),
        ENV=env, K3=k % 3, K10=k % 10, K=k, C=c,
    )
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 20_000).select(
        F.concat(F.lit("front-"), (c % 5).cast("string")).alias("service"),
        F.concat(directory, F.lit("f"), k.cast("string"), extension).alias("path"),
        F.concat(F.repeat(F.lit("\n"), (k % 4).cast("int")), body).alias("content"),
    )


def env_dim(spark: SparkSession) -> DataFrame:
    """Configuration: environment names."""
    return spark.sql(
        """SELECT * FROM VALUES
        ('backend', 'ORDERS_URL', 'orders'), ('backend', 'BILLING_URL', 'billing'),
        ('backend', 'STOCK_URL', 'stock'),
        ('frontend', 'VITE_ORDERS_URL', 'orders'), ('frontend', 'VITE_BILLING_URL', 'billing'),
        ('frontend', 'VITE_STOCK_URL', 'stock'), ('frontend', 'STOCK_API_URL', 'stock'),
        ('frontend', 'ordersApiUrl', 'orders')
        AS t(side, env, target)"""
    )


def wrapper_dim(spark: SparkSession) -> DataFrame:
    """Configuration: client wrappers."""
    return spark.sql(
        """SELECT * FROM VALUES
        ('object', 'ordersApi', 'orders', '/api/v1'),
        ('function', 'billingRequest', 'billing', '/api/v2')
        AS t(kind, name, target, prefix)"""
    )


def front_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes that back ends serve, for calls that do not name a service."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    by_nation = nations.selectExpr(
        "CASE WHEN n_nationkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS method",
        "concat('/api/v', n_nationkey % 3, '/routes/{route_id}') AS path",
        "concat('svc-', n_nationkey) AS service",
        "struct(0 AS rank, n_nationkey AS place) AS ord",
    )
    items = regions.selectExpr(
        "CASE WHEN r_regionkey % 2 = 0 THEN 'GET' ELSE 'DELETE' END AS method",
        "'/items/{item_id}' AS path",
        "concat('items-', r_regionkey) AS service",
        "struct(1 AS rank, r_regionkey AS place) AS ord",
    )
    legacy = regions.selectExpr(
        "'GET' AS method",
        "concat('/v', r_regionkey, '/items') AS path",
        "concat('legacy-', r_regionkey) AS service",
        "struct(2 AS rank, r_regionkey AS place) AS ord",
    )
    return by_nation.unionByName(items).unionByName(legacy)


_CONFIG = """from pydantic import BaseSettings

ORDER_TOPIC = "module.@K@"


class Settings(BaseSettings):
    API_PREFIX: str = "/api/v@N4@"
    ORDER_TOPIC: str = "@SEG@.order.@K100@"
    EMPTY_TOPIC: str | None = None
    TIMEOUT: int = 30
    RETRY_TOPIC = "@SEG@.retry"

    def helper(self):
        RETRY_TOPIC = "shadow.@K@"
        return RETRY_TOPIC


settings = Settings()
"""
_EVENTS = """import pydantic
from pydantic import BaseModel


class OrderPlaced(BaseModel):
    order_id: int


class Customer@K7@Event(pydantic.BaseModel):
    class Inner(BaseModel):
        x: int


class Plain:
    pass
"""
_ORDERS = """from fastapi import APIRouter
@IMPORT@

router = APIRouter(prefix="/@SEG@")
@INCLUDE@


@router.get("/orders/{order_id}")
async def get_order(order_id: str):
    return {}


@router.post(path="/events/@SEG@.shipped.@K50@")
def on_shipped(body: dict):
    return {}


@router.DELETE("//orders//@K@/")
@router.put("/orders")
def change():
    return {}


@other.post(path=make_path())
def ignored():
    return {}
"""
_API = """from fastapi import APIRouter
from app.api.endpoints import orders
from app.core.config import settings

api_router = APIRouter()
api_router.include_router(orders.router, prefix="/n@N@")
api_router.include_router(orders.router, prefix="/second")
"""
_MAIN = """from fastapi import FastAPI
from app.api.api import api_router
from app.core.config import settings

app = FastAPI()
@MOUNT@
"""
_EXTRA = """from fastapi import APIRouter
router = APIRouter()


@router.get("/@WHAT@/@K@")
def extra():
    return {}
"""
_PUBLISHER = """from app.core.config import settings
from app.schemas.events import OrderPlaced


async def publish_literal(publisher):
    await publisher.publish(topic="@SEG@.created.@K20@", event_type="x")


async def publish_setting(publisher):
    event = OrderPlaced(order_id=1)
    await publisher.publish(
        topic=settings.ORDER_TOPIC,
        data=event,
    )


def publish_missing(publisher):
    publisher.publish(topic=settings.NO_SUCH_@K9@)


def publish_dynamic(publisher, name):
    def inner():
        emit_event(topic=name, event_type="y")
    inner()


def not_publishing(bus):
    bus.send(topic="no")
"""
_CLIENT = """import httpx
from app.core.config import settings


class OrdersClient:
    def __init__(self):
        self.base_url = (settings.@ENV@ or "http://x").rstrip("/")

    async def _post(self, path, body):
        async with httpx.AsyncClient() as c:
            return await c.post(path, json=body)

    async def request(self, method, path):
        return await httpx.AsyncClient().request(method, path)

    async def get_order(self, order_id):
        client = httpx.AsyncClient()
        return await client.get(f"{self.base_url}/api/orders/{order_id}")

    async def local(self, order):
        url = "/first"
        url = f"/local/{order.customer}/{make(1)}/@K@"
        return await self.client.put(url)

    async def unpacked(self):
        made = self.build("/built/@SEG@")
        url, headers = made
        return await self.client.patch(url, headers=headers)

    async def create(self, body):
        return await self._post("/orders", body)


orders_client = OrdersClient()


def direct(a):
    return httpx.delete(f"{settings.BILLING_URL}/bills/{a.b}")


def nested(c):
    return c.head(wrap(wrap2("/never")))
"""
_USE = """from app.services.client import orders_client


def handler(kind):
    orders_client.request("patch", "/x/@K@")
    orders_client.request(kind, "/dropped")
    return [orders_client.get(build(f"{kind}/y")) for _ in kind]


orders_client.delete("/module")
orders_client.request("trace", "/odd")
"""


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small service of eleven files per customer."""
    k = F.col("c_custkey")
    values = dict(
        SEG=F.lower("c_mktsegment"), N=F.col("c_nationkey"), N4=F.col("c_nationkey") % 4,
        K=k, K7=k % 7, K9=k % 9, K20=k % 20, K50=k % 50, K100=k % 100,
    )
    env = F.element_at(
        F.array(*[F.lit(e) for e in ("ORDERS_URL", "BILLING_URL", "STOCK_URL", "OTHER_URL")]),
        (k % 4 + 1).cast("int"),
    )
    loop = k % 7 == 0
    broken = F.when(k % 11 == 0, "def broken(:\n").otherwise("")
    made = {
        "config": (
            F.when(k % 3 == 0, "app/config.py").otherwise("app/core/config.py"),
            F.concat(fill(_CONFIG, **values), broken),
        ),
        "events": (F.lit("app/schemas/events.py"), fill(_EVENTS, **values)),
        "orders": (
            F.lit("app/api/endpoints/orders.py"),
            fill(
                _ORDERS,
                IMPORT=F.when(loop, "from app.api.api import api_router").otherwise("# routes"),
                INCLUDE=F.when(loop, 'router.include_router(api_router, prefix="/loop")').otherwise("# end"),
                **values,
            ),
        ),
        "api": (F.lit("app/api/api.py"), fill(_API, **values)),
        "main": (
            F.lit("app/main.py"),
            fill(
                _MAIN,
                MOUNT=F.when(k % 5 == 1, "# not mounted").otherwise(
                    "app.include_router(api_router, prefix=settings.API_PREFIX)"
                ),
            ),
        ),
        "package": (F.lit("app/extra/__init__.py"), fill(_EXTRA, WHAT=F.lit("extra"), **values)),
        "private": (F.lit("app/api/_private.py"), fill(_EXTRA, WHAT=F.lit("private"), **values)),
        "shadow": (
            F.when(k % 6 == 0, "app/extra.py").otherwise("scripts/extra.py"),
            fill(_EXTRA, WHAT=F.lit("shadow"), **values),
        ),
        "publisher": (F.lit("app/services/publisher.py"), fill(_PUBLISHER, **values)),
        "client": (F.lit("app/services/client.py"), fill(_CLIENT, ENV=env, **values)),
        "use": (F.lit("app/api/use.py"), fill(_USE, **values)),
    }
    chosen = [
        F.struct(path.alias("path"), content.alias("content"))
        for path, content in made.values()
    ]
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return spread(customers, 2_000).select(
        F.concat(F.lit("svc-"), k.cast("string")).alias("service"),
        F.explode(F.array(*chosen)).alias("file"),
    ).select("service", "file.path", "file.content")


def nested_python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with every second service's ``app/`` one directory down."""
    files = python_files(spark, sf_dir)
    odd = F.element_at(F.split("service", "-"), -1).cast("long") % 2 == 1
    return files.withColumn(
        "path", F.when(odd, F.concat("service", F.lit("/"), "path")).otherwise(F.col("path"))
    )


_GOOD_HTTP = '{"method": "GET", "path": "/p/@K@", "handler": "h", "line": @K@}'


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract document per part; most are broken, each kind in its own way."""
    k = F.col("p_partkey")
    good = '{"service": "svc-@K@", "x": 1, "provides": {"http": [' + _GOOD_HTTP + ']}}'
    subscription = '{"service": "s", "consumes": {"topics_subscribed": [{"topic": "t", "handler": null}, %s]}}'
    kinds = [
        good,
        '{"service": "svc-@K@"',
        '{"provides": {"http": [' + _GOOD_HTTP + "]}}",
        '{"service": @K@, "extractor_version": null}',
        '{"service": "s", "provides": {"http": [' + _GOOD_HTTP + ', {"method": "get", "path": 5, "line": "x"}]}}',
        '{"service": "s", "provides": {"http": {}, "topics_published": [{"topic": "t", "schema": null, "publisher": "p", "line": "@K@"}]}}',
        subscription % '{"topic": "t", "dlq": "@K@", "line": 1.0}',
        subscription % '{"handler": "h", "line": 1.5}',
        '{"service": "s", "provides": [], "event_schemas": [{"class_name": "C", "file": "f", "line": true}, 7]}',
        '["service"]',
        '{"service": "s", "_extraction_warnings": [{"kind": "k", "file": "f", "line": null, "message": "m"}]}',
        '{"service": "full-@K@", "provides": {"topics_published": [{"topic": "t@K@", "event_schema": "E",'
        ' "publisher": "p", "line": "@K@"}, {"topic": "u", "schema": "S", "publisher": "p", "line": 2.0}]},'
        ' "consumes": {"http": [{"target": "x", "method": "PUT", "path": "/a", "caller": "c", "line": 3}],'
        ' "topics_subscribed": [{"topic": "t@K@"}]}, "_extraction_warnings": []}',
    ]
    document = F.lit(None).cast("string")
    for number, kind in enumerate(kinds):
        document = F.when(k % len(kinds) == number, fill(kind, K=k)).otherwise(document)
    return spread(table(spark, sf_dir, "part").select("p_partkey"), 20_000).select(
        F.concat(F.lit("repo-"), k.cast("string")).alias("repo"), document.alias("document")
    )


def source_tree(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Write source trees below ``root``: one per supplier, and one with a directory per part."""
    k, p = F.col("s_suppkey"), F.col("p_partkey")
    name = F.concat(F.lit("svc-"), k.cast("string"))
    own = [
        ("app/main.py", F.concat(F.lit("x = "), k.cast("string"), F.lit("\r\n"))), ("app/__init__.py", F.lit("")),
        ("app/api/_private.py", F.concat(F.lit("# "), "s_name")), (".github/run.py", F.lit("1")),
        ("node_modules/a/b.py", F.lit("2")), ("app/readme.md", F.lit("3")), ("a b+c%20.py", F.lit("é")),
    ]
    files = [F.struct(F.lit(path).alias("path"), text.alias("content")) for path, text in own]
    small_ones = table(spark, sf_dir, "supplier").select(name.alias("service"), F.explode(F.array(*files)).alias("f"))
    deep = F.concat(F.lit("app/d"), (p % 10).cast("string"), F.lit("/p"), p.cast("string"), F.lit("/__init__.py"))
    large = table(spark, sf_dir, "part").select(F.lit("large").alias("service"), deep.alias("path"), F.col("p_name").alias("content"))
    rows = small_ones.select("service", "f.path", "f.content").unionByName(large)

    def write(batches):
        import pyarrow as pa
        from pyarrow.fs import FileSystem, LocalFileSystem

        fs, base = FileSystem.from_uri(root) if "://" in root else (LocalFileSystem(), root)
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{base}/{row['service']}/{row['path']}"
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(path) as file:
                    file.write(row["content"].encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    rows.repartition(8).mapInArrow(write, "n LONG").write.format("noop").mode("overwrite").save()
