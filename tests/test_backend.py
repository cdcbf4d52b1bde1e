"""Small services, from which every extractor's facts are known by hand."""

import random

import pytest
from pyspark.sql import functions as F

from seamline import extract_backend, schema
from seamline.operators import routes, settings
from seamline.operators.impact import section
from seamline.plans import extract
from seamline.plans.staging import stage
from tests.conftest import rows

ROUTER = '''from fastapi import APIRouter

router = APIRouter(prefix="/api/v1")


@router.get("/books")
async def list_books():
    return []


@router.post("/events/book.lent")
async def on_lent(body):
    return {}
'''
LITERAL = '''async def announce(bus, book):
    await bus.publish(topic="book.added", event_type="added", data=book)
'''
FROM_SETTINGS = '''import app.core.config


class Shelf:
    def restock(self, settings, copies):
        for copy in copies:
            if copy.lost:
                self.line.publish("ignored", topic=settings.TOPIC_BOOKS)
'''
WRAPPER = '''def nightly():
    relay(data=None, event_type="overdue", topic="book.overdue")


class Line:
    def relay(self, topic): self.queue.publish(topic=topic)
'''
CLIENT = '''import httpx


class Members:
    base_url = None

    def __init__(self, settings):
        self.base_url, self.retries = "", 3
        self.base_url = settings.USERS_URL or ""

    def rename(self, key, card):
        with httpx.Client() as http:
            http.patch(f"/members/{key}/cards/{card.number}", timeout=5)

    def forget(self, key):
        self.session.delete("/members")
'''


CASES = []


def case(check):
    """A check that first yields its files, then gets a reader of the facts found.

    All cases are services of one extraction.
    """
    CASES.append(check)
    return check


@pytest.fixture(scope="module")
def facts(spark):
    files = [
        (check.__name__, path, text)
        for check in CASES
        for path, text in next(check()).items()
    ]
    known = [("backend", "USERS_URL", "users"), ("backend", "BILLING_URL", "billing")]
    return extract_backend(
        spark.createDataFrame(files, "service STRING, path STRING, content STRING"),
        spark.createDataFrame(known, "side STRING, env STRING, target STRING"),
    ).toPandas()


@case
def routes_and_subscriptions():
    get = yield ({"app/api/books.py": ROUTER})
    assert get(schema.HTTP_PROVIDERS) == [
        ("GET", "/api/v1/books", "app/api/books.py::list_books", 7),
        ("POST", "/api/v1/events/book.lent", "app/api/books.py::on_lent", 12),
    ]
    assert get(schema.TOPICS_SUBSCRIBED) == [("book.lent", "app/api/books.py::on_lent", 12)]


@case
def literal_topic():
    get = yield ({"app/services/a.py": LITERAL})
    assert get(schema.TOPICS_PUBLISHED) == [("book.added", None, "app/services/a.py::announce", 2)]
    assert get(schema.EXTRACTION_WARNINGS) == []


@case
def topic_from_settings_with_default():
    config = 'class Settings:\n    TOPIC_BOOKS: str = "books.all"\n'
    get = yield ({"app/services/a.py": FROM_SETTINGS, "app/core/config.py": config})
    assert get(schema.TOPICS_PUBLISHED) == [("books.all", None, "app/services/a.py::restock", 8)]
    assert get(schema.EXTRACTION_WARNINGS) == []


@case
def unresolved_topic_warns_and_is_never_dropped_silently():
    config = "class Settings:\n    TOPIC_BOOKS: str | None = None\n"
    get = yield ({"app/services/a.py": FROM_SETTINGS, "app/core/config.py": config})
    assert get(schema.TOPICS_PUBLISHED) == []
    ((kind, file, line, message),) = get(schema.EXTRACTION_WARNINGS)
    assert (kind, file, line) == ("unresolved_settings_topic", "app/services/a.py", 8)
    assert "settings.TOPIC_BOOKS" in message


@case
def publishing_through_a_helper():
    get = yield ({"app/services/a.py": WRAPPER})
    assert get(schema.TOPICS_PUBLISHED) == [("book.overdue", None, "app/services/a.py::nightly", 2)]
    ((kind, _, line, message),) = get(schema.EXTRACTION_WARNINGS)
    assert (kind, line) == ("dynamic_topic", 6)
    assert message == "topic is a dynamic expression (Name(id='topic', ctx=Load()))"


@case
def helper_calls_alone_are_not_looked_at():
    # without the text ".publish(" in the file
    get = yield ({"app/a.py": 'def f():\n    send(topic="t", event_type="x")\n'})
    assert get(schema.TOPICS_PUBLISHED) == []


@case
def dynamic_topic_text_is_cut():
    get = yield ({"app/a.py": 'def f(b, x):\n    b.publish(topic=[x, x, x, x, x, x, x, x])\n'})
    ((_, _, _, message),) = get(schema.EXTRACTION_WARNINGS)
    inside = message[len("topic is a dynamic expression ("):-1]
    assert len(inside) == 80 and inside.startswith("List(elts=[Name(id='x'")


@case
def schema_of_a_publish_site():
    events = "from pydantic import BaseModel\nclass A(BaseModel): pass\nclass B(A): pass\nclass C(BaseModel): pass\n"
    code = '''def outer(bus):
    data = B(x=C(y=A()))
    def inner():
        bus.publish(topic="t", data=data)
        A()
'''
    get = yield ({"app/schemas/events.py": events, "app/a.py": code})
    assert get(schema.EVENT_SCHEMAS) == [
        ("A", "app/schemas/events.py", 2), ("C", "app/schemas/events.py", 4),
    ]
    # breadth-first, the call in the nested function comes before the nested arguments
    assert get(schema.TOPICS_PUBLISHED) == [
        ("t", "A", "app/a.py::inner", 4), ("t", "A", "app/a.py::outer", 4),
    ]


@case
def broken_schema_file_is_a_warning():
    get = yield ({"app/schemas/events.py": "class A(:\n"})
    assert [w[:2] for w in get(schema.EXTRACTION_WARNINGS)] == [
        ("unparsable_file", "app/schemas/events.py")
    ]


@case
def too_deep_a_file_is_a_warning():
    get = yield ({"app/a.py": "x = " + "-" * 50_000 + "1\n"})
    assert [w[:2] for w in get(schema.EXTRACTION_WARNINGS)] == [("unparsable_file", "app/a.py")]


@case
def client_class():
    get = yield ({"app/services/users.py": CLIENT})
    assert get(schema.HTTP_CONSUMERS) == [
        ("users", "DELETE", "/members", "app/services/users.py::Members.forget", 16),
        ("users", "PATCH", "/members/{key}/cards/{number}", "app/services/users.py::Members.rename", 13),
    ]


@case
def client_rules():
    code = '''import httpx
class ByText:
    x = f"{settings.BILLING_URL.rstrip('/')}/never"
    def m(self):
        name = 5
        self.c.get(name)
        other = "/first"
        other = helper(other)
        self.c.get(other)
        r1 = make("/early")
        r1 = make("/late")
        a, url = r1
        self.c.post(url)
        self.c.get("no-slash")
        self.c.get(f"plain/{x}")
        self.c.get(f"{settings.UNKNOWN_URL}/u")
        self.c.get(wrap(f"{settings.USERS_URL}/w"))
        anything.get("/other")
        self.c.get(f"{self.base_url}")
    def n(self):
        self.c.delete(url)
class LateText:
    def m(self):
        self.c.get("/also")
        self.c.PUT(f"{settings.USERS_URL or 'x'}/kept")
'''
    get = yield ({"app/services/c.py": code})
    where = "app/services/c.py::ByText.m"
    assert get(schema.HTTP_CONSUMERS) == sorted([
        ("billing", "GET", "/first", where, 9),
        ("billing", "POST", "/late", where, 13),
        ("billing", "GET", "/plain/{x}", where, 15),
        ("billing", "GET", "/{UNKNOWN_URL}/u", where, 16),
        ("users", "GET", "/w", where, 17),
        ("billing", "GET", "/other", where, 18),
        ("users", "GET", "/also", "app/services/c.py::LateText.m", 24),
        ("users", "PUT", "/kept", "app/services/c.py::LateText.m", 25),
    ], key=repr)


@case
def an_unpack_takes_only_helpers_before_it():
    code = '''import httpx
class C:
    def m(self):
        url, h = r
        r = make("/late")
        self.c.get(url, f"{settings.USERS_URL}")
'''
    get = yield {"app/services/c.py": code}
    assert get(schema.HTTP_CONSUMERS) == []


@case
def client_files():
    code = 'import httpx\ndef f():\n    httpx.get(f"{settings.USERS_URL}/a")\n'
    get = yield ({
        "app/services/_private.py": code, "app/services/__init__.py": code, "app/other.py": code,
        "app/services/text.py": code.replace("httpx", "http"), "app/services/sub/ok.py": code,
    })
    assert get(schema.HTTP_CONSUMERS) == [("users", "GET", "/a", "app/services/sub/ok.py::f", 3)]


@case
def wrappers_and_singletons():
    client = '''import httpx
class Users:
    def __init__(self):
        self.url = settings.USERS_URL
    def _get(self, path):
        return self.c.get(path)
    def _post(self, path):
        return self.c.send(path)
    def proxy(self, verb, path, body=None):
        pass
    def load(self):
        self._get("/wrapped")
        self._post("/not-a-wrapper")
        other._get("/no")
users = Users()
'''
    use = '''from app.services.users import users
async def outer():
    def inner():
        return users.proxy("delete", f"/d/{x.y}")
    users.proxy(verb, "/unknown-verb")
    users.proxy("GET")
    users.patch("/p", users.get("/g"))
    users.load("/no")
users.proxy("odd", "/odd")
'''
    get = yield ({"app/services/users.py": client, "app/_use.py": use})
    assert get(schema.HTTP_CONSUMERS) == sorted([
        ("users", "GET", "/wrapped", "app/services/users.py::Users.load", 12),
        ("users", "DELETE", "/d/{y}", "app/_use.py::inner", 4),
        ("users", "PATCH", "/p", "app/_use.py::outer", 7),
        ("users", "GET", "/g", "app/_use.py::outer", 7),
    ], key=repr)
    assert [w[0] for w in get(schema.EXTRACTION_WARNINGS)] == ["unknown_method"]


@case
def last_singleton_of_a_name_counts():
    def client(env):
        return f"import httpx\nclass K:\n    def __init__(self):\n        self.url = settings.{env}\none = K()\n"

    get = yield ({
        "app/services/a.py": client("USERS_URL"), "app/services/b.py": client("BILLING_URL"),
        "app/use.py": 'one.get("/x")\n',
    })
    assert [c[0] for c in get(schema.HTTP_CONSUMERS)] == ["billing"]


@case
def multi_file_routes():
    get = yield ({
        "app/config.py": 'def f():\n    PREFIX = "/deep"\n\nPREFIX: str = "/flat"\n',
        "app/api/a.py": 'r_router = APIRouter(prefix="/a")\n@r_router.get("/x/")\ndef x(): pass\n',
        "app/api/b.py": '@router.get(path="y")\n@mock.patch("z")\ndef y(): pass\n',
        "app/api/_c.py": '@router.get("/no")\ndef no(): pass\n',
        "app/api/__init__.py": (
            "from app.api.a import r_router as ra\nfrom app.api import b\nfrom . import nothing\n"
            'top = APIRouter(prefix="//top")\ntop.include_router(ra)\n'
            'top.include_router(b.router, prefix="/b")\ntop.include_router(b.router, prefix="/second")\n'
        ),
        "app/main.py": "from app.api import top\napp.include_router(top, prefix=settings.PREFIX)\n",
    })
    assert get(schema.HTTP_PROVIDERS) == [
        ("GET", "/top/a/x", "app/api/a.py::x", 3),
        ("GET", "/top/by", "app/api/b.py::y", 3),
        ("PATCH", "/z", "app/api/b.py::y", 3),
    ]


@case
def router_suffix_import_and_settings_prefix():
    get = yield ({
        "app/core/config.py": 'class S:\n    PREFIX = "/one"\n    def f(self):\n        PREFIX = "/two"\n',
        "app/config.py": 'PREFIX = "/unused"\n',
        "app/a.py": 'a_router = APIRouter(prefix=settings.NONE)\n@a_router.head("/x")\ndef x(): pass\n',
        "app/main.py": "from app.a import a_router\napp.include_router(a_router, prefix=settings.PREFIX)\n",
    })
    assert get(schema.HTTP_PROVIDERS) == [("HEAD", "/two/x", "app/a.py::x", 3)]


@case
def a_file_stands_for_the_package_of_its_name():
    get = yield ({
        "app/a/__init__.py": '@router.get("/package")\ndef p(): pass\n',
        "app/a.py": '@router.get("/file")\ndef f(): pass\n',
        "app/b/__init__.py": '@router.get("/kept")\ndef k(): pass\n',
        "app/b.py": "def broken(:\n",
    })
    assert [p[1] for p in get(schema.HTTP_PROVIDERS)] == ["/file", "/kept"]


@pytest.mark.parametrize("check", CASES, ids=lambda c: c.__name__)
def test_case(facts, check):
    own = facts[facts["service"] == check.__name__]

    def get(name):
        found = own[own["section"] == name]
        columns = [[None if v != v else v for v in found[c]] for c in schema.SECTIONS[name]]
        return sorted(zip(*columns), key=repr)

    steps = check()
    next(steps)
    with pytest.raises(StopIteration):
        steps.send(get)


def climb(router, own, edges, seen=()):
    """Prefix of a router by walking up, one include at a time."""
    if router in seen:
        return ""
    if router not in edges:
        return own.get(router, "")
    parent, sub = edges[router]
    return climb(parent, own, edges, (*seen, router)) + sub + own.get(router, "")


def test_prefixes_on_random_include_graphs(spark):
    rng = random.Random(11)
    own, edges, names = {}, {}, []
    for service in ("s1", "s2", "s3"):
        keys = [(service, f"m{i}", "r") for i in range(40)]
        names += keys
        for key in keys:
            if rng.random() < 0.6:
                own[key] = f"/o{key[0]}{key[1]}"
            if rng.random() < 0.85:
                edges[key] = (rng.choice(keys), rng.choice(["", f"/s{key[1]}"]))
    chain = [("long", f"c{i}", "r") for i in range(12)]
    names += chain
    edges |= {chain[i]: (chain[i + 1], f"/{i}") for i in range(11)}
    wanted = spark.createDataFrame(names, "service STRING, module STRING, router STRING")
    own_df = spark.createDataFrame(
        [(*k, v) for k, v in own.items()], "service STRING, module STRING, router STRING, prefix STRING"
    )
    edge_df = spark.createDataFrame(
        [(k[0], k[1], k[2], (p[1], p[2], sub)) for k, (p, sub) in edges.items()],
        "service STRING, child_module STRING, child_router STRING, "
        "parent STRUCT<module: STRING, router: STRING, prefix: STRING>",
    )
    got = routes.full_prefixes(wanted, own_df, edge_df)
    found = {(r.service, r.module, r.router): r.prefix for r in got.collect()}
    assert found == {k: climb(k, own, edges) for k in names}


@pytest.mark.parametrize("length, rounds", [(64, 7), (1, 1), (100, 8)])
def test_a_chain_of_includes_takes_a_logarithm_of_rounds(spark, monkeypatch, length, rounds):
    staged = []
    monkeypatch.setattr(routes, "stage", lambda df, name, *by: staged.append(name) or stage(df, name, *by))
    edges = [("s", f"m{i}", "r", (f"m{i + 1}", "r", f"/{i}")) for i in range(length)]
    edge_df = spark.createDataFrame(
        edges, "service STRING, child_module STRING, child_router STRING, "
        "parent STRUCT<module: STRING, router: STRING, prefix: STRING>",
    )
    own = spark.createDataFrame([("s", f"m{length}", "r", "/top")], "service STRING, module STRING, router STRING, prefix STRING")
    wanted = spark.createDataFrame([("s", f"m{i}", "r") for i in range(length + 1)], "service STRING, module STRING, router STRING")
    found = {r.module: r.prefix for r in routes.full_prefixes(wanted, own, edge_df).collect()}
    assert found == {f"m{i}": "/top" + "".join(f"/{k}" for k in range(length - 1, i - 1, -1)) for i in range(length + 1)}
    assert staged.count("router-jumps") == rounds and "router-climb" not in staged


def test_document_order_of_calls(spark, sources, env):
    code = '''import httpx
def late(): httpx.get(f"{settings.USERS_URL}/4")
class B:
    def __init__(self): self.url = settings.USERS_URL
    def _get(self, p): return self.c.get("/1")
    def m(self):
        self._get("/3")
        self.c.get("/2")
b = B()
x = b.get("/6", b.get("/5"))
'''
    facts = extract_backend(sources({"s": {"app/services/c.py": code}}), env)
    consumers = section(facts, schema.HTTP_CONSUMERS).orderBy("ord").collect()
    assert [c.path for c in consumers] == ["/1", "/2", "/3", "/4", "/5", "/6"]


def test_many_services_at_once_and_one_with_most_files(spark, sources, env):
    services = {f"s{i}": {"app/api/r.py": ROUTER} for i in range(5)}
    services["big"] = {f"app/api/r{i}.py": ROUTER for i in range(200)}
    services["empty"] = {"README.py": ""}
    services["nested"] = {"nested/app/api/r.py": ROUTER, "other/app/x.py": ROUTER}
    facts = extract_backend(sources(services), env)
    counts = {r.service: r["count"] for r in section(facts, schema.HTTP_PROVIDERS).groupBy("service").count().collect()}
    assert counts == {**{f"s{i}": 2 for i in range(5)}, "big": 400, "nested": 2}
    assert facts.filter(F.col("section") == schema.SERVICE).count() == 8
    nested = section(facts, schema.HTTP_PROVIDERS).filter("service = 'nested'").first()
    assert nested.handler.startswith("app/api/r.py::")


def test_only_counted_tables_are_broadcast_for_routers(spark, sources):
    module = "from fastapi import APIRouter\nrouter = APIRouter(prefix=settings.P)\n"
    files = sources({
        "a": {"app/x/__init__.py": module, "app/x.py": module, "app/core/config.py": "P = '/p'"},
        "b": {"app/x.py": module, "app/config.py": "P = '/q'"},
    })
    nodes = extract.staged_nodes(files)
    found = routes.routers(routes.route_nodes(nodes), settings.route_settings(nodes, files.select("service", "path")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not any("BroadcastHashJoin" in line and ("LeftSemi" in line or "LeftAnti" in line or "setting" in line) for line in plan.splitlines())
    assert rows(found, "service", "module", "router", "prefix") == [("a", "app.x", "router", "/p"), ("b", "app.x", "router", "/q")]
