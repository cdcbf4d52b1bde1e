"""Front-end cases, all services of one extraction."""

import pytest
from pyspark.sql import functions as F

from seamline import extract_frontend, schema
from seamline.operators import frontend
from seamline.operators.impact import section
from tests.conftest import rows

CASES = []


def case(check):
    CASES.append(check)
    return check


@pytest.fixture(scope="module")
def consumers(spark):
    files = [
        (check.__name__, path, text) for check in CASES for path, text in next(check()).items()
    ]
    env = [
        ("frontend", "VITE_USERS_URL", "users"), ("frontend", "USERS_API", "users"),
        ("frontend", "billingUrl", "billing"), ("frontend", "STOCK_API", "stock"),
        ("backend", "ONLY_BACKEND", "nobody"),
    ]
    wrappers = [("object", "usersApi", "users", "/api/v1"), ("function", "billingRequest", "billing", "/api/v2")]
    routes = [
        ("POST", "/api/books", "books-a", 1), ("GET", "/api/books/{id}", "books-b", 2),
        ("GET", "/api/books/{other}", "books-c", 3), ("GET", "/api", "root", 4), ("GET", "/", "never", 5),
    ]
    facts = extract_frontend(
        spark.createDataFrame(files, "service STRING, path STRING, content STRING"),
        spark.createDataFrame(env, "side STRING, env STRING, target STRING"),
        spark.createDataFrame(wrappers, "kind STRING, name STRING, target STRING, prefix STRING"),
        spark.createDataFrame(routes, "method STRING, path STRING, service STRING, ord INT"),
    )
    return section(facts, schema.HTTP_CONSUMERS).orderBy("service", "ord").collect()


@case
def known_wrappers():
    get = yield {"a.ts": "usersApi.get(event, '/u/${id}/')\nother.get(event, '/x')\nusersApi.head(event, '/x')\n"
                         "usersApi\n.get(event, '/x')\nusersApi.put (\n event ,\n \"/u/[id]\")\n"}
    assert get() == [
        ("users", "GET", "/api/v1/u/{param}", "a.ts::usersApi.get", 1),
        ("users", "PUT", "/api/v1/u/{param}", "a.ts::usersApi.put", 6),
    ]


@case
def known_request_functions():
    get = yield {"a.vue": "billingRequest<Bill[]>(event, `/b`, { method: 'PATCH' })\n"
                          "xRequest(event, '/no')\nbillingRequest(event, '/b', { headers: {}, method: 'PUT' })\n"}
    # a method after a nested object is not seen
    assert get() == [
        ("billing", "PATCH", "/api/v2/b", "a.vue::billingRequest", 1),
        ("billing", "GET", "/api/v2/b", "a.vue::billingRequest", 3),
    ]


@case
def repeated_calls_count_once():
    get = yield {"a.js": "usersApi.get(event, '/u')\n" * 3, "b.js": "usersApi.get(event, '/u')\n"}
    assert get() == [
        ("users", "GET", "/api/v1/u", "a.js::usersApi.get", 1),
        ("users", "GET", "/api/v1/u", "b.js::usersApi.get", 1),
    ]


@case
def fetch_wrapper_with_prefix():
    get = yield {"a.ts": "const BASE = import.meta.env.VITE_USERS_URL || 'http://h:1/api/v1//?x'\n"
                         "const apiFetch = (endpoint) => fetch(`${BASE}${endpoint}`)\n"
                         "apiFetch('/a/{id}')\napiFetch(`/b/${x}`, { method: 'DELETE' })\n"}
    assert get() == [
        ("users", "GET", "/api/v1/a/{id}", "a.ts::apiFetch", 3),
        ("users", "DELETE", "/api/v1/b/{param}", "a.ts::apiFetch", 4),
    ]


@case
def digits_in_a_fallback_name_are_not_read():
    get = yield {"a.ts": "const BASE = process.env.USERS_API2 || 'http://h/api'\n"
                         "fetch(`${BASE}${endpoint}`)\napiFetch('/a')\n"}
    assert get() == []


@case
def calls_without_a_known_base_are_routed():
    get = yield {"a.tsx": "apiFetch('/api/books/7')\napiFetch('/api/books', { method: 'POST' })\n"
                          "apiFetch('/api/books/7/x', { method: 'POST' })\napiFetch('/api')\napiFetch('/elsewhere')\n"
                          "apiFetch('/api/other', { method: 'PUT' })\nfetch(`${base}/api/books/${id}`)\n"}
    # an equal method beats a longer match
    assert get() == [
        ("books-b", "GET", "/api/books/7", "a.tsx::apiFetch", 1),
        ("books-a", "POST", "/api/books", "a.tsx::apiFetch", 2),
        ("books-a", "POST", "/api/books/7/x", "a.tsx::apiFetch", 3),
        ("root", "GET", "/api", "a.tsx::apiFetch", 4),
        ("root", "PUT", "/api/other", "a.tsx::apiFetch", 6),
        ("books-b", "GET", "/api/books/{param}", "a.tsx::fetch", 7),
    ]


@case
def bases_of_template_calls():
    get = yield {
        "a.mjs": "const A = import.meta.env.VITE_USERS_URL\nconst A = process.env.STOCK_API\n"
                 "fetch(`${A}/last-wins`)\nfetch(`${x.y.A}/last-name`)\nfetch(`${process.env.USERS_API}/direct`)\n",
        "b.mjs": "fetch(`${USERS_API}/global`)\nfetch(`${config.billingUrl}/runtime`)\n"
                 "fetch(`${ONLY_BACKEND}/none`)\nfetch(`${process.env.USERS_API_TWO}/none`)\n",
        "c.mjs": "const STOCK_API = process.env.USERS_API\nfetch(`${STOCK_API}/own-name-first`)\n",
        # a longer name holds a known one
        "d.mjs": "y = process.env.USERS_API_TWO\nconst r = useRuntimeConfig().nothing\nfetch(`${a.USERS_API}/inside`)\n",
    }
    assert get() == [
        ("stock", "GET", "/last-wins", "a.mjs::fetch", 3),
        ("stock", "GET", "/last-name", "a.mjs::fetch", 4),
        ("users", "GET", "/direct", "a.mjs::fetch", 5),
        ("users", "GET", "/global", "b.mjs::fetch", 1),
        ("billing", "GET", "/runtime", "b.mjs::fetch", 2),
        ("users", "GET", "/own-name-first", "c.mjs::fetch", 2),
        ("users", "GET", "/inside", "d.mjs::fetch", 3),
    ]


@case
def files_looked_at():
    call = "usersApi.get(event, '/u')\n"
    get = yield {
        "src/node_modules/a.ts": call, "dist/a.ts": call, "src/a.md": call, ".ts": call, "a.ts/readme": call,
        "src/distant/a.jsx": call, "src/public": call, "public.ts": call,
    }
    assert [c[3] for c in get()] == ["public.ts::usersApi.get", "src/distant/a.jsx::usersApi.get"]


@case
def document_order():
    get = yield {
        "b.ts": "apiFetch('/api')\nbillingRequest(event, '/2')\nusersApi.get(event, '/1')\n",
        "b/a.ts": "usersApi.get(event, '/0')\n",
    }
    assert [c[2] for c in get()] == ["/api/v1/0", "/api/v1/1", "/api/v2/2", "/api"]


@pytest.mark.parametrize("check", CASES, ids=lambda c: c.__name__)
def test_case(consumers, check):
    steps = check()
    next(steps)
    own = [
        (c.target, c.method, c.path, c.caller, c.line)
        for c in consumers if c.service == check.__name__
    ]
    with pytest.raises(StopIteration):
        steps.send(lambda: own)


def test_only_the_kinds_asked_for_are_searched(sources):
    text = "const U = process.env.USERS_API || 'https://x.y/v1'\nfetch(`${U}${endpoint}`)\nfetch(`${U}/a`)\napiFetch('/b')"
    files = sources({"front": {"src/a.ts": text, "src/b.ts": "usersApi.get(event, '/c')"}})
    whole = frontend.frontend_matches(files)
    for kinds in (frontend.BINDING_KINDS, frontend.TARGET_KINDS, frontend.API_FETCH_KINDS, frontend.TEMPLATE_FETCH_KINDS, ("wrapper",)):
        chosen, expected = frontend.frontend_matches(files, kinds), whole.filter(whole.kind.isin(*kinds))
        assert rows(chosen, *chosen.columns) == rows(expected, *chosen.columns) != []
