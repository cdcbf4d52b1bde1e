import random
import re

import pytest

from seamline.operators import resolve
from seamline.operators.resolve import resolve_routes


def segments(path):
    for pattern in (r"\{[^}]+\}", r"\[[^\]]+\]", r"\$\{[^}]+\}"):
        path = re.sub(pattern, "{param}", path)
    return path.strip("/").split("/")


def expected(method, path, routes):
    """Compare with every route."""
    call, best = segments(path), None
    if call == [""]:
        return None
    for place, (route_method, route, service) in enumerate(routes):
        parts = segments(route)
        if parts == [""] or len(parts) > len(call):
            continue
        if all(r in ("{param}", c) for r, c in zip(parts, call)):
            score = len(parts) + (1000 if route_method == method.upper() else 0)
            if best is None or score > best[0]:
                best = (score, service)
    return best and best[1]


@pytest.mark.parametrize("masks, buckets", [(4096, 1 << 20), (3, 4)])
def test_same_as_comparing_with_every_route(spark, monkeypatch, masks, buckets):
    """Masks tried in several passes and buckets that hold many keys change nothing."""
    monkeypatch.setattr(resolve, "_MASKS", masks)
    monkeypatch.setattr(resolve, "_BUCKETS", buckets)
    rng = random.Random(3)
    words = ["a", "b", "{id}", "[x]", "${y}", "{}", "", "c"]
    paths = lambda n: ["/" + "/".join(rng.choice(words) for _ in range(rng.randrange(0, 5))) + rng.choice(["", "/"]) for _ in range(n)]
    methods = ["GET", "POST", "get", "Put"]
    routes = [(rng.choice(methods[:2]), p, f"s{i}") for i, p in enumerate(paths(120))]
    calls = [(rng.choice(methods), p) for p in paths(500)] + [("GET", "{param}/a"), ("GET", "/a/{param}/b")]
    route_df = spark.createDataFrame(
        [(*r, i) for i, r in enumerate(routes)], "method STRING, path STRING, service STRING, ord INT"
    )
    call_df = spark.createDataFrame(calls, "method STRING, path STRING")
    got = {(r.method, r.path): r.target for r in resolve_routes(call_df, route_df).collect()}
    wanted = {c: expected(*c, routes) for c in calls}
    assert got == {c: t for c, t in wanted.items() if t is not None}
    assert len(got) > 100


def test_a_popular_prefix_keeps_all_calls(spark):
    routes = spark.createDataFrame([("GET", "/hot", "hot", 0)], "method STRING, path STRING, service STRING, ord INT")
    calls = spark.range(20000).selectExpr("'GET' AS method", "concat('/hot/', id) AS path")
    assert resolve_routes(calls, routes).filter("target = 'hot'").count() == 20000


def test_calls_are_shuffled_by_route_key_only(spark):
    """No exchange deals rows out by a length, and keys are sifted before they are dealt out."""
    routes = spark.createDataFrame(
        [("GET", f"/a/{n}/{{id}}", "s", n) for n in range(50)], "method STRING, path STRING, service STRING, ord INT"
    )
    calls = spark.range(1000).selectExpr("'GET' AS method", "concat('/a/', id, '/x/y') AS path")
    found = resolve_routes(calls, routes)
    plan = found._jdf.queryExecution().toString()
    assert "hashpartitioning(length" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "LeftSemi" in plan and found.count() == 50


def test_no_routes_and_no_calls(spark):
    some = spark.createDataFrame([("GET", "/a", "s", 0)], "method STRING, path STRING, service STRING, ord INT")
    calls = some.select("method", "path")
    assert resolve_routes(calls, some.limit(0)).count() == 0
    assert resolve_routes(calls.limit(0), some).count() == 0
