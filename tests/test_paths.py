import re

import pytest
from pyspark.sql import functions as F

from seamline.functions import paths

PATHS = [
    "", "/", "//", "/a", "/a/", "a//b/", "/a/{id}/b", "/a/{}/b", "/a/{x{y}z}/", "/a/{open", "/[id]/${x}/",
    "/${a.b}", "/{a}${b}[c]", "/é/{ü}/", "/a/{x\ny}/",
]


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def drop_slash(path):
    return path[:-1] if len(path) > 1 and path.endswith("/") else path


def expected_match(path):
    out, rest = "", path
    while "{" in rest and "}" in rest[rest.index("{"):]:
        start = rest.index("{")
        out, rest = out + rest[:start] + "{param}", rest[rest.index("}", start) + 1:]
    return out + rest


def expected_router(path):
    for pattern in (r"\{[^}]+\}", r"\[[^\]]+\]", r"\$\{[^}]+\}"):
        path = re.sub(pattern, "{param}", path)
    return drop_slash(path)


def expected_frontend(path):
    for pattern in (r"\$\{[^}]+\}", r"\[[^\]]+\]"):
        path = re.sub(pattern, "{param}", path)
    return drop_slash(path)


def expected_route(path):
    return drop_slash(re.sub("/+", "/", "/" + path))


@pytest.mark.parametrize(
    "function, expected",
    [
        (paths.match_path, expected_match),
        (paths.router_path, expected_router),
        (paths.frontend_path, expected_frontend),
        (paths.route_path, expected_route),
    ],
)
def test_normalisers(spark, function, expected):
    assert apply(spark, function, PATHS) == [expected(p) for p in PATHS]


def test_file_module(spark):
    files = ["app/main.py", "app/api/__init__.py", "__init__.py", "app/a.py/b.pyi"]
    assert apply(spark, paths.file_module, files) == [
        "app.main", "app.api", "__init__", "app.a.py.b.pyi",
    ]


def test_questions(spark):
    texts = ["GET /a", "  get \t /a b ", "GET", "", "/a", "get\n/x/{y}"]
    assert apply(spark, paths.question_method, texts) == ["GET", "GET", None, None, None, "GET"]
    assert apply(spark, paths.question_path, texts) == ["/a", "/a b", None, None, None, "/x/{y}"]


def test_files_sort_by_component(spark):
    files = ["a.py", "a/x.py", "a/__init__.py", "a-b/x.py", "a/b/c.py"]
    df = spark.createDataFrame([(f,) for f in files], "f STRING")
    got = [r.f for r in df.orderBy(paths.file_order(F.col("f"))).collect()]
    assert got == sorted(files, key=lambda f: f.split("/"))
    assert got != sorted(files)


def test_location(spark):
    df = spark.createDataFrame([("a", 1), (None, None)], "p STRING, l INT")
    assert [r[0] for r in df.select(paths.location(F.col("p"), F.col("l"))).collect()] == ["a:1", "None:None"]
