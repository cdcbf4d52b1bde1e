import random
import re

import pytest
from pyspark.sql import functions as F

from seamline import fixed
from seamline.functions import regex
from seamline.functions.regex import group_values, markable, marked_pieces, matches

PATTERNS = [
    (fixed.WRAPPER_CALL, 3),
    (fixed.REQUEST_CALL, 3),
    (fixed.API_FETCH_CALL, 2),
    (fixed.TEMPLATE_FETCH_CALL, 3),
    (fixed.ENV_CONSTANT, 2),
    (fixed.RUNTIME_CONFIG, 1),
]
PIECES = [
    "usersApi.get(event, '/a')", "x.usersApi.post( event ,\n `/b/${c}`)", "éusersApi.put(event, '/a')",
    "aRequest<T>(event, '/r', { method: 'POST' })", "bRequest\n(event,\"/r\", {a: {}, method: 'PUT'})",
    "apiFetch('/x')", "apiFetch<A>(`/x/${y}`, {\n body, method: \"DELETE\"\n})", "éapiFetch('/no')",
    "fetch(`${BASE}/p`)", "fetch(`${a.b.C}/p/${d}`, { method: 'PATCH' })", "const A = import.meta.env.VITE_B",
    "const  c1 =\nprocess.env.X_1", "useRuntimeConfig().key", "config.other", "myconfig.no", "\n", "\n\n", " ",
    "text", "'", "`", "{", "}", "$1\\", "é\u00a0", "'/a\nb'",
]


def expected(text, pattern, groups):
    return [
        (text.count("\n", 0, m.start()) + 1, [m.group(i + 1) or "" for i in range(groups)])
        for m in re.finditer(pattern, text)
    ]


@pytest.mark.parametrize("pattern, groups", PATTERNS)
def test_same_matches_and_lines_as_a_plain_search(spark, pattern, groups):
    rng = random.Random(7)
    texts = ["", *PIECES] + [
        "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 40))) for _ in range(300)
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    cut = df.withColumn("cut", marked_pieces(F.col("t"), pattern, list(range(1, groups + 1))))
    found = cut.select("i", F.transform(matches(F.col("cut")), lambda m: F.struct(
        m["pos"], m["line"], group_values(m["groups"]).alias("groups"))).alias("m"))
    got = {r.i: [(m.line, list(m.groups)) for m in r.m] for r in found.collect()}
    assert got == {i: expected(t, pattern, groups) for i, t in enumerate(texts)}


def test_marks_in_a_text_are_kept(spark):
    odd = "".join(map(chr, range(0xFDD0, 0xFDD8)))
    text = f"apiFetch('/a{odd}b')\n{odd}apiFetch('/c{odd[3]}{odd[5]}')"
    df = spark.createDataFrame([(text,)], "t STRING").select(markable(F.col("t")).alias("t"))
    found = df.withColumn("cut", marked_pieces(F.col("t"), fixed.API_FETCH_CALL, [1]))
    rows = found.select(F.explode(matches(F.col("cut"))).alias("m"))
    got = rows.select("m.line", group_values(F.col("m.groups"))[0]).collect()
    assert [tuple(r) for r in got] == [(1, f"/a{odd}b"), (2, f"/c{odd[3]}{odd[5]}")]


def test_many_matches_in_a_large_text(spark):
    text = "".join("x" * 50 + "\n" + f"apiFetch('/p{i}')" for i in range(100_000))
    df = spark.createDataFrame([(text,)], "t STRING")
    cut = df.withColumn("cut", marked_pieces(F.col("t"), fixed.API_FETCH_CALL, [1]))
    (row,) = cut.select(matches(F.col("cut")).alias("m")).collect()
    assert [(m.line, m.groups) for m in row.m] == [(i + 2, f"/p{i}") for i in range(100_000)]


def test_quick_patterns_match_the_same(spark):
    assert regex.quick(r"\bgo\s*\(") == r"go(?<=\bgo)\s*\(" and regex.quick(r"a\b") == r"a\b"
    texts = ["go(1) xgo(2) _go (3) égo(4) -go(5)", "é́go(1) égo(2) ́go(3)", "a.b é.c éa.d 1a.e ña.f́a.g _a.h-a.i", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for pattern in (r"\bgo\s*\((\d)", r"\b([a-zA-Z_][a-zA-Z0-9_]*)\.([a-z])"):
        assert regex.quick(pattern) != pattern
        both = df.select(*[F.regexp_replace("t", "(?U)" + p, "<$1>") for p in (pattern, regex.quick(pattern))])
        assert all(row[0] == row[1] for row in both.collect())


@pytest.mark.parametrize("count", [255, 256, 257])
def test_lines_of_few_and_of_many_matches(spark, count):
    text = "\n" + "".join(f"\n-x{n}" * (n % 2) + f"x{n}" for n in range(count))
    pieces = spark.createDataFrame([(text,)], "t STRING").select(regex.marked_pieces(F.col("t"), r"x(\d+)", [1]).alias("p"))
    found = pieces.select(regex.matches(F.col("p")).alias("m")).first().m
    expected = [(text[: m.start()].count("\n") + 1, m[1]) for m in re.finditer(r"x(\d+)", text)]
    assert [(m.line, m.groups) for m in found] == expected and [m.pos for m in found] == list(range(len(expected)))
