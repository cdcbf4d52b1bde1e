import ast

from pyspark.sql import functions as F

from seamline.operators.syntax import py_nodes, syntax_rows
from seamline.plans import extract

SOURCE = '''
from app.core.config import settings, other as alias
import os

class Client(base.Model, Mixin):
    size: int = 4
    empty: int

    def __init__(self):
        self.url = (settings.URL or "x").rstrip("/")

    def call(self):
        async def inner():
            return go(f"{settings.A.strip()}/b/{c.d}/{e()}")
        url, rest = made

@router.get("/x")
def top(): pass

if os: 
    def not_a_unit(): run(1)
a = b = c
'''


def by_kind(rows, kind):
    return [r for r in rows if r["kind"] == kind]


def test_rows_describe_the_file():
    rows = syntax_rows(SOURCE)
    assert [(r["name"], r["source"], r["imported"]) for r in by_kind(rows, "import")] == [
        ("settings", "app.core.config", "settings"), ("alias", "app.core.config", "other"),
    ]
    assert by_kind(rows, "class")[0]["bases"] == ["Model", "Mixin"]
    functions = {r["name"]: r for r in by_kind(rows, "function")}
    assert functions["call"]["unit"]["name"] == "call"
    assert functions["inner"]["unit"]["name"] == "call"
    assert "unit" not in functions["not_a_unit"]
    assert [f["name"] for f in functions["inner"]["functions"]] == ["call", "inner"]
    (url,) = [r for r in by_kind(rows, "assign") if r.get("self_attr")]
    assert (url["self_attr"], url["peel_base"], url["peel_attr"]) == ("url", "settings", "URL")
    (unpacked,) = [r for r in by_kind(rows, "assign") if r.get("tuple_names")]
    assert unpacked["tuple_names"] == ["url", "rest"]
    (text,) = by_kind(rows, "fstring")
    assert text["value"]["parts"] == ["{param}", "/b/", "{d}", "/", "{param}"]
    assert (text["value"]["lead_base"], text["value"]["lead_attr"]) == ("settings", "A")
    (decorator,) = [r for r in rows if r.get("decorated")]
    assert decorator["decorated"]["name"] == "top"
    assert len(by_kind(rows, "annotated")) == 1  # no row without a value
    assert len(by_kind(rows, "assign")) == 2  # none for two targets


def test_order_is_breadth_first_and_children_first():
    tree = ast.parse(SOURCE)
    calls = [n.lineno for n in ast.walk(tree) if isinstance(n, ast.Call)]
    rows = by_kind(syntax_rows(SOURCE), "call")
    assert [r["line"] for r in sorted(rows, key=lambda r: r["node_id"])] == calls
    nested = syntax_rows("f(g(h()), *i(), k=j())")
    by_visit = sorted(by_kind(nested, "call"), key=lambda r: r["visit_id"])
    assert [r["func"] for r in by_visit] == ["h", "g", "i", "j", "f"]


def test_files_that_cannot_be_parsed_give_one_row():
    for text in ("x = (", "\0", "(" * 5000, "def f(:\n"):
        (row,) = syntax_rows(text)
        assert row["kind"] == "error"
    assert [r["kind"] for r in syntax_rows("")] == ["module"]


def test_odd_text_survives_the_trip(spark, sources):
    files = sources({"s": {"app/a.py": 'x = "\\ud800é"\ny = f"{a}\\udfff"\n' + "f(1)\n" * 5000}})
    rows = py_nodes(files)
    assert rows.filter("kind = 'call'").count() == 5000
    assert rows.filter("kind = 'assign' AND value.text = '?é'").count() == 1


def test_missing_text_is_skipped(spark):
    files = spark.createDataFrame(
        [("s", "app/a.py", None), ("s", "app/b.py", "x = 1")], "service STRING, path STRING, content STRING"
    )
    assert sorted(r.path for r in py_nodes(files).collect()) == ["app/b.py", "app/b.py"]


def test_very_deep_expressions(spark, sources):
    files = sources({"s": {"app/a.py": "x = " + " + ".join(["f(1)"] * 3000), "app/b.py": "-" * 50_000 + "1"}})
    found = py_nodes(files).filter("kind != 'module'").groupBy("path", "kind").count()
    assert sorted(map(tuple, found.collect())) == [
        ("app/a.py", "assign", 1), ("app/a.py", "call", 3000), ("app/b.py", "too_deep", 1),
    ]


def test_chosen_files_and_kinds_give_the_rows_a_filter_would(spark, sources):
    files = sources({"a": {"app/x.py": SOURCE, "app/y.py": "httpx = 1", "app/z.py": "def ("}, "b": {"app/x.py": "f(g(1))"}})
    whole = py_nodes(files)
    for kinds in (("call",), ("import", "function"), ("fstring", "annotated", "error"), ("class", "assign", "module")):
        chosen = py_nodes(files, F.col("path") != "app/y.py", kinds)
        expected = whole.filter((F.col("path") != "app/y.py") & F.col("kind").isin(*kinds))
        assert chosen.exceptAll(expected).isEmpty() and expected.exceptAll(chosen).isEmpty()
    two = py_nodes(files, columns=("service", "kind"))
    assert two.columns == ["service", "kind"] and sorted(two.collect()) == sorted(whole.select("service", "kind").collect())
    assert {r.path for r in py_nodes(files, F.col("has_client")).collect()} == {"app/y.py"}


def test_kinds_can_differ_by_file(spark, sources):
    files = sources({"a": {"app/x.py": SOURCE, "app/y.py": "httpx = f(1)", "app/z.py": "def ("}})
    kinds = {"call": F.lit(True), "class": F.col("path") == "app/x.py", "assign": F.col("has_client"), "error": F.lit(None) == 1}
    chosen, whole = py_nodes(files, kinds=kinds), py_nodes(files)
    wanted = (F.col("kind") == "call") | ((F.col("kind") == "class") & (F.col("path") == "app/x.py"))
    expected = whole.filter(wanted | ((F.col("kind") == "assign") & F.col("has_client")))
    assert chosen.exceptAll(expected).isEmpty() and expected.exceptAll(chosen).isEmpty()


def test_extraction_describes_only_what_operators_read(spark, sources):
    uses = "import os\nfrom a import b\nclass A:\n    x: int = 1\n    def f(self): return c.get(f'{s.t}/')\nrouter = c.R()\n"
    files = sources({"a": {
        "app/api/x.py": uses, "app/_x.py": uses, "app/services/x.py": uses + "httpx\n", "app/core/config.py": uses,
        "app/schemas/events.py": uses, "app/bad.py": "def (", "app/_deep.py": "-" * 50_000 + "1",
    }})
    found = {}
    for row in extract.staged_nodes(files).collect():
        found.setdefault(row.path, set()).add(row.kind)
    routes = {"module", "import", "assign", "call"}
    assert found == {
        "app/api/x.py": routes, "app/_x.py": {"call"}, "app/services/x.py": routes | {"class", "function", "fstring"},
        "app/core/config.py": routes | {"annotated"}, "app/schemas/events.py": routes | {"class"},
        "app/_deep.py": {"too_deep"},
    }
