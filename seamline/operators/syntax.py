"""Python files → syntax rows.

With ``search``, the only Python in the data path.  It parses each file once with the standard
``ast`` module and *describes* what is there: imports, classes, functions,
assignments, calls and f-strings, each with the scopes around it.  It decides
nothing; what counts as a route, a client call or a published topic is left to
the joins and aggregates in the other operators.

``node_id`` numbers the rows of a file breadth-first and ``visit_id``
depth-first with children before parents.  The first orders most facts and all
first-wins / last-wins rules, the second orders singleton calls.
"""

from __future__ import annotations

import ast
import gc
import sys
from collections.abc import Iterable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from seamline import fixed
from seamline.schema import PY_NODES, struct_type

# Ship the parser with the task: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ROWS_PER_BATCH = 1024
_ALLOCATIONS_PER_COLLECTION = 200_000  # trees and rows are no cycles, and are freed without a collection
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_SCOPES = (ast.ClassDef, *_FUNCTIONS)
_DUMP_KEYWORD = "topic"
_DUMP_WIDTH = fixed.DYNAMIC_TOPIC_WIDTH


_NO_ANCHOR = (None, None)
_SHOWN_BY = {ast.Name: "id", ast.Attribute: "attr"}


def _anchor(node):
    """``(name, attribute)`` that an expression hangs on.

    A method call hangs on what its object hangs on, a fallback on its first operand.
    """
    while True:
        kind = node.__class__
        if kind is ast.Attribute:
            return (node.value.id, node.attr) if node.value.__class__ is ast.Name else _NO_ANCHOR
        if kind is ast.Call and node.func.__class__ is ast.Attribute:
            node = node.func.value
        elif kind is ast.BoolOp and node.op.__class__ is ast.Or:
            node = node.values[0]
        else:
            return _NO_ANCHOR


def _name(node):
    return node.id if node.__class__ is ast.Name else None


_KIND_OF = {ast.JoinedStr: "fstr", ast.Name: "name", ast.Attribute: "attr", ast.Call: "call"}


def _kind(node):
    if node.__class__ is ast.Constant:
        return "str" if node.value.__class__ is str else "const"
    return _KIND_OF.get(node.__class__, "other")


def _fstring_parts(pieces):
    """The pieces of an f-string, expressions shown by their last name."""
    for piece in pieces:
        inner = getattr(piece, "value", None)
        if isinstance(piece, ast.FormattedValue):
            shown = getattr(inner, _SHOWN_BY.get(type(inner), ""), fixed.UNNAMED_PART)
            yield _text(f"{{{shown}}}")
        else:
            yield _text(str(inner))


def _text(text):
    """Text that Arrow can hold: lone surrogates become question marks."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def _expression(node, dump=False):
    """Describe an expression; for nested calls, the innermost first argument."""
    leaf = node
    while leaf.__class__ is ast.Call and leaf.args:
        leaf = leaf.args[0]
    shown = _kind(leaf)
    out = {"kind": shown if leaf is node else _kind(node), "leaf": shown}
    if shown == "str":
        out["text"] = _text(leaf.value)
    elif shown == "name":
        out["text"] = leaf.id
    elif shown == "attr":
        out["text"], out["base"] = leaf.attr, _name(leaf.value)
    elif shown == "fstr":
        out["parts"] = list(_fstring_parts(leaf.values))
        if leaf.values and leaf.values[0].__class__ is ast.FormattedValue:
            out["lead_base"], out["lead_attr"] = _anchor(leaf.values[0].value)
    if dump:
        out["dump"] = _text(ast.dump(node)[:_DUMP_WIDTH])
    return out


def _call(node):
    """Describe a call."""
    topic = any(k.arg == _DUMP_KEYWORD for k in node.keywords)
    out = {
        "func": _name(node.func),
        "nargs": len(node.args),
        "keywords": [
            {"arg": k.arg, "value": _expression(k.value, topic and k.arg == _DUMP_KEYWORD)}
            for k in node.keywords
        ],
    }
    if isinstance(node.func, ast.Attribute):
        out["attr"], out["recv"] = node.func.attr, _name(node.func.value)
    for number, arg in enumerate(node.args[:2]):
        out[f"arg{number}"] = _expression(arg)
    return out


def _import_rows(node, parent):
    if not node.module or not isinstance(parent, ast.Module):
        return []
    return [
        {"kind": "import", "name": a.asname or a.name, "source": node.module, "imported": a.name}
        for a in node.names
    ]


def _class_rows(node, parent):
    bases = [getattr(b, "attr", None) or _name(b) or "" for b in node.bases]
    return [{"kind": "class", "name": node.name, "bases": bases}]


def _function_rows(node, parent):
    return [{"kind": "function", "name": node.name, "params": [a.arg for a in node.args.args]}]


def _fstring_rows(node, parent):
    value = _expression(node)
    return [{"kind": "fstring", "value": value}] if value.get("lead_attr") else []


def _assignment(kind, target, value):
    row = {"kind": kind, "name": _name(target), "value": _expression(value)}
    row["peel_base"], row["peel_attr"] = _anchor(value)
    if isinstance(value, ast.Call):
        row |= _call(value)
    if isinstance(target, ast.Attribute) and _name(target.value) == "self":
        row["self_attr"] = target.attr
    if isinstance(target, ast.Tuple):
        row["tuple_names"] = [_name(e) for e in target.elts if _name(e)]
    return [row]


def _assign_rows(node, parent):
    return _assignment("assign", node.targets[0], node.value) if len(node.targets) == 1 else []


def _annotated_rows(node, parent):
    return _assignment("annotated", node.target, node.value) if node.value else []


# Node type -> the rows a node gives rise to: none, one, or one per imported name.
# The module itself has a row, so that every parsed file has at least one.
_DESCRIBED = {
    ast.Module: lambda node, parent: [{"kind": "module"}],
    ast.ImportFrom: _import_rows,
    ast.ClassDef: _class_rows,
    ast.FunctionDef: _function_rows,
    ast.AsyncFunctionDef: _function_rows,
    ast.Call: lambda node, parent: [{"kind": "call", **_call(node)}],
    ast.JoinedStr: _fstring_rows,
    ast.Assign: _assign_rows,
    ast.AnnAssign: _annotated_rows,
}


# Node type -> the kind of its rows, and how many it has without describing them.
_KINDS = {
    ast.Module: ("module", lambda node, parent: 1),
    ast.ImportFrom: (
        "import", lambda node, parent: len(node.names) if node.module and isinstance(parent, ast.Module) else 0
    ),
    ast.ClassDef: ("class", lambda node, parent: 1),
    ast.FunctionDef: ("function", lambda node, parent: 1),
    ast.AsyncFunctionDef: ("function", lambda node, parent: 1),
    ast.Call: ("call", lambda node, parent: 1),
    ast.JoinedStr: ("fstring", lambda node, parent: len(_fstring_rows(node, parent))),
    ast.Assign: ("assign", lambda node, parent: int(len(node.targets) == 1)),
    ast.AnnAssign: ("annotated", lambda node, parent: int(node.value is not None)),
}


def _rows_of(node, parent, kinds):
    """The rows of a node; ``None`` stands for each row of a kind that is not wanted."""
    kind, count = _KINDS[node.__class__]
    if kinds is None or kind in kinds:
        return _DESCRIBED[node.__class__](node, parent)
    return [None] * count(node, parent)


# Nodes with nothing described in them: names, constants, operators and the like.
_LEAVES = {ast.Name, ast.Constant, ast.alias, ast.Pass, ast.Break, ast.Continue}
for _group in (ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop):
    _LEAVES.update(_group.__subclasses__())


# Fields that hold names, numbers and the like, or leaves only, whatever the node.
_PLAIN_FIELDS = {
    "id", "attr", "arg", "ctx", "op", "ops", "names", "module", "level", "asname", "kind", "conversion",
    "type_comment", "type_ignores", "is_async", "simple", "rest", "kwd_attrs",
}
_PLAIN = {str, int, float, complex, bool, bytes, type(None), type(...)}
_PASSED = _LEAVES | _PLAIN
_FIELDS = {
    kind: tuple(field for field in kind._fields if field not in _PLAIN_FIELDS)
    for kind in vars(ast).values()
    if isinstance(kind, type) and issubclass(kind, ast.AST) and not issubclass(kind, ast.Constant)
}


def _walk(tree):
    """Lists, one for each depth, of ``(visit, node, parent, scopes, decorated)``.

    Only of nodes that are described.  The last child is entered first, so a list holds a
    depth from its last node to its first, and ``visit`` counts nodes from the one that a
    walk leaves last, with children before parents, to the one it leaves first.  ``scopes``
    holds the classes and functions around a node with their parents, itself included.
    """
    levels, visits = [], 0
    stack = [(tree, None, 0, (), None)]
    while stack:
        node, parent, depth, scopes, decorated = stack.pop()
        kind = node.__class__
        decorators = ()
        if kind in _DESCRIBED:
            if kind in _SCOPES:
                scopes = (*scopes, (node, parent))
                if kind in _FUNCTIONS:
                    decorators = node.decorator_list
            while len(levels) <= depth:
                levels.append([])
            levels[depth].append((visits, node, parent, scopes, decorated))
            visits += 1
        depth += 1
        for field in _FIELDS[kind]:
            value = getattr(node, field, None)
            inner = value.__class__
            if inner is list:
                owner = node if decorators and value is decorators else None
                for child in value:
                    if child.__class__ not in _PASSED:
                        stack.append((child, node, depth, scopes, owner))
            elif inner not in _PASSED:
                stack.append((value, node, depth, scopes, None))
    return levels, visits


def syntax_rows(content: str, kinds: frozenset | None = None) -> list[dict]:
    """Syntax rows of one file; a single ``error`` row if it is no Python.

    A file that only the parser's limits refuse gives one ``too_deep`` row.  With
    ``kinds`` only rows of these are described, with the numbers they have among all.
    """
    rows = _syntax_rows(content, kinds)
    return rows if kinds is None else [row for row in rows if row["kind"] in kinds]


def _syntax_rows(content, kinds):
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError) as error:
        line = getattr(error, "lineno", None) or 0
        text = str(getattr(error, "msg", None) or error)
        return [{"kind": "error", "line": line, "name": text, "node_id": 0, "visit_id": 0}]
    except (RecursionError, MemoryError):
        text = "nested too deeply"
        return [{"kind": "too_deep", "line": 0, "name": text, "node_id": 0, "visit_id": 0}]

    levels, visits = _walk(tree)
    number, around, rows, place = {}, {}, [], 0
    for level in levels:
        for visit, node, parent, scopes, decorated in reversed(level):
            if node.__class__ in _SCOPES:
                number[id(node)] = place
            described = _rows_of(node, parent, kinds)
            for row in described:
                if row is not None:
                    row["node_id"], row["visit_id"] = place, visits - 1 - visit
                    row["line"] = getattr(node, "lineno", 0)
                    row["parent"] = parent.__class__.__name__
                    if (inside := around.get(id(scopes))) is None:
                        inside = around[id(scopes)] = _around(scopes, number)
                    row |= inside
                    if decorated is not None:
                        row["decorated"] = {"name": decorated.name, "line": decorated.lineno}
                    rows.append(row)
                place += 1
    return rows


def _around(scopes, number):
    """What the rows inside these scopes share."""
    out = {
        "functions": [{"id": number[id(s)], "name": s.name} for s, _ in scopes if s.__class__ in _FUNCTIONS]
    }
    for level, (scope, owner) in enumerate(scopes[:2]):
        described = {"id": number[id(scope)], "name": scope.name}
        if level == 0 and scope.__class__ is ast.ClassDef and owner.__class__ is ast.Module:
            out["top_class"] = described
        if scope.__class__ in _FUNCTIONS and (
            owner.__class__ is ast.Module
            or (level == 1 and "top_class" in out and owner is scopes[0][0])
        ):
            out.setdefault("unit", described)
    return out


def py_nodes(
    files: DataFrame, scanned: Column | None = None, kinds: Iterable[str] | dict[str, Column] | None = None,
    columns: Iterable[str] | None = None,
) -> DataFrame:
    """Syntax rows of every file of ``files(service, path, content)``.

    Files are parsed where they are read: no shuffle, and the text itself never
    leaves the parsing task.  What reads only some of the rows can say so: ``scanned``
    is a condition on files, on the columns that rows have of their file, ``kinds``
    are the kinds of rows, each with such a condition on files if they differ, and
    ``columns`` what is handed over of a row.  The rows are those that a filter of all
    rows would leave.
    """
    by_file = isinstance(kinds, dict)
    everywhere = None if kinds is None else frozenset(kinds)
    schema = struct_type(PY_NODES)
    if columns is not None:
        schema = StructType([schema[name] for name in columns])
    arrow_schema = to_arrow_schema(schema)

    def parse(batches):
        if not gc.get_freeze_count():  # what is loaded stays: collections look at trees and rows only
            gc.freeze()
        gc.set_threshold(_ALLOCATIONS_PER_COLLECTION)
        chosen = {}
        for batch in batches:
            rows = []
            *about, contents = batch.columns
            names = batch.schema.names[: len(about)]
            described = zip(*[column.to_pylist() for column in about])
            for values, content in zip(described, contents):  # one file's text at a time
                file, wanted = dict(zip(names, values)), everywhere
                if by_file:
                    flags = file.pop("kinds")
                    if flags not in chosen:
                        chosen[flags] = frozenset(flags.split())
                    wanted = chosen[flags]
                for row in syntax_rows(content.as_py(), wanted):
                    row |= file
                    rows.append(row)
                if len(rows) >= _ROWS_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema)

    wanted = files.filter(F.col("content").isNotNull()).select(
        "service",
        "path",
        F.contains("content", F.lit(fixed.PUBLISH_TEXT)).alias("has_publish"),
        F.contains("content", F.lit(fixed.CLIENT_TEXT)).alias("has_client"),
        "content",
    )
    if scanned is not None:
        wanted = wanted.filter(scanned)
    if by_file:
        named = F.concat_ws(" ", *[F.when(condition, kind) for kind, condition in kinds.items()])
        wanted = wanted.select(*wanted.columns[:-1], named.alias("kinds"), "content")
    return wanted.mapInArrow(parse, schema)
