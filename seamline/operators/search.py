"""All matches of the front-end patterns in a text, with groups and line numbers.

A pattern that starts with a name or a word boundary is slow to search for, as it is tried
at every letter.  What follows the name is searched for instead, and what stands before it
is looked at then.  Matches are those of the whole patterns in ``fixed``, one after the other.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle

from seamline import fixed

# Ship the search with the task: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ROWS_PER_BATCH = 8192
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_NAME = r"\b([a-zA-Z_][a-zA-Z0-9_]*"
_NAME_CHARACTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
_DIGITS = frozenset("0123456789")
_WORD_CATEGORIES = {"Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "Pc"}


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(r"\s", _SPACE))


def _starts_word(text: str, at: int) -> bool:
    """Whether no character of a word stands before ``at``."""
    if not at or (before := text[at - 1]) in _NAME_CHARACTERS:
        return not at
    return before.isascii() or not (
        unicodedata.category(before) in _WORD_CATEGORIES or before in "\u200c\u200d" or "\u24b6" <= before <= "\u24e9"
    )


# Where a match begins, of which ``found`` is what was searched for and nothing before
# ``floor``, the end of the match before, can be a part; -1 if there is no match.


def _here(text: str, found: re.Match, floor: int) -> int:
    return found.start()


def _at_word(text: str, found: re.Match, floor: int) -> int:
    return found.start() if _starts_word(text, found.start()) else -1


def _after_name(text: str, found: re.Match, floor: int) -> int:
    start = end = found.start()
    while start > floor and text[start - 1] in _NAME_CHARACTERS:
        start -= 1
    return start if start < end and text[start] not in _DIGITS and _starts_word(text, start) else -1


def _after_environment(text: str, found: re.Match, floor: int) -> int:
    for owner in ("process", "import.meta"):
        if text.endswith(owner, floor, found.start()):
            return found.start() - len(owner)
    return -1


def _in_config(text: str, found: re.Match, floor: int) -> int:
    if found[1]:
        called = text.endswith("useRuntimeC", floor, found.start())
        return found.start() - len("useRuntimeC") if called else -1
    start = found.start() - 1
    return start if start >= floor and text[start] == "c" and _starts_word(text, start) else -1


# kind -> (what is searched for, where the match begins, groups for name, method, route);
# a name of group 0 is what stands before the part searched for, and what ends it there.
_Begin = Callable[[str, re.Match, int], int]
_SEARCHES: dict[str, tuple[re.Pattern, _Begin, str | None, tuple[int, int, int]]] = {
    "wrapper": (_compiled(fixed.WRAPPER_CALL.removeprefix(_NAME + ")")), _after_name, "", (0, 1, 2)),
    "request": (
        _compiled("Request" + fixed.REQUEST_CALL.removeprefix(_NAME + "Request)")), _after_name, "Request", (0, 2, 1)
    ),
    "api_fetch": (_compiled(fixed.API_FETCH_CALL.removeprefix(r"\b")), _at_word, None, (0, 2, 1)),
    "template_fetch": (_compiled(fixed.TEMPLATE_FETCH_CALL.removeprefix(r"\b")), _at_word, None, (1, 3, 2)),
    "env_constant": (_compiled(fixed.ENV_CONSTANT), _here, None, (1, 0, 2)),
    "env_access": (
        _compiled(fixed.ENV_ACCESS.removeprefix(r"(?:process\.env|import\.meta\.env)").join((r"\.env", ""))),
        _after_environment, None, (1, 0, 0),
    ),
    "runtime_config": (
        _compiled(r"onfig(\(\))?" + fixed.RUNTIME_CONFIG.removeprefix(r"(?:useRuntimeConfig\(\)|\bconfig)")),
        _in_config, None, (2, 0, 0),
    ),
}
_DEFINITION, _URL_PATH = _compiled(fixed.API_FETCH_DEFINITION), _compiled(fixed.URL_PATH)
_FALLBACK_URL = fixed.FALLBACK_URL


def found_in(text: str, kind: str) -> Iterator[tuple]:
    """``(pos, line, name, method, route)`` of every match of a kind; None for an empty group."""
    pattern, begin, suffix, (name, method, route) = _SEARCHES[kind]
    search = pattern.search
    at = floor = counted = pos = 0
    line = 1
    while found := search(text, at):
        start = begin(text, found, floor)
        if start < 0:
            at = found.start() + 1
            continue
        line += text.count("\n", counted, start)
        counted = start
        if suffix is not None:
            named = text[start : found.start()] + suffix
        else:
            named = found[name] or None if name else None
        yield pos, line, named, found[method] or None if method else None, found[route] or None if route else None
        pos += 1
        at = floor = found.end()


def definition_in(text: str) -> tuple[str, str | None] | None:
    """Base of a file's own ``apiFetch`` wrapper, and the prefix of its fallback URL."""
    found = _DEFINITION.search(text) if "${endpoint" in text else None
    if not found:
        return None
    constant = _compiled(_FALLBACK_URL % found[1].rpartition(".")[2]).search(text)
    url = _URL_PATH.search(constant[1]) if constant else None
    return found[1], url[1].rstrip("/") if url else None


def search_rows(batches: Iterable[pa.RecordBatch], kinds: Iterable[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of the matches in ``(service, path, content)``, by file and kind."""
    searched = [kind for kind in _SEARCHES if kind in kinds]
    for batch in batches:
        services, paths, contents = batch.columns
        files, rows = [], []

        def made():
            of_file = pa.array(files, pa.int32())
            columns = [pa.array(column, field.type) for column, field in zip(zip(*rows), list(schema)[2:])]
            return pa.RecordBatch.from_arrays([services.take(of_file), paths.take(of_file), *columns], schema=schema)

        for file, content in enumerate(contents):  # one file's text at a time
            text, before = content.as_py(), len(rows)
            if "definition" in kinds and (own := definition_in(text)):
                rows.append(("definition", 0, 0, own[0], None, own[1]))
            for kind in searched:
                rows += [(kind, *match) for match in found_in(text, kind)]
            files += [file] * (len(rows) - before)
            if len(rows) >= _ROWS_PER_BATCH:
                yield made()
                files, rows = [], []
        if rows:
            yield made()
