"""All matches of a pattern in a text, with groups and line numbers.

Spark has no match offsets.  One ``regexp_replace`` puts marks around every match
and copies its groups in front of it; splitting at the marks then gives the groups,
and newlines counted over the pieces give the line.  The pattern runs once per text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# (?U): \b and \s follow Unicode, as they do in the code bases' own tooling.
_UNICODE = "(?U)"

# Unicode noncharacters: no text meant for interchange holds them.
_START, _NEXT, _MATCH = "﷐", "﷑", "﷒"
_MARKS = _START + _NEXT + _MATCH

# What stands for a mark, or the escape itself, in a text that holds one all the same.
_ESCAPE = "﷓"
_STAND_INS = {
    _ESCAPE: _ESCAPE + "﷔",
    _START: _ESCAPE + "﷕",
    _NEXT: _ESCAPE + "﷖",
    _MATCH: _ESCAPE + "﷗",
}

_BLOCK = 256


def markable(text: Column) -> Column:
    """``text`` with the marks it holds itself escaped; ``restored`` undoes it."""
    escaped = text
    for mark, stand_in in _STAND_INS.items():
        escaped = F.replace(escaped, F.lit(mark), F.lit(stand_in))
    return F.when(F.rlike(text, F.lit(f"[{_MARKS}{_ESCAPE}]")), escaped).otherwise(text)


def restored(text: Column) -> Column:
    """A part of a ``markable`` text as it was."""
    plain = text
    for mark, stand_in in reversed(_STAND_INS.items()):
        plain = F.replace(plain, F.lit(stand_in), F.lit(mark))
    return F.when(F.contains(text, F.lit(_ESCAPE)), plain).otherwise(text)


def newlines(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def quick(pattern: str) -> str:
    r"""The same matches of a pattern that starts with ``\b``, which is slow on Unicode.

    A word after it is searched for first, and what is before it looked at then.  Before a
    class of ASCII letters, whether an ASCII letter follows and none precedes is asked first.
    """
    if word := re.match(r"\\b([A-Za-z]+)(?![*+?{|\w])", pattern):
        return f"{word[1]}(?<=\\b{word[1]}){pattern[word.end():]}"
    if pattern.startswith(r"\b([a-zA-Z_]"):
        return r"(?=[a-zA-Z_])(?<![a-zA-Z0-9_])" + pattern
    return pattern


def marked_pieces(text: Column, pattern: str, groups: list[int]) -> Column:
    """``text`` cut at its matches, with the numbered groups copied in.

    ``text`` must be ``markable``.  Make this a column of its own before passing it
    to ``matches``, so that the pattern runs once.
    """
    copies = _NEXT.join(f"${number}" if number else "" for number in groups)
    marked = F.regexp_replace(text, _UNICODE + quick(pattern), f"{_START}{copies}{_MATCH}$0")
    return F.split(marked, _START, -1)


def _after(piece: Column) -> Column:
    """A piece without its mark: the match and the text up to the next one."""
    return F.substring_index(piece, _MATCH, -1)


def _numbered(block: Column, line: Column) -> Column:
    """Matches of a block of pieces that starts on ``line``."""

    def add(state: Column, piece: Column) -> Column:
        entry = F.struct(
            state["line"].alias("line"), F.substring_index(piece, _MATCH, 1).alias("groups")
        )
        return F.struct(
            (state["line"] + newlines(_after(piece))).alias("line"),
            F.array_append(state["found"], entry).alias("found"),
        )

    empty = F.array().cast("array<struct<line:int,groups:string>>")
    start = F.struct(line.alias("line"), empty.alias("found"))
    return F.aggregate(block, start, add, lambda state: state["found"])


def matches(pieces: Column) -> Column:
    """Array of ``struct(pos, line, groups)``, one entry per match; see ``group_values``.

    Running totals of many pieces go block by block, as growing one long array entry by
    entry would copy it each time.
    """
    first = newlines(F.get(pieces, F.lit(0))) + 1
    matched = F.slice(pieces, 2, F.size(pieces) - 1)
    found = F.when(F.size(pieces) <= _BLOCK, _numbered(matched, first)).otherwise(
        _numbered_by_block(pieces, matched, first)
    )
    return F.transform(found, lambda m, pos: F.struct(pos.alias("pos"), m["line"], m["groups"]))


def _numbered_by_block(pieces: Column, matched: Column, first: Column) -> Column:
    last_block = F.floor((F.size(pieces) - 2) / _BLOCK).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(last_block, F.lit(0))),
        lambda number: F.slice(matched, number * _BLOCK + 1, F.lit(_BLOCK)),
    )
    starts = F.aggregate(
        blocks,
        F.array(first),
        lambda lines, block: F.array_append(
            lines,
            F.aggregate(
                block, F.element_at(lines, -1), lambda line, piece: line + newlines(_after(piece))
            ),
        ),
    )
    numbered = F.zip_with(
        blocks, starts, lambda block, line: F.when(block.isNotNull(), _numbered(block, line))
    )
    return F.flatten(F.filter(numbered, lambda block: block.isNotNull()))


def group_values(groups: Column) -> Column:
    """The copied groups as an array; those that took no part in the match are empty."""
    values = F.split(groups, _NEXT, -1)
    held = F.contains(groups, F.lit(_ESCAPE))
    return F.when(held, F.transform(values, restored)).otherwise(values)


def first_group(text: Column, pattern: Column, number: int) -> Column:
    """A group of the first match of a pattern that may differ from row to row."""
    unicode = F.concat(F.lit(_UNICODE), pattern)
    return F.nullif(F.call_function("regexp_extract", text, unicode, F.lit(number)), F.lit(""))
