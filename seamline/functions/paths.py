"""Path normalisers and small text rules, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamline.fixed import DEFAULT_METHOD, PARAM


def _drop_trailing_slash(path: Column) -> Column:
    """Drop one trailing slash, but never the only character."""
    return F.regexp_replace(path, r"(?<=[\s\S])/\z", "")


def match_path(path: Column) -> Column:
    """Matching form: every ``{…}`` (``{}`` too) becomes ``{param}``."""
    return F.regexp_replace(path, r"\{[^}]*\}", PARAM)


def router_path(path: Column) -> Column:
    """Routing form: ``{x}``, ``[x]`` and ``${x}`` become ``{param}``."""
    out = F.regexp_replace(path, r"\{[^}]+\}", PARAM)
    out = F.regexp_replace(out, r"\[[^\]]+\]", PARAM)
    out = F.regexp_replace(out, r"\$\{[^}]+\}", PARAM)
    return _drop_trailing_slash(out)


def frontend_path(path: Column) -> Column:
    """Front-end form: ``${x}`` and ``[x]`` become ``{param}``, ``{x}`` stays."""
    out = F.regexp_replace(path, r"\$\{[^}]+\}", PARAM)
    out = F.regexp_replace(out, r"\[[^\]]+\]", PARAM)
    return _drop_trailing_slash(out)


def route_path(path: Column) -> Column:
    """Served form: one leading slash, no doubled or trailing slashes."""
    return _drop_trailing_slash(F.regexp_replace(F.concat(F.lit("/"), path), r"/+", "/"))


def route_segments(path: Column) -> Column:
    """Segments used for route resolution; null for the root path."""
    bare = F.regexp_replace(router_path(path), r"\A/+|/+\z", "")
    return F.when(bare != "", F.split(bare, "/", -1))


def file_module(path: Column) -> Column:
    """``app/api/__init__.py`` → ``app.api``."""
    bare = F.regexp_replace(path, r"\.py\z", "")
    return F.translate(F.regexp_replace(bare, r"/__init__\z", ""), "/", ".")


def file_order(path: Column) -> Column:
    """Sort key of a file: its path components."""
    return F.split(path, "/", -1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def method_or_default(method: Column) -> Column:
    """Upper-case method; GET where the call names none."""
    return F.upper(F.coalesce(F.nullif(method, F.lit("")), F.lit(DEFAULT_METHOD)))


_QUESTION = r"(?Us)\A\s*(\S+)\s+(\S.*?)\s*\z"


def question_method(question: Column) -> Column:
    """Method of ``"METHOD /path"``, upper-cased; null if not two parts."""
    return F.upper(F.nullif(F.regexp_extract(question, _QUESTION, 1), F.lit("")))


def question_path(question: Column) -> Column:
    """Path of ``"METHOD /path"``; null if not two parts."""
    return F.nullif(F.regexp_extract(question, _QUESTION, 2), F.lit(""))


def location(place: Column, line: Column) -> Column:
    """``place:line`` as shown to people; a missing part reads ``None``."""
    none = F.lit("None")
    return F.concat_ws(":", F.coalesce(place, none), F.coalesce(line.cast("string"), none))


def ord_key(phase, file: Column, *seq: Column) -> Column:
    """Build the document-order key of a fact."""
    return F.struct(
        F.lit(phase).cast("int").alias("phase"),
        file.alias("file"),
        F.array(*[F.coalesce(c.cast("int"), F.lit(0)) for c in seq]).alias("seq"),
    )
