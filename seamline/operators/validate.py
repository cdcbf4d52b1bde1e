"""Checks contract documents, as raw JSON text, against the declared form."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline import fixed, schema

# section -> field -> (type, required, may be null)
_STRING, _NULLABLE_STRING = ("string", True, False), ("string", False, True)
_INT, _NULLABLE_INT = ("int", True, False), ("int", False, True)
_METHOD = ("method", True, False)
_RULES = {
    schema.HTTP_PROVIDERS: {"method": _METHOD, "path": _STRING, "handler": _STRING, "line": _INT},
    schema.TOPICS_PUBLISHED: {
        "topic": _STRING, "schema": _NULLABLE_STRING, "event_schema": _NULLABLE_STRING,
        "publisher": _STRING, "line": _INT,
    },
    schema.HTTP_CONSUMERS: {
        "target": _STRING, "method": _METHOD, "path": _STRING, "caller": _STRING, "line": _INT,
    },
    schema.TOPICS_SUBSCRIBED: {"topic": _STRING, "handler": _NULLABLE_STRING, "line": _NULLABLE_INT},
    schema.EVENT_SCHEMAS: {"class_name": _STRING, "file": _STRING, "line": _INT},
    schema.EXTRACTION_WARNINGS: {"kind": _STRING, "file": _STRING, "line": _INT, "message": _STRING},
}
_CLOSED = {schema.TOPICS_SUBSCRIBED}  # sections that allow no other fields
_VIOLATION = "struct<location:string,pos:int,rule:string>"


def _type(value: Column) -> Column:
    return F.schema_of_variant(value)


def whole_number(value: Column) -> Column:
    """The BIGINT that a value stands for, or null if it is none.

    Whole numbers, also as text or with a zero fraction, and booleans.  Reading and
    validating both go by this, so a line is either kept or reported.
    """
    kind = _type(value)
    text = F.trim(F.try_variant_get(value, "$", "string"))
    digits = F.regexp_replace(text, r"_|\.0*\z", "")
    real = F.try_variant_get(value, "$", "double")
    return F.when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint")).when(
        (kind == "STRING") | kind.startswith("DECIMAL"),
        F.when(F.rlike(text, F.lit(r"\A[+-]?[0-9]+(_[0-9]+)*(\.0*)?\z")), digits.try_cast("bigint")),
    ).when(
        kind.isin("DOUBLE", "FLOAT"), F.when(real == F.floor(real), F.floor(real))
    ).when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("bigint"))


def _wrong(value: Column, kind: str, nullable: bool) -> Column:
    """Rule a present value breaks, or null."""
    is_string = _type(value) == "STRING"
    if kind == "int":
        broken = F.when(whole_number(value).isNull(), "not an integer")
    elif kind == "method":
        known = F.try_variant_get(value, "$", "string").isin(fixed.HTTP_METHODS)
        broken = F.when(~is_string | ~known, "unknown method")
    else:
        broken = F.when(~is_string, "not a string")
    null = F.lit(None).cast("string")
    return F.when(F.is_variant_null(value), null if nullable else F.lit("null")).otherwise(broken)


def _violation(location: Column, pos: Column, rule: Column) -> Column:
    return F.when(
        rule.isNotNull(),
        F.struct(location.alias("location"), pos.cast("int").alias("pos"), rule.alias("rule")),
    )


def _field_violations(item: Column, pos: Column, section: str) -> list[Column]:
    place = schema.DOCUMENT_PATHS[section]
    out = []
    for name, (kind, required, nullable) in _RULES[section].items():
        value = F.try_variant_get(item, f"$.{name}", "variant")
        missing = F.lit("missing") if required else F.lit(None).cast("string")
        rule = F.when(value.isNull(), missing).otherwise(_wrong(value, kind, nullable))
        if name == "event_schema":  # the second name of "schema", which comes first
            rule = F.when(F.try_variant_get(item, "$.schema", "variant").isNull(), rule)
        out.append(_violation(F.lit(f"{place}.{name}"), pos, rule))
    if section in _CLOSED:
        keys = F.map_keys(F.try_variant_get(item, "$", "map<string,variant>"))
        known = F.array(*[F.lit(n) for n in _RULES[section]])
        extra = F.size(F.array_except(keys, known)) > 0
        out.append(_violation(F.lit(place), pos, F.when(extra, "unknown field")))
    return out


def plain_types(section: str) -> list[str]:
    """The types of whole items, as Spark writes them, that break no rule of a field's type.

    Those of ordinary items: lines as plain numbers, one name of ``schema``, no other fields.
    """
    forms = {}
    for name, (kind, _, nullable) in sorted(_RULES[section].items()):
        if name != "event_schema":
            forms[name] = ["BIGINT" if kind == "int" else "STRING"] + [None, "VOID"] * nullable
    items = [[f"{name}: {form}" for name, form in zip(forms, chosen) if form] for chosen in product(*forms.values())]
    return [f"OBJECT<{', '.join(fields)}>" for fields in items if fields]


def _list_violations(document: Column, section: str) -> Column:
    """Violations of one list of the document."""
    place = schema.DOCUMENT_PATHS[section]
    items = F.try_variant_get(document, f"$.{place}", "variant")

    def of_item(item: Column, pos: Column) -> Column:
        # An item is described once; only those that are not plain are looked at field by field.
        is_plain = _type(item).isin(plain_types(section))
        if "method" in _RULES[section]:
            is_plain &= F.try_variant_get(item, "$.method", "string").isin(fixed.HTTP_METHODS)
        is_object = _type(item).startswith("OBJECT")
        fields = F.array(*_field_violations(item, pos, section))
        return F.when(is_plain, none).when(is_object, fields).otherwise(
            F.array(_violation(F.lit(place), pos, F.lit("not an object")))
        )

    none = F.array().cast(f"array<{_VIOLATION}>")
    elements = F.try_variant_get(items, "$", "array<variant>")
    inside = F.flatten(F.transform(elements, of_item))
    return F.when(items.isNull(), none).when(
        ~_type(items).startswith("ARRAY"),
        F.array(_violation(F.lit(place), F.lit(None), F.lit("not a list"))),
    ).otherwise(inside)


def _object_violation(document: Column, name: str) -> Column:
    value = F.try_variant_get(document, f"$.{name}", "variant")
    broken = value.isNotNull() & ~_type(value).startswith("OBJECT")
    return _violation(F.lit(name), F.lit(None), F.when(broken, "not an object"))


def violations(document: Column) -> Column:
    """Array of ``struct(location, pos, rule)``, one entry per broken rule.

    ``document`` is the parsed text (``try_parse_json``).
    """
    service = F.try_variant_get(document, "$.service", "variant")
    version = F.try_variant_get(document, "$.extractor_version", "variant")
    nowhere = F.lit(None)
    top = [
        _violation(
            F.lit("service"), nowhere,
            F.when(service.isNull(), "missing").otherwise(_wrong(service, "string", False)),
        ),
        _violation(
            F.lit("extractor_version"), nowhere,
            F.when(version.isNotNull(), _wrong(version, "string", False)),
        ),
        _object_violation(document, "provides"),
        _object_violation(document, "consumes"),
    ]
    inside = F.concat(F.array(*top), *[_list_violations(document, section) for section in _RULES])
    found = F.when(
        document.isNull(), F.array(_violation(F.lit("document"), nowhere, F.lit("not JSON")))
    ).when(
        ~_type(document).startswith("OBJECT"),
        F.array(_violation(F.lit("document"), nowhere, F.lit("not an object"))),
    ).otherwise(inside)
    return F.filter(found, lambda v: v.isNotNull())


def contract_violations(raw: DataFrame) -> DataFrame:
    """``(repo, location, pos, rule)``: one row per broken rule of ``raw(repo, document)``.

    All checks of a document happen where it is read, without a shuffle.
    """
    return (
        raw.withColumn("parsed", F.try_parse_json("document"))
        .withColumn("violations", violations(F.col("parsed")))
        .select("repo", F.explode_outer("violations").alias("v"))
        .filter("v IS NOT NULL")
        .select("repo", "v.location", "v.pos", "v.rule")
    )


def contract_validity(raw: DataFrame) -> DataFrame:
    """``(repo, violations, valid)`` for every document."""
    broken = F.size(violations(F.col("parsed")))
    return (
        raw.withColumn("parsed", F.try_parse_json("document"))
        .select("repo", broken.alias("violations"))
        .withColumn("valid", F.col("violations") == 0)
        .orderBy("repo")
    )
