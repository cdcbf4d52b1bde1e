"""What the operators share: reading tables, running a function over texts, bounds."""

from __future__ import annotations

import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from seamline.llm import textbuf

SMALL_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_column(make: Callable[[pa.Array], dict], columns: str, kind: str = "string") -> Callable:
    """A column function over texts, computed a few MB of text at a time.

    ``make`` gets an Arrow array of texts (or of bytes) and returns a value for each in
    every one of ``columns``, a DDL string.  The result is a struct of them.
    """
    schema = to_arrow_schema(_parse_datatype_string(columns))

    def part(texts: pa.Array) -> pa.Array:
        found = make(texts)
        arrays = []
        for field in schema:
            values = found[field.name]
            arrays.append(values if isinstance(values, pa.Array) else pa.array(values, field.type))
        return pa.StructArray.from_arrays(
            [a.cast(f.type) for a, f in zip(arrays, schema)], fields=list(schema)
        )

    def run(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.struct(list(schema)))
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        return pa.concat_arrays([part(piece.column(0)) for piece in textbuf.slices(batch)])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    whole = F.arrow_udf(run, _parse_datatype_string(columns))
    return lambda column: whole(column.cast(kind))


def with_struct(
    df: DataFrame, text: str, make: Callable[[pa.Array], dict], columns: str, into: str,
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` with a struct column ``into``, replacing one of that name.

    Like ``text_column``, but the results leave the task a few MB at a time, for results
    about as large as the texts.  ``keep`` names the columns of ``df`` to keep, all if
    not given; only these and the texts reach the workers, and each only once.
    """
    names = [c for c in (df.columns if keep is None else keep) if c != into]
    plain = text in df.columns and df.schema[text].dataType == StringType()
    others = [c for c in names if not (plain and c == text)]
    chosen = df.select(F.col(_quoted(text)).cast("string").alias("text"), *(F.col(_quoted(c)) for c in others))
    chosen = chosen.toDF("text", *(f"sent{k}" for k in range(len(others))))
    places = [1 + others.index(c) if c in others else 0 for c in names]
    made = _parse_datatype_string(columns)
    arrow = to_arrow_schema(made)
    kept = [StructField(f"c{k}", chosen.schema[place].dataType) for k, place in enumerate(places)]
    schema = StructType([*kept, StructField("made", made)])

    def run(batches):
        gc.collect()  # what earlier stages have left in this worker
        textbuf.release()
        for batch in batches:
            for piece in textbuf.slices(batch, "text"):
                found = make(piece.column(0))
                arrays = [
                    (found[f.name] if isinstance(found[f.name], pa.Array) else pa.array(found[f.name], f.type)).cast(f.type)
                    for f in arrow
                ]
                struct = pa.StructArray.from_arrays(arrays, fields=list(arrow))
                yield pa.RecordBatch.from_arrays([*map(piece.column, places), struct], names=schema.names)

    return chosen.mapInArrow(run, schema).toDF(*names, into)


def hidden(df: DataFrame, *columns: str) -> tuple:
    """``df`` with names of its own, ``own0`` and so on, and the new names of some columns.

    For work that adds columns: whatever a caller's are called, they cannot clash.
    """
    names = [f"own{k}" for k in range(len(df.columns))]
    return df.toDF(*names), *(names[df.columns.index(c)] for c in columns)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def small_enough(df: DataFrame, row_bytes: int, limit: int = SMALL_BYTES) -> bool:
    """Whether a stored table of rows of at most ``row_bytes`` stays below ``limit``."""
    return df.limit(limit // row_bytes + 1).count() <= limit // row_bytes


def lowered(column: Column) -> Column:
    """A-Z in lower case, all else as it is; null as empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(column, F.lit("")), upper, upper.lower())
