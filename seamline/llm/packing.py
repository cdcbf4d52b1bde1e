"""Packing of documents into sequences of one length: concatenate and cut.

Pass 1 encodes every text once, stores its ids with the place of the first of them in
its partition, and sums the ids of each partition.  The running sum of these totals is
where each partition begins in the row of all ids.  Pass 2 cuts that row into windows of
one size: a document's pieces follow from the place of its first id alone, so that no
row needs another.  Windows that reach over the end of what one task reads are boundary
records, put together by their number; all others are whole where they are cut.
"""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from seamline.llm import textbuf
from seamline.llm.frames import _quoted
from seamline.llm.packed import from_planes, planes
from seamline.llm.vocabularies import ByteVocabulary, vocabulary
from seamline.plans.staging import stage

WINDOW = 1024
END_ID = 0
_ROWS_AT_ONCE = 4096


def _encoded(df: DataFrame, path: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """Pass 1: ``part, place, n, id, ids``; ``place`` counts from the partition's first id."""
    data = Path(path).read_bytes()
    chosen = df.select(F.col(_quoted(id_col)).alias("id"), F.col(_quoted(text_col)).cast("string").alias("text"))
    schema = StructType([*_parse_datatype_string("part int, place long, n long"), StructField("id", chosen.schema["id"].dataType),
                         *_parse_datatype_string("ids binary")])
    kind = to_arrow_schema(schema).field("id").type

    def run(batches):
        of = vocabulary(ByteVocabulary, data)
        part, place, end = TaskContext.get().partitionId(), 0, np.array([end_id], np.uint32)
        for batch in batches:
            for piece in textbuf.slices(batch):
                ids = [np.concatenate([of.encode(text or ""), end]) for text in piece.column(1).to_pylist()]
                n = np.array([len(i) for i in ids], np.int64)
                ends = place + np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part, np.int32)), pa.array(ends - n), pa.array(n),
                     piece.column(0).cast(kind), pa.array(list(map(planes, ids)), pa.binary())],
                    schema.names,
                )
                place = int(ends[-1])

    return stage(chosen.mapInArrow(run, schema), "packing-ids")


def _begins(encoded: DataFrame) -> np.ndarray:
    """Where each partition's first id lies among all; one number for each task of pass 1."""
    totals = {row.part: row.n for row in encoded.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    n = np.array([totals.get(part, 0) for part in range(max(totals, default=-1) + 1)], np.int64)
    return np.cumsum(n) - n


def pack_pieces(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID
) -> DataFrame:
    """One row per piece of a document: where it was cut from and where it lies.

    A document is its ids and then ``end_id``.  ``start`` is the number of its ids before the piece,
    ``length`` that of the piece's, ``ids_crc32`` the checksum of these as little-endian
    32-bit integers, ``doc_tokens`` the ids of the whole document; ``sequence_id`` and
    ``offset`` tell where the piece lies.  Sequences are full but for the last.  Documents
    follow each other in the order of the table's partitions and their rows.  A null or
    empty text is the end id alone; null ids and repeated rows are kept, each row with its
    own pieces; a very long text has many.  Other columns are not read.  An empty table
    gives an empty result.
    """
    encoded = _encoded(df, path, id_col, text_col, end_id)
    begins = _begins(encoded)
    schema = StructType([
        StructField("id", encoded.schema["id"].dataType),
        *_parse_datatype_string("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"),
    ])

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS_AT_ONCE):
                yield cut(batch.slice(first, _ROWS_AT_ONCE))

    def cut(batch):
        part, place, n = (batch.column(k).to_numpy() for k in range(3))
        begin = begins[part] + place
        counts = (begin + n - 1) // window - begin // window + 1
        row = np.repeat(np.arange(len(n)), counts)
        sequence = np.repeat(begin // window - (np.cumsum(counts) - counts), counts) + np.arange(len(row))
        at = np.maximum(sequence * window, begin[row])
        length = np.minimum((sequence + 1) * window, (begin + n)[row]) - at
        start, sums, last = at - begin[row], np.zeros(len(row), np.int64), -1
        for k, (r, i, j) in enumerate(zip(row.tolist(), (4 * start).tolist(), (4 * (start + length)).tolist())):
            if r != last:
                last, ids = r, memoryview(from_planes(batch.column(4)[r].as_py(), int(n[r])).astype("<u4").tobytes())
            sums[k] = zlib.crc32(ids[i:j])
        values = [start, length, sums, n[row], sequence, at - sequence * window]
        return pa.RecordBatch.from_arrays([batch.column(3).take(pa.array(row)), *map(pa.array, values)], schema.names)

    pieces = encoded.select("part", "place", "n", "id", "ids").mapInArrow(run, schema)
    return pieces.withColumnRenamed("id", id_col)


def pack_sequences(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    end_id: int = END_ID, pad_id: int = END_ID,
) -> DataFrame:
    """The sequences themselves: ``sequence_id, n_tokens, n_padding, ids``.

    ``ids`` are packed as little-endian 32-bit integers.  A sequence that is not full, the
    last, is filled up with ``pad_id`` unless its length is a power of two.  The cases of
    ``pack_pieces`` hold; ``sequence_id`` is as there if the table's partitions are the same.
    """
    encoded = _encoded(df, path, id_col, text_col, end_id)
    begins = _begins(encoded)

    def run(batches):
        held, at = np.zeros(0, np.uint32), 0  # ids not yet cut, and the place of the first
        for batch in batches:
            part, place, n = (batch.column(k).to_numpy() for k in range(3))
            for k, begin in enumerate((begins[part] + place).tolist()):
                if begin != at + len(held):
                    yield from cut(held, at, True)
                    held, at = held[:0], begin
                held = np.concatenate([held, from_planes(batch.column(3)[k].as_py(), int(n[k])).astype("<u4")])
                whole = (at + len(held)) // window * window
                if whole > at:
                    yield from cut(held[: whole - at], at, False)
                    held, at = held[whole - at :], whole
        yield from cut(held, at, True)

    def cut(ids, at, rest):
        edges = [at, *range((at // window + 1) * window, at + len(ids), window), at + len(ids)] if len(ids) else []
        for first in range(0, max(len(edges) - 1, 0), _ROWS_AT_ONCE):
            some = edges[first : first + _ROWS_AT_ONCE + 1]
            yield pa.RecordBatch.from_arrays([
                pa.array([e // window for e in some[:-1]], pa.int64()), pa.array([e % window for e in some[:-1]], pa.int64()),
                pa.array([ids[i - at : j - at].tobytes() for i, j in zip(some, some[1:])], pa.binary()),
            ], ["sequence_id", "offset", "ids"])

    parts = stage(encoded.select("part", "place", "n", "ids").mapInArrow(run, "sequence_id long, offset long, ids binary"), "packing-windows")
    full = F.octet_length("ids") == 4 * window
    boundary = parts.filter(~full).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts.ids", F.lit(b""), lambda ids, part: F.concat(ids, part))
    found = parts.filter(full).select("sequence_id", "ids").unionByName(boundary.select("sequence_id", joined.alias("ids")))
    n = (F.octet_length("ids") / 4).cast("long")
    short = F.when(F.bit_count(n) == 1, F.lit(0)).otherwise(window - n)
    padding = F.unhex(F.repeat(F.lit(np.array([pad_id], "<u4").tobytes().hex()), short.cast("int")))
    return found.select("sequence_id", n.alias("n_tokens"), short.cast("long").alias("n_padding"), F.concat("ids", padding).alias("ids"))
