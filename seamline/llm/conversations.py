"""Repair of the structure of conversations: one system row at most, then pairs of user and assistant.

Rows are put in order once, by conversation and turn, over ranges that can cut a
conversation, and are then read in windows of consecutive rows.  A window's rows of one
conversation are a segment.  Most conversations are one segment and are settled in it
(``auction``).  One that goes on in other windows is settled in three steps, whose data
is a few numbers a segment: what it costs to pass each segment, the prices between the
segments, and the node at which each segment is entered.  So a conversation with a third
of all rows is spread over the tasks that hold its windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from seamline.llm import auction
from seamline.llm.frames import _quoted
from seamline.plans.staging import stage

WINDOW = 1024  # rows
BLANK = " \t\n\v\f\r"
_ROLE = {auction.USER: "user", auction.ASSISTANT: "assistant"}
_NOTHING = hashlib.sha256(b"").hexdigest()
_FAULTS = ("blank", "duplicate", "truncated")


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows ``conv, turn, role, text`` with the faults that a checksum of their place deals out.

    A null role or text becomes a space, and counts as one in the checksum of a null
    conversation or turn.  Of twenty remainders one drops the row, one empties its text,
    one takes ``.!?`` out of it, one repeats it, and one makes its role ``user``.
    """
    named = {"conv": conv_col, "turn": turn_col, "role": role_col, "text": text_col}
    rows = df.select(*(F.col(_quoted(c)).alias(name) for name, c in named.items()))
    place = F.concat(*(F.coalesce(p, F.lit(" ")) for p in (F.col("conv").cast("string"), F.lit(":"), F.col("turn").cast("string"))))
    kind, text = F.crc32(place.cast("binary")) % 20, F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.withColumn("kind", kind).filter("kind <> 0").select(
        "conv", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" "))).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _code() -> Column:
    """A row's role initial and what its own text tells, as one number."""
    end = F.rtrim(F.col("text"), F.lit(BLANK))
    first = F.substring("role", 1, 1)
    role = F.when(first == "s", auction.SYSTEM).when(first == "u", auction.USER).when(first == "a", auction.ASSISTANT).otherwise(0)
    fault = F.when(end == "", auction.REMOVED).when(~F.substring(end, -1, 1).isin(".", "!", "?"), auction.TRUNCATED).otherwise(0)
    return (role + fault).cast("int")


class Conversations:
    """Rows ``conv, turn, role, text`` in order, and the cheapest edits of each conversation.

    Rows of one conversation and turn are in the order of their roles, then of a digest
    of their texts.
    """

    def __init__(self, rows: DataFrame):
        key = F.unhex(F.md5("text"))
        rows = rows.select("conv", "turn", "role", "text", key.alias("digest"), F.monotonically_increasing_id().alias("row"))
        order = ("conv", "turn", "role", "digest", "row")
        placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        placed = placed.select("conv", "turn", "role", "text", "digest", _code().alias("code"), F.monotonically_increasing_id().alias("at"))
        self.rows = stage(placed.withColumn("window", F.expr(f"at div {WINDOW}")), "conversation-rows")
        self.segments = stage(self._segments(), "conversation-segments")
        self.plans = stage(self._plans(), "conversation-plans")

    def _field(self, name: str, column: str = "conv") -> StructField:
        return StructField(name, self.rows.schema[column].dataType)

    def _segments(self) -> DataFrame:
        """Each window's stretch of a conversation: its codes, counts and, if it is all, its edits."""
        seen = self.rows.groupBy("conv", "role", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
        a, b = self.rows.select("conv", "role", "digest", "at", "window").alias("a"), seen.alias("b")
        same = F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.digest") == F.col("b.digest"))
        again = a.join(b, same & (F.col("a.at") > F.col("b.first"))).select("a.window", "a.at", F.lit(True).alias("again"))
        rows = self.rows.select("window", "at", "conv", "turn", "code").unionByName(again, allowMissingColumns=True)
        schema = StructType([
            self._field("conv"), *_parse_datatype_string("first long, codes binary, whole boolean, blank long, duplicate long, truncated long, illegal long, turns long"),
            self._field("least", "turn"), self._field("most", "turn"), self._field("last", "turn"), self._field("begin", "turn"),
            *_parse_datatype_string("cost long, audit string, passage array<long>"),
        ])
        arrow = to_arrow_schema(schema)

        def window(key, batches):
            rows, again = [], set()
            for batch in batches:
                for row in batch.to_pylist():
                    if row["again"]:
                        again.add(row["at"])
                    else:
                        rows.append(row)
            rows.sort(key=lambda row: row["at"])
            starts = [k for k in range(len(rows)) if not k or rows[k]["conv"] != rows[k - 1]["conv"]]
            found = []
            for i, j in zip(starts, [*starts[1:], len(rows)]):
                found.append(segment(rows[i:j], again, i > 0 and j < len(rows)))
            yield pa.RecordBatch.from_pylist(found, arrow)

        def segment(rows, again, whole):
            codes, faults = [], dict.fromkeys(_FAULTS, 0)
            for row in rows:
                code = row["code"]
                if code & auction.REMOVED:
                    faults["blank"] += 1
                elif row["at"] in again:
                    faults["duplicate"] += 1
                    code = code & 3 | auction.REMOVED
                elif code & auction.TRUNCATED:
                    faults["truncated"] += 1
                codes.append(code)
            turns = [row["turn"] for row in rows if row["turn"] is not None]
            made = faults | {
                "conv": rows[0]["conv"], "first": rows[0]["at"], "codes": bytes(codes), "whole": whole,
                "illegal": sum(not legal(x, y) for x, y in zip(codes, codes[1:])), "turns": len(set(turns)),
                "least": min(turns, default=None), "most": max(turns, default=None),
                "begin": rows[0]["turn"], "last": rows[-1]["turn"],
            }
            if whole:
                table = auction.prices(codes)
                made |= {"cost": table[0][auction.START], "audit": auction.trace(codes, table, auction.START)[0]}
            else:
                made["passage"] = [cost for row in auction.passage(codes) for cost in row]
            return made

        window.__annotations__ = _BY_GROUP
        return rows.groupBy("window").applyInArrow(window, schema)

    def _plans(self) -> DataFrame:
        """``conv, first, audit, entry, cost, illegal, same`` of each segment; the last two count what lies between it and the one before."""
        parts = self.segments.filter("NOT whole")
        ends = StructType([
            *_parse_datatype_string("first long, ends array<long>, last boolean, cost long, illegal long, same long"),
        ])

        def between(key, batches):
            rows = sorted((row for batch in batches for row in batch.to_pylist()), key=lambda row: row["first"])
            price, found = list(auction.ENDS), []
            for k in range(len(rows) - 1, -1, -1):
                row, prior = rows[k], rows[k - 1] if k else None
                flat = row["passage"]
                made = {"first": row["first"], "ends": price, "last": k == len(rows) - 1, "illegal": 0, "same": 0}
                price = auction.before([flat[4 * s : 4 * s + 4] for s in range(4)], price)
                if prior is None:
                    made["cost"] = price[auction.START]
                else:
                    made["illegal"] = int(not legal(prior["tail"], row["head"]))
                    made["same"] = int(row["begin"] is not None and row["begin"] == prior["last"])
                found.append(made)
            yield pa.RecordBatch.from_pylist(found, to_between)

        to_between = to_arrow_schema(ends)
        between.__annotations__ = _BY_GROUP
        head = F.ascii(F.substring("codes", 1, 1).cast("string"))
        tail = F.ascii(F.substring("codes", -1, 1).cast("string"))
        narrow = parts.select("conv", "first", "passage", "begin", "last", head.alias("head"), tail.alias("tail"))
        priced = parts.select("conv", "first", "codes").join(narrow.groupBy("conv").applyInArrow(between, ends), "first")

        def traced(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    codes = row.pop("codes")
                    table = auction.prices(codes, row.pop("ends"))
                    if row["last"]:
                        table[-1] = list(auction.ENDS)
                    found = [auction.trace(codes, table, s, row["last"]) if table[0][s] < auction.NEVER else ("", s) for s in range(4)]
                    row |= {"audits": [audit for audit, _ in found], "exits": [end for _, end in found]}
                    yield pa.RecordBatch.from_pylist([row], to_traced)

        columns = StructType([self._field("conv"), *_parse_datatype_string("first long, last boolean, cost long, illegal long, same long, audits array<string>, exits array<int>")])
        to_traced = to_arrow_schema(columns)
        cut = stage(priced.select("conv", "first", "codes", "ends", "last", "cost", "illegal", "same").mapInArrow(traced, columns), "conversation-cut")

        def entered(key, batches):
            state, found = auction.START, []
            for row in sorted((row for batch in batches for row in batch.to_pylist()), key=lambda row: row["first"]):
                found.append({"first": row["first"], "entry": state})
                state = row["exits"][state]
            yield pa.RecordBatch.from_pylist(found, to_entered)

        to_entered = pa.schema([("first", pa.int64()), ("entry", pa.int32())])
        entered.__annotations__ = _BY_GROUP
        entries = cut.select("conv", "first", "exits").groupBy("conv").applyInArrow(entered, "first long, entry int")
        cut = cut.join(entries, "first").select(
            "conv", "first", F.element_at("audits", F.col("entry") + 1).alias("audit"), "entry", "cost", "illegal", "same"
        )
        nothing = F.lit(0).cast("long")
        whole = self.segments.filter("whole").select(
            "conv", "first", "audit", F.lit(auction.START).alias("entry"), "cost", nothing.alias("illegal"), nothing.alias("same")
        )
        return whole.unionByName(cut)

    def report(self) -> DataFrame:
        """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit``, one row per conversation."""
        of = self.segments.groupBy("conv").agg(
            *(F.sum(name).alias(name) for name in (*_FAULTS, "illegal", "turns")), F.min("least").alias("least"), F.max("most").alias("most")
        )
        plan = self.plans.groupBy("conv").agg(
            F.sum("cost").alias("cost"), F.sum("illegal").alias("more"), F.sum("same").alias("same"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "audit"))), lambda part: part["audit"]), "").alias("audit"),
        )
        gaps = F.col("most") - F.col("least") + 1 - (F.col("turns") - F.col("same"))
        joined = of.join(plan.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")))
        return joined.select(
            "conv", F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *_FAULTS,
            (F.col("illegal") + F.col("more")).alias("illegal"), "cost", "audit",
        )

    def _edited(self, df: DataFrame, function, schema) -> DataFrame:
        plans = self.plans.select("conv", F.col("first").alias("at"), F.lit(0).alias("kind"), "audit", "entry")
        rows = self.rows.select("conv", "at", F.lit(1).alias("kind"), "role", "text")
        both = rows.unionByName(plans, allowMissingColumns=True)
        return df(both).sortWithinPartitions("conv", "at", "kind").mapInArrow(function, schema)

    def repaired(self) -> DataFrame:
        """The rows after all edits: ``conv, at, sub, role, text``, in the order of ``at`` and ``sub``.

        The rows of a window stay together, so that a long conversation is spread.
        """
        schema = StructType([self._field("conv"), *_parse_datatype_string("at long, sub int, role string, text string")])
        arrow = to_arrow_schema(schema)

        def run(batches):
            for some in _chunks(edited(batches)):
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, row)) for row in some], arrow)

        return self._edited(lambda both: both.withColumn("window", F.expr(f"at div {WINDOW}")).repartition("window").drop("window"), run, schema)

    def digests(self) -> DataFrame:
        """``conv, repaired_sha256`` of the repaired rows as ``role:text``, a line feed between them.

        A digest is made from its first byte to its last, so the rows of a conversation pass
        one task, one after the other; nothing of them is held.  Those without any row
        left are not listed.
        """
        schema = StructType([self._field("conv"), *_parse_datatype_string("repaired_sha256 string")])
        arrow = to_arrow_schema(schema)

        def run(batches):
            for some in _chunks(hashed(edited(batches))):
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, row)) for row in some], arrow)

        def hashed(rows):
            last, digest = None, None
            for conv, _, _, role, text in rows:
                if digest is None or conv != last:
                    if digest is not None:
                        yield last, digest.hexdigest()
                    last, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if digest is not None:
                yield last, digest.hexdigest()

        return self._edited(lambda both: both.repartition("conv"), run, schema)


_BY_GROUP = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}


def legal(code: int, after: int) -> bool:
    """Whether two neighbours' role initials are su, ua or au."""
    return (code & 3, after & 3) in {(1, 2), (2, 3), (3, 2)}


def _chunks(rows: Iterable, n: int = 256) -> Iterator[list]:
    some = []
    for row in rows:
        some.append(row)
        if len(some) == n:
            yield some
            some = []
    if some:
        yield some


def edited(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Repaired rows from those of segments, each after the segment's edits."""
    letters, place, left, state = "", 0, 0, auction.START
    for batch in batches:
        for part in range(0, batch.num_rows, 256):
            for row in batch.slice(part, 256).to_pylist():
                conv, at = row["conv"], row["at"]
                if row["kind"] == 0:
                    letters, place, state = row["audit"], 0, row["entry"]
                    left = len(letters) - letters.count("I")
                    continue
                sub = 0
                while letters[place] == "I":
                    state = auction.NEXT[state]
                    yield conv, at, sub, _ROLE[state], ""
                    place, sub = place + 1, sub + 1
                if letters[place] == "K":
                    state = "?sua".index(row["role"][0])
                    yield conv, at, sub, row["role"], row["text"]
                elif letters[place] == "R":
                    state = auction.NEXT[state]
                    yield conv, at, sub, _ROLE[state], row["text"]
                place, left = place + 1, left - 1
                while not left and place < len(letters):
                    state, sub = auction.NEXT[state], sub + 1
                    yield conv, at, sub, _ROLE[state], ""
                    place += 1


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Conversations:
    """The conversations of ``df`` in order, with their cheapest repair.

    Null turns come first and a null conversation is one of its own; a null role or text
    counts as a space.  Blank rows and repetitions of a row's role and text are deleted.
    Empty tables give empty results, other columns are not read.  Rows pass through the
    workers once for the edits; texts of any length are held one row at a time.
    """
    named = {"conv": conv_col, "turn": turn_col, "role": role_col, "text": text_col}
    space = {"role", "text"}
    columns = [F.coalesce(F.col(_quoted(c)).cast("string"), F.lit(" ")) if name in space else F.col(_quoted(c)) for name, c in named.items()]
    return Conversations(df.select(*(c.alias(name) for c, name in zip(columns, named))))


def audit(original: DataFrame, rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation of ``original``: what was found in ``rows``, the edits, and the digest of the result."""
    found = repair(rows, "conv")
    report, digests = found.report(), found.digests()
    every = original.select(F.col(_quoted(conv_col)).alias("every")).distinct()
    joined = every.join(report, F.col("every").eqNullSafe(F.col("conv")), "left").drop("conv")
    joined = joined.join(digests, F.col("every").eqNullSafe(F.col("conv")), "left").drop("conv")
    counts = ("gaps", *_FAULTS, "illegal", "cost")
    return joined.select(
        F.col("every").alias(conv_col), *(F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in counts),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_NOTHING)).alias("repaired_sha256"),
    )
