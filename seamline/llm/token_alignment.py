"""Alignment of two tokenizers over a corpus, and how common each pair of tokens is.

A byte-level vocabulary (A) reads a space and the text, a piece model (B) the text, to
which it adds the space.  Byte offsets where tokens of both end cut a text into groups;
every A token of a group is linked to every B token of it.

Pass 1 finds the distinct pairs of each block of texts.  Pairs are spread by a reversible
mixing of their number over slices of equal size, so that the vocabularies, not the
corpus, bound what one slice can hold.  The distinct pairs of a slice get a minimal
perfect hash; each node of a tree adds the counts of its blocks to a dense vector indexed
by it, and the next nodes add these vectors, up to one for each slice.  A number is only
read after the key kept beside it has been compared.

Pass 2 aligns the texts again, block by block, beside the counts of the block's pairs.

Tokens never cross the place between a visible character and certain white space; texts
are cut there, and what was found for a stretch is kept for its next occurrence.
Stretches are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from seamline.llm import textbuf
from seamline.llm.frames import _quoted
from seamline.llm.packed import from_planes, gather, pack, planes, unpack
from seamline.llm.pair_index_bpe import SPACES
from seamline.llm.perfect_hash import PerfectHash
from seamline.llm.vocabularies import ByteVocabulary, PieceVocabulary, vocabulary
from seamline.plans.staging import stage

BLOCK_BYTES = 8 << 20  # of text, or one text
SLICE_BITS = 23  # a slice has at most 2**23 pairs
FAN_IN = 1024  # blocks, then vectors, that one node of the tree adds
_STRETCHES_KEPT = 200_000
_LONGEST_KEPT = 64
_AT_ONCE = 1 << 16  # stretches aligned together
_PAIR_BITS = 44
_LARGE = 4096  # links of a group that is counted by its distinct tokens
_U = np.uint64


class Pairs:
    """Numbers of token pairs, mixed so that neighbours lie far apart."""

    def __init__(self, a_size: int, b_size: int):
        self.b_size = b_size
        self.bits = max((a_size * b_size - 1).bit_length(), 1)
        if self.bits > _PAIR_BITS:
            raise ValueError("the vocabularies have too many pairs")
        self.slice_bits = min(SLICE_BITS, self.bits)
        self._mask, self._shift = _U((1 << self.bits) - 1), _U((self.bits + 1) // 2)
        self._factor = 0x9E3779B97F4A7C15
        self._back = pow(self._factor, -1, 1 << 64)

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (a.astype(_U) * _U(self.b_size) + b.astype(_U)) * _U(self._factor) & self._mask
        x = (x ^ (x >> self._shift)) * _U(self._factor) & self._mask
        return x.astype(np.int64)

    def tokens(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = code.astype(_U) * _U(self._back) & self._mask
        x = (x ^ (x >> self._shift)) * _U(self._back) & self._mask
        return (x // _U(self.b_size)).astype(np.int64), (x % _U(self.b_size)).astype(np.int64)


class _Values:
    """A numpy array that grows at its end."""

    def __init__(self, kind: type = np.int64):
        self._data, self._n = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        while self._n + len(values) > len(self._data):
            self._data = np.concatenate([self._data, np.zeros_like(self._data)])
        self._data[self._n : self._n + len(values)] = values
        self._n += len(values)

    def __getitem__(self, places):
        return self._data[places]

    def __len__(self) -> int:
        return self._n


def _space_ends() -> tuple[np.ndarray, np.ndarray]:
    """Last two and last three bytes of the white space outside ASCII."""
    spaces = [c.encode() for c in re.findall(f"[{SPACES}]", "".join(map(chr, [*range(128, 0xD800), *range(0xE000, 0x10000)])))]
    of = {n: np.array([int.from_bytes(s, "big") for s in spaces if len(s) == n]) for n in (2, 3)}
    return of[2], of[3]


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_TWO, _THREE = _space_ends()


def stretches(data: np.ndarray, offsets: np.ndarray, cuts: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where texts are cut: at their ends, and before white space of ``cuts`` after a visible character."""
    cut = np.zeros(256, bool)
    cut[[ord(c) for c in cuts]] = True
    at = np.flatnonzero(cut[data[1:]] & ~_WHITE[data[:-1]]) + 1
    far = np.flatnonzero(data[at - 1] >= 128)
    last = at[far] - 1
    before = data.astype(np.int64)
    two = (before[last - 1] << 8) | before[last]
    three = (before[np.maximum(last - 2, 0)] << 16) | two
    space = np.isin(two, _TWO) | np.isin(three, _THREE)
    at = np.delete(at, far[space])
    filled = offsets[:-1][np.diff(offsets) > 0]
    starts, _ = distinct(np.concatenate([at, filled]))
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


class Aligner:
    """Groups and links of texts, and the distinct pairs of each stretch."""

    def __init__(self, a: ByteVocabulary, b: PieceVocabulary, named: bool = True):
        if " " not in b.cuts or not b.adds_space:
            raise ValueError("needs a piece model that sets a space before a text and whose pieces end before spaces")
        self.a, self.b, self.pairs = a, b, Pairs(a.size, b.size)
        self._names = named and [[b"%d%c" % (k, end) for k in range(of.size)] for of, ends in ((a, b",|"), (b, b",;")) for end in ends]
        self._white = set(re.findall(f"[{SPACES}]", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))))
        self.clear()

    def clear(self) -> None:
        self.row: dict[int, int] = {}
        self.n_a, self.n_b, self.n_groups, self.n_links = (_Values() for _ in range(4))
        self.first, self.n_pairs, self.code, self.times = (_Values() for _ in range(4))
        self.bad = _Values(bool)
        self.names: list[bytes] = []  # the groups of each row, written out

    def _of_a(self, texts: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text by A.  Texts that end in a visible character are read in one go."""
        last = [t[-1] for t in texts]
        apart = np.array([c <= 32 and _WHITE[c] or c >= 128 and t.decode()[-1] in self._white for c, t in zip(last, texts)], bool)
        counts = np.zeros(len(texts), np.int64)
        together = b"".join(t for t, own in zip(texts, apart.tolist()) if not own) if apart.any() else b"".join(texts)
        joined = self.a.encode(together.decode(), special=False)
        ends = np.cumsum(self.a.lengths[joined])
        counts[~apart] = np.diff(np.searchsorted(ends, np.cumsum(lengths[~apart]), side="right"), prepend=0)
        alone = [self.a.encode(texts[k].decode(), special=False) for k in np.flatnonzero(apart)]
        counts[apart] = [len(ids) for ids in alone]
        source = np.concatenate([joined, *alone]).astype(np.int64)
        if not len(alone):
            return source, counts
        first = np.zeros(len(texts), np.int64)
        order = np.argsort(apart, kind="stable")
        first[order] = np.cumsum(counts[order]) - counts[order]
        return source[gather(first, counts)], counts

    @staticmethod
    def _differs(ids: np.ndarray, counts: np.ndarray, of, texts: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """Which texts are not the joined bytes of their tokens."""
        made = [of.pieces[k] for k in ids.tolist()]
        ends = np.cumsum(counts)
        sizes = np.append(0, np.cumsum(of.lengths[ids]))[np.append(0, ends)]
        if np.array_equal(np.diff(sizes), lengths) and b"".join(made) == b"".join(texts):
            return np.zeros(len(texts), bool)
        return np.array([b"".join(made[e - n : e]) != t for e, n, t in zip(ends.tolist(), counts.tolist(), texts)], bool)

    def add(self, texts: list[bytes]) -> None:
        """Align texts as a whole each and append what was found, in their order."""
        for k in range(0, len(texts), _AT_ONCE):
            self._add(texts[k : k + _AT_ONCE])

    def _add(self, texts: list[bytes]) -> None:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        a, a_counts = self._of_a(texts, lengths)
        lists = self.b.encode(texts)
        b_counts = np.fromiter(map(len, lists), np.int64, len(lists))
        b = np.fromiter(chain.from_iterable(lists), np.int64, int(b_counts.sum()))
        bad = self._differs(a, a_counts, self.a, texts, lengths) | self._differs(b, b_counts, self.b, texts, lengths)
        if bad.any():
            a, b = a[np.repeat(~bad, a_counts)], b[np.repeat(~bad, b_counts)]
            a_counts, b_counts, lengths = (np.where(bad, 0, n) for n in (a_counts, b_counts, lengths))
        a_ends, b_ends, ends = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b]), np.cumsum(lengths)
        both = a_ends[b_ends[np.searchsorted(b_ends, a_ends)] == a_ends]
        a_group, b_group = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
        n_a, n_b = np.bincount(a_group, minlength=len(both)), np.bincount(b_group, minlength=len(both))
        owner = np.searchsorted(ends, both)  # the text of each group
        links = np.zeros(len(texts), np.int64)
        np.add.at(links, owner, n_a * n_b)
        code, times = self._linked(a, b, a_group, n_a, n_b, owner)
        of = code >> _PAIR_BITS
        counts = np.bincount(of, minlength=len(texts))
        self.first.add(len(self.code) + np.cumsum(counts) - counts)
        self.n_pairs.add(counts)
        self.code.add(code & ((1 << _PAIR_BITS) - 1))
        self.times.add(times)
        self.n_a.add(a_counts)
        self.n_b.add(b_counts)
        self.n_groups.add(np.bincount(owner, minlength=len(texts)))
        self.n_links.add(links)
        self.bad.add(bad)
        if self._names:
            self.names += self._named(a, b, a_group, b_group, a_counts + b_counts)

    def _linked(self, a, b, a_group, n_a, n_b, owner) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs of each text, in order of text and code, and how many links each has."""
        size = n_a * n_b
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        each = np.where(size > _LARGE, 0, n_b)[a_group]
        links = self.pairs.code(np.repeat(a, each), b[gather(first_b[a_group], each)])
        code, times = distinct((np.repeat(owner[a_group], each) << _PAIR_BITS) | links)
        more = [(code, times)]
        for g in np.flatnonzero(size > _LARGE):
            of_a, times_a = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
            of_b, times_b = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
            links = self.pairs.code(np.repeat(of_a, len(of_b)), np.tile(of_b, len(of_a)))
            more.append(((owner[g] << _PAIR_BITS) | links, np.outer(times_a, times_b).ravel()))
        return (code, times) if len(more) == 1 else added(*map(np.concatenate, zip(*more)))

    def _named(self, a, b, a_group, b_group, counts) -> list[bytes]:
        """The groups of each text as ``a1,a2|b1;``, joined."""
        a_last = np.append(np.diff(a_group) > 0, True)[: len(a)].tolist()
        b_last = np.append(np.diff(b_group) > 0, True)[: len(b)].tolist()
        within, at_end, from_b, from_b_end = self._names
        names = [at_end[k] if end else within[k] for k, end in zip(a.tolist(), a_last)]
        names += [from_b_end[k] if end else from_b[k] for k, end in zip(b.tolist(), b_last)]
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        names = list(map(names.__getitem__, order.tolist()))
        ends = np.cumsum(counts).tolist()
        return [b"".join(names[e - n : e]) for e, n in zip(ends, counts.tolist())]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For every stretch of every text, the number of the text and the row of what was found.

        A text that its tokens do not give back has none.
        """
        if len(self.bad) > _STRETCHES_KEPT:
            self.clear()
        texts = pc.fill_null(texts, "")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise("", texts, " "))
        data, offsets = textbuf.buffers(texts)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts, ends, counts = stretches(data, offsets, self.b.cuts)
        hashes = textbuf.hash_spans(data, starts, ends)
        order = np.argsort(hashes)
        first = np.flatnonzero(np.diff(hashes[order], prepend=hashes[order[:1]] ^ _U(1)))
        place, keys = order[first], hashes[order[first]].tolist()
        known = np.fromiter(map(self.row.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = len(self.bad) + np.arange(len(new))
            raw, begin, end = data.tobytes(), starts[place[new]], ends[place[new]]
            self.add([raw[i:j] for i, j in zip(begin.tolist(), end.tolist())])
            kept = new[end - begin <= _LONGEST_KEPT]
            self.row.update(zip(map(keys.__getitem__, kept.tolist()), known[kept].tolist()))
        rows, text = np.empty(len(hashes), np.int64), textbuf.of_text(counts)
        rows[order] = np.repeat(known, np.diff(first, append=len(order)))
        broken, _ = distinct(text[self.bad[rows]])
        if len(broken):
            stays = ~np.isin(text, broken)
            rows, text = rows[stays], text[stays]
            first = len(self.bad)
            self.add([data[offsets[k] : offsets[k + 1]].tobytes() for k in broken])
            whole = ~self.bad[first : first + len(broken)]
            rows = np.concatenate([rows, np.flatnonzero(whole) + first])
            text = np.concatenate([text, broken[whole]])
        return text, rows

    def pairs_of(self, rows: np.ndarray) -> np.ndarray:
        """The places of the distinct pairs of these rows."""
        return gather(self.first[rows], self.n_pairs[rows])

    def documents_with(self, text: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs of some texts, and how many of the texts hold each."""
        both, _ = distinct((text << 32) | rows)
        text, rows = both >> 32, both & 0xFFFFFFFF
        held, _ = distinct((np.repeat(text, self.n_pairs[rows]) << _PAIR_BITS) | self.code[self.pairs_of(rows)])
        return distinct(held & ((1 << _PAIR_BITS) - 1))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each occurs."""
    values = np.sort(values)
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(first, append=len(values))


def added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the sum of the counts of each."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


_aligners: dict[tuple, Aligner] = {}


def aligner(a: bytes, b: bytes, named: bool = True) -> Aligner:
    """The aligner of two files, made once in each process; ``named`` ones write groups out.

    Only the last is held.
    """
    key = hashlib.sha256(a).digest(), hashlib.sha256(b).digest(), named
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(vocabulary(ByteVocabulary, a), vocabulary(PieceVocabulary, b), named)
    return _aligners[key]


def _sliced(codes: np.ndarray, counts: np.ndarray, slice_bits: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Ascending codes and their counts by slice, packed."""
    of = codes >> slice_bits
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    for i, j in zip(starts, np.append(starts[1:], len(codes))):
        yield int(of[i]), int(j - i), pack(codes[i:j].astype(_U)), planes(counts[i:j])


def _blocks(df: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """Pass 1: texts with the number of their block, and the packed pairs of each block and slice."""
    schema = StructType(
        [StructField("block", _parse_datatype_string("long")), StructField("id", df.schema[0].dataType)]
        + list(_parse_datatype_string("text string, spot int, n long, codes binary, counts binary"))
    )
    names = schema.names
    types = [f.type for f in to_arrow_schema(schema)]

    def run(batches):
        of = aligner(a, b, named=False)
        block, size, held = TaskContext.get().partitionId() << 32, 0, []

        def close():
            rows = list(_sliced(*added(*map(np.concatenate, zip(*held))), of.pairs.slice_bits)) if held else []
            if rows:
                nulls = [pa.nulls(len(rows), t) for t in types[1:3]]
                made = [pa.array(column, t) for column, t in zip(zip(*rows), types[3:])]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), *nulls, *made], names)

        for batch in batches:
            for piece in textbuf.slices(batch):
                text, rows = of.texts(piece.column(1))
                if len(rows):
                    held.append(of.documents_with(text, rows))
                nulls = [pa.nulls(piece.num_rows, t) for t in types[3:]]
                numbers = pa.array(np.full(piece.num_rows, block))
                yield pa.RecordBatch.from_arrays([numbers, piece.column(0).cast(types[1]), piece.column(1).cast(types[2]), *nulls], names)
                size += piece.column(1).nbytes
                if size >= BLOCK_BYTES:
                    yield from close()
                    block, size, held = block + 1, 0, []
                elif len(held) > 16:
                    held = [added(*map(np.concatenate, zip(*held)))]
        yield from close()

    return df.mapInArrow(run, schema)


def _up(rows: DataFrame, nodes: int, function, schema: str, leaves=None) -> DataFrame:
    """Join the rows of each slice node by node, ``FAN_IN`` at a time, until one is left."""
    first = True
    while first or nodes > 1:
        nodes = -(-nodes // FAN_IN)
        placed = rows.withColumn("node", F.pmod(F.col("node") if not first else F.xxhash64("node"), F.lit(nodes)))
        if first and leaves is not None:
            placed = leaves(placed, nodes)
        rows = placed.groupBy("spot", "node").applyInArrow(function, schema)
        first = False
    return rows


def _vector(row: dict) -> np.ndarray:
    return np.frombuffer(row["counts"], "<i8")


class CorpusPairs:
    """What pass 1 leaves: blocks, and for each slice its pairs, their hash and their counts."""

    def __init__(self, df: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str):
        self.a, self.b = Path(a_path).read_bytes(), Path(b_path).read_bytes()
        sizes = vocabulary(ByteVocabulary, self.a).size, vocabulary(PieceVocabulary, self.b).size
        self.pairs, self.a_size = Pairs(*sizes), sizes[0]
        chosen = df.select(F.col(_quoted(id_col)).alias("id"), F.col(_quoted(text_col)).cast("string").alias("text"))
        self.blocks = stage(_blocks(chosen, self.a, self.b), "alignment-blocks")
        self.held = self.blocks.filter("spot IS NOT NULL").select("block", "spot", "n", "codes", "counts")
        self.n_blocks = max(self.held.select("block").distinct().count(), 1)
        self.index = stage(self._index(), "alignment-index")
        self.table = stage(self._counted(), "alignment-counts")

    def _index(self) -> DataFrame:
        """For each slice its distinct pairs, as a union over the tree, and their hash."""
        bits = self.pairs.slice_bits

        def union(key, batches):
            seen = np.zeros(1 << bits, bool)
            spot = key[0].as_py()
            for batch in batches:
                for row in batch.select(["n", "codes"]).to_pylist():
                    seen[unpack(row["codes"], row["n"]).astype(np.int64) - (spot << bits)] = True
            codes = (np.flatnonzero(seen) + (spot << bits)).astype(_U)
            yield pa.RecordBatch.from_pylist([{"spot": spot, "node": key[1].as_py(), "n": len(codes), "codes": pack(codes)}], _UNION)

        union.__annotations__ = _BY_GROUP
        rows = self.held.select("spot", F.col("block").alias("node"), "n", "codes")
        merged = _up(rows, self.n_blocks, union, "spot int, node long, n long, codes binary")

        def hashed(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    codes = unpack(row["codes"], row["n"])
                    index = PerfectHash.of(codes)
                    keys = np.zeros(len(codes), _U)
                    keys[index.numbers(codes)] = codes
                    made = {"spot": row["spot"], "n": row["n"], "hash": index.to_bytes(), "keys": keys.astype("<u8").tobytes()}
                    yield pa.RecordBatch.from_pylist([made], _HASHED)

        return merged.select("spot", "n", "codes").mapInArrow(hashed, "spot int, n long, hash binary, keys binary")

    def _beside(self, rows: DataFrame, nodes: int, table: DataFrame, what: str) -> DataFrame:
        """Rows of a slice's nodes, and the slice's part of a table once for each node."""
        shared = table.select("spot", "n", "hash", "keys", what).withColumnRenamed(what, "counts") if what else table.select("spot", "n", "hash", "keys")
        shared = shared.withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nodes - 1).cast("long"))))
        return rows.unionByName(shared, allowMissingColumns=True)

    def _counted(self) -> DataFrame:
        """For each slice the dense vector of its pairs' counts, summed over the tree."""

        def summed(key, batches):
            rows = [row for batch in batches for row in batch.to_pylist()]
            own = next((row for row in rows if row.get("hash") is not None), None)
            if own is None:  # vectors of the nodes below
                total = np.sum([_vector(row) for row in rows], axis=0)
            else:
                index, total = _Slice(own), np.zeros(own["n"], np.int64)
                for row in rows:
                    if row["hash"] is None:
                        total[index.numbers(unpack(row["codes"], row["n"]))] += from_planes(row["counts"], row["n"])
            made = {"spot": key[0].as_py(), "node": key[1].as_py(), "n": len(total), "counts": total.astype("<i8").tobytes()}
            yield pa.RecordBatch.from_pylist([made], _SUMMED)

        summed.__annotations__ = _BY_GROUP
        rows = self.held.select("spot", F.col("block").alias("node"), "n", "codes", "counts")
        total = _up(
            rows, self.n_blocks, summed, "spot int, node long, n long, counts binary",
            lambda placed, nodes: self._beside(placed, nodes, self.index, ""),
        )
        return self.index.join(total.select("spot", "counts"), "spot")

    def best(self) -> np.ndarray:
        """For each A id the count of its most common pair; bounded by the vocabulary."""
        pairs = self.pairs

        def highest(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    of_a, _ = pairs.tokens(np.frombuffer(row["keys"], "<u8"))
                    best = np.zeros(int(of_a.max()) + 1, np.int64)
                    np.maximum.at(best, of_a, _vector(row))
                    found = np.flatnonzero(best)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(best[found])], ["a", "best"])

        rows = self.table.select("keys", "counts").mapInArrow(highest, "a long, best long")
        best = np.zeros(self.a_size, np.int64)
        for row in rows.groupBy("a").agg(F.max("best").alias("best")).collect():
            best[row.a] = row.best
        return best

    def counts(self) -> DataFrame:
        """``a_id, b_id, n_documents`` for every pair that some document links."""
        pairs = self.pairs

        def spread(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    of_a, of_b = pairs.tokens(np.frombuffer(row["keys"], "<u8"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(of_a.astype(np.int32)), pa.array(of_b.astype(np.int32)), pa.array(_vector(row))],
                        ["a_id", "b_id", "n_documents"],
                    )

        return self.table.select("keys", "counts").mapInArrow(spread, "a_id int, b_id int, n_documents long")

    def _answers(self) -> DataFrame:
        """For each block and slice the corpus-wide counts of the block's pairs."""

        def looked_up(key, batches):
            rows = [row for batch in batches for row in batch.to_pylist()]
            own = next(row for row in rows if row["hash"] is not None)
            index, total = _Slice(own), _vector(own)
            for row in rows:
                if row["hash"] is None:
                    found = total[index.numbers(unpack(row["codes"], row["n"]))]
                    made = {"block": row["block"], "spot": key[0].as_py(), "n": row["n"], "codes": row["codes"], "counts": planes(found)}
                    yield pa.RecordBatch.from_pylist([made], _ANSWER)

        looked_up.__annotations__ = _BY_GROUP
        nodes = -(-self.n_blocks // FAN_IN)
        rows = self.held.select("block", "spot", "n", "codes").withColumn("node", F.pmod(F.xxhash64("block"), F.lit(nodes)))
        rows = self._beside(rows, nodes, self.table, "counts")
        return rows.groupBy("spot", "node").applyInArrow(looked_up, "block long, spot int, n long, codes binary, counts binary")

    def documents(self, id_col: str = "doc_id", groups: bool = False) -> DataFrame:
        """Pass 2: one row per document."""
        a, b, best = self.a, self.b, self.best().tobytes()
        columns = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", `groups` string" * groups
        schema = StructType([self.blocks.schema["id"], *_parse_datatype_string(columns)])
        arrow = to_arrow_schema(schema)

        def block(key, batches):
            texts, answers = [], []
            for batch in batches:
                text = pc.is_null(batch.column("spot"))
                texts.append(batch.select(["id", "text"]).filter(text))
                answers += batch.select(["spot", "n", "codes", "counts"]).filter(pc.invert(text)).to_pylist()
            answers.sort(key=lambda row: row["spot"])
            codes = np.concatenate([np.zeros(0, _U), *(unpack(r["codes"], r["n"]) for r in answers)]).astype(np.int64)
            counts = np.concatenate([np.zeros(0, np.int64), *(from_planes(r["counts"], r["n"]) for r in answers)])
            of = aligner(a, b)
            highest = counts == np.frombuffer(best, np.int64)[of.pairs.tokens(codes)[0]]
            for batch in texts:
                for piece in textbuf.slices(batch):
                    yield described(piece, of, codes, counts, highest)

        def described(piece, of, codes, counts, highest):
            n, (text, rows) = piece.num_rows, of.texts(piece.column(1))
            order = np.argsort(text, kind="stable")
            text, rows = text[order], rows[order]
            each, _ = distinct(rows)
            inverse = np.searchsorted(each, rows)
            at = of.pairs_of(each)
            place = np.searchsorted(codes, of.code[at])
            if len(at) and not np.array_equal(codes[place], of.code[at]):
                raise RuntimeError("the second pass links a pair that the first has not seen")
            owner = np.repeat(np.arange(len(each)), of.n_pairs[each])
            sums = [np.zeros(len(each), np.int64) for _ in range(2)]
            np.add.at(sums[0], owner, of.times[at] * highest[place])
            np.add.at(sums[1], owner, of.times[at] * counts[place])
            values = [of.n_a[rows], of.n_b[rows], of.n_groups[rows], of.n_links[rows], sums[0][inverse], sums[1][inverse]]
            totals = []
            for value in values:
                total = np.zeros(n, np.int64)
                np.add.at(total, text, value)
                totals.append(pa.array(total))
            names = list(map(of.names.__getitem__, rows.tolist()))
            ends = np.cumsum(np.bincount(text, minlength=n)).tolist()
            joined = [b"".join(names[i:j])[:-1] for i, j in zip([0, *ends], ends)]
            digests = [hashlib.sha256(j).hexdigest() if j else "" for j in joined]
            columns = [piece.column(0).cast(arrow.field(0).type), *totals, pa.array(digests, pa.string())]
            if groups:
                columns.append(pa.array([j.decode() for j in joined], pa.string()))
            return pa.RecordBatch.from_arrays(columns, arrow.names)

        block.__annotations__ = _BY_GROUP
        texts = self.blocks.filter("spot IS NULL").select("block", "id", "text")
        rows = texts.unionByName(self._answers(), allowMissingColumns=True)
        return rows.groupBy("block").applyInArrow(block, schema).withColumnRenamed("id", id_col)


class _Slice:
    """The pairs of a slice: their hash, and the keys to compare with."""

    def __init__(self, row: dict):
        self.hash, self.keys = PerfectHash.from_bytes(row["hash"]), np.frombuffer(row["keys"], "<u8")

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        found = self.hash.numbers(codes)
        if not np.array_equal(self.keys[found], codes):
            raise RuntimeError("a pair is not in its slice's table")
        return found


_BY_GROUP = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
_KINDS = {"spot": pa.int32(), "node": pa.int64(), "n": pa.int64(), "block": pa.int64(),
          "codes": pa.binary(), "counts": pa.binary(), "hash": pa.binary(), "keys": pa.binary()}
_UNION, _HASHED, _SUMMED, _ANSWER = (
    pa.schema([(name, _KINDS[name]) for name in names.split()])
    for names in ("spot node n codes", "spot n hash keys", "spot node n counts", "block spot n codes counts")
)


def align(
    df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False
) -> DataFrame:
    """One row per row of ``df``: its id, counts of its tokens, groups and links, and what these are worth.

    ``n_a, n_b, n_groups, n_links``; ``n_best``, the links whose pair is as common as any
    of its A id; ``count_sum``, the sum over the links of the number of documents that
    link the pair; ``groups_sha256``, of the groups written as ``a1,a2|b1;a3|b2,b3``, and
    with ``groups`` that text itself.  A null or empty text, and one that the tokens do
    not give back (one with U+2581), has no tokens: zeros and an empty string.  Null ids
    and repeated rows are kept; other columns are not read.  An empty table gives an
    empty result.  A long text is a block of its own.
    """
    return CorpusPairs(df, a_path, b_path, id_col, text_col).documents(id_col, groups)


def pair_counts(df: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """``a_id, b_id, n_documents`` for every pair of tokens that some text of ``df`` links."""
    return CorpusPairs(df, a_path, b_path, text_col, text_col).counts()
