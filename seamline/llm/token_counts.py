"""Exact token counts of every prefix of a text, for a sentencepiece BPE model.

The encoding of a prefix ends in exactly one token t such that the encoding of what
precedes t, followed by t, stands: the last two tokens must encode to themselves.  So
the count at a position is the count before its last token plus one, found from left to
right.  A table of these counts answers how many tokens any prefix has, how long the
longest prefix within a budget is, and whether a text fits, without encoding again.

No piece of the model spans certain places, such as the one before a space; texts are
cut there, and the counts of a unit between two cuts are kept for its next occurrence.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm import textbuf
from seamline.llm.frames import _quoted, text_column

SPACE = "▁"  # fixed value: how the models write a space
LIMIT = 4096
_UNITS_KEPT = 1_200_000
_PAIRS_KEPT = 2_000_000
_LONGEST_KEPT = 64


class PrefixCounter:
    """Prefix counts for one model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec, kinds = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or not plain or not spec.escape_whitespaces:
            raise ValueError("needs a BPE model that leaves texts as they are")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("models with pieces of the user's own are not supported")
        self.score = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        self.fallback = proto.trainer_spec.byte_fallback
        self.lead = SPACE if spec.add_dummy_prefix else ""
        # Pieces by their letters: a node is what follows, and the number of the piece or -1.
        self.tokens: list[str] = [""]
        self.cost: list[int] = [0]
        self.root: dict[str, tuple] = {}
        for piece in sorted(self.score, key=len):
            children = self.root
            for c in piece[:-1]:
                if c not in children:
                    children[c] = ({}, -1 if children is not self.root else self._number(c))
                children = children[c][0]
            children[piece[-1]] = ({}, self._number(piece))
        self.stands: list[dict[int, bool]] = [{} for _ in self.tokens]
        self.n_stands = 0
        self.chains: dict[str, tuple | None] = {}
        self.units: dict[str, bytes] = {}
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.part = self._cuts()

    def _number(self, token: str) -> int:
        """The number of a token; a character without a piece costs as many as its bytes."""
        self.tokens.append(token)
        self.cost.append(1 if token in self.score or not self.fallback else len(token.encode()))
        return len(self.tokens) - 1

    def _character(self, c: str) -> tuple:
        """The node of a character that begins no piece."""
        self.root[c] = ({}, self._number(c))
        self.stands.append({})
        return self.root[c]

    def _cuts(self) -> re.Pattern | None:
        """Further units inside those between spaces: letters, and others."""
        beside = {(a, b) for piece in self.score for a, b in zip(piece, piece[1:]) if a != SPACE}
        if any(b == SPACE for _, b in beside):
            self.cut = re.compile("(?s).+")
            return None
        if any(a.isalpha() != b.isalpha() for a, b in beside):
            return None
        numbers = "".join(
            c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()
        )
        other = rf"(?:(?!{SPACE})[\W\d_{numbers}])"
        return re.compile(rf"{SPACE}*(?:[^\W\d_{numbers}]+|{other}+)|{SPACE}+")

    def _merged(self, symbols: list[str]) -> list[str]:
        """Merge neighbours, best score first and leftmost among equals, until none can."""
        while True:
            best = max(
                ((self.score[a + b], -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in self.score),
                default=None,
            )
            if best is None:
                return symbols
            k = -best[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]

    def _chain(self, token: str) -> tuple | None:
        """The symbols at the left and at the right end of a token while it is merged.

        Each with the score of the merge that made it, outermost first.  None if the
        token does not encode to itself, or not by merges of falling scores.
        """
        if token in self.chains:
            return self.chains[token]
        made = np.inf if len(token) == 1 else self.score[token]
        left, right = [(token, made)], [(token, made)]
        if len(token) > 1:
            found = None
            for k in range(1, len(token)):
                a, b = token[:k], token[k:]
                if (k > 1 and a not in self.score) or (len(b) > 1 and b not in self.score):
                    continue
                of_a, of_b = self._chain(a), self._chain(b)
                if of_a and of_b and min(of_a[0][0][1], of_b[0][0][1]) > made and self._apart(of_a, of_b, made):
                    found = (left + of_a[0], right + of_b[1])
            self.chains[token] = found
        else:
            self.chains[token] = (left, right)
        return self.chains[token]

    def _apart(self, before: tuple, token: tuple, until: float = -np.inf) -> bool:
        """Whether no merge of a score over ``until`` joins two tokens that meet.

        Symbols at the border meet from the later of their own merges until the earlier
        of the merges that take them up; a merge on the left goes first among equals.
        """
        right, left = before[1], token[0]
        i = j = 0
        while True:
            (a, made_a), (b, made_b) = right[i], left[j]
            taken_a = right[i - 1][1] if i else -np.inf
            taken_b = left[j - 1][1] if j else -np.inf
            joined = self.score.get(a + b)
            if joined is not None and joined > max(taken_a, until) and joined >= taken_b:
                return False
            if made_a == made_b == np.inf:
                return True
            if made_a <= made_b:
                i += 1
            else:
                j += 1

    def _stands(self, before: int, token: int) -> bool:
        """Whether two tokens side by side (or one at the beginning) encode to themselves."""
        if self.n_stands >= _PAIRS_KEPT:
            for known in self.stands:
                known.clear()
            self.n_stands = 0
        found = self._encodes(self.tokens[before], self.tokens[token])
        self.stands[before][token] = found
        self.n_stands += 1
        return found

    def _encodes(self, before: str, token: str) -> bool:
        # Scores of pieces of spaces only do not fall, so these are merged one by one.
        if before.endswith(SPACE) or not token.strip(SPACE):
            return self._merged(list(before + token)) == ([before, token] if before else [token])
        chain = self._chain(token)
        if not before or chain is None:
            return chain is not None
        chain_before = self._chain(before)
        return chain_before is not None and self._apart(chain_before, chain)

    def _counts(self, text: str) -> bytes:
        """Counts after 1, 2, ... characters of a part, as 32-bit integers."""
        n, root, cost = len(text), self.root, self.cost
        counts, last = [0] * (n + 1), [0] * (n + 1)
        for start in range(n):
            before, count = last[start], counts[start]
            node = root.get(text[start]) or self._character(text[start])
            stands = self.stands[before].get
            end = start + 1
            while True:
                children, token = node
                if token >= 0:
                    known = stands(token)
                    if known is None:
                        known = self._stands(before, token)
                    if known:
                        counts[end] = count + cost[token]
                        last[end] = token
                if end == n:
                    break
                node = children.get(text[end])
                if node is None:
                    break
                end += 1
        return array("i", counts[1:]).tobytes()

    def unit(self, text: str) -> bytes:
        """Counts after 1, 2, ... characters of a unit, as 32-bit integers."""
        if self.part is None or text.lstrip(SPACE).isalpha():
            return self._kept(text, self._counts(text))
        found, before = [], 0
        for part in self.part.findall(text):
            counts = self.units.get(part)
            if counts is None:
                counts = self._kept(part, self._counts(part))
            found.append(counts if not before else (np.frombuffer(counts, np.int32) + np.int32(before)).tobytes())
            before = int.from_bytes(found[-1][-4:], "little")
        return self._kept(text, b"".join(found)) if len(found) > 1 else found[0]

    def _kept(self, text: str, counts: bytes) -> bytes:
        if len(text) <= _LONGEST_KEPT:
            if len(self.units) >= _UNITS_KEPT:
                self.units.clear()
            self.units[text] = counts
        return counts

    def total(self, text: str) -> int:
        return int(self.prefixes(text)[-1])

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of the first 0, 1, 2, ... characters of a text."""
        if not text:
            return np.zeros(1, np.int32)
        lead = len(self.lead)
        known, unit = self.units, self.unit
        units = self.cut.findall(self.lead + text.replace(" ", SPACE))
        inside = np.frombuffer(b"".join([known.get(u) or unit(u) for u in units]), np.int32)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        totals = inside[np.cumsum(lengths) - 1]
        before = np.cumsum(totals, dtype=np.int32) - totals
        table = np.empty(len(inside) + 1 - lead, np.int32)
        table[0] = 0
        table[1:] = (inside + np.repeat(before, lengths))[lead:]
        return table


_counters: dict[str, PrefixCounter] = {}


def counter(model: bytes) -> PrefixCounter:
    """The counter for a model, made once in each process."""
    name = hashlib.sha256(model).hexdigest()
    if name not in _counters:
        _counters[name] = PrefixCounter(model)
    return _counters[name]


def longest_within(table: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens.

    Counts need not ascend, as a longer prefix can end in a longer token.
    """
    return int(np.flatnonzero(table <= budget)[-1]) if budget >= 0 else 0


def prefix_table(text: Column, model_path: str) -> Column:
    """Array of the token counts of the first 0, 1, 2, ... characters of a text."""
    model = Path(model_path).read_bytes()

    def make(texts: pa.Array) -> dict:
        of = counter(model)
        tables = [of.prefixes(t.as_py() or "") for t in texts]
        ends = np.cumsum([0, *map(len, tables)]).astype(np.int32)
        values = np.concatenate([np.zeros(0, np.int32), *tables])
        return {"prefix_tokens": pa.ListArray.from_arrays(pa.array(ends), pa.array(values))}

    return text_column(make, "prefix_tokens array<int>")(text)["prefix_tokens"]


def tokens_of_prefix(table: Column, n_chars: Column) -> Column:
    """Tokens of the first ``n_chars`` characters, from a stored table."""
    return F.try_element_at(table, n_chars.cast("int") + 1)


def truncation(table: Column, budget: int) -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens, from a stored table."""
    return F.array_max(F.transform(table, lambda n, place: F.when(n <= budget, place)))


def count_tokens(
    df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """One row per row of ``df``: its id, ``n_bytes``, ``n_tokens``, ``over_limit``, ``fit_chars``.

    ``fit_chars`` is the number of characters of the longest prefix with at most
    ``limit`` tokens.  All are read from the text's prefix table, which is not sent on.
    A null text counts as empty and has no bytes and no tokens.  Null ids and repeated
    rows are kept as they are; other columns are not read.  An empty table gives an
    empty result.  A table takes 4 bytes a character, one text at a time.
    """
    model = Path(model_path).read_bytes()

    def make(texts: pa.Array) -> dict:
        of = counter(model)
        _, offsets = textbuf.buffers(texts)
        totals, fits = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            table = of.prefixes(text.as_py() or "")
            totals[k] = table[-1]
            fits[k] = len(table) - 1 if table[-1] <= limit else longest_within(table, limit)
        return {"n_bytes": np.diff(offsets), "n_tokens": totals, "fit_chars": fits}

    counted = text_column(make, "n_bytes long, n_tokens long, fit_chars long")
    rows = df.select(F.col(_quoted(id_col)).alias(id_col), counted(F.col(_quoted(text_col))).alias("__c"))
    return rows.select(
        _quoted(id_col), "__c.n_bytes", "__c.n_tokens",
        (F.col("__c.n_tokens") > limit).alias("over_limit"), "__c.fit_chars",
    )
