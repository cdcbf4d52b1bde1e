"""Byte-level BPE by an index of pair occurrences.

All new words of a part of a partition are laid side by side.  An index maps each
pair of neighbouring symbols that can be merged to all its positions.  The active ranks are
applied in ascending order, each to all positions of its pair; a merge changes the lists only
of the pairs to its left and right.  Merges never cross words, so that a word's symbols are those it would
have alone, and are kept for its next occurrence.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from seamline.llm import textbuf
from seamline.llm.frames import text_column, with_struct

# The characters that count as space, and the pattern that cuts texts into
# words for this kind of vocabulary.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
_KEPT = 100_000  # chunks
_WORDS_KEPT = 800_000
_LONGEST_KEPT = 64
_AT_ONCE = 8192  # words that share an index
_NONE = 1 << 30


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself if it is visible."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PairIndexTokenizer:
    """Encodes and decodes with the vocabulary of a tokenizer file, given as its bytes."""

    def __init__(self, data: bytes, words_kept: int = _WORDS_KEPT):
        import regex

        self.words_kept = words_kept

        spec = json.loads(data)
        model, cut = spec["model"], spec["pre_tokenizer"]
        if (
            model["type"] != "BPE" or cut["type"] != "ByteLevel" or cut["add_prefix_space"]
            or not cut.get("use_regex", True) or spec["normalizer"] or model.get("dropout")
            or model.get("ignore_merges") or model.get("unk_token")
            or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
        ):
            raise ValueError("needs a plain byte-level BPE vocabulary")
        added = {t["content"]: t for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added.values()):
            raise ValueError("added tokens with conditions are not supported")
        letters = byte_letters()
        ids = model["vocab"]
        self.byte_id = np.array([ids[letters[b]] for b in range(256)])
        self.size = max([*ids.values(), *(t["id"] for t in added.values())]) + 1
        self.rank: dict[int, int] = {}
        self.pair: list[tuple[int, int]] = []
        self.made: list[int] = []
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            key = ids[a] * self.size + ids[b]
            if key not in self.rank:
                self.rank[key] = len(self.pair)
                self.pair.append((ids[a], ids[b]))
                self.made.append(ids[a + b])
        self.follow: list[dict[int, int]] = [{} for _ in range(self.size)]  # ranks by left and right symbol
        for r, (a, b) in enumerate(self.pair):
            self.follow[a][b] = r
        made_by = dict(zip(self.made, range(len(self.made))))
        if any(max(made_by.get(a, -1), made_by.get(b, -1)) >= r for r, (a, b) in enumerate(self.pair)):
            raise ValueError("a merge must come after those that make its parts")
        keys = np.array(list(self.rank))
        self.pair_ranks = np.argsort(keys)
        self.pair_keys = keys[self.pair_ranks]
        self.byte_rank = self._ranks(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256))
        value = {letter: b for b, letter in letters.items()}
        self.piece = [b""] * self.size
        for token, k in ids.items():
            self.piece[k] = bytes(value[c] for c in token)
        for token, t in added.items():
            self.piece[t["id"]] = token.encode()
        self.added = {token: np.array([t["id"]], "<u4").tobytes() for token, t in added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.words = regex.compile(WORDS)
        self.chunks = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
        self.known: dict[str, bytes] = {}
        self.word_ids: dict[str, bytes] = {}

    def merged(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of a list of words, none empty, as little-endian 32-bit integers.

        The words lie side by side.  The index maps the rank of every pair that can be merged
        to all its positions; ranks are applied in ascending order, each to all its
        positions from left to right, and the lists of the pairs beside a merge are
        extended.  A position whose pair has changed meanwhile is passed over.
        """
        if not words:
            return []
        data = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.array([len(word) for word in words])
        ends = np.cumsum(lengths)
        rank = np.full(len(data), _NONE)
        rank[:-1] = self.byte_rank[data[:-1].astype(np.int64) * 256 + data[1:]]
        rank[ends - 1] = _NONE
        places = self._positions(rank)
        follow, made, pair = self.follow, self.made, self.pair
        symbol = self.byte_id[data].tolist()
        after, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        after[ends - 1] = before[ends - lengths] = -1
        after, before = after.tolist(), before.tolist()
        active = list(places)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            (left, right_symbol), new = pair[r], made[r]
            then, found = follow[new].get, places.get
            at_rank = places.pop(r)
            at_rank.sort()
            for at in at_rank:
                right = after[at]
                if symbol[at] != left or right < 0 or symbol[right] != right_symbol:
                    continue  # an earlier merge has taken one of the two
                symbol[at], symbol[right] = new, -1
                beyond, prior = after[right], before[at]
                after[at] = beyond
                if beyond >= 0:
                    before[beyond] = at
                    beside = then(symbol[beyond])
                    if beside is not None:
                        listed = found(beside)
                        if listed is None:
                            places[beside] = [at]
                            heapq.heappush(active, beside)
                        else:
                            listed.append(at)
                if prior >= 0:
                    beside = follow[symbol[prior]].get(new)
                    if beside is not None:
                        listed = found(beside)
                        if listed is None:
                            places[beside] = [prior]
                            heapq.heappush(active, beside)
                        else:
                            listed.append(prior)
        ids = np.array(symbol)
        kept = ids >= 0
        cuts = np.append(0, np.cumsum(kept)[ends - 1]) * 4
        packed, cuts = ids[kept].astype("<u4").tobytes(), cuts.tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]

    @staticmethod
    def _positions(rank: np.ndarray) -> dict[int, list[int]]:
        """The positions of each rank."""
        at = np.flatnonzero(rank != _NONE)
        at = at[np.argsort(rank[at], kind="stable")]
        ranks = rank[at]
        first = np.flatnonzero(np.diff(ranks, prepend=-1))
        listed, edges = at.tolist(), [*first.tolist(), len(at)]
        return {r: listed[a:b] for r, a, b in zip(ranks[first].tolist(), edges, edges[1:])}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.size + right
        place = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[place] == wanted, self.pair_ranks[place], _NONE)

    def _learn(self, chunks: Iterable[str]) -> dict[str, bytes]:
        """The ids of chunks not seen before."""
        cut = {chunk: self.words.findall(chunk) for chunk in chunks}
        known = self.word_ids
        if len(known) > self.words_kept:
            known.clear()
        wanted = set().union(*cut.values())
        new = list(wanted.difference(known))
        for k in range(0, len(new), _AT_ONCE):
            some = new[k : k + _AT_ONCE]
            known.update(zip(some, self.merged([word.encode() for word in some])))
        ids = known.__getitem__
        found = {chunk: b"".join(map(ids, words)) if len(words) > 1 else ids(words[0]) for chunk, words in cut.items()}
        for word in [word for word in new if len(word) > _LONGEST_KEPT]:
            del known[word]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        cut: list[list[str]] = []
        for text in texts:
            if self.special and (parts := self.special.split(text)) and len(parts) > 1:
                found = []
                for part in parts:
                    found += [part] if part in self.added else self.chunks.findall(part)
                cut.append(found)
            else:
                cut.append(self.chunks.findall(text))
        known, wanted = self.known, set().union(*cut)
        if len(known) + len(wanted) > _KEPT:
            known.clear()
        known.update(self.added)
        known.update(self._learn(wanted.difference(known)))
        found = [b"".join(map(known.__getitem__, chunks)) for chunks in cut]
        for chunk in wanted:
            if len(chunk) > _LONGEST_KEPT:
                del known[chunk]
        return found

    def decode(self, ids: bytes) -> str:
        """The text of ids given as little-endian 32-bit integers."""
        piece = self.piece
        return b"".join([piece[k] for k in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_tokenizers: dict[tuple, PairIndexTokenizer] = {}


def tokenizer(data: bytes, words_kept: int = _WORDS_KEPT) -> PairIndexTokenizer:
    """The tokenizer of a file, made once in each process."""
    name = hashlib.sha256(data).hexdigest(), words_kept
    if name not in _tokenizers:
        _tokenizers[name] = PairIndexTokenizer(data, words_kept)
    return _tokenizers[name]


def decode(ids: Column, path: str) -> Column:
    """The text of packed ids; null ids give an empty text."""
    data = Path(path).read_bytes()

    def make(packed: pa.Array) -> dict:
        of = tokenizer(data)
        return {"text": [of.decode(i or b"") for i in packed.to_pylist()]}

    return text_column(make, "text string", "binary")(ids)["text"]


def id_array(ids: Column) -> Column:
    """Packed ids as ``array<int>``."""

    def make(packed: pa.Array) -> dict:
        data, offsets = textbuf.buffers(packed)
        values = pa.array(np.frombuffer(data.tobytes(), "<u4").astype(np.int32))
        return {"ids": pa.ListArray.from_arrays(pa.array((offsets // 4).astype(np.int32)), values)}

    return text_column(make, "ids array<int>", "binary")(ids)["ids"]


def tokenize(
    df: DataFrame, path: str, text_col: str = "text", into: str = "tokens", decoded: bool = False,
    keep: list[str] | None = None, checked: bool = False, words_kept: int = _WORDS_KEPT,
) -> DataFrame:
    """``df`` with its texts' tokens in ``into``: ``struct<n_tokens long, ids binary>``.

    Ids are packed as little-endian 32-bit integers.  With ``decoded`` the struct also
    has ``decoded``, the text that the ids decode to; with ``checked`` it has ``round_trip``,
    whether that is the text, found in the task.  A null text encodes like an empty
    one, to no ids.  ``into`` replaces a column of that name; all other columns stay,
    whatever their names, or those that ``keep`` lists.  Repeated rows are encoded alike; an empty table gives an empty
    result.  A worker keeps the ids of ``words_kept`` words, about 150 bytes each; the
    result does not depend on it.
    """
    data = Path(path).read_bytes()

    def make(texts: pa.Array) -> dict:
        of = tokenizer(data, words_kept)
        plain = [t or "" for t in texts.to_pylist()]
        ids = of.encode(plain)
        made = {"n_tokens": np.array([len(i) // 4 for i in ids], np.int64), "ids": pa.array(ids, pa.binary())}
        if checked:
            made["round_trip"] = [of.decode(i) == t for i, t in zip(ids, plain)]
        return made | ({"decoded": [of.decode(i) for i in ids]} if decoded else {})

    return with_struct(df, text_col, make, "n_tokens long, ids binary" + ", round_trip boolean" * checked + ", decoded string" * decoded, into, keep)
