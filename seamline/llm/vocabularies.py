"""Public vocabularies as their libraries read them, and the bytes that their tokens stand for."""

from __future__ import annotations

import hashlib
import json

import numpy as np

from seamline.llm.pair_index_bpe import WORDS, byte_letters

SPACE = "▁"  # fixed value: how piece models write a space


class ByteVocabulary:
    """A byte-level BPE vocabulary, given as the bytes of its tokenizer file.

    Its merges make tokens of ascending ids, so that an id is its own rank and the ids
    can be found by rank; a text that this way refuses goes to the file's own library.
    """

    def __init__(self, data: bytes):
        import tiktoken

        spec = json.loads(data)
        model, cut = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("needs a plain byte-level BPE vocabulary")
        value = {letter: b for b, letter in byte_letters().items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(value[c] for c in token): k for token, k in model["vocab"].items() if token not in self.added}
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(set(made)) or (made and made[0] < 256):
            raise ValueError("needs ids that ascend with the merges")
        self.size = max([*ranks.values(), *self.added.values()]) + 1
        self.pieces = [b""] * self.size
        for token, k in [*ranks.items(), *((t.encode(), k) for t, k in self.added.items())]:
            self.pieces[k] = token
        self.lengths = np.array([len(p) for p in self.pieces])
        name = hashlib.sha256(data).hexdigest()
        self._data, self._library = data, {}
        # White space as the file's own library sees it, whatever "\s" means elsewhere.
        self._core = tiktoken.Encoding(name, pat_str=WORDS, mergeable_ranks=ranks, special_tokens=self.added)

    def encode(self, text: str, special: bool = True) -> np.ndarray:
        """The ids of a text; ``special``: the strings of special tokens stand for them."""
        try:
            if special:
                return self._core.encode_to_numpy(text, allowed_special="all")
            return self._core.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # a run of white space that its regular expressions cannot hold
            return np.array(self._plainly(special).encode(text, add_special_tokens=False).ids, np.uint32)

    def _plainly(self, special: bool):
        from tokenizers import Tokenizer

        if special not in self._library:
            self._library[special] = Tokenizer.from_buffer(self._data)
            self._library[special].encode_special_tokens = not special
        return self._library[special]


class PieceVocabulary:
    """A sentencepiece BPE model with byte fallback, given as the bytes of its file.

    Texts are encoded as they are: a space that the model sets before a text must be
    part of it.
    """

    def __init__(self, data: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        spec, kind = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("needs a model that leaves texts as they are")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces):
            raise ValueError("models with pieces of the user's own are not supported")
        self.adds_space = spec.add_dummy_prefix
        spec.add_dummy_prefix = False
        self._model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.pieces = [
            bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else p.piece.replace(SPACE, " ").encode()
            for p in proto.pieces
        ]
        self.size = len(self.pieces)
        self.lengths = np.array([len(p) for p in self.pieces])
        blank = f"\t\n\v\f\r {SPACE}"
        inside = {
            b for p in proto.pieces if p.type == kind.NORMAL for a, b in zip(p.piece, p.piece[1:]) if a not in blank
        }
        # Before these characters, after a visible one, no piece goes on.
        self.cuts = "".join(c for c in "\t\n\v\f\r" if c not in inside) + " " * (SPACE not in inside)

    def encode(self, texts: list[str] | list[bytes]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


_known: dict[tuple, object] = {}


def vocabulary(kind: type, data: bytes):
    """A vocabulary of a file's bytes, made once in each process."""
    key = kind, hashlib.sha256(data).hexdigest()
    if key not in _known:
        _known[key] = kind(data)
    return _known[key]
