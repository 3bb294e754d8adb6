"""Token ids of whole texts with a public tokenizer.

The tokenizer's rules never look across white space: normalisation maps every white-space run to one space and the
pre-tokenizer's pieces hold none. So the ids of a text are the ids of its white-space separated words in order, and a
bounded per-process memo of words gives the same ids as encoding the text at once, many times faster. The memo holds
ids as little-endian unsigned 32-bit bytes; joining them gives the ids of a document.
"""

from __future__ import annotations

import codecs
import re
import struct

import numpy as np

# The tokenizer's pieces, for lower-case words of printable ASCII.
_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
_PRINTED = re.compile(rb"[!-~]+").fullmatch

END_ID = 1
END = np.array([END_ID], "<u4").tobytes()
TOKENIZER = "word_bpe_49k.json"
#: Words that one process remembers (about 0.2 KB each): half of them lately seen, half seen before these.
MEMO_WORDS = 500_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_table() -> str:
    """The printable character that a byte-level vocabulary uses for each byte value."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(rest)) for b in range(256))


class Encoder(dict):
    """Memo from a word's UTF-8 bytes to its ids' bytes; call it with a text's UTF-8 bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._normal = self._tokenizer.normalizer
        self._table = _byte_table()
        self._older: dict[bytes, bytes] = {}
        self.vocabulary = self._tokenizer.get_vocab_size()

    def __call__(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, text.split())) if text else b""

    def __missing__(self, word: bytes) -> bytes:
        ids = self._older.get(word)
        if ids is None:
            ids = self._ids(word)
        if len(self) >= MEMO_WORDS // 2:
            self._older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _ids(self, word: bytes) -> bytes:
        if b"<|" in word:  # may hold a special token, which the library matches before it normalises
            return self._encode(word)
        if word.isascii():
            low = word.lower()
            if low != word:
                return self[low]
            if word.isalpha():
                return self._piece(word)
            if not _PRINTED(word):
                return self._encode(word)
            pieces = _PIECES(word)
            return b"".join(map(self.__getitem__, pieces)) if len(pieces) > 1 else self._piece(word)
        text = word.decode("utf-8", "replace")
        if text.isalpha():
            text = self._normal.normalize_str(text)
            return self._piece(text.encode()) if text.isalpha() else self._encode(word)
        if text[-1] in ".,;:!?" and text[-2].isalpha() and self._normal.normalize_str(text[-2]).isalpha():
            return self[word[:-1]] + self[word[-1:]]
        return self._encode(word)

    def _piece(self, piece: bytes) -> bytes:
        """Ids of one piece of the pre-tokenizer, already normalised."""
        found = self._model.tokenize(codecs.charmap_decode(piece, "strict", self._table)[0])
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def _encode(self, word: bytes) -> bytes:
        ids = self._tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This process's encoder for a tokenizer file; workers that are reused keep their memo."""
    path = path or tokenizer_path()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
