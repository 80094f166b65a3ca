"""Text to token ids with a public tokenizer, quickly.

The tokenizers library splits a text into pieces and merges each piece by itself, so a piece has
the same ids wherever it stands. Natural text repeats its words; each worker therefore keeps the
ids of pieces that it has met (bounded: of two generations the older goes) and asks the library's model
only for words that it hasn't. Whatever the quick split can't promise to cut as the library would (rare white space,
letters with context rules, the names of special tokens) goes through the library as a whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array

import numpy as np
import regex

_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_BYTES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space other than ASCII's, and control characters that Python alone counts as such.
_ODD_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: The first letter that may have other forms; those before it are single characters in NFC.
_FORMS = "\u0250"
#: A space after other white space: a run that cutting at spaces would break.
_RUNS = ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ")
#: White space next to which the end of a line may be no part of its own.
_NO_LINES = ("\n\n", "\t", "\r", "\x0b", "\x0c")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Known(dict):
    """Ids of pieces; a new piece is looked up in the last generation, or learnt, when it is asked for."""

    def __init__(self, old: dict, learn):
        super().__init__()
        self.old, self.learn = old, learn

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.learn(piece)
        self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts; equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    A piece is a word as it stands between blanks. Of the byte-level kind it has a space before it, or,
    if it begins with a zero character, none.
    """

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.lowered = spec["model"].get("end_of_word_suffix") == "</w>"
        if not self.lowered and (spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel"):
            raise ValueError(f"{path}: not a kind of tokenizer that is known here")
        self.letters, self.most = byte_letters(), most
        #: Two bytes an id if all ids fit.
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.model, self.blank = self.whole.model, self.letters[32]
        #: Letters without other forms, spelled in the byte-level alphabet.
        self.spelled = {c: "".join(self.letters[b] for b in chr(c).encode()) for c in range(ord(_FORMS))}
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.known = _Known({}, self._learn)

    def forget(self) -> None:
        """Give up the ids of all pieces, which take up to some 200 MB."""
        self.known = _Known({}, self._learn)

    def turn(self) -> None:
        """Begin a new generation of pieces; those that are met again come over from the last."""
        self.known.old = {}
        self.known = _Known(self.known, self._learn)

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _merged(self, spelled: str) -> bytes:
        return self._pack([t.id for t in self.model.tokenize(spelled)])

    def _part(self, part: str) -> bytes:
        """Ids of what the tokenizer's pattern takes as one; kept as those of the piece that it would be."""
        return self.known[part if self.lowered else part[1:] if part[0] == " " else "\0" + part]

    def _learn(self, piece: str) -> bytes:
        # most pieces are a word, or a word and one mark; the pattern cuts these the same way
        if piece.isalpha():
            if piece.isascii():
                if not self.lowered or piece.islower():
                    return array(self.code, [t.id for t in self.model.tokenize(piece if self.lowered else self.blank + piece)]).tobytes()
            elif max(piece) < _FORMS and (not self.lowered or piece.lower() == piece):
                spelled = piece.translate(self.spelled)
                return array(self.code, [t.id for t in self.model.tokenize(spelled if self.lowered else self.blank + spelled)]).tobytes()
        elif piece[-1:] in ".,;:!?" and piece[:-1].isalpha():
            return self.known[piece[:-1]] + self._part(piece[-1])
        if self.lowered:
            if not piece.isascii() and max(piece) >= _FORMS:
                return self._pack(self.whole.encode(piece, add_special_tokens=False).ids)
            text = unicodedata.normalize("NFC", piece).lower()
        else:
            text = piece[1:] if piece[:1] == "\0" else " " + piece
        parts = (_WORDS if self.lowered else _BYTES).findall(text)
        if parts == [text] and (text == piece or not self.lowered):
            return self._merged(text.encode().decode("latin-1").translate(self.letters))
        return b"".join(map(self._part, parts))

    def _strange(self, text: str) -> bool:
        return any(x in text for x in self.special) or "\0" in text or any(map(text.__contains__, _ODD_SPACE))

    def _split(self, text: str) -> list[str] | None:
        """Pieces whose ids can be put one after another; None if the library must see the whole."""
        if self._strange(text):
            return None
        if self.lowered:
            # letters up to Latin-1 have no other forms and no context rules, so the case can go at once
            return (text.lower() if text.isascii() or _latin(text) else text).split()
        if not text or text[0] == " " or text[-1] == " " or any(x in text for x in _RUNS):
            return None
        if "\n" in text and not any(x in text for x in _NO_LINES):
            text = text.replace("\n", " \0\n \0")  # a line's end is a part of its own
        return ("\0" + text).split(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array of ``kind``, and how many each text has."""
        if len(self.known) > self.most:
            self.turn()
        of = self.known.__getitem__
        split = map(self._split, texts)
        found = [self._odd(t) if pieces is None else b"".join(map(of, pieces)) for t, pieces in zip(texts, split)]
        return np.frombuffer(b"".join(found), self.kind), np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize

    def _odd(self, text: str) -> bytes:
        if self.lowered or self._strange(text):
            return self._pack(self.whole.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self._part, _BYTES.findall(text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, most: int = 300_000) -> Encoder:
    """One encoder per worker process and file; Spark reuses workers, so what one task met helps the next. ``most``: pieces of a generation."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].most = most
    return _ENCODERS[path]
