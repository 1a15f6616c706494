"""Public tokenizers over whole texts, faster than text by text and with the same ids.

Both vocabularies split a text before they merge, and never across the places where an Encoder
cuts; so ids are kept by piece of text and, below that, by the tokenizer's own pre-tokens, and only
pre-tokens not yet seen reach the library's model. A text that holds the string of an added token, such as
<|endoftext|>, goes to the library as a whole, which makes one id of it. A piece with any character for which the split
can't be shown to be the tokenizer's goes through the whole library instead. An Encoder keeps
at most CACHED pieces (or as many as it is told) and PRETOKENS pre-tokens and then starts afresh, so memory is bounded; the ids don't
depend on what it holds.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

CACHED, PRETOKENS, KEPT = 250_000, 400_000, 400_000

#: Characters of which Python's classes and the tokenizers' are known to agree.
_PLAIN = re.compile("[\n\x21-\x7e\u00c0-\u012f\u0131-\u024f]+")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_SPACED = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_LAST, _MARKS = "\u0250", frozenset(",.;:!?")
_CUT = re.compile(r"(?<=\S)(?= \S)")


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies use for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def width_of(path: str, *more: int) -> int:
    """Bytes that hold every id of a vocabulary, and those in more."""
    return 2 if max([*load(path).get_vocab().values(), *more]) < 1 << 16 else 4


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Odd(Exception):
    """A piece with white space at an end, or an empty one: this text needs the careful cut."""


class _Pieces(dict):
    """Ids by piece of text; a piece not yet seen is learnt. before: what precedes each piece in its text."""

    def __init__(self, tokenizer, before: str, pattern: re.Pattern, pretokens: dict, kind: str, most: int):
        super().__init__()
        self.kind, self.most = kind, most
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, byte_letters()
        self.space = self.letters[32]
        self.before, self.pattern, self.pretokens = before, pattern, pretokens

    def __missing__(self, piece: str) -> bytes:
        if not self.before:
            if not piece:
                return b""
        elif not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Odd
        if len(self) > self.most:
            self.clear()
        known, full = self.pretokens, self.before + piece if self.before else piece.lower()
        if piece.isalpha() and (piece.isascii() or max(piece) < _LAST and "\u0130" not in piece):  # a word
            out = known.get(full) or self.learn(full)
        elif piece[-1] in _MARKS and piece[:-1].isalpha() and (piece.isascii() or max(piece) < _LAST and "\u0130" not in piece):  # a word and a mark
            out = (known.get(full[:-1]) or self.learn(full[:-1])) + (known.get(full[-1]) or self.learn(full[-1]))
        else:
            out = self.plain(full) if _PLAIN.fullmatch(piece) else self.library(self.before + piece)
        self[piece] = out
        return out

    def plain(self, text: str) -> bytes:
        known = self.pretokens
        return b"".join([known.get(x) or self.learn(x) for x in self.pattern.findall(text if self.before else text.lower())])

    def whole(self, text: str) -> bytes:
        """Ids of a text that stands first or alone."""
        return self.plain(text) if _PLAIN.fullmatch(text) else self.library(text)

    def library(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, pretoken: str) -> bytes:
        if len(self.pretokens) > PRETOKENS:
            self.pretokens.clear()
        if not pretoken.isascii():
            name = pretoken.encode().decode("latin-1").translate(self.letters)
        elif pretoken.isalnum():
            name = pretoken
        elif pretoken[0] == " " and pretoken[1:].isalnum():
            name = self.space + pretoken[1:]
        else:
            name = pretoken.translate(self.letters)
        self.pretokens[pretoken] = out = array(self.kind, [t.id for t in self.model.tokenize(name)]).tobytes()
        return out


class Encoder:
    """encode(texts): for each text its ids as bytes, unsigned little-endian numbers of `width` bytes, 2 or 4."""

    def __init__(self, path: str, width: int = 4, cached: int | None = None):
        self.tokenizer = load(path)
        vocab = self.tokenizer.get_vocab()
        self.word_ends = sum(t.endswith("</w>") for t in vocab) > len(vocab) // 10
        self.pieces = _Pieces(self.tokenizer, *(("", _WORD) if self.word_ends else (" ", _SPACED)), {}, {2: "H", 4: "I"}[width], cached or CACHED)
        self.get = self.pieces.__getitem__
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content)
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE).search if added else lambda text: None

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [(self.pieces.library if self.added(t) else self._words if self.word_ends else self._spaced)(t) if t else b"" for t in texts]

    def _words(self, text: str) -> bytes:
        """White space is dropped, so any space or line end is a place to cut."""
        return b"".join(map(self.get, text.replace("\n", " ").split(" ")))

    def _spaced(self, text: str) -> bytes:
        """A single space belongs to the word after it; the first piece has none.

        Every space is a cut if no piece is empty or has white space at an end; else only those
        spaces are that stand between other characters.
        """
        first, *rest = text.split(" ")
        try:
            if rest and (not first or first[-1].isspace()):
                raise _Odd
            return self.pieces.whole(first) + b"".join(map(self.get, rest))
        except _Odd:
            first, *rest = _CUT.split(text)
            last = [rest.pop()] if rest and rest[-1][-1].isspace() else []
            return self.pieces.whole(first) + b"".join([self.get(p[1:]) for p in rest]) + b"".join(map(self.pieces.whole, last))


@lru_cache(maxsize=1)
def kept_encoder(path: str, width: int = 4) -> Encoder:
    """An Encoder that a Python worker keeps from one task to the next, with up to KEPT pieces it has learnt."""
    return Encoder(path, width, KEPT)
