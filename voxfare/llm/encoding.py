"""Byte-pair encoding of whole texts with the tokenizers library, with the ids of known words kept.

A space between two characters that are no white space always starts a new word of a byte-level
vocabulary. Texts whose spaces are all of this kind are split there and each distinct part is looked up; a new part
is split into words by the vocabulary's pattern, and the library's model merges each new word. Any other
text is encoded by the library as a whole. Either way the ids are those of the library for the whole text.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from functools import cache

import public_tokenizers
import regex
from tokenizers import Tokenizer

#: Parts kept per task; beyond that new ones are encoded each time they come.
MAX_KEPT = 1_000_000
#: Characters of white space other than the space, by the Unicode property; and the opening of a special token.
OTHER_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ODD = ("  ", "<|", "\0", *[" " + c for c in "\t\n\r"], *[c + " " for c in "\t\n\r"])
RARE_SPACE = re.compile(f"[{''.join(c for c in OTHER_SPACES if c not in chr(9) + chr(10) + chr(13))}]")
SPLIT = regex.compile(public_tokenizers.PATTERN)


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 characters stand for
    themselves, the other bytes for the letters from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + others.index(b)) for b in others}


LETTERS = byte_letters()
SPACE = LETTERS[ord(" ")]


@dataclass(frozen=True)
class Encoder:
    """Where the vocabulary file is; opened inside each task."""

    path: str

    def open(self) -> Coder:
        """One coder per worker process, so that later tasks find the words of earlier ones."""
        return _opened(self.path)


@cache
def _opened(path: str) -> Coder:
    return Coder(Tokenizer.from_file(path))


class Coder(dict):
    """Ids as little-endian unsigned 32-bit bytes, by part of a text."""

    def __init__(self, library: Tokenizer):
        super().__init__()
        self.library = library
        self.merge = library.model.tokenize

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        written = word.replace(" ", SPACE) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(LETTERS)
        return array("I", [t.id for t in self.merge(written)]).tobytes()

    def __missing__(self, part: str) -> bytes:
        body = part[1:] if part[:1] == " " else part
        if body.isalpha():
            ids = self.word(part)
        elif body[:-1].isalpha() and body[-1] in ".,;:!?":
            ids = self[part[:-1]] + self.word(part[-1])
        else:
            ids = b"".join([self.word(w) if w == part else self[w] for w in SPLIT.findall(part)])
        if len(self) < MAX_KEPT:
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as bytes; the empty text has none."""
        if text.endswith(" ") or any(o in text for o in ODD) or RARE_SPACE.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.replace(" ", "\0 ").split("\0")))
