"""Byte-level BPE token ids of whole texts, piece by piece.

A byte-level BPE vocabulary splits a text into pieces by a fixed pattern and
encodes each piece by itself, so the tokenizers library is asked once for each
distinct piece and a bounded table of pieces answers the rest.  Texts with a
special string, or with characters whose class might differ between the
pattern engines, go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np

from . import kernel

#: The piece pattern of byte-level BPE vocabularies, for the characters that _PLAIN lets through.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Anything but ASCII, Latin letters and common punctuation; U+001C-1F and fractions and superscripts class differently.
_ODD = re.compile("[^\\x00-\\x1b\\x20-\\x84\\x86-\\xa9\\xab-\\xb1\\xb4\\xb6-\\xb8\\xbb\\xbf-\\u024f\\u2010-\\u2027\\u2030-\\u205e]")
#: Entries of the table of pieces in each Python worker.
TABLE = 1_000_000


def public_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def is_space(char: str) -> bool:
    """White space of the piece pattern, which U+001C-1F are not."""
    return char.isspace() and not "\x1c" <= char <= "\x1f"


def printable() -> list[str]:
    """The character of a byte-level vocabulary for each byte: printable ones stand for themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (chr(k) for k in range(256, 512))
    return [chr(b) if b in plain else next(rest) for b in range(256)]


class Remembered(dict):
    """Answers of a function, worked out on demand; drops the newer half when it holds too many, as what is frequent comes early."""

    def __init__(self, find, most: int = TABLE):
        self.find, self.most = find, most

    def __missing__(self, key):
        if len(self) >= self.most:
            for last in list(islice(reversed(self), self.most // 2)):
                del self[last]
        found = self[key] = self.find(key)
        return found


class Encoder:
    """Ids of texts under a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, most: int = TABLE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        tokenize, chars = self.library.model.tokenize, dict(enumerate(printable()))
        #: ids of a piece, by the library's model, as bytes of 32-bit integers
        self.table = Remembered(lambda p: array("I", [t.id for t in tokenize(p.encode().decode("latin-1").translate(chars))]).tobytes(), most)

    def odd(self, text: str) -> bool:
        """Only the library can split this text."""
        return _ODD.search(text) is not None

    def whole(self, text: str) -> bool:
        """The library must see this text as a whole."""
        return self.odd(text) or any(s in text for s in self.special)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.uint32)
        if self.whole(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        table = self.table
        return np.frombuffer(b"".join([table[p] for p in PIECES.findall(text)]), dtype=np.uint32)


@lru_cache(maxsize=4)
def encoder(path: str, most: int = TABLE) -> Encoder:
    """One encoder for each file and Python worker."""
    return Encoder(path, most)


kernel.FORGET.append(encoder.cache_clear)
