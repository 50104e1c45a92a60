"""Vocabulary files of byte-level tokenizers, and cutting texts where no token can cross."""

from __future__ import annotations

import base64
import re

#: A run of letters and digits, or of other signs with the letters and digits after it; each with the white space before it. The patterns of
#: byte-level tokenizers let no token go on from a letter or digit to another sign, or from any of these to white space, and look at nothing
#: before a token; so each chunk gives the same tokens alone as in its text. The information separators are white space to Python only.
CHUNK = re.compile(r"[^\S\x1c-\x1f]*(?:[^\W_]+|(?:[^\w\s]|[_\x1c-\x1f])+[^\W_]*)|[^\S\x1c-\x1f]+")

#: The same without white space, for tokenizers that drop it.
WORD_CHUNK = re.compile(r"[^\W_]+|(?:[^\w\s]|[_\x1c-\x1f])+[^\W_]*")

#: Short strings that one generation of a worker's cache holds, and how short they are, so that its memory is bounded.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 40


def byte_alphabet() -> list[str]:
    """For each byte, the printable character that stands for it in vocabulary files.

    Bytes that print stand for themselves; the others get the characters from 256 on, in order.
    """
    printable = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class BoundedCache(dict):
    """What a function gives for a string, remembered for short strings.

    When it is full, its entries become the old generation, from which those still in use come back; so frequent strings stay.
    """

    def __init__(self, function, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.function, self.entries, self.old = function, entries, {}

    def __missing__(self, text: str):
        value = self.old.get(text)
        if value is None:
            value = self.function(text)
        if len(text) <= CACHE_CHARS:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[text] = value
        return value
