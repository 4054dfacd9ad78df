"""Splitting text into the pieces that byte-level BPE encodes one by one."""

from __future__ import annotations

import re

import public_tokenizers
import regex

EXACT = regex.compile(public_tokenizers.PATTERN)

#: Characters for which the plain pattern below splits like the exact one:
#: printable ASCII, line ends, and the Latin letters and signs up to U+024F
#: without the numerals among them.
_ODD = re.compile("[^\t\n\r -~¡-±´-¸º»¿-ɏ]")
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_SIGN = "!-/:-@\\[-`{-~¡-©«-±´¶-¸»¿×÷"
_PLAIN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[{_SIGN}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+"
)


def pieces(text: str) -> list[str]:
    """All matches of public_tokenizers.PATTERN, which cover the text."""
    return (EXACT if _ODD.search(text) else _PLAIN).findall(text)


class Memo(dict):
    """What was worked out per piece; starts anew when full, so memory is bounded."""

    def __init__(self, work, most: int = 400_000, longest: int = 64):
        super().__init__()
        self.work, self.most, self.longest = work, most, longest

    def __missing__(self, piece):
        value = self.work(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = value
        return value
