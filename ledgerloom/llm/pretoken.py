"""Cutting texts into independent units for byte-level BPE.

A space followed by a non-space always starts a new pretoken in the GPT-2 pattern, and what stands
between two such places is tokenised alike with or without its neighbours. Texts are cut there, so a
unit's result can be kept and used again for every later text.
"""

from __future__ import annotations

import re

import regex

# Unicode White_Space, as the tokenizers library reads \s (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The byte-level pretokenizer's pattern (fixed value), with \s spelt out.
PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+"
)
_CUT = re.compile(f" (?=[^{SPACE}])")
_ODD = re.compile(f" (?:[{SPACE}]|$)")
_SLICE = 1 << 20


def units(text: str) -> list[str]:
    """Units of a text, without the one space in front of every unit but the first."""
    if _ODD.search(text) is None:
        return text.split(" ")
    return _CUT.split(text)


def slices(text: str):
    """A very long text in slices of about 1 MB that start where a unit starts: (first, slice)."""
    if len(text) <= _SLICE:
        yield True, text
        return
    at, first = 0, True
    while at < len(text):
        cut = _CUT.search(text, min(at + _SLICE, len(text)))
        end = cut.start() if cut else len(text)
        yield first, text[at:end]
        at, first = end + 1, False
