"""Cutting a text where no tokenizer of the kinds used here joins across, so that pieces can be encoded once.

A single blank between two characters that are not white space starts a token in both vocabularies: byte-level
BPE splits words there before it merges, and the sentencepiece vocabulary has no piece with the blank mark
inside or at the end (checked when the model is loaded). So a text's tokens are those of its units, one after
the other, and a unit's tokens need to be made only once per worker.
"""

from __future__ import annotations

import re

_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: units kept by a worker; beyond, it starts anew (that costs time only)
MOST_UNITS = 1_000_000


def units(text: str) -> list[str]:
    """'a b  c' gives 'a', 'b  c': the text is ' '.join(units)."""
    words = text.split()
    if len(text) - sum(map(len, words)) == len(words) - 1:  # single characters of white space, and only between words
        return text.split(" ")
    return _SAFE.split(text)
