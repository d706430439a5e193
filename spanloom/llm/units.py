"""Cutting a text where a byte-level BPE pattern cuts it in any case.

The pattern (spaces before words, white-space runs) never joins text across an ASCII space that has a character other
than white space on at least one side, so the tokens of a text are those of its units, one after another.
"""

from __future__ import annotations

import re

_BLANKS = re.compile(r" \s")
_SAFE = re.compile(r"(?= )(?:(?<=\S)|(?= \S))")


def units(text: str) -> list[str]:
    """The units of a text: each but the first begins with a space."""
    if not text:
        return []
    if _BLANKS.search(text):
        return [x for x in _SAFE.split(text) if x]
    head, *rest = text.split(" ")
    return ([head] if head else []) + [" " + x for x in rest]


def stretches(text: str, most: int) -> list[str]:
    """The text in parts of about `most` characters, each whole units; a longer unit is a part of its own."""
    if len(text) <= most:
        return [text] if text else []
    out, at = [], 0
    while len(text) - at > most:
        cut = at + most
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or not text[cut - 1].isspace() or not text[cut + 1 : cut + 2].isspace():
                break
            cut += 1
        if cut <= at or cut >= len(text) - 1:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]
