"""Words of whole texts for the operators that compare texts by runs of words.

A-Z become lower case; words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``: digits, small letters and every character
beyond ASCII. In UTF-8 all bytes of such a character are 0x80 and more, so the rule holds byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a long text that are split into words at once.
PIECE = 1 << 20


def _folded(byte: int) -> int:
    c = chr(byte).lower() if byte < 0x80 else ""
    return byte if byte >= 0x80 else ord(c) if c.isdigit() or c.isalpha() else 0x20


_FOLD = bytes(_folded(b) for b in range(256))


def word_lists(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of bounded length, none of them empty."""
    if not text:
        return
    folded = text.translate(_FOLD)
    at = 0
    while at < len(folded):
        # a piece ends at a separator; a word longer than a piece stays whole
        end = len(folded) if len(folded) - at <= PIECE else folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        found = folded[at:end].split()
        if found:
            yield found
        at = end
