"""Display widths of characters, as classes for regular expressions.

The classes follow from the character database: East Asian wide and full-width characters take two
columns; marks, format characters and the inner parts of Hangul syllables take none.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

# Ranges with a width of their own, whatever their category says.
ZERO = ((0x1160, 0x11FF), (0xD7B0, 0xD7FB), (0xE0000, 0xE0FFF))
TWO = ((0x20000, 0x2FFFD), (0x30000, 0x3FFFD))
ONE = ((0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0x110BD, 0x110CD))


def _within(code: int, ranges: tuple[tuple[int, int], ...]) -> bool:
    return any(first <= code <= last for first, last in ranges)


def width(char: str) -> int:
    """Columns of a character that is no control character."""
    code = ord(char)
    if _within(code, ZERO):
        return 0
    if unicodedata.category(char) in ("Mn", "Me", "Cf") and not _within(code, ONE):
        return 0
    return 2 if _within(code, TWO) or unicodedata.east_asian_width(char) in "WF" else 1


FAN = 8  # ranges or groups of them that are tried one after the other


def _grouped(ranges: list[tuple[int, int]]) -> str:
    """Ranges in order as the inside of a pattern class. A class tries its parts one by one, so they are
    groups that are left at once by a character outside their bounds, groups of groups above."""
    if not ranges:
        return ""
    parts = [(first, last, f"\\x{{{first:X}}}-\\x{{{last:X}}}") for first, last in ranges]
    while len(parts) > 1:
        cuts = [parts[i : i + FAN] for i in range(0, len(parts), FAN)]
        parts = [
            (c[0][0], c[-1][1], f"[\\x{{{c[0][0]:X}}}-\\x{{{c[-1][1]:X}}}&&[{''.join(p for *_, p in c)}]]")
            for c in cuts
        ]
    return parts[0][2]


def _pattern_class(holds: Callable[[int], bool]) -> str:
    ranges, first = [], None
    for code in range(0xA0, 0x110001):
        inside = code < 0x110000 and holds(code)
        if inside and first is None:
            first = code
        elif not inside and first is not None:
            ranges.append((first, code - 1))
            first = None
    return _grouped(ranges)


@cache
def classes() -> tuple[str, str]:
    """Insides of the pattern classes of characters without a column and with two."""
    found = bytes(width(chr(code)) for code in range(0x110000))
    return _pattern_class(lambda code: found[code] == 0), _pattern_class(lambda code: found[code] == 2)
