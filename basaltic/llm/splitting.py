"""Cutting texts by patterns with Unicode classes.

The regex library knows the classes of all characters. For texts within a range of characters whose classes no Unicode version
changes, the same pattern with its classes spelled out runs twice as fast in the standard library.

For one pattern, SURELY_CUT, two neighbouring bytes mostly tell whether a match ends between them, so that whole batches of texts are
cut by table. What such a cut leaves together may hold several matches.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import regex

#: The settled range: Latin letters to U+02AF and the common punctuation, without any that compose with others.
SETTLED = [(0x00, 0x2AF), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF)]
ODD = re.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" for a, b in SETTLED).replace("\x00", "\\x00") + "]")


def members(kind: str) -> str:
    """The settled characters of a class such as \\p{L}, as the inside of a bracket."""
    test, runs = regex.compile(kind), []
    for a, b in SETTLED:
        for c in range(a, b + 1):
            if test.fullmatch(chr(c)):
                if runs and runs[-1][1] == c - 1:
                    runs[-1][1] = c
                else:
                    runs.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


def spelled_out(pattern: str) -> str:
    """The pattern with its classes \\p{..} and \\s spelled out over the settled range, and \\S as not \\s."""
    inside, out = False, []
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        if part.startswith("\\p{") or part == "\\s":
            out.append(members(part) if inside else f"[{members(part)}]")
        elif part == "\\S" and not inside:
            out.append(f"[^{members(chr(92) + 's')}]")
        elif part[0] == "\\" and part[1].isalpha():
            raise ValueError(f"{part} has no spelling here")
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return "".join(out)


class Splitter:
    """findall and finditer of a pattern over any text."""

    def __init__(self, pattern: str):
        self.full = regex.compile(pattern)
        try:
            self.fast = re.compile(spelled_out(pattern))
        except (ValueError, re.error):
            self.fast = None

    def _for(self, text: str):
        return self.full if self.fast is None or ODD.search(text) else self.fast

    def findall(self, text: str) -> list[str]:
        return self._for(text).findall(text)

    def finditer(self, text: str) -> Iterator:
        return self._for(text).finditer(text)


@functools.cache
def splitter(pattern: str) -> Splitter:
    return Splitter(pattern)


#: Bytes looked at at once, and the pattern for which sure_cuts holds.
SECTION = 1 << 20
SURELY_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _pairs() -> np.ndarray:
    """What two neighbouring bytes (the first one is the lower in the index) say. 1: a match ends between them. 2: a match begins at the
    first. 4: the second begins a run of white space. 8: if that run is the first alone, a match ends between them."""
    letters, digits, space = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"0123456789", b"\t\n\x0b\x0c\r"
    marks = bytes(c for c in range(0x21, 0x7F) if c not in letters + digits)
    visible = letters + digits + marks
    # first bytes of characters none of which is white space
    wide = bytes(c for c in range(0xC3, 0xF5) if c not in (0xE1, 0xE2, 0xE3))
    says = np.zeros((256, 256), "u1")
    for bit, first, second in (
        (1, letters, digits + marks + space + b" "),
        (1, digits, letters + marks + space + b" "),
        (1, marks, digits + space + b" "),
        (1, marks.replace(b"'", b""), letters),  # an apostrophe may take letters
        (2, b" ", visible + wide),
        (4, visible, space),
        (8, space, visible),
    ):
        says[np.ix_(list(second), list(first))] |= bit
    return says.ravel()


PAIRS = _pairs()


def sure_cuts(data: bytes, ends: np.ndarray) -> np.ndarray:
    """Where parts of texts begin, as byte offsets. data: texts in UTF-8, one after the other; ends: 0 and the end of each.

    Each part by itself gives SURELY_CUT the matches that it has in its text: a cut is made only where a match ends whatever
    stands around, and no white space that looks ahead is torn. Cuts within characters beyond ASCII, between them and other
    characters and within runs of white space are left out, but for the one before a space that something visible follows.
    """
    of, size = np.frombuffer(data, "u1"), len(data)
    cut, inner = np.zeros(size + 1, bool), ends[(ends > 0) & (ends < size)]
    for lo in range(0, size - 1, SECTION):
        a, b = max(0, lo - 1), min(lo + SECTION, size - 1)  # with the pair before, for bit 8
        pair = of[a:b].astype("u2")
        pair |= of[a + 1 : b + 1].astype("u2") << 8
        says = PAIRS[pair]
        says[inner[np.searchsorted(inner, a + 1) : np.searchsorted(inner, b, "right")] - 1 - a] = 0  # two texts
        cut[a + 1 : b + 1] |= (says & 1) > 0
        cut[a:b] |= (says & 2) > 0
        cut[a + 2 : b + 1] |= ((says[:-1] & 4) > 0) & ((says[1:] & 8) > 0)
    cut[ends] = True
    return np.flatnonzero(cut[:size])
