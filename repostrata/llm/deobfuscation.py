"""Noisy-channel restoration of disguised words under a character language model.

The channel writes digits and signs for letters, repeats letters, and puts separators or
spaces between them. A disguised stretch becomes a lattice of the letters each character
may stand for; the Viterbi path under a character trigram model, weighed against channel
costs, is the restored text. Everything outside such stretches has one reading: itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

# Letters that a sign is commonly written for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "*": "aeiou", "#": "aeiou", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
}
_SIGNS = re.escape("".join(LEET))
_JOINERS = r".\-_~'’·"
_LETTER = r"[^\W\d_]"
_SOUND = rf"(?:{_LETTER}|[{_SIGNS}])"
# A disguised stretch: letters around signs, a letter three times or more, letters around
# joiners within a word, or single letters in a row with the same gap. Within a word a stretch
# can only start where the run of letters and signs does, and what has been taken is not given
# back, so a line of any length is read a fixed number of times.
_IN_WORD = (
    rf"(?:{_LETTER}|[{_SIGNS}])*(?:{_LETTER}[{_SIGNS}{_JOINERS}]++{_LETTER}|({_LETTER})\1\1"
    rf"|(?<!\S)[{_SIGNS}]++{_LETTER}{{2}}|{_LETTER}{{2}}[{_SIGNS}]{{1,2}}(?=$|[\s.,;:?]))"
    rf"(?:[{_SIGNS}{_JOINERS}]*+{_LETTER})*+[{_SIGNS}]*"
)
_STRETCH = re.compile(
    rf"(?<![^\W_])(?:{_SOUND}(?:[ ]|[{_JOINERS}]{{1,2}}|[ ][{_JOINERS}][ ])){{2,}}{_SOUND}(?![^\W_])"
    rf"|(?<!{_LETTER})(?<![{_SIGNS}]){_IN_WORD}"
)
_REST = re.compile(_IN_WORD)  # of a word whose beginning belongs to a stretch of single letters
# What the characters of the pattern above are to the hint, by code point; the last entry is for
# all beyond the first 65,536, which may be letters or not.
_IS_LETTER, _IS_SIGN, _IS_JOINER, _IS_WORD = 1, 2, 4, 8
_KIND = np.zeros(1 << 16, np.uint8)
for _c in map(chr, range(len(_KIND))):
    if _c.isalnum():
        _KIND[ord(_c)] = _IS_WORD if _c.isdecimal() else _IS_WORD | _IS_LETTER
_KIND[[ord(c) for c in LEET]] |= _IS_SIGN
_KIND[[ord(c) for c in _JOINERS if c != "\\"]] |= _IS_JOINER
_KIND[-1] = _IS_LETTER
# Costs in natural logarithms; a sign left as it is, or a gap kept, breaks the word.
SIGN, DROP, LOSE, KEEP, REPEAT, GAP_KEPT = 1.0, 0.5, 14.0, 16.0, 1.5, 3.0
CLASSES = 128
EDGE = 0


def symbol(char: str) -> int:
    """Class of a lower-case character: 1-26 for a-z, others hashed into 27-127, 0 for no letter."""
    if "a" <= char <= "z":
        return ord(char) - 96
    return 27 + ord(char) % 101 if char.isalpha() else EDGE


def trigrams(text: str) -> np.ndarray:
    """Ids below ``CLASSES ** 3`` of all trigrams of letter classes; edges set off words."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    latin = (codes >= 97) & (codes <= 122)
    other = np.zeros(len(codes), bool)
    wide = np.flatnonzero(codes >= 170)
    if len(wide):
        values, inverse = np.unique(codes[wide], return_inverse=True)
        other[wide] = np.array([chr(v).isalpha() for v in values.tolist()])[inverse]
    classes = np.where(latin, codes - 96, np.where(other, 27 + codes % 101, EDGE)).astype(np.int32)
    classes = np.r_[EDGE, EDGE, classes, EDGE]
    keep = (classes[2:] != EDGE) | (classes[1:-1] != EDGE)
    first = np.where(classes[1:-1] == EDGE, EDGE, classes[:-2])
    return ((first * CLASSES + classes[1:-1]) * CLASSES + classes[2:])[keep]


class CharModel:
    """Interpolated trigram model over letter classes, in natural logarithms."""

    def __init__(self, logs: np.ndarray):
        self.logs = logs

    @staticmethod
    def fit(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Logarithms of the interpolated probabilities, from counts of trigram ids."""
        three = np.zeros(CLASSES**3, np.float32)
        three[ids] = counts
        three = three.reshape(CLASSES, CLASSES, CLASSES)
        two = three.sum(axis=0)
        one = two.sum(axis=0)
        base = (one + 0.5) / (one.sum() + 0.5 * CLASSES)
        middle = (two + 5 * base) / (two.sum(axis=1, keepdims=True) + 5)
        three += 5 * middle[None]
        three /= three.sum(axis=2, keepdims=True)
        return np.log(three, out=three)

    def cost(self, first: int, second: int, third: int) -> float:
        return -float(self.logs[first, second, third])


def _readings(stretch: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters, what it may stand for and at what channel cost."""
    out = []
    spaced = bool(re.fullmatch(rf"(?:{_SOUND}(?:[ ]|[{_JOINERS}]{{1,2}}|[ ][{_JOINERS}][ ]))+{_SOUND}", stretch))
    for match in re.finditer(r"(.)\1*", stretch, re.S):
        char, n = match[1], len(match[0])
        options: list[tuple[str, float]] = []
        if char.isalpha():
            options.append((char * min(n, 2), 0.0 if n <= 2 else REPEAT))
            if n > 1:
                options.append((char, REPEAT))
        elif char == " ":
            options += [("", DROP if spaced else KEEP), (" ", GAP_KEPT)]
        else:
            ending = char == "!" and match.end() == len(stretch)
            options += [(letter * k, SIGN) for letter in LEET.get(char, "") for k in ((1, 2) if n > 1 else (1,))]
            options += [("", DROP if ending or char not in LEET else LOSE), (match[0], KEEP)]
        out.append(options)
    return out


def restore(stretch: str, model: CharModel) -> str:
    """The Viterbi path through the lattice of one stretch of any length, in lower case.

    Paths are linked lists, so a step costs the same wherever it is.
    """
    states: dict[tuple[int, int], tuple[float, tuple]] = {(EDGE, EDGE): (0.0, ())}
    for options in _readings(stretch.lower()):
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, path) in states.items():
            for letters, price in options:
                x, y, total = a, b, cost + price
                for char in letters:
                    z = symbol(char)
                    if z != EDGE or y != EDGE:
                        total += model.cost(x, y, z)
                    x, y = (EDGE, EDGE) if z == EDGE else (EDGE if y == EDGE else y, z)
                best = after.get((x, y))
                if best is None or total < best[0]:
                    after[x, y] = (total, (path, letters))
        states = after
    ends = [(c + (model.cost(a, b, EDGE) if b else 0.0), i) for i, ((a, b), (c, _)) in enumerate(states.items())]
    path, parts = list(states.values())[min(ends)[1]][1], []
    while path:
        path, letters = path
        parts.append(letters)
    return "".join(reversed(parts))


def _hinted(text: str) -> np.ndarray:
    """Numbers of the lines in which a disguise may stand; lines without one are left out."""
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    raw = np.r_[raw, np.zeros(5, np.uint32)].astype(np.uint32)
    kind = _KIND[np.minimum(raw, len(_KIND) - 1)]
    letter, sign, joiner = ((kind & bit) > 0 for bit in (_IS_LETTER, _IS_SIGN, _IS_JOINER))
    sound, gap = letter | sign, joiner | (raw == 32)
    size = len(raw) - 5
    s, g = ([values[i : i + size] for i in range(6)] for values in (sound, gap))
    close = (letter[:size] & sign[1 : size + 1]) | (sign[:size] & letter[1 : size + 1])
    joined = letter[:size] & joiner[1 : size + 1] & (s[2] | joiner[2 : size + 2])
    same = letter[:size] & (raw[:size] == raw[1 : size + 1]) & (raw[:size] == raw[2 : size + 2])
    before = np.r_[True, (kind[: size - 1] & _IS_WORD) == 0][:size]
    after = (s[2] & g[3]) | (g[2] & s[3] & g[4]) | (g[2] & g[3] & s[4] & g[5])
    spaced = before & s[0] & g[1] & after
    hits = np.flatnonzero(close | joined | same | spaced)
    if not len(hits):
        return hits
    return np.unique(np.searchsorted(np.flatnonzero(raw == 10), hits))


def stretches(line: str) -> Iterator[tuple[int, int]]:
    """Start and end of each disguised stretch of a line."""
    at = 0
    while match := _STRETCH.search(line, at):
        while match:
            yield match.span()
            at = match.end()
            match = _REST.match(line, at)


def deobfuscate(text: str, model: CharModel, cache: dict[str, str], longest: int = 200) -> str:
    """``text`` in lower case with every disguised stretch restored.

    ``cache`` keeps results of stretches of up to ``longest`` characters and is emptied when
    it grows large.
    """
    text = text.lower()
    where = _hinted(text)
    if not len(where):
        return text

    def fix(stretch: str) -> str:
        if stretch in cache:
            return cache[stretch]
        out = restore(stretch, model)
        if len(stretch) <= longest:
            if len(cache) > 50_000:
                cache.clear()
            cache[stretch] = out
        return out

    lines = text.split("\n")
    for i in where.tolist():
        line, parts, at = lines[i], [], 0
        for start, end in stretches(line):
            parts += [line[at:start], fix(line[start:end])]
            at = end
        lines[i] = "".join([*parts, line[at:]])
    return "\n".join(lines)
