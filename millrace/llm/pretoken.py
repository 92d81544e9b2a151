"""Vectorised pre-tokenisation: token boundaries of the GPT-2 pattern without a regex.

Code points become classes by one table look-up; the only part of the pattern that depends on more than neighbouring classes
(whether an apostrophe starts a contraction) is a four-state automaton. A code point's transition function on four states fits in
one byte, functions are composed by a 256 x 256 table, and composition is associative: a blocked prefix scan gives every state.
"""

from __future__ import annotations

import unicodedata

import numpy as np

LETTER, NUMBER, BLANK, SPACE, OTHER = 0, 1, 2, 3, 4
#: States before a code point: an apostrophe here joins the run before it (JOIN) or may start a contraction (FREE);
#: ONE, TWO: so many code points of a contraction are still to come.
JOIN, FREE, ONE, TWO = 0, 1, 2, 3
#: Code points with the Unicode property White_Space (fixed values).
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

_tables: dict[str, np.ndarray] = {}


def classes() -> np.ndarray:
    """Class of every code point, from the Unicode categories."""
    if "class" not in _tables:
        t = np.full(0x110000, OTHER, np.uint8)
        for cp in range(0x110000):
            kind = unicodedata.category(chr(cp))[0]
            if kind == "L":
                t[cp] = LETTER
            elif kind == "N":
                t[cp] = NUMBER
        t[list(WHITE)] = BLANK
        t[0x20] = SPACE
        _tables["class"] = t
    return _tables["class"]


def _function(to: tuple[int, int, int, int]) -> int:
    return to[0] | to[1] << 2 | to[2] << 4 | to[3] << 6


#: Transition functions: what each kind of code point makes of JOIN, FREE, ONE, TWO.
F_FREE = _function((FREE, FREE, FREE, ONE))  # letters (those of a contraction too), numbers, blanks
F_JOIN = _function((JOIN, JOIN, JOIN, JOIN))  # other symbols, and the space before a token
F_ONE = _function((JOIN, ONE, JOIN, JOIN))  # an apostrophe before s, t, m or d
F_TWO = _function((JOIN, TWO, JOIN, JOIN))  # an apostrophe before re, ve or ll
IDENTITY = _function((JOIN, FREE, ONE, TWO))


def _compose() -> np.ndarray:
    """table[f << 8 | g]: first f, then g."""
    if "compose" not in _tables:
        f, g = np.arange(256)[:, None], np.arange(256)[None, :]
        out = np.zeros((256, 256), np.int64)
        for s in range(4):
            out |= (g >> 2 * (f >> 2 * s & 3) & 3) << 2 * s
        _tables["compose"] = out.astype(np.uint8).ravel()
    return _tables["compose"]


def prefix(functions: np.ndarray, block: int = 64) -> np.ndarray:
    """Inclusive scan of transition functions under composition: in blocks side by side, then over the blocks' totals."""
    n, table = len(functions), _compose()
    if n <= block:
        out = functions.copy()
        for i in range(1, n):
            out[i] = table[int(out[i - 1]) << 8 | int(out[i])]
        return out
    rows = -(-n // block)
    grid = np.full(rows * block, IDENTITY, np.uint8)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    for i in range(1, block):
        grid[i] = table[(grid[i - 1].astype(np.uint16) << 8) | grid[i]]
    carry = np.empty(rows, np.uint8)
    carry[0] = IDENTITY
    carry[1:] = prefix(grid[-1], block)[:-1]
    grid = table[(carry.astype(np.uint16) << 8)[None, :] | grid]
    return grid.T.reshape(-1)[:n]


def starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Index of the first code point of every token. points: the code points of texts, one after the other; first: where texts start.

    Each text is cut for itself: no token, contraction or look-ahead goes beyond its end. Empty texts have no tokens.
    """
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    cls = classes()[points]
    head = np.zeros(n + 1, bool)
    head[first[first < n]] = True
    head[n] = True
    end = head[1:]
    white = (cls == BLANK) | (cls == SPACE)
    last_white = white.copy()  # white space before something else of the same text
    last_white[:-1] &= ~white[1:]
    last_white &= ~end
    glue = last_white & (cls == SPACE)  # the space that belongs to the token after it
    f = np.full(n, F_FREE, np.uint8)
    f[(cls == OTHER) | glue] = F_JOIN
    at = np.flatnonzero(points == 0x27)
    if len(at):
        pad = np.concatenate([points, np.zeros(2, points.dtype)])
        a, b = pad[at + 1], pad[at + 2]
        inside1 = ~end[at]
        inside2 = inside1 & ~np.concatenate([end, [True]])[at + 1]
        one = inside1 & np.isin(a, [ord(c) for c in "stmd"])
        two = inside2 & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        f[at[one]], f[at[two]] = F_ONE, F_TWO
    # A text starts in FREE whatever came before: its first function forgets the state.
    h = np.flatnonzero(head[:n])
    to = f[h] >> 2 & 3
    f[h] = to | to << 2 | to << 4 | to << 6
    after = prefix(f) >> 2 & 3  # the state after each code point, from FREE
    before = np.empty(n, np.uint8)
    before[0] = FREE
    before[1:] = after[:-1]
    before[head[:n]] = FREE
    prev = np.empty(n, np.uint8)
    prev[0] = 255
    prev[1:] = cls[:-1]
    prev[head[:n]] = 255
    after_glue = np.zeros(n, bool)
    after_glue[1:] = glue[:-1]
    ended = np.zeros(n, bool)  # right after a contraction
    ended[1:] = before[:-1] == ONE
    ended &= ~head[:n]
    inside = (before == ONE) | (before == TWO)
    opens = (f == F_ONE) | (f == F_TWO)
    opens[h] = (to == ONE) | (to == TWO)
    opens &= before == FREE
    new = cls != prev
    new &= ~after_glue
    new |= ended
    new &= ~inside
    new |= opens
    new[white] = (~((prev == BLANK) | (prev == SPACE)) | last_white)[white]
    new |= head[:n]
    return np.flatnonzero(new)


def _cut(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """All texts joined, their code points, where tokens start among these, and how many each text has."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = starts(points, (ends - lengths)[lengths > 0])
    return joined, points, at, np.searchsorted(at, ends) - np.searchsorted(at, ends - lengths)


def pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The tokens of all texts in order, and how many each text has."""
    joined, _, at, counts = _cut(texts)
    bounds = at.tolist()
    bounds.append(len(joined))
    return [joined[a:b] for a, b in zip(bounds, bounds[1:])], counts


def byte_pieces(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """As pieces, in UTF-8: bytes are cut without a search for the widest character of each slice."""
    joined, points, at, counts = _cut(texts)
    raw = joined.encode("utf-8")
    if len(raw) > len(joined):
        more = np.cumsum((points > 0x7F).view(np.int8) + (points > 0x7FF).view(np.int8) + (points > 0xFFFF).view(np.int8), dtype=np.int64)
        at = at + np.where(at > 0, more[at - 1], 0)
    bounds = at.tolist()
    bounds.append(len(raw))
    return [raw[a:b] for a, b in zip(bounds, bounds[1:])], counts
