"""Segment lattices of single words over a fixed piece vocabulary, in log space.

A word is written as the mark ``\\u2581`` followed by its characters. Every way to cut that string into
vocabulary pieces is a path of the lattice; a character outside the vocabulary falls back to one
piece per UTF-8 byte, so every string has a path. Both functions need memory in proportion to the
word alone.
"""

from __future__ import annotations

from math import exp, inf, log, log1p

MARK = "▁"


def byte_piece(value: int) -> str:
    return f"<0x{value:02X}>"


BYTE_PIECES = tuple(byte_piece(b) for b in range(256))


def lattice_index(weight: dict[str, float]) -> dict[str, float]:
    """Piece weights plus every proper prefix of a piece at -inf, so that a walk knows when to stop."""
    index = {}
    for piece in weight:
        if piece not in BYTE_PIECES:
            for end in range(1, len(piece)):
                index.setdefault(piece[:end], -inf)
    index.update(weight)
    return index


def _spelled(char: str) -> list[str]:
    return [BYTE_PIECES[b] for b in char.encode("utf-8", "surrogatepass")]


def _add(a: float, b: float) -> float:
    return a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))


def log_marginal(word: str, index: dict[str, float]) -> float:
    """Natural log of the summed weight of all segmentations: the forward recursion."""
    string = MARK + word
    size = len(string)
    get = index.get
    forward = [-inf] * (size + 1)
    forward[0] = 0.0
    for start in range(size):
        here = forward[start]
        if get(string[start], -inf) == -inf:
            path = here + sum([index[p] for p in _spelled(string[start])])
            forward[start + 1] = path if forward[start + 1] == -inf else _add(forward[start + 1], path)
        for end in range(start + 1, size + 1):
            value = get(string[start:end])
            if value is None:
                break
            if value > -inf:
                path = here + value
                forward[end] = path if forward[end] == -inf else _add(forward[end], path)
    return forward[size]


def expected_counts(word: str, count: float, index: dict[str, float], into: dict[str, float]) -> float:
    """Add ``count`` times the posterior expectation of every piece; returns the log marginal."""
    string = MARK + word
    size = len(string)
    get = index.get
    forward = [-inf] * (size + 1)
    forward[0] = 0.0
    arcs = []
    for start in range(size):
        here = forward[start]
        if get(string[start], -inf) == -inf:
            value = sum([index[p] for p in _spelled(string[start])])
            arcs.append((start, start + 1, value, None))
            forward[start + 1] = _add(forward[start + 1], here + value) if forward[start + 1] > -inf else here + value
        for end in range(start + 1, size + 1):
            piece = string[start:end]
            value = get(piece)
            if value is None:
                break
            if value > -inf:
                arcs.append((start, end, value, piece))
                forward[end] = _add(forward[end], here + value) if forward[end] > -inf else here + value
    total = forward[size]
    backward = [-inf] * size + [0.0]
    for start, end, value, piece in reversed(arcs):
        tail = backward[end]
        if tail == -inf:
            continue
        path = value + tail
        backward[start] = path if backward[start] == -inf else _add(backward[start], path)
        share = count * exp(min(0.0, forward[start] + path - total))
        for part in (piece,) if piece is not None else _spelled(string[start]):
            into[part] = into.get(part, 0.0) + share
    return total
