"""Where csvlog records begin in byte ranges of a file, exactly.

Whether a newline ends a record depends on all quotes before it in its file. So a first pass frames
every range under both parities that may hold at its start and keeps one summary row; a walk over a
file's summary rows then fixes the parity and the first record of each range, and the second pass
reads from there. An over-large record begins anew at a line end, whatever the quotes: where a
summary shows one, its range is framed once more from the record's start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

#: Bytes of a range that are looked at together.
CHUNK = 4 << 20


@dataclass
class Summary:
    """Of a range: its bounds, the parity of its quotes, its first line's end, and by the parity that holds at its start
    the ends (bytes after the newline) of the first and the last record that ends here and whether one begun and ended here is over-large."""

    start: int
    stop: int
    odd: int = 0
    newline: int | None = None
    first: tuple[int | None, int | None] = (None, None)
    last: tuple[int | None, int | None] = (None, None)
    large: tuple[bool, bool] = (False, False)


def summary(f: BinaryIO, start: int, stop: int, cap: int) -> Summary:
    f.seek(start)
    odd, newline, at = 0, None, start
    first, last, large = [None, None], [None, None], [False, False]
    while at < stop and (buf := f.read(min(CHUNK, stop - at))):
        b = np.frombuffer(buf, np.uint8)
        lines, quotes = np.flatnonzero(b == 10), np.flatnonzero(b == 34)
        if newline is None and len(lines):
            newline = at + int(lines[0]) + 1
        parity = (np.searchsorted(quotes, lines) + odd) % 2
        for p in (0, 1):
            ends = lines[parity == p] + at + 1
            if len(ends):
                begun = np.r_[ends[0] if last[p] is None else last[p], ends[:-1]]
                large[p] |= bool((ends - 1 - begun > cap).any())
                first[p], last[p] = int(ends[0]) if first[p] is None else first[p], int(ends[-1])
        odd, at = (odd + len(quotes)) % 2, at + len(buf)
    return Summary(start, stop, odd, newline, tuple(first), tuple(last), tuple(large))


@dataclass
class _State:
    """At a range's start: where the open record began and the quotes' parity, or that an over-large one is being passed over."""

    open: int = 0
    odd: int = 0
    passing: bool = False


def _walk(f: BinaryIO, at: int, start: int, stop: int, cap: int) -> tuple[int | None, _State]:
    """The first record start in [start, stop), and the state at stop, from a record that starts at `at`."""
    f.seek(at)
    b = np.frombuffer(f.read(stop - at), np.uint8)
    lines, quotes = np.flatnonzero(b == 10), np.flatnonzero(b == 34)
    from_, begins = 0, []
    while True:
        own, before = lines[np.searchsorted(lines, from_) :], np.searchsorted(quotes, from_)
        ends = own[(np.searchsorted(quotes, own) - before) % 2 == 0]
        begin = np.r_[from_, ends + 1]
        over = np.flatnonzero(np.r_[ends, len(b)] - begin > cap)
        begins += (begin[: over[0] + 1] if len(over) else begin).tolist()
        if not len(over):
            state = _State(at + begins[-1], int((len(quotes) - np.searchsorted(quotes, begins[-1])) % 2))
            break
        line = np.searchsorted(lines, begins[-1] + cap)
        if line == len(lines):
            state = _State(at + begins[-1], 0, True)
            break
        from_ = int(lines[line]) + 1
    return next((at + x for x in begins if start <= at + x < stop), None), state


def _step(f: BinaryIO, s: Summary, state: _State, cap: int) -> tuple[int | None, _State]:
    """The first record start in a range, if it has one, and the state behind it."""
    p, at = state.odd, state.open
    ends = s.last[p]
    if state.passing:
        return (None, state) if s.newline is None else _walk(f, s.newline, s.start, s.stop, cap)
    if s.large[p] or (s.first[p] or s.stop + 1) - 1 - at > cap or s.stop - (ends or at) > cap:
        return _walk(f, at, s.start, s.stop, cap)
    return at if at >= s.start else s.first[p], _State(ends or at, (p + s.odd) % 2)


def first_records(f: BinaryIO, ranges: list[Summary], cap: int, bom: bool) -> Iterator[tuple[int, int, int]]:
    """(range start, range stop, where its first record begins) of the ranges, in order, of a file; ranges without one are left out."""
    state = _State(3 if bom else 0)
    for s in ranges:
        first, state = _step(f, s, state, cap)
        if first is not None and first < s.stop:
            yield s.start, s.stop, first


def whole_until(f: BinaryIO, start: int, stop: int, cap: int) -> int:
    """Where the last whole record before stop ends, from a record start on.

    Of an over-large record that isn't at its end yet, whole lines count.
    """
    state, line = _State(start), start
    for at in range(start, stop, 8 * CHUNK):
        s = summary(f, at, min(at + 8 * CHUNK, stop), cap)
        _, state = _step(f, s, state, cap)
        line = max(line, *(x for x in (*s.last, line) if x is not None))
    return line if state.passing else state.open
