"""Refractory counting for many chunks of hits at once, on NumPy arrays."""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right, insort

import numpy as np


def chains(position, owner, gap):
    """For each hit: events counted from it on in its chunk, and the last one's index.

    ``position`` is sorted, with chunks further apart than any ``gap``. The next
    event after a hit is the first hit beyond its gap; following that link twice as
    far in each round reaches the end of every chain in a logarithm of its length.
    """
    n = len(position)
    after = np.searchsorted(position, position + gap + 1)
    after[owner[np.minimum(after, n - 1)] != owner] = n
    after = np.append(after, n)
    count = np.append(np.ones(n, dtype=np.int64), 0)
    last = np.arange(n + 1)
    while (after[:n] < n).any():
        count = count + count[after]
        last = np.where(after < n, last[after], last)
        after = after[after]
    return count[:n], last[:n]


def entry_tables(local, owner, passing, chunk, gap, chunk_frames: int):
    """Tables "blocked on entry -> (events, blocked until)" of the chunks that have hits.

    ``local`` holds hit frames counted from the start of their chunk and ``owner``
    the row of the chunk, both sorted; ``passing`` selects the hits that count.
    Returns (rows, seen, sizes, events, until): one entry per row when none of its
    hits can be blocked on entry, else one for each of 0 to gap blocked frames.
    ``until`` is counted from the start of the chunk.
    """
    local, owner = local[passing], owner[passing]
    rows, first, seen = np.unique(owner, return_index=True, return_counts=True)
    if not len(rows):
        none = np.zeros(0, dtype=np.int64)
        return rows, seen, none, none, none
    stride = chunk_frames + int(gap.max()) + 2
    position = owner * stride + local
    count, last = chains(position, owner, gap[owner])

    feels_past = (chunk[rows] > 0) & (local[first] < gap[rows])
    sizes = np.where(feels_past, gap[rows] + 1, 1)
    entry_row = np.repeat(np.arange(len(rows)), sizes)
    blocked = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.searchsorted(position, rows[entry_row] * stride + blocked)
    inside = np.minimum(at, len(position) - 1)
    hit = (at < len(position)) & (owner[inside] == rows[entry_row])
    events = np.where(hit, count[inside], 0)
    until = np.where(hit, local[last[inside]] + gap[rows[entry_row]] + 1, blocked)
    return rows, seen, sizes, events, until


def step_events(frames, scores, gap: int):
    """Events that each hit adds when hits join one by one from the highest score down.

    ``frames`` is sorted. A new hit that isn't blocked starts an event; those after it
    move until they fall on an event that was there before. The sum is never lowered.
    """
    added = np.zeros(len(frames), dtype=np.int64)
    present, events = array("q"), array("q")
    for at in np.argsort(-np.asarray(scores), kind="stable").tolist():
        frame = int(frames[at])
        insort(present, frame)
        low = bisect_right(events, frame)
        if low and frame <= events[low - 1] + gap:
            continue
        chain, high = array("q", [frame]), low
        while True:
            after = bisect_right(present, chain[-1] + gap)
            if after == len(present):
                high = len(events)
                break
            high = bisect_left(events, present[after], high)
            if high < len(events) and events[high] == present[after]:
                break
            chain.append(present[after])
        added[at] = len(chain) - (high - low)
        events[low:high] = chain
    return added


def pieces(frames, gap: int) -> list[tuple[int, int]]:
    """Ranges of hits no more than ``gap`` frames apart: none can block a hit of another."""
    cuts = (np.flatnonzero(np.diff(frames) > gap) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(frames)]))
