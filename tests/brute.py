"""Slow, plain restatements of the rules, used only to check the Spark operators."""


def events(marks, grouping):
    """Frames that start an event."""
    out = []
    for mark in sorted(marks):
        if not out or mark > out[-1] + grouping:
            out.append(mark)
    return out


def exact_threshold(streams, allowed, grouping):
    """Lowest of the scores and -1 at which events above it fit, trying every one."""
    scores = {s for frames in streams.values() for _, s in frames}
    if not scores:
        return None
    fits = [
        t for t in [*scores, -1.0]
        if sum(len(events([i for i, s in frames if s > t], grouping))
               for frames in streams.values()) <= allowed
    ]
    return min(fits)


def runs(frames, threshold):
    """(lo, hi, peak, first peak frame) of consecutive frames at or above the threshold."""
    hit = {i: s for i, s in frames if s >= threshold}
    spans = []
    for i in sorted(hit):
        if spans and spans[-1][1] == i - 1:
            spans[-1][1] = i
        else:
            spans.append([i, i])
    return [
        (lo, hi, max(hit[i] for i in range(lo, hi + 1)),
         min(range(lo, hi + 1), key=lambda i: (-hit[i], i)))
        for lo, hi in spans
    ]
