"""Sets of word shingles as sorted 64-bit hashes, many texts at a time.

Words are runs of characters other than space and the control characters 9 to 13, A-Z
in lower case. A shingle is ``WORDS`` words in a row; a text of fewer words has one, of
all of them; a text without words has none.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Words are hashed in segments of so many bytes of text.
SEGMENT = 1 << 18

_FOLD = bytes(
    32 if c == 32 or 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
_RANDOM = np.random.PCG64(5).random_raw(256 + 3 + WORDS).astype(np.uint64)
_OF_BYTE = _RANDOM[:256]
_BASE = int(_RANDOM[256] | np.uint64(1))
_OF_PLACE = _RANDOM[257:257 + WORDS] | np.uint64(1)
_OF_LENGTH = int(_RANDOM[257 + WORDS])

_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(2 * SEGMENT, 1 << int(n).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        steps = [np.full(size, base, np.uint64) for base in (_BASE, inverse)]
        for step in steps:
            step[0] = 1
        _POWERS[:] = [np.cumprod(step, dtype=np.uint64) for step in steps]
    return _POWERS[0], _POWERS[1]


def _long_word(word: np.ndarray) -> np.uint64:
    """The same sum for a word longer than a segment, piece by piece."""
    up, _ = _powers(SEGMENT)
    total, shift = 0, pow(_BASE, SEGMENT, 1 << 64)
    for k in reversed(range(0, len(word), SEGMENT)):
        piece = word[k:k + SEGMENT]
        here = int((_OF_BYTE[piece] * up[:len(piece)]).sum(dtype=np.uint64))
        total = (total * shift + here) % (1 << 64)
    return np.uint64(total)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and the number of its text."""
    flat = np.frombuffer(b" ".join([b"", *texts, b""]).translate(_FOLD), np.uint8)
    content = flat != 32
    starts = np.flatnonzero(content[1:] & ~content[:-1]) + 1
    ends = np.flatnonzero(content[:-1] & ~content[1:]) + 1
    hashes = np.empty(len(starts), np.uint64)
    stops = np.searchsorted(starts, np.arange(0, len(flat) + SEGMENT, SEGMENT))
    for a, b in zip(stops[:-1], stops[1:]):
        if a == b:
            continue
        if ends[b - 1] - starts[b - 1] > SEGMENT:  # at most the last of a segment
            b -= 1
            hashes[b] = _long_word(flat[starts[b]:ends[b]])
            if a == b:
                continue
        first, last = starts[a], ends[b - 1]
        up, down = _powers(last - first + 1)
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(_OF_BYTE[flat[first:last]] * up[:last - first], out=sums[1:])
        hashes[a:b] = (sums[ends[a:b] - first] - sums[starts[a:b] - first]) * down[starts[a:b] - first]
    hashes = mixed(hashes)
    firsts = np.cumsum([1] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(firsts, starts, side="right") - 1


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, in order, and where each text's begin.

    The second array has one entry more than there are texts.
    """
    words, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    begins = np.concatenate([[0], np.cumsum(counts)])
    if len(words) >= WORDS:
        last = len(words) - WORDS + 1
        whole = owner[:last] == owner[WORDS - 1:]
        runs = np.zeros(last, np.uint64)
        for k in range(WORDS):
            runs += words[k:k + last] * _OF_PLACE[k]
        hashes, owners = mixed(runs[whole]), owner[:last][whole]
    else:
        hashes, owners = np.empty(0, np.uint64), np.empty(0, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for k in range(WORDS - 1):
            has = counts[few] > k
            short[has] += words[begins[few[has]] + k] * _OF_PLACE[k]
        short = mixed(short + counts[few].astype(np.uint64) * np.uint64(_OF_LENGTH))
        order = np.argsort(np.concatenate([owners, few]), kind="stable")
        hashes, owners = np.concatenate([hashes, short])[order], np.concatenate([owners, few])[order]
    at = np.searchsorted(owners, np.arange(len(texts) + 1))
    for a, b in zip(at[:-1], at[1:]):
        hashes[a:b].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[keep], np.concatenate([[0], np.cumsum(np.bincount(owners[keep], minlength=len(texts)))])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least ``percent`` in 100."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int(np.count_nonzero(b[at] == a))
    return 100 * common >= percent * (len(a) + len(b) - common)
