"""Word shingles of whole texts as 64-bit hashes, on byte arrays."""

from __future__ import annotations

import numpy as np

from quirefold.llm.runs import blocks

#: Fixed: white space that parts words; A-Z are lower-cased, nothing else.
BLANKS = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
_BLANK = np.zeros(256, bool)
_BLANK[BLANKS] = True
_random = np.random.default_rng(424242).integers(0, 1 << 64, 257, np.uint64)
#: A random number for each byte, the same for both cases of A-Z; blanks count nothing.
_VALUE = _random[:256].copy()
_VALUE[65:91] = _VALUE[97:123]
_VALUE[BLANKS] = 0
_BASE = _random[256] | np.uint64(1)
#: Bytes of one long text whose words are hashed at once.
LONG = 1 << 22


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser under which every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words one after another, and the number of words of each text."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    if n == 1 and len(data) > LONG:
        # Cut behind blanks; a longer word is hashed whole.
        parts = [_hashed(data[lo:hi], np.array([0, hi - lo]))[0] for lo, hi in blocks(data, ~_BLANK, LONG)]
        return np.concatenate(parts), np.array([sum(map(len, parts))])
    return _hashed(data, offsets)


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~_BLANK[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    per_text = np.diff(np.concatenate([[0], np.cumsum(begins)])[offsets])
    if not len(starts):
        return np.zeros(0, np.uint64), per_text
    # Powers restart at each word; the blanks after a word add nothing.
    spans = np.diff(np.append(starts, len(data)))
    powers = np.full(int(spans.max()), _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    place = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    sums = np.add.reduceat(_VALUE[data[starts[0] :]] * powers[place], starts - starts[0])
    return mix(sums), per_text


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, one text after another, and the text of each. A text of fewer words, but not
    none, has its whole sequence as the one shingle."""
    words, per_text = word_hashes(data, offsets)
    ends = np.cumsum(per_text)
    first = ends - per_text
    text = np.repeat(np.arange(len(per_text)), per_text)
    length = np.minimum(per_text, size)
    at = np.arange(len(words)) - first[text]
    begin = np.flatnonzero(at <= (per_text - length)[text])
    owner = text[begin]
    h = np.zeros(len(begin), np.uint64)
    for k in range(size):
        has = k < length[owner]
        word = words[np.minimum(begin + k, max(len(words) - 1, 0))]
        h = np.where(has, mix(h * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(k + 1)), h)
    return h, owner
