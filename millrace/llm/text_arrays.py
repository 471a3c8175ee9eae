"""Words and word shingles of many texts as numpy arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time; a block ends at white space.
BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


def powers(n: int) -> np.ndarray:
    """1, b, b^2, ... modulo 2^64."""
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, in order, and the number of words of each text.

    Words are runs of anything but space, tab, line feed, vertical tab, form feed and return.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    all_hashes, all_starts = [], []
    at = 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data) and not _SPACE[data[end - 1]]:  # on to the end of a word
            more = np.flatnonzero(_SPACE[data[end : end + BLOCK]])
            end = end + int(more[0]) + 1 if len(more) else min(end + BLOCK, len(data))
        x = _LOWER[data[at:end]]
        inside = ~_SPACE[x]
        place = np.flatnonzero(inside)
        if len(place):
            first = np.flatnonzero(np.append(True, np.diff(place) > 1))
            starts = place[first]
            offset = place - np.repeat(starts, np.diff(np.append(first, len(place))))
            hashed = np.add.reduceat(_VALUE[x[place]] * powers(int(offset.max()) + 1)[offset], first)
            all_hashes.append(mixed(hashed))
            all_starts.append(starts + at)
        at = end
    if not all_hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    text_starts = np.append(0, np.cumsum(sizes + 1))
    return np.concatenate(all_hashes), np.diff(np.searchsorted(np.concatenate(all_starts), text_starts))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each place on."""
    weights = mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    runs = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        runs += words[k : k + len(runs)] * weights[k]
    return mixed(runs)


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of n words; with fewer words, of the whole as one; none without words."""
    words, counts = word_hashes(texts)
    weights = mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    runs = shingles(words, n)
    out, at = [], 0
    for count in counts.tolist():
        if count >= n:
            out.append(np.unique(runs[at : at + count - n + 1]))
        elif count:
            whole = (words[at : at + count] * weights[:count]).sum(dtype=np.uint64) + np.uint64(count)
            out.append(mixed(mixed(np.array([whole], np.uint64))))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out



def set_print(x: np.ndarray) -> tuple[int, int]:
    """Two longs that stand for a set of hashes."""
    again = mixed(x ^ _BASE)
    return int(x.sum(dtype=np.uint64).view(np.int64)), int(again.sum(dtype=np.uint64).view(np.int64))


def place_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of all texts laid end to end with a line feed after each, in code points; the same of each text's first point; and the places of all line feeds."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.concatenate([[False], (codes != 32) & ((codes < 9) | (codes > 13)), [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return change[::2], change[1::2], np.cumsum(sizes) - sizes, np.flatnonzero(codes == 10)


def frequent(x: np.ndarray, least: int) -> np.ndarray:
    """Which of the numbers occur at least so many times."""
    bucket = (x & np.uint64(0xFFFFF)).astype(np.int64)
    out = (np.bincount(bucket, minlength=1 << 20) >= least)[bucket]
    if out.any():
        _, of, times = np.unique(x[out], return_inverse=True, return_counts=True)
        out[out] = (times >= least)[of]
    return out
