"""Shingle sets, PartEnum signatures and exact link tests of single texts (numpy)."""

from __future__ import annotations

import numpy as np

WIDTH = 5               # words of a shingle
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]                        # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15 | 1                      # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2 ** 64)
_LANES = _rng.integers(1, 2 ** 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0 .. n-1 of the base, or of its inverse."""
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 1 << 16), _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:n]


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    turns = np.diff(inside)
    start, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _power("up", len(raw)), out=sums[1:])
    return mix((sums[end] - sums[start]) * _power("down", len(raw))[start]
               + (end - start).astype(np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``WIDTH`` words; with
    fewer words, of the whole sequence; empty without words."""
    words = word_hashes(text or "")
    n = len(words)
    if not n:
        return words
    width = min(n, WIDTH)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out += words[k:n - width + 1 + k] * _LANES[k]
    return np.unique(mix(out + np.uint64(width)))


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set (signed)."""
    a = mix(np.add.reduce(mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)))[None] + np.uint64(len(shingles)))
    b = mix(np.add.reduce(mix(shingles ^ np.uint64(0x5C5C5C5C5C5C5C5C)))[None] - np.uint64(len(shingles)))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


# Links and PartEnum signatures ----------------------------------------------

SIGNATURE_BITS = 48
BAND = 4                # sizes of a band: 4**b up to 4**(b+1) - 1
NUM, DEN = 75, 100      # sets link at DEN * intersection >= NUM * union


def differences(n: int, m: int) -> int:
    """Largest size of the symmetric difference of linked sets of sizes n, m."""
    return (n + m) * (DEN - NUM) // (DEN + NUM)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and DEN * both >= NUM * (len(a) + len(b) - both)


def band_of(n: int) -> int:
    b = 0
    while BAND ** (b + 1) <= n:
        b += 1
    return b


def parts_of(band: int) -> int:
    """Parts of the domain for the sets of a band; 0: each element is a part.
    So many that a set has far more non-empty parts than it may differ in."""
    top = BAND ** (band + 1)
    return top // 2 if band >= 4 else top * 3 // 4 if band == 3 else 0


def signatures(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Signatures of a set, such that linked sets share one.

    In the instance of a band, the domain falls into parts; the elements of a
    set in one part make a signature. Linked sets differ in at most k
    elements, hence in at most k parts, so under any order of signatures that
    all sets share, the least k + 1 of each set have one in common. The order
    takes signatures without a frequent shingle first (``frequent`` is a sorted
    array; it moves work, never results). A set takes part in the band of its
    size and, if linked sets may be as large, in the next. Signatures have
    ``SIGNATURE_BITS`` bits, as shuffles send each of them: a chance meeting of
    two is a pair more to compare, never a result.
    """
    n = len(shingles)
    if not n:
        return np.empty(0, np.uint64)
    if len(frequent):
        at = np.searchsorted(frequent, shingles)
        at[at == len(frequent)] = 0
        common = frequent[at] == shingles
    else:
        common = np.zeros(n, bool)
    largest = n * DEN // NUM
    need = differences(n, largest) + 1
    out = []
    for band in range(band_of(n), band_of(largest) + 1):
        parts = parts_of(band)
        key = mix(shingles + np.uint64(band + 1))
        hot = common
        if parts:
            part = key % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            part = part[order]
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            if len(first) < need:       # beyond any chance with so many parts
                raise ValueError(f"a set of {n} elements fills only {len(first)} parts")
            key = mix(np.add.reduceat(mix(key[order]), first) + part[first])
            hot = np.logical_or.reduceat(common[order], first)
        out.append(key[np.lexsort((key, hot))][:need])
    return np.concatenate(out) >> np.uint64(64 - SIGNATURE_BITS)


def profile(shingles: np.ndarray) -> bytes:
    """Number of elements (255 at most) in each of 2**j classes of hashes."""
    classes = 16
    while classes * 4 < len(shingles):
        classes *= 2
    counts = np.bincount((shingles & np.uint64(classes - 1)).astype(np.int64), minlength=classes)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def may_link(n: int, p: bytes, m: int, q: bytes) -> bool:
    """False only if sets of sizes n, m and profiles p, q can't be linked: the
    counts of the classes differ by no more than the sets do."""
    if DEN * min(n, m) < NUM * max(n, m):
        return False
    a, b = np.frombuffer(p, np.uint8).astype(np.int32), np.frombuffer(q, np.uint8).astype(np.int32)
    if len(a) != len(b):        # fold the finer one; sums of capped counts are no bounds
        small, big = (a, b) if len(a) < len(b) else (b, a)
        if small.max() >= 255 or big.max() >= 255:
            return True
        folded = big.reshape(-1, len(small)).sum(0)
        return int(np.abs(folded - small).sum()) <= differences(n, m)
    return int(np.abs(a - b).sum()) <= differences(n, m)
