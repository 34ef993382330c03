"""SuperMinHash signatures of word shingles, in numpy over batches of texts."""

from __future__ import annotations

import numpy as np

#: Elements whose permutations are held at once.
BLOCK = 100_000
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_SPACES = np.isin(np.arange(256), (32, 9, 10, 11, 12, 13))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_CODE = mixed((np.arange(256, dtype=np.uint64) + _U(1)) * _GOLD)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text in ``raw``, and the n + 1 offsets of the texts' words.

    Words are runs without ASCII white space, A-Z in lower case; none crosses two texts.
    """
    word = ~_SPACES[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[1:-1][offsets[1:-1] < len(raw)]
    begins[inner] = word[inner]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    last = inner[inner > 0] - 1
    ends[last] = word[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODE[_LOWER[raw]] * _powers(_BASE, len(raw)), out=sums[1:])
    back = _powers(pow(_BASE, -1, 1 << 64), len(raw) + 1)
    hashes = mixed((sums[stops] - sums[starts]) * back[starts] + (stops - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text; a text of fewer words has one, of none it has none."""
    out = []
    whole = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        whole = mixed(whole + hashes[k : k + len(whole)] * _U(2 * k + 3))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            short = np.zeros(1, np.uint64)
            for k in range(a, b):
                short = mixed(short + hashes[k : k + 1] * _U(2 * (k - a) + 3))
            out.append(mixed(short + _U(b - a)))
        else:
            out.append(whole[:0])
    return out


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """A row of m SuperMinHash values for each set; empty sets keep infinity.

    In round j an element sends j plus a random fraction to the j-th place of its own random
    permutation of the m places, so its values for different places are correlated ranks.  A set
    stops once none of its values can fall in a later round.
    """
    out = np.full((len(sets), m), np.inf)
    at = 0
    while at < len(sets):
        stop, total = at, 0
        while stop < len(sets) and (stop == at or total + len(sets[stop]) <= BLOCK):
            total += len(sets[stop])
            stop += 1
        _signed(sets[at:stop], out[at:stop], m)
        at = stop
    return out


def _signed(sets: list[np.ndarray], out: np.ndarray, m: int) -> None:
    if not any(map(len, sets)):
        return
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    element = np.concatenate(sets)
    flat = out.reshape(-1)
    places: np.ndarray | None = None
    for j in range(m):
        draw = mixed(element + _U((j + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
        swap = j + ((draw & _U(0xFFFFFFFF)) * _U(m - j) >> _U(32)).astype(np.int64)
        rows = np.arange(len(element))
        if places is None:
            place = swap
        else:
            place = places[rows, swap].astype(np.int64)
            places[rows, swap] = places[:, j]
        np.minimum.at(flat, owner * m + place, j + (draw >> _U(32)) / 2.0**32)
        going = (out.max(axis=1) > j + 1)[owner]
        if not going.any():
            return
        if places is None:
            places = np.tile(np.arange(m, dtype=np.uint16), (int(going.sum()), 1))
            places[np.arange(len(places)), swap[going]] = 0
            owner, element = owner[going], element[going]
        elif going.mean() < 0.7:
            owner, element, places = owner[going], element[going], places[going]


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One key for each band of so many rows, different bands having different keys."""
    bits = signature.view(np.uint64)
    bands = signature.shape[1] // rows
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _GOLD + np.zeros((len(signature), 1), np.uint64)
    for r in range(rows):
        key = mixed(key + bits[:, r : bands * rows : rows])
    return key


def sketches(signature: np.ndarray) -> np.ndarray:
    """A byte for each value of a signature."""
    return (mixed(signature.view(np.uint64)) >> _U(56)).astype(np.uint8)
