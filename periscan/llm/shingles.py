"""Word shingles and SuperMinHash signatures of many texts at once, on numpy arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15
#: Odd, so that it has an inverse modulo 2**64.
INVERSE = pow(BASE, -1, 1 << 64)
#: Bits of a signature's value below the round number.
VALUE_BITS = 40
#: Cells (elements x signature length) of the permutations held at a time.
STATE_CELLS = 4_000_000

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes hashed at a time, whatever the lengths of texts and words.
SEGMENT = 1 << 18
#: Two primes below 2^31 and a drawn base for each. Products of two remainders fit 64 bits, as does a segment's sum of bytes times powers.
FIELDS = ((2147483647, 1186590653), (2147483629, 604270931))


def _powers(base: int, prime: int) -> np.ndarray:
    """The first ``SEGMENT`` powers, by doubling."""
    out = np.ones(SEGMENT, np.uint64)
    n = 1
    while n < SEGMENT:
        out[n : 2 * n] = out[:n] * np.uint64(pow(base, n, prime)) % np.uint64(prime)
        n *= 2
    return out


POWERS = [(prime, base, _powers(base, prime), _powers(pow(base, -1, prime), prime)) for prime, base in FIELDS]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and the number of words of each text.

    Words are runs of bytes other than space and 09 to 0D; A-Z count as a-z. A word's hash is
    its length and two polynomials of its bytes, modulo a prime each, taken as differences of running
    totals that go on from segment to segment. Two words of n bytes share both for n^2 of the 2^62 pairs of bases at most.
    """
    parts = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    del parts
    blank_before, carries = True, [(0, 1, 1)] * len(POWERS)
    starts, ends = [], []
    opened, shifts, closed = ([[] for _ in POWERS] for _ in range(3))
    for at in range(0, len(data), SEGMENT):
        piece = data[at : at + SEGMENT]
        blank = (piece == 32) | ((piece >= 9) & (piece <= 13))
        edge = np.diff(np.concatenate(([blank_before], blank)).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        starts.append(start + at)
        ends.append(end + at)
        blank_before = bool(blank[-1])
        total = np.zeros(len(piece) + 1, np.uint64)
        for f, (prime, base, up, down) in enumerate(POWERS):
            np.cumsum(piece * up[: len(piece)], out=total[1:])
            p, (carry, risen, sunk) = np.uint64(prime), carries[f]
            opened[f].append((total[start] % p * np.uint64(risen) + np.uint64(carry)) % p)
            closed[f].append((total[end] % p * np.uint64(risen) + np.uint64(carry)) % p)
            shifts[f].append(down[start] * np.uint64(sunk) % p)
            carries[f] = ((int(total[-1]) * risen + carry) % prime, risen * pow(base, SEGMENT, prime) % prime, sunk * pow(base, -SEGMENT, prime) % prime)
    first, last = np.concatenate(starts), np.concatenate(ends)
    one, other = ((np.concatenate(closed[f]) + np.uint64(prime) - np.concatenate(opened[f])) % np.uint64(prime) * np.concatenate(shifts[f]) % np.uint64(prime) for f, (prime, *_) in enumerate(POWERS))
    with np.errstate(over="ignore"):
        hashes = mix(mix(one << np.uint64(32) | other) + (last - first).astype(np.uint64) * np.uint64(BASE))
    return hashes, np.diff(np.searchsorted(first, bounds))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted, distinct hashes of each text's shingles of ``width`` words.

    A text with fewer words has one shingle of all its words; one without words, none.
    """
    hashes, counts = word_hashes(texts)
    rolled = np.zeros(len(hashes), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            whole = max(0, len(hashes) - k)
            rolled[:whole] = rolled[:whole] * np.uint64(BASE) + hashes[k:]
        rolled = mix(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            h = hashlib.blake2b(hashes[at : at + n].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(h, "<u8").astype(np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def set_key(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def _draw(elements: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Round ``j`` of every element: the place to swap with, from j to m - 1, and the value."""
    with np.errstate(over="ignore"):
        x = mix(elements + np.uint64(j + 1) * np.uint64(BASE))
    place = j + ((x >> np.uint64(VALUE_BITS)) * np.uint64(m - j) >> np.uint64(64 - VALUE_BITS)).astype(np.int64)
    return place, (x & np.uint64((1 << VALUE_BITS) - 1)) | np.uint64(j << VALUE_BITS)


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, a row of ``m`` values for each set.

    Each element walks through a random permutation of the ``m`` places, and in
    round j offers its place the value j plus a random fraction; every place
    keeps its least. Values of later rounds are larger, so a set is done once
    all its places hold values of earlier rounds; large sets are after one. All
    sets go through a round together. The signature of an empty set is all ones.
    """
    sig = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return sig
    owner = np.repeat(np.arange(len(sets)), sizes)
    every = np.concatenate(sets)
    place, value = _draw(every, 0, m)
    np.minimum.at(sig.reshape(-1), owner * m + place, value)
    todo = np.flatnonzero((sizes > 0) & (sig.max(1) >> np.uint64(VALUE_BITS) > 0))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    for rows in _groups(todo, sizes, max(1, STATE_CELLS // m)):
        held = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in rows])
        who, element, swap = owner[held], every[held], place[held]
        order = np.tile(np.arange(m, dtype=np.int16), (len(held), 1))
        for j in range(m):
            if j:
                swap, value = _draw(element, j, m)
            index = np.arange(len(element))
            moved = order[index, swap]
            order[index, swap] = order[:, j]
            order[:, j] = moved
            if j:
                np.minimum.at(sig.reshape(-1), who * m + moved, value)
            open_rows = sig[rows].max(1) >> np.uint64(VALUE_BITS) > j
            if not open_rows.any():
                break
            if j % 4 == 0 and not open_rows.all():
                keep = np.isin(who, rows[open_rows])
                rows, who, element, order = rows[open_rows], who[keep], element[keep], order[keep]
    return sig


def _groups(rows: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    start = held = 0
    for k, r in enumerate(rows):
        if k > start and held + sizes[r] > most:
            yield rows[start:k]
            start, held = k, 0
        held += sizes[r]
    if start < len(rows):
        yield rows[start:]


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band of ``rows`` values; equal only for the same band with the same values."""
    n, m = sig.shape
    with np.errstate(over="ignore"):
        key = np.arange(1, m // rows + 1, dtype=np.uint64)[None] * np.uint64(INVERSE) + np.zeros((n, 1), np.uint64)
        for k in range(rows):
            key = mix(key * np.uint64(BASE) + sig[:, k :: rows][:, : m // rows])
    return key
