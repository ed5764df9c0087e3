"""Numpy kernels over bytes and words; each works on one block of a task's rows."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

U = np.uint64
P = 0x9E3779B97F4A7C15
M64 = (1 << 64) - 1
#: A random number for each byte; all hashes start from these.
TABLE = np.random.default_rng(20240601).integers(0, 1 << 64, 256, dtype=np.uint64)


#: Lower case for A-Z; and the same with spaces for all ASCII but letters and digits.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACED = bytes(c if c >= 128 or 48 <= c < 58 or 97 <= c < 123 else 32 for c in LOWER)


def split(texts: list[bytes], table: bytes | None = None) -> tuple[list[bytes], np.ndarray]:
    """The words between ASCII white space of all texts, translated by the table first, and where each text's words start (one more for the end)."""
    parts = [x.translate(table).split() if table else x.split() for x in texts]
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=at[1:])
    return [w for x in parts for w in x], at


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


#: True for the bytes of ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_SEED = U(0x6A09E667F3BCC909)


def _spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; buf ends with white space."""
    inside = ~SPACE[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside.size and inside[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts, and where each text's words start (one more for the end).

    Eight bytes at a time are mixed into the hash of those before, which unlike a sum of powers has no words that collide by their pattern. Equal words
    have equal hashes; where equality decides a result, `digest` or the words themselves are used.
    """
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=at[1:])
    data = b"\n".join([*texts, b""])
    start, end = _spans(np.frombuffer(data, np.uint8))
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))  # the eight bytes from each place
    left = end - start
    h = mix(left.astype(np.uint64) + _SEED)
    live = np.arange(len(start))
    place = start
    while len(live):
        part = eight[place]
        short = np.minimum(left, 8).astype(np.uint64) * U(8)
        part = np.where(short < U(64), part & ((U(1) << (short & U(63))) - U(1)), part)
        h[live] = mix((h[live] ^ part) * U(P) + _SEED)
        more = left > 8
        live, place, left = live[more], place[more] + 8, left[more] - 8
    return h, np.searchsorted(start, at)


def digest(data: bytes) -> bytes:
    """128 bits that stand for the data where equality decides."""
    return blake2b(data, digest_size=16).digest()


def numbered(words: list[bytes]) -> np.ndarray:
    """Numbers from 1 for the words of one call, equal for equal words only."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen) + 1) for w in words), np.int64, len(words))


def classes(values: np.ndarray, k: int) -> np.ndarray:
    """Numbers of each k consecutive values (32 bits each), equal for equal sequences only, by doubling."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out, covered, part, step = None, 0, values, 1
    while True:
        if k & step:
            if out is None:
                out = part
            else:
                m = min(len(out), len(part) - covered)
                out = np.unique((out[:m] << np.int64(32)) | part[covered : covered + m], return_inverse=True)[1]
            covered += step
        if covered == k:
            return out[:n]
        part = np.unique((part[:-step] << np.int64(32)) | part[step:], return_inverse=True)[1]
        step *= 2


def windows(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values, unmixed, by doubling."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, covered, part, step = None, 0, values, 1
    while True:
        if k & step:
            if out is None:
                out = part
            else:
                m = min(len(out), len(part) - covered)
                out = out[:m] * U(pow(P, step, 1 << 64)) + part[covered : covered + m]
            covered += step
        if covered == k:
            return out[:n]
        part = part[:-step] * U(pow(P, step, 1 << 64)) + part[step:]
        step *= 2


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each k consecutive values."""
    n, step = len(x) - k + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * step <= k:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[k - step : k - step + n])


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """True for each of n places that lies in [s, s + length) for a start s."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + length, n), -1)
    return np.cumsum(d[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True."""
    d = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)
