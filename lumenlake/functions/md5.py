"""MD5 of many short texts at once: "seed|number|slot" for columns of numbers, "seed|one__two" for pairs of names."""

from __future__ import annotations

import hashlib

import numpy as np

_SHIFTS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(4, 4, 4).reshape(-1)
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).astype(np.uint32)
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of a text that is one block with its padding.
ONE_BLOCK = 55
#: Numbers that one call of run() hashes, a power of ten: so many differ in their last digits only.
RUN = 10**4
_DIGITS = np.frombuffer(b"".join(b"%04d" % k for k in range(RUN)), np.uint8).reshape(RUN, 4)
#: Pairs whose digests are computed together, so that they stay in the processor's cache.
STEP = 1 << 14


def _first_words(words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the digests of n padded blocks, given as their 16 words; one that all blocks share may be a
    number."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        w = words[g]
        f = f + a + (np.uint32(w + int(_SINES[i]) & 0xFFFFFFFF) if isinstance(w, int) else w + _SINES[i])
        s = np.uint32(_SHIFTS[i])
        a, d, c, b = d, c, b, b + ((f << s) | (f >> np.uint32(32 - s)))
    return a + np.uint32(_START[0]), b + np.uint32(_START[1])


def hashes(seed: int, numbers: np.ndarray, slot: str) -> np.ndarray:
    """The first 60 bits of MD5 of "seed|number|slot" for each number, 0 or more."""
    head, tail = f"{seed}|".encode(), f"|{slot}".encode()
    out = np.empty(len(numbers), np.int64)
    digits = np.searchsorted(10 ** np.arange(1, 19, dtype=np.int64), numbers, side="right") + 1
    for k in np.unique(digits):
        at = np.flatnonzero(digits == k)
        size = len(head) + int(k) + len(tail)
        if size > ONE_BLOCK:
            out[at] = [int(hashlib.md5(head + str(x).encode() + tail).hexdigest()[:15], 16) for x in numbers[at].tolist()]
            continue
        blocks = np.zeros((len(at), 64), np.uint8)
        blocks[:, : len(head)] = np.frombuffer(head, np.uint8)
        rest = numbers[at]
        for place in range(len(head) + int(k) - 1, len(head) - 1, -1):
            rest, digit = np.divmod(rest, 10)
            blocks[:, place] = digit + 48
        blocks[:, len(head) + int(k) : size] = np.frombuffer(tail, np.uint8)
        blocks[:, size], blocks[:, 56], blocks[:, 57] = 0x80, size * 8 & 255, size * 8 >> 8
        one, two = (x.byteswap().astype(np.uint64) for x in _first_words(np.ascontiguousarray(blocks.view("<u4").T), len(blocks)))
        out[at] = ((one << np.uint64(28)) | (two >> np.uint64(4))).astype(np.int64)
    return out


def _in_place(words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """_first_words() for words most of which are numbers, without new arrays."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
            k = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
            k = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
            k = (3 * i + 5) % 16
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
            k = 7 * i % 16
        np.add(f, a, out=f)
        w, s = words[k], int(_SHIFTS[i])
        if isinstance(w, int):
            np.add(f, np.uint32(w + int(_SINES[i]) & 0xFFFFFFFF), out=f)
        else:
            np.add(f, w, out=f)
            np.add(f, _SINES[i], out=f)
        np.left_shift(f, np.uint32(s), out=g)
        np.right_shift(f, np.uint32(32 - s), out=f)
        np.bitwise_or(f, g, out=f)
        # The array of the old a takes the new b.
        np.add(f, b, out=a)
        a, d, c, b = d, c, b, a
    return a + np.uint32(_START[0]), b + np.uint32(_START[1])


def run(seed: int, which: int, slot: str) -> np.ndarray:
    """hashes() of the numbers from which * RUN on, RUN of them. Their texts differ in four bytes, so most words of a block
    are one number for all."""
    head, tail = f"{seed}|{which}".encode(), f"|{slot}".encode()
    start, size = len(head), len(head) + 4 + len(tail)
    if which < 1 or size > ONE_BLOCK:
        return hashes(seed, np.arange(which * RUN, (which + 1) * RUN, dtype=np.int64), slot)
    text = head + bytes(4) + tail + b"\x80"
    words = np.frombuffer(text.ljust(56, b"\0") + (size * 8).to_bytes(8, "little"), "<u4").tolist()
    low, high = start // 4, (start + 3) // 4
    own = np.zeros((RUN, 4 * (high - low + 1)), np.uint8)
    own[:, start - 4 * low : start - 4 * low + 4] = _DIGITS
    own = own.view("<u4")
    for k in range(low, high + 1):
        words[k] = own[:, k - low] | np.uint32(words[k])
    one, two = (x.byteswap().astype(np.uint64) for x in _in_place(words, RUN))
    return ((one << np.uint64(28)) | (two >> np.uint64(4))).astype(np.int64)


def _blocks(texts: list[bytes], start: int) -> np.ndarray:
    """(16, n) words of blocks that hold texts of one length from a place on, and zeros elsewhere."""
    out = np.zeros((len(texts), 64), np.uint8)
    size = len(texts[0])
    out[:, start : start + size] = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, size)
    return np.ascontiguousarray(out.view("<u4").T)


def pairs_below(seed: int, one: list[bytes], two: list[bytes], rank_one: np.ndarray, rank_two: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in one and in two of the pairs with rank_one < rank_two for which the first 60 bits of MD5 of
    "seed|one__two" are less than bound. No text of a pair is made: the words of its block are those of either name."""
    head, rows, columns = f"{seed}|".encode(), [], []
    sizes = [np.array([len(x) for x in side], np.int64) for side in (one, two)]
    for m in np.unique(sizes[0]):
        at = np.flatnonzero(sizes[0] == m)
        start = len(head) + int(m) + 2
        left = [head + one[i] + b"__" for i in at]
        for k in np.unique(sizes[1]):
            to = np.flatnonzero(sizes[1] == k)
            row, column = np.nonzero(rank_one[at][:, None] < rank_two[to][None])
            right, size = [two[j] for j in to], start + int(k)
            if size > ONE_BLOCK:
                kept = np.flatnonzero([int(hashlib.md5(left[i] + right[j]).hexdigest()[:15], 16) < bound for i, j in zip(row, column)])
                rows.append(at[row[kept]])
                columns.append(to[column[kept]])
                continue
            a, b = _blocks(left, 0), _blocks([x + b"\x80" for x in right], start)
            shared = [0] * 14 + [size * 8, 0]
            for first in range(0, len(row), STEP):
                r, c = row[first : first + STEP], column[first : first + STEP]
                words = [a[g][r] | b[g][c] if 4 * g <= size else shared[g] for g in range(16)]
                high, low = (x.byteswap().astype(np.uint64) for x in _first_words(words, len(r)))
                kept = np.flatnonzero(((high << np.uint64(28)) | (low >> np.uint64(4))) < np.uint64(bound))
                rows.append(at[r[kept]])
                columns.append(to[c[kept]])
    whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return whole(rows), whole(columns)
