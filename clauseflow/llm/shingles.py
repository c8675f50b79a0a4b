"""Words and word shingles of whole texts as 64-bit hashes, in NumPy.

Words are runs of bytes other than the six ASCII spaces, with A-Z in lower case.  A set of
hashes stands for a set of shingles; two different shingles share a hash with a chance of
about 2**-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WORDS_PER_SHINGLE = 5
SLICE_BYTES = 1 << 18  # work arrays stay small; a longer text is cut between words
PORTION_BYTES = 4 << 20
LONG_WORD = 64  # bytes; longer words are hashed one by one

_ROOT = 0x9E3779B97F4A7C15
_FACTORS = np.array([pow(_ROOT, 2 * k + 3, 1 << 64) for k in range(64)], np.uint64)
SPACES = b" \t\n\r\x0b\x0c"
_SPACE = np.isin(np.arange(256), list(SPACES))
_LOWER = bytes(32 if c in SPACES else c + 32 if 65 <= c <= 90 else c for c in range(256))
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slices(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(text numbers, pieces) of about SLICE_BYTES; pieces end between words."""
    owners: list[int] = []
    pieces: list[bytes] = []
    size = 0
    for k, text in enumerate(texts):
        at, n = 0, len(text)
        while at < n:
            end = n
            if n - at > SLICE_BYTES:
                end = at + SLICE_BYTES
                while end < n and not _SPACE[text[end]]:
                    end += 1
            owners.append(k)
            pieces.append(text if end - at == n else text[at:end])
            size += end - at
            at = end
            if size >= SLICE_BYTES:
                yield owners, pieces
                owners, pieces, size = [], [], 0
    if pieces:
        yield owners, pieces


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    counts = np.zeros(len(texts), np.int64)
    out = [np.empty(0, np.uint64)]
    for owners, pieces in _slices(texts):
        raw = b"".join([b" ", b"\n".join(pieces).translate(_LOWER), b" " * 8])
        space = np.frombuffer(raw, np.uint8) == 32
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        size = end - start
        eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # the eight bytes from every byte on
        found = mixed(eight[start] & _FIRST_BYTES[np.minimum(size, 8)])
        more = np.flatnonzero(size > 8)
        for at in range(8, LONG_WORD, 8):
            rest = size[more] - at
            found[more] = mixed(found[more] ^ (eight[start[more] + at] & _FIRST_BYTES[np.minimum(rest, 8)]))
            more = more[rest > 8]
            if not len(more):
                break
        for k in more.tolist():
            found[k] = int.from_bytes(hashlib.blake2b(raw[start[k] : end[k]], digest_size=8).digest(), "little")
        out.append(mixed(found + size.astype(np.uint64)))
        first = np.cumsum([1, *(len(p) + 1 for p in pieces)])
        np.add.at(counts, owners, np.diff(np.searchsorted(start, first)))
    return np.concatenate(out), counts


def windows_of(texts: list[bytes], size: int = WORDS_PER_SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, words of each text, hashes of ``size`` words from every word on)."""
    words, counts = word_hashes(texts)
    return words, counts, windowed(words, size)


def windowed(words: np.ndarray, size: int) -> np.ndarray:
    flat = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        flat += words[k : len(flat) + k] * _FACTORS[k]
    return mixed(flat)


def sequence_key(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def shingle_sets(
    texts: list[bytes], size: int = WORDS_PER_SHINGLE
) -> Iterator[tuple[bytes | None, np.ndarray]]:
    """For each text (key of its word sequence, its shingle hashes: sorted, distinct).

    A text of fewer than ``size`` words has its whole sequence as one shingle; without a
    word it has the key None and no shingle.
    """
    for part in portions(texts):
        yield from _sets(part, size)


def sequence_names(texts: list[bytes], least: int, size: int = WORDS_PER_SHINGLE) -> Iterator[tuple[bytes | None, int]]:
    """For each text (key, at least as many shingles as its set has), from its words alone.

    The key is that of its word sequence.  Sets of fewer than ``least`` shingles may be equal
    though the sequences differ; both then repeat all words but one of a shingle less than
    ``least`` words later.  Such texts have the key of their set and their exact number.
    """
    every = least > 64  # so long repeats are not looked for
    for part in portions(texts):
        words, counts = word_hashes(part)
        ends = np.cumsum(counts)
        owner = np.repeat(np.arange(len(part)), counts)
        again = np.zeros(len(part), np.int64)
        for step in range(1, 1 if every else least):
            same = (words[step:] == words[:-step]) & (owner[step:] == owner[:-step])
            again += np.bincount(owner[step:][same], minlength=len(part))
        for n, end, repeats in zip(counts.tolist(), ends.tolist(), again.tolist()):
            own = words[end - n : end]
            found = n - size + 1
            if n < size:
                yield (sequence_key(own), 1) if n else (None, 0)
                continue
            key = None
            if every or repeats >= size - 1:
                exact = np.unique(windowed(own, size))
                if len(exact) < least:
                    key, found = sequence_key(np.append(exact, np.uint64(size))), len(exact)
            yield key or sequence_key(own), found


def sampled_shingles(
    texts: list[bytes], least: int, top: np.uint64, size: int = WORDS_PER_SHINGLE
) -> Iterator[tuple[bytes, np.ndarray]]:
    """(key of its word sequence, its shingle hashes up to ``top`` in the order of the text)
    of each text of at least ``least`` windows; what a text says twice comes twice."""
    for part in portions(texts):
        words, counts, flat = windows_of(part, size)
        owner = np.repeat(np.arange(len(part)), counts)
        mine = owner[: len(flat)]
        chosen = (flat <= top) & (mine == owner[size - 1 : size - 1 + len(flat)])
        flat = flat[chosen]
        cuts = np.cumsum(np.bincount(mine[chosen], minlength=len(part))).tolist()
        last = 0
        for n, end, cut in zip(counts.tolist(), np.cumsum(counts).tolist(), cuts):
            if n - size + 1 >= least:
                yield sequence_key(words[end - n : end]), flat[last:cut]
            last = cut


def portions(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in order, a few megabytes at a time or one alone: work arrays stay small."""
    part: list[bytes] = []
    held = 0
    for text in texts:
        if part and held + len(text) > PORTION_BYTES:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


def _sets(texts: list[bytes], size: int) -> Iterator[tuple[bytes | None, np.ndarray]]:
    words, counts, flat = windows_of(texts, size)
    for n, end in zip(counts.tolist(), np.cumsum(counts).tolist()):
        if not n:
            yield None, np.empty(0, np.uint64)
            continue
        own = words[end - n : end]
        if n < size:
            yield sequence_key(own), mixed((own * _FACTORS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
        else:
            found = np.sort(flat[end - n : end - size + 1])
            new = found[1:] != found[:-1]
            yield sequence_key(own), found if new.all() else found[np.append(True, new)]
