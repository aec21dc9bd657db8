"""Word and shingle hashes of whole texts, vectorised over a batch inside a task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SHINGLE = 5
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BYTE[list(_SPACES)] = 0
_SPACE = np.zeros(256, bool)
_SPACE[list(_SPACES)] = True
#: The same with ASCII punctuation and digits as separators too.
_WORD_BYTE, _WORD_SPACE = _BYTE.copy(), _SPACE.copy()
_WORD_SPACE[:65] = _WORD_SPACE[91:97] = _WORD_SPACE[123:128] = True
_WORD_BYTE[_WORD_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
#: Bytes hashed at a time; a longer text goes through in parts cut at white space.
SEGMENT = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE)
    out[0] = 1
    return np.multiply.accumulate(out)


def _hash_bytes(raw: bytes, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in raw, and where each starts."""
    value, space = (_WORD_BYTE, _WORD_SPACE) if letters else (_BYTE, _SPACE)
    buf = np.frombuffer(raw, np.uint8)
    solid = ~space[buf]
    starts = np.flatnonzero(solid & np.concatenate(([True], ~solid[:-1])))
    if not len(starts):
        return np.empty(0, np.uint64), starts
    place = np.arange(starts[0], len(buf)) - np.repeat(starts, np.diff(starts, append=len(buf)))
    terms = value[buf[starts[0] :]] * _powers(int(place.max()) + 1)[place]
    return mix(np.add.reduceat(terms, starts - starts[0])), starts


def _parts(raw: bytes) -> Iterator[bytes]:
    """raw, cut at white space into parts of about SEGMENT bytes; a word is never cut."""
    at = 0
    while len(raw) - at > SEGMENT:
        end = at + SEGMENT
        while end < len(raw) and raw[end] not in _SPACES:
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def words(texts: Iterable[str | None], letters: bool = False) -> Iterator[np.ndarray]:
    """For each text the hashes of its words ``[^\\x20\\x09-\\x0D]+`` in order, A-Z lower-cased; null: none.
    ``letters``: ASCII other than letters separates words too."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if held:
            hashes, starts = _hash_bytes(b"\n".join(held), letters)
            ends = np.cumsum([len(x) + 1 for x in held])
            yield from np.split(hashes, np.searchsorted(starts, ends[:-1]))
            held.clear()

    for text in texts:
        raw = (text or "").encode("utf-8", "replace")
        if len(raw) > SEGMENT:
            yield from flush()
            size = 0
            yield np.concatenate([_hash_bytes(p, letters)[0] for p in _parts(raw)])
            continue
        held.append(raw)
        size += len(raw) + 1
        if size > SEGMENT:
            yield from flush()
            size = 0
    yield from flush()


def shingles(hashes: np.ndarray) -> np.ndarray:
    """The sorted distinct hashes of a text's five-word shingles; with fewer words, the whole sequence as one."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(n, SHINGLE)
    total = np.full(n - k + 1, k * int(_LENGTH) % 2**64, np.uint64)
    for i in range(k):
        total += hashes[i : n - k + 1 + i] * _PLACE[i]
    return np.unique(mix(total))
