"""Words of many texts at once: their places in the texts' bytes and their XXH64, as array operations.

Words are those of ``bytes.lower().split()``: runs without the six ASCII white-space characters, A-Z in lower case.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

P1, P2, P3, P4, P5 = (
    np.uint64(p)
    for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)
# XXH64 takes other steps from here on.
SHORT = 32


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one behind the other, and the ends of each; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64)
    _, places, content = texts.buffers()
    bounds = np.frombuffer(places, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(content, dtype=np.uint8) if content is not None else np.zeros(0, dtype=np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds[1:] - bounds[0]


def places(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and length of every word, and the number of words in each text; no word goes over a text's end."""
    solid = (raw != 32) & (raw - np.uint8(9) > 4)
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    inner = ends[(ends > 0) & (ends < len(raw))]
    begins[inner] = solid[inner]
    stops[inner - 1] = solid[inner - 1]
    first = np.flatnonzero(begins)
    lengths = np.flatnonzero(stops) + 1 - first
    return first, lengths, np.diff(np.searchsorted(first, ends), prepend=0)


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, and as many zero bytes behind as the hashes read beyond a word."""
    out = np.zeros(len(raw) + SHORT + 8, dtype=np.uint8)
    np.add(raw, ((raw - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5), out=out[: len(raw)])
    return out


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(raw: np.ndarray, first: np.ndarray, lengths: np.ndarray, long: Callable[[bytes], int]) -> np.ndarray:
    """XXH64 with seed 0 of the words in ``raw`` (see ``lowered``); ``long`` hashes those of 32 bytes and more."""
    eight = np.ndarray(len(raw) - 7, dtype="<u8", buffer=raw, strides=(1,))
    out = lengths.astype(np.uint64) + P5
    for done in range(0, SHORT - 8, 8):
        at = np.flatnonzero(lengths >= done + 8)
        if not len(at):
            break
        lane = _turned(eight[first[at] + done] * P2, 31) * P1
        out[at] = _turned(out[at] ^ lane, 27) * P1 + P4
    whole = lengths & ~7
    rest = (lengths & 7).astype(np.uint8)
    tail = eight[np.minimum(first + whole, len(eight) - 1)]
    at = np.flatnonzero(rest & 4)
    out[at] = _turned(out[at] ^ ((tail[at] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    tail[at] >>= np.uint64(32)
    rest &= 3
    for done in range(3):
        at = np.flatnonzero(rest > done)
        byte = (tail[at] >> np.uint64(8 * done)) & np.uint64(255)
        out[at] = _turned(out[at] ^ (byte * P5), 11) * P1
    out ^= out >> np.uint64(33)
    out *= P2
    out ^= out >> np.uint64(29)
    out *= P3
    out ^= out >> np.uint64(32)
    for i in np.flatnonzero(lengths >= SHORT).tolist():
        out[i] = long(raw[first[i] : first[i] + lengths[i]].tobytes())
    return out
