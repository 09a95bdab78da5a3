"""Word hashing, shingle sets and MinHash signatures of Arrow batches of texts.

Null text and text without words give no words, an empty set and no signature; empty batches give empty arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from orrery.llm.common import arrow_words

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def listed_words(texts: pa.Array, lower: bool = False, seed: int = 0) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words one after another, their 64-bit hashes, and the word offsets of each text (n + 1)."""
    lists = arrow_words(texts, lower)
    flat = pc.list_flatten(lists)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    encoded = flat.dictionary_encode()
    pool = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in encoded.dictionary.to_pylist()), np.uint64, len(encoded.dictionary))
    index = encoded.indices.to_numpy()
    # the split leaves one empty piece in a text without words
    empty = np.flatnonzero(pc.equal(encoded.dictionary, "").to_numpy(zero_copy_only=False))
    if len(empty):
        keep = index != empty[0]
        index, flat = index[keep], flat.filter(pa.array(keep))
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return flat, pool[index] if len(pool) else np.zeros(0, np.uint64), offsets


def hashed_words(texts: pa.Array, lower: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words one after another, and the word offsets of each text (n + 1)."""
    _, words, offsets = listed_words(texts, lower, seed)
    return words, offsets


#: Words of more bytes are hashed one by one.
_LONG = 64
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, first and last place of each word in them (the last one past its end), the word offsets and the byte
    offsets of each text (n + 1)."""
    texts = pc.fill_null(texts, "")
    _, at, data = texts.buffers()
    borders = np.zeros(1, np.int64)
    if len(texts):
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        borders = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[borders[0] : borders[-1]] if data is not None else np.zeros(0, np.uint8)
    borders = borders - borders[0]
    inside = ~((data == 32) | (data - np.uint8(9) < 5))
    heads, tails = inside.copy(), inside.copy()
    heads[1:] &= ~inside[:-1]
    tails[:-1] &= ~inside[1:]
    begins, ends = borders[borders < len(data)], borders[borders > 0] - 1
    heads[begins], tails[ends] = inside[begins], inside[ends]
    first = np.flatnonzero(heads)
    return data, first, np.flatnonzero(tails) + 1, np.searchsorted(first, borders), borders


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the words at ``word_bounds``, eight bytes of all words at a time."""
    size = last - first
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h = _mixed(size.astype(np.uint64) + np.uint64((seed + 1) * int(_ODD) % (1 << 64)))
    live = np.flatnonzero(size <= _LONG)
    for j in range(0, _LONG, 8):
        live = live[size[live] > j]
        h[live] = _mixed(h[live] ^ (eights[first[live] + j] & _BYTES[np.minimum(size[live] - j, 8)]))
    for i in np.flatnonzero(size > _LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[first[i] : last[i]].tobytes(), seed)
    return h


def rolling(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each k consecutive words (across text borders too; see ``inside``)."""
    n = max(0, len(hashes) - k + 1)
    h = np.full(n, seed, np.uint64)
    for j in range(k):
        h = (h ^ hashes[j : n + j]) * _ODD
        h ^= h >> _SHIFT
    return h


def shingle_sets(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; of all its words where it has fewer than k."""
    words, offsets = hashed_words(texts, lower=True)
    all_k = rolling(words, k)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(all_k[a : b - k + 1]))
        else:
            out.append(rolling(words[a:b], b - a, seed=int(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def signature_params(n: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 2**32, n, dtype=np.uint32)


def signature(shingles: np.ndarray, params: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """MinHash signature: the least value of each random linear permutation of the set's 32-bit keys."""
    a, b = params
    keys = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(keys), 4096):
        part = keys[lo : lo + 4096]
        least = np.minimum(least, (part[:, None] * a + b).min(axis=0))
    return least


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit key of each band (``rows`` values and the band's number) of each signature."""
    cut = values[:, : bands * rows].reshape(len(values), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(values), bands)).copy()
    for j in range(rows):
        h = (h ^ cut[:, :, j]) * _ODD
        h ^= h >> _SHIFT
    return h
