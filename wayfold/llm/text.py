"""Small helpers on text columns and Arrow batches that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
U = np.uint64


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace")


def space_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text, A-Z lower-cased."""
    return utf8(text).translate(LOWER).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive words; fewer words than n make one shingle, none make none."""
    size = len(hashes)
    if not size:
        return hashes
    width = min(n, size)
    out = np.full(size - width + 1, U(width), dtype=U)
    for i in range(width):
        out = mix(out * U(0x9E3779B97F4A7C15) + hashes[i : size - width + 1 + i])
    return out


def shingles_of_each(hashes: np.ndarray, lengths: np.ndarray, n: int) -> list[np.ndarray]:
    """shingles() of each of several texts whose word hashes stand one after the other, in one pass over all."""
    every = shingles(hashes, n) if len(hashes) >= n else hashes[:0]
    ends = np.cumsum(lengths)
    return [every[e - k : e - n + 1] if k >= n else shingles(hashes[e - k : e], n) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a slice holds about most_bytes of the column or one row."""
    for batch in batches:
        start, size = 0, 0
        texts = batch.column(batch.schema.get_field_index(column))
        for i in range(batch.num_rows):
            size += len(texts[i].as_buffer()) if texts[i].is_valid else 0
            if size >= most_bytes:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)
