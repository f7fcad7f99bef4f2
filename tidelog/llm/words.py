"""Words of a batch of texts as arrays: each distinct word once, and its place in the texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that leaves no pattern (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """A-Z in lower case; words are runs of anything but space and \\t \\n \\v \\f \\r. The distinct words, for each word in turn its index among them, and where each text's words start, and the end. A null counts as empty."""
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))
    for white in "\t\n\v\f\r":
        texts = pc.replace_substring(texts, white, " ")
    lists = pc.split_pattern(texts, " ")
    coded = lists.values.cast(pa.binary()).dictionary_encode()
    distinct, of = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    if b"" in distinct:  # between two blanks, and in texts without words
        stays = of != distinct.index(b"")
        starts = np.concatenate([[0], np.cumsum(stays)])[starts]
        of = of[stays]
    return distinct, of, starts


def hashed(distinct: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
