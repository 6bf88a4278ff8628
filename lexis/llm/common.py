"""Pieces that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialise, new_path, shared_dir  # noqa: F401  for the operators

#: A word of the whitespace-separated contracts; bytes.split() without arguments cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def own(df: DataFrame, name: str) -> Column:
    """The column of df with this name, whatever characters it has."""
    return df["`" + name.replace("`", "``") + "`"]


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def least_hashed(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most `most` rows: those with the smallest hashes of `keys`, a sample that reruns agree on.

    Only rows below a hash are sorted, so that what the sort gathers does not grow with the number of tasks. With
    distinct keys about twice as many rows as wanted lie below it; where repeated keys leave too few, it is raised.
    """
    n, h = rows.count(), F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    share = 2 * most / n if n else 1
    while share < 1:
        fewer = rows.where(h < int((1 << 40) * share))
        if fewer.count() >= most:
            return fewer.orderBy(h, *keys).limit(most)
        share *= 4
    return rows.orderBy(h, *keys).limit(most)


def bytes_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def pieces(texts: list[bytes], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `most` bytes, so that the words in memory stay few."""
    begin = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """2^26 bits, in words of 64, with those of the leading bits of every `h` set: bounded, and it forgets none."""
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 38) & 63 as int))")
    found = hashes.select(F.shiftrightunsigned("h", 44).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << 20, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def inside(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes have their bit in the bitmap."""
    return (bits[h >> np.uint64(44)] >> (h >> np.uint64(38) & np.uint64(63)) & np.uint64(1)).astype(bool)


class Once(set):
    """Digests met in a task: copies need not be worked on again. Emptied when it holds `most`, so a copy may pass."""

    def new(self, key: bytes, most: int = 100_000) -> bool:
        if key in self:
            return False
        if len(self) >= most:
            self.clear()
        self.add(key)
        return True


class WordHashes(dict):
    """Memo of 64-bit hashes by word; emptied when it holds `most` words."""

    def __init__(self, seed: int = 0, most: int = 100_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = xxhash.xxh64_intdigest(word, self.seed)
        if len(word) < 64:
            self[word] = value
        return value
