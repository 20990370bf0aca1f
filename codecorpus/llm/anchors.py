"""Anchors: a few places of each text, chosen by content, that every long repeat has in common.

Of all short grams inside a window the one with the smallest hash is the window's anchor.  Equal
windows have the same anchor at the same place, so a window that occurs twice has an anchor that
occurs twice.  Looking at anchors only leaves a fraction 2 / (window - gram + 2) of all places, and
nothing that repeats can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a task works on at a time, so that its arrays stay in the processor's cache; a
#: longer text is a block of its own.
BLOCK_BYTES = 120_000

_LETTERS = np.random.default_rng(2024).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd bases of polynomial hashes and their inverses modulo 2^64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


class Powers:
    """Powers of a base and of its inverse, grown when a longer block comes."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up[:n], self.down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of a hash spread over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def range_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of the runs values[first:last], equal for equal runs wherever they stand."""
    up, down = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mixed((sums[last] - sums[first]) * down[first])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values; one result per run."""
    done, out = 1, values
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    if done < width:
        rest = width - done
        out = np.minimum(out[: len(out) - rest], out[rest:])
    return out


def anchor_places(grams: np.ndarray, ends: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Places of grams that are the smallest of some window.

    ``grams[i]`` is the hash of the gram at place i; ``ends[i]`` is where the text of place i ends,
    so windows and grams over the end of a text do not count.
    """
    n = len(grams)
    if n < window:
        return np.empty(0, np.int64)
    place = np.arange(n)
    top = np.uint64(2**64 - 1)
    width = window - gram + 1
    inside = np.where(place + gram <= ends, grams | np.uint64(1), top)
    low = sliding_min(inside, width)
    whole = place[: len(low)] + window <= ends[: len(low)]
    # A gram is chosen if the smallest gram of one of its windows is itself: the maximum, over the
    # windows with the gram, of their minimum.
    flipped = np.full(n + width - 1, top)
    flipped[width - 1 : width - 1 + len(low)] = np.where(whole, top - low, top)
    high = top - sliding_min(flipped, width)
    return np.flatnonzero((high == inside) & (place + gram <= ends))


class Block:
    """Some texts as one run of bytes."""

    def __init__(self, column: pa.Array):
        data = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
        bodies = [x.as_py() or b"" for x in data]
        self.bytes = np.frombuffer(b"".join(bodies), np.uint8)
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        self.bounds = np.concatenate(([0], np.cumsum(sizes)))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte and end of every word, and the number of words before each text."""
        inside = np.zeros(len(self.bytes) + 2, bool)
        inside[1:-1] = ~_SPACE[self.bytes]
        starts = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        cuts = self.bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(self.bytes))]
        starts[cuts] |= inside[1:-1][cuts]
        ends[cuts - 1] |= inside[1:-1][cuts - 1]
        first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        return first, last, np.searchsorted(first, self.bounds)


def word_hashes(block: Block, first: np.ndarray, last: np.ndarray, which: int, powers: Powers) -> np.ndarray:
    return range_hashes(_LETTERS[which][block.bytes], first, last, powers)


def letters(block: Block, which: int = 0) -> np.ndarray:
    return _LETTERS[which][block.bytes]


def ends_of(bounds: np.ndarray) -> np.ndarray:
    """For every place below the last bound, where its text ends."""
    return np.repeat(bounds[1:], np.diff(bounds))


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one are about ``BLOCK_BYTES`` long together."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > BLOCK_BYTES:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def row_key(doc_id: str, text: str) -> Column:
    """A digest of id and text: rows that repeat both are one document."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def singles(anchors: DataFrame) -> DataFrame:
    """Per document (key) the places of its anchors that occur nowhere else: key, single.

    ``anchors`` has h, key and place.  The aggregate by hash keeps a count and, for hashes that
    occur once, their place; it is combined before the shuffle, so a passage in a third of all
    documents is a few rows.
    """
    once = anchors.groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("key"), F.min("place").alias("place")
    )
    return once.where("n = 1").groupBy("key").agg(F.collect_list("place").alias("single"))


#: Polynomial hashes of the two hash families, over bytes and over words.
BYTE_BASE, WORD_BASE, OTHER_BASE = _BASES
