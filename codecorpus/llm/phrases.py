"""Substring dedup over words with automata of repeated phrases.

1. Every text yields its anchor phrases (see ``anchors``); those that occur once are ruled out.
2. The phrases that recur are compiled into Aho-Corasick automata, one shard for each block of
   documents that share phrases, and the documents of the block are streamed through it: that finds
   every place of every phrase, word for word.
3. Windows around the places are compared by the XXH128 of their words over the whole corpus; those
   that occur once are ruled out, and the words of all others are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.anchors import (
    BYTE_BASE,
    WORD_BASE,
    Block,
    Powers,
    anchor_places,
    ends_of,
    range_hashes,
    row_key,
    singles,
    slices,
    word_hashes,
)

WINDOW = 35
#: Words of an anchor phrase.
PHRASE = 10


class Words:
    """The words of a block of texts, by hash."""

    def __init__(self, column: pa.Array, powers: tuple[Powers, Powers]):
        self.block = Block(column)
        self.first, self.last, self.bounds = self.block.words()
        self.hashes = word_hashes(self.block, self.first, self.last, 0, powers[0])
        self.powers = powers

    def runs(self, starts: np.ndarray, size: int, values: np.ndarray, base: Powers) -> np.ndarray:
        stop = np.minimum(starts + size, len(self.first))
        return range_hashes(values, starts, stop, base)

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place (over the block) of each anchor phrase."""
        n = len(self.first)
        grams = self.runs(np.arange(n), PHRASE, self.hashes, self.powers[1])
        places = anchor_places(grams, ends_of(self.bounds), window, PHRASE)
        return grams[places], places

    def texts(self) -> np.ndarray:
        """For each word, which text it is in."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def _powers() -> tuple[Powers, Powers]:
    return Powers(BYTE_BASE), Powers(WORD_BASE)


def find_anchors(rows: DataFrame, window: int) -> DataFrame:
    """h, key, place of the anchor phrases; ``rows`` has _key and _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers()
        for batch in slices(batches, 1):
            words = Words(batch.column(1), powers)
            if not len(words.first):
                continue
            h, places = words.anchors(window)
            text = words.texts()[places]
            key = batch.column(0).to_numpy(zero_copy_only=False)[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(key), pa.array(places - words.bounds[text])],
                names=["h", "key", "place"],
            )

    return rows.select("_key", "_text").mapInArrow(run, "h long, key long, place long")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the row that each is of."""
    sizes = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values, np.repeat(np.arange(len(sizes)), sizes.astype(np.int64))


def candidate_windows(words: Words, single: pa.Array, window: int) -> np.ndarray:
    """Starts (over the block) of the windows that hold a phrase which recurs."""
    none = np.empty(0, np.int64)
    if not len(words.first):
        return none
    _, places = words.anchors(window)
    values, row = flat(single)
    recurring = np.setdiff1d(places, values + words.bounds[row], assume_unique=True)
    if not len(recurring):
        return none
    data = words.block.bytes.tobytes().decode("latin-1")
    first, last = words.first, words.last
    automaton = ahocorasick.Automaton()
    for place in recurring.tolist():
        phrase = " ".join(
            data[a:b] for a, b in zip(first[place : place + PHRASE].tolist(), last[place : place + PHRASE].tolist())
        )
        automaton.add_word(f" {phrase} ", PHRASE)
    automaton.make_automaton()
    found = []
    text_of = words.texts()
    for text in np.unique(text_of[recurring]).tolist():
        a, b = int(words.bounds[text]), int(words.bounds[text + 1])
        lengths = last[a:b] - first[a:b]
        plain = " ".join(data[x:y] for x, y in zip(first[a:b].tolist(), last[a:b].tolist()))
        ends = np.fromiter((end for end, _ in automaton.iter(f" {plain} ")), np.int64)
        # The blank after word i stands at i + 1 blanks and the letters of i + 1 words.
        blank = np.cumsum(lengths + 1)
        found.append(a + np.searchsorted(blank, ends) - PHRASE + 1)
    places = np.concatenate(found)
    low = words.bounds[text_of[places]]
    high = words.bounds[text_of[places] + 1] - window
    start = np.maximum(places + PHRASE - window, low)
    stop = np.minimum(places, high)
    ok = start <= stop
    change = np.zeros(len(words.first) + 1, np.int64)
    np.add.at(change, start[ok], 1)
    np.add.at(change, stop[ok] + 1, -1)
    return np.flatnonzero(np.cumsum(change[:-1]) > 0)


def window_digests(words: Words, starts: np.ndarray, window: int) -> np.ndarray:
    """XXH128 of each window's words, joined by one space, as two numbers.

    Polynomial hashes choose the anchors, where a collision only adds a candidate; here one would
    remove words, and there are texts that make any polynomial hash collide.
    """
    data = words.block.bytes.tobytes()
    first, last = words.first, words.last
    plain = b" ".join([data[a:b] for a, b in zip(first.tolist(), last.tolist())])
    end = np.cumsum(last - first + 1) - 1
    begin = end - (last - first)
    digests = [
        xxhash.xxh3_128_digest(plain[a:b])
        for a, b in zip(begin[starts].tolist(), end[starts + window - 1].tolist())
    ]
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def find_windows(rows: DataFrame, window: int) -> DataFrame:
    """f, g (halves of the XXH128 of the words), key and place of all candidate windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers()
        for batch in slices(batches, 1):
            words = Words(batch.column(1), powers)
            starts = candidate_windows(words, batch.column(2), window)
            if not len(starts):
                continue
            halves = window_digests(words, starts, window)
            text = words.texts()[starts]
            key = batch.column(0).to_numpy(zero_copy_only=False)[text]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                    pa.array(key), pa.array(starts - words.bounds[text]),
                ],
                names=["f", "g", "key", "place"],
            )

    # The id is not needed here; with it the texts are shuffled once for this and the last step.
    chosen = rows.select("_key", "_text", "single", "_id")
    return chosen.mapInArrow(run, "f long, g long, key long, place long")


def spans_of(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of each run of true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def repeated_phrases(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """Per row: doc_id, n_words, spans (array of start and end in words), kept_text.

    A word goes if a window of ``window`` words that covers it occurs anywhere else, in the same
    text or in another; windows are judged on the input.  ``kept_text`` has the kept words, joined
    by one space.  Rows that repeat a doc_id and its text are two places of one text, so all their
    windows go.  A null text, and a text of fewer words than a window, keeps everything; an empty
    table gives an empty table.  A text of any length is worked on as a whole in one task.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(
        F.col(doc_id).alias("_id"), F.col(text).cast("binary").alias("_text"),
        row_key(doc_id, text).alias("_key"),
    )
    once = singles(find_anchors(rows, window))
    joined = rows.join(once.hint("shuffle_hash"), rows["_key"] == once["key"], "left").drop("key")
    places = find_windows(joined, window).groupBy("f", "g").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("key"), F.min("place").alias("place")
    )
    lone = places.where("n = 1").groupBy("key").agg(F.collect_list("place").alias("lone"))
    joined = joined.join(lone.hint("shuffle_hash"), joined["_key"] == lone["key"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers()
        for batch in slices(batches, 1):
            words = Words(batch.column(1), powers)
            starts = candidate_windows(words, batch.column(2), window)
            values, row = flat(batch.column(3))
            starts = np.setdiff1d(starts, values + words.bounds[row], assume_unique=True)
            change = np.zeros(len(words.first) + window + 1, np.int64)
            change[starts] += 1
            change[starts + window] -= 1
            gone = np.cumsum(change[: len(words.first)]) > 0
            data = words.block.bytes.tobytes()
            spans, kept = [], []
            for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
                first, end = spans_of(gone[a:b])
                spans.append([{"start": s, "end": e} for s, e in zip(first.tolist(), end.tolist())])
                left = np.flatnonzero(~gone[a:b]) + a
                pairs = zip(words.first[left].tolist(), words.last[left].tolist())
                kept.append(b" ".join([data[s:e] for s, e in pairs]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(4), pa.array(np.diff(words.bounds)),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "spans", "kept_text"],
            )

    return joined.select("_key", "_text", "single", "lone", "_id").mapInArrow(
        run,
        f"doc_id {id_type}, n_words long, spans array<struct<start:long,end:long>>, "
        "kept_text string",
    )
