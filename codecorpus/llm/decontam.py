"""Benchmark decontamination with a generalised suffix automaton over words.

The benchmark is cut into shards of bounded size; each shard becomes one automaton, which is small
enough to broadcast.  Documents are streamed through it word by word; the length of the longest
match that ends at a word says which spans occur in the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words in a window; an item of fewer words is a window of its own.
WINDOW = 10
#: Words of benchmark text in one automaton: the proven bound of what is broadcast.
SHARD_WORDS = 250_000
#: A document is dropped by ``decontaminate`` if more than this share of its words is hit.
MAX_COVERAGE = 0.5

#: Lower-cases A-Z and turns every other ASCII character that is no letter or digit into a space.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case."""
    return (text or b"").translate(_TABLE).split()


class SuffixAutomaton:
    """All runs of words of some items, with the items of every window.

    State 0 is the empty run.  ``edges[s]`` leads from a state by the number of a word, ``link`` and
    ``length`` are the suffix link and the longest run of a state.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.edges: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.numbers: dict[bytes, int] = {}
        coded = []
        for item, words in items:
            if words:
                coded.append((item, [self.numbers.setdefault(w, len(self.numbers)) for w in words]))
        for _, codes in coded:
            state = 0
            for code in codes:
                state = self._extend(state, code)
        self.shortest = min([window, *(len(codes) for _, codes in coded)])
        #: (state of a window, its length) -> items; short items are windows of their own length.
        self.items: dict[tuple[int, int], set] = {}
        #: Lengths of short items that end in a state.
        self.short_ends: dict[int, set[int]] = {}
        for item, codes in coded:
            size = min(window, len(codes))
            state, matched = 0, 0
            for code in codes:
                state, matched = self.edges[state][code], matched + 1
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                matched = min(matched, self.length[state])
                if matched >= size:
                    matched = size
                    self.items.setdefault((state, size), set()).add(item)
                    if size < window:
                        self.short_ends.setdefault(state, set()).add(size)

    def _extend(self, last: int, code: int) -> int:
        edges, link, length = self.edges, self.link, self.length
        if code in edges[last]:
            target = edges[last][code]
            if length[target] == length[last] + 1:
                return target
            return self._split(last, code, target)
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        state = last
        while state >= 0 and code not in edges[state]:
            edges[state][code] = new
            state = link[state]
        if state >= 0:
            target = edges[state][code]
            if length[target] == length[state] + 1:
                link[new] = target
            else:
                link[new] = self._split(state, code, target)
        return new

    def _split(self, state: int, code: int, target: int) -> int:
        edges, link, length = self.edges, self.link, self.length
        copy = len(edges)
        edges.append(dict(edges[target]))
        length.append(length[state] + 1)
        link.append(link[target])
        link[target] = copy
        while state >= 0 and edges[state].get(code) == target:
            edges[state][code] = copy
            state = link[state]
        return copy

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans (first word, word after the last) of all windows, and the items they are of.

        A word that no item has ends every match, so only runs of known words that are as long as
        the shortest window are streamed.
        """
        numbers = self.numbers
        if not numbers or len(words) < self.shortest:
            return [], set()
        codes = np.fromiter((numbers.get(w, -1) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (codes >= 0).view(np.int8), [0]))))
        first, last = edge[::2], edge[1::2]
        long_enough = last - first >= self.shortest
        found: list[tuple[int, int]] = []
        items: set = set()
        for start, end in zip(first[long_enough].tolist(), last[long_enough].tolist()):
            self._stream(codes[start:end].tolist(), start, found, items)
        return found, items

    def _stream(self, codes: list[int], offset: int, found: list, items: set) -> None:
        edges, link, length, window = self.edges, self.link, self.length, self.window
        state, matched = 0, 0
        for place, code in enumerate(codes, offset + 1):
            while state and code not in edges[state]:
                state = link[state]
                matched = length[state]
            if code in edges[state]:
                state, matched = edges[state][code], matched + 1
            covered = 0
            if matched >= window:
                covered = matched
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                items |= self.items.get((at, window), ())
            if self.short_ends:
                at = state
                while at > 0:
                    low = length[link[at]]
                    for size in self.short_ends.get(at, ()):
                        if low < size <= min(matched, length[at]):
                            covered = max(covered, size)
                            items |= self.items[(at, size)]
                    at = link[at]
            if covered:
                start = place - covered
                while found and start <= found[-1][1]:
                    start = min(start, found.pop()[0])
                found.append((start, place))


def benchmark_shards(
    benchmark: DataFrame, item: str = "item_id", text: str = "text", shard_words: int = SHARD_WORDS
) -> Iterator[list[tuple[object, bytes]]]:
    """The items in order of their id, cut so that no shard has more than ``shard_words`` words.

    Items come to the driver one partition at a time and no more than one shard is held; a single
    item above the bound is a shard of its own.  Null texts have no words and are left out.
    """
    rows = benchmark.where(F.col(text).isNotNull()).select(item, F.col(text).cast("binary"))
    shard, size = [], 0
    for row in rows.orderBy(item).toLocalIterator():
        n_words = len(words_of(bytes(row[1])))
        if shard and size + n_words > shard_words:
            yield shard
            shard, size = [], 0
        shard.append((row[0], bytes(row[1])))
        size += n_words
    if shard:
        yield shard


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``docs`` with n_words, spans (array of start and end in words) and items.

    ``items`` are the distinct ids, as strings in order, of the benchmark items with a window in the
    document; ``spans`` are the merged spans of all windows.  All shards are streamed over a block
    of documents while it is in memory, so documents are read once and not shuffled.  A null text
    has no words; an empty benchmark gives no hits; repeated documents are answered alike; an item
    that repeats, or whose id repeats, counts once.  The new columns replace columns of the same
    name.
    """
    spark = docs.sparkSession
    shards = [
        spark.sparkContext.broadcast(shard)
        for shard in benchmark_shards(benchmark, item, item_text, shard_words)
    ] or [spark.sparkContext.broadcast([])]
    source = docs.drop("n_words", "spans", "items")
    place = source.columns.index(text)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: dict[int, SuffixAutomaton] = {}

        def automaton(i: int) -> SuffixAutomaton:
            if i not in built:
                if len(built) >= 2:
                    built.clear()
                built[i] = SuffixAutomaton([(k, words_of(b)) for k, b in shards[i].value], window)
            return built[i]

        for batch in batches:
            bodies = batch.column(place).cast(pa.binary())
            n_words = [0] * len(bodies)
            spans: list[list] = [[] for _ in bodies]
            items: list[set] = [set() for _ in bodies]
            for i in range(len(shards)):
                shard = automaton(i)
                # The words of one document at a time: those of a whole batch take many times its size.
                for n, body in enumerate(bodies):
                    document = words_of(body.as_py())
                    found, which = shard.spans(document)
                    n_words[n] = len(document)
                    spans[n] += found
                    items[n] |= which
            added = [
                pa.array(n_words, pa.int64()),
                pa.array(
                    [[{"start": a, "end": b} for a, b in merged(s)] for s in spans], _SPANS
                ),
                pa.array([sorted({str(x) for x in w}) for w in items], pa.list_(pa.string())),
            ]
            names = [*batch.schema.names, "n_words", "spans", "items"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)

    schema = T.StructType(
        source.schema.fields
        + T.StructType.fromDDL(
            "n_words long, spans array<struct<start:long,end:long>>, items array<string>"
        ).fields
    )
    return source.mapInArrow(stream, schema)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of several shards in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    max_coverage: float = MAX_COVERAGE,
    text: str = "text",
    **options,
) -> DataFrame:
    """``benchmark_hits`` with clean_text, n_hit and dropped.

    ``clean_text`` is the text without the words of all spans; each span leaves one space, and all
    other characters stay as they were.  A document of which more than ``max_coverage`` of the
    words are hit is dropped: what is left of it is not worth keeping.  ``options`` go to
    ``benchmark_hits``, which also says what happens to nulls and repeats.
    """
    hits = benchmark_hits(docs, benchmark, text=text, **options).drop("clean_text")
    body, found = hits.columns.index(text), hits.columns.index("spans")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                without_words(value, spans) if spans else value
                for value, spans in zip(batch.column(body).to_pylist(), batch.column(found).to_pylist())
            ]
            names = [*batch.schema.names, "clean_text"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    schema = T.StructType([*hits.schema.fields, T.StructField("clean_text", T.StringType())])
    rows = hits.mapInArrow(clean, schema).withColumn("n_hit", n_hit(F.col("spans")))
    return rows.withColumn("dropped", F.col("n_hit") > F.lit(max_coverage) * F.col("n_words"))


def n_hit(spans: Column) -> Column:
    """The number of words inside spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def without_words(text: str, spans: list[dict]) -> str:
    """The text with each span of words, and what stands between them, made one space."""
    body = text.encode()
    plain = body.translate(_TABLE)
    places, at = [], 0
    for word in plain.split():
        at = plain.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    out, done = [], 0
    for span in spans:
        out.append(body[done : places[span["start"]][0]])
        done = places[span["end"] - 1][1]
    out.append(body[done:])
    return b" ".join(out).decode()
