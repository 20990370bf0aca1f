"""Suffix-array dedup over bytes: a distributed merge sort that knows common prefixes.

Only suffixes that start at the windows of recurring anchors (see ``anchors``) take part, cut where
those windows end.  Each task sorts its suffixes into runs, keeps the first of equal ones, and writes
the runs front-coded: of each suffix only what differs from the one before.  A sample of the runs
gives splitters; every run is cut at them, and the task of a range merges its pieces with a loser
tree that remembers common prefixes and never compares them again.  Equal suffixes meet in the merge,
and all but the earliest are repeats.

A suffix stands for a range of windows around one anchor.  If two suffixes of the same anchor
differ, some of their windows may still be equal: these few go round again in blocks of
``BLOCK_WINDOWS`` windows at the same distance from the anchor, and what still differs in single
windows, which settles every one of them byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.llm.anchors import (
    BYTE_BASE,
    Block,
    Powers,
    anchor_places,
    ends_of,
    letters,
    mixed,
    range_hashes,
    row_key,
    singles,
    slices,
)
from codecorpus.llm.phrases import flat, spans_of
from codecorpus.session import stored

WINDOW = 100
#: Bytes of an anchor: long enough that few recur by chance, which no corpus size changes much.
GRAM = 40
BLOCK_WINDOWS = 8
#: Bytes of suffixes sorted into one run.
RUN_BYTES = 16_000_000
#: Bytes of suffixes merged in one group, pieces that a run is cut into at a time, bytes of suffixes
#: for which one is put into the sample, and repeats found by a run that travel in one row.
PART_BYTES = 16_000_000
FAN_OUT = 256
SAMPLE_BYTES = 64_000
LATE_ROWS = 50_000


def byte_grams(block: Block, powers: Powers) -> np.ndarray:
    n = len(block.bytes)
    starts = np.arange(n)
    return range_hashes(letters(block), starts, np.minimum(starts + GRAM, n), powers)


def find_anchors(rows: DataFrame, window: int) -> DataFrame:
    """h, key, place of the anchors; ``rows`` has _key and _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(BYTE_BASE)
        for batch in slices(batches, 1):
            block = Block(batch.column(1))
            grams = byte_grams(block, powers)
            places = anchor_places(grams, ends_of(block.bounds), window, GRAM)
            text = np.searchsorted(block.bounds, places, side="right") - 1
            key = batch.column(0).to_numpy(zero_copy_only=False)[text]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(grams[places].view(np.int64)), pa.array(key),
                    pa.array(places - block.bounds[text]),
                ],
                names=["h", "key", "place"],
            )

    return rows.select("_key", "_text").mapInArrow(run, "h long, key long, place long")


def anchor_ranges(block: Block, single: pa.Array, window: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """For each anchor that recurs: its hash, place, and the first and last window that it anchors.

    The anchor of a window is its leftmost smallest gram, so the windows of one anchor are
    consecutive.  All places count from the start of the block.
    """
    grams = byte_grams(block, powers)
    ends = ends_of(block.bounds)
    places = anchor_places(grams, ends, window, GRAM)
    values, row = flat(single)
    recurring = np.setdiff1d(places, values + block.bounds[row], assume_unique=True)
    if not len(recurring):
        return tuple(np.empty(0, np.int64) for _ in range(4))
    width = window - GRAM + 1
    change = np.zeros(len(grams) + 1, np.int64)
    np.add.at(change, np.maximum(recurring - width + 1, 0), 1)
    np.add.at(change, recurring + 1, -1)
    starts = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    starts = starts[starts + window <= ends[starts]]
    # Each window looks through the anchors inside it for the smallest, from the left.
    small = grams[places] | np.uint64(1)
    best = np.searchsorted(places, starts)
    look = best.copy()
    open_ = np.arange(len(starts))
    while True:
        look[open_] += 1
        inside = look[open_] < len(places)
        open_ = open_[inside]
        open_ = open_[places[look[open_]] <= starts[open_] + width - 1]
        if not len(open_):
            break
        better = small[look[open_]] < small[best[open_]]
        best[open_[better]] = look[open_[better]]
    owner = places[best]
    mine = np.isin(owner, recurring, assume_unique=False)
    starts, owner = starts[mine], owner[mine]
    edge = np.flatnonzero(np.diff(owner)) + 1
    low = np.concatenate(([0], edge)) if len(owner) else edge
    high = np.concatenate((edge, [len(owner)])) - 1 if len(owner) else edge
    return grams[owner[low]].view(np.int64), owner[low], starts[low], starts[high]


class RunWriter:
    """Collects suffixes as rows of one byte matrix and yields them as sorted, front-coded runs.

    A row of the matrix is a suffix padded with zeros, then its length in two bytes, so rows compare
    as the suffixes do.  A full matrix is sorted; the first of equal suffixes stays, the others are
    settled.  These go out in rows of their own, each with a part below 0, and enter no exchange.

    ``numbers`` are seven rows of 64-bit numbers: h, key, place, start and n of each suffix, the
    length of its common prefix with the one before, and that of its rest.
    """

    def __init__(self, id_type: pa.DataType, window: int, width: int):
        self.id_type, self.window, self.width = id_type, window, width
        self.late: list[np.ndarray] = []
        self._clear()

    def _clear(self) -> None:
        self.texts: list[tuple] = []
        self.matrix = np.empty((0, self.width + 2), np.uint8)
        self.numbers = np.empty((6, 0), np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, data: np.ndarray, low: np.ndarray, numbers: np.ndarray, texts: list[tuple]) -> None:
        """Suffixes of ``data`` from ``low``; numbers: h, key, place, start, n, and which of texts.

        A text is (id is null, id, key), which is the order of texts.
        """
        rows = np.lib.stride_tricks.sliding_window_view(
            np.concatenate((data, np.zeros(self.width + 2, np.uint8))), self.width + 2
        )[low]
        sizes = numbers[4] + self.window - 1
        rows[np.arange(self.width + 2) >= sizes[:, None]] = 0
        rows[:, -2], rows[:, -1] = sizes >> 8, sizes & 255
        numbers = numbers.copy()
        numbers[5] += len(self.texts)
        self.texts += texts
        self.waiting.append((rows, numbers))
        self.n_waiting += rows.size

    def settle(self) -> None:
        """Sorts what is there and keeps the first of equal suffixes."""
        if not self.waiting:
            return
        rows = np.concatenate([self.matrix] + [rows for rows, _ in self.waiting])
        numbers = np.concatenate([self.numbers] + [more for _, more in self.waiting], axis=1)
        self.waiting, self.n_waiting = [], 0
        rank_of = {text: rank for rank, text in enumerate(sorted(set(self.texts)))}
        rank = np.array([rank_of[text] for text in self.texts], np.int64)[numbers[5]]
        order = np.lexsort((numbers[3], rank))
        order = order[np.argsort(rows[order].view(f"S{rows.shape[1]}").ravel(), kind="stable")]
        rows, numbers, rank = rows[order], numbers[:, order], rank[order]
        same = np.zeros(len(rows), bool)
        same[1:] = (rows[1:] == rows[:-1]).all(axis=1)
        repeated = same.copy()  # a row that repeats id and text is the same text
        repeated[1:] &= (rank[1:] == rank[:-1]) & (numbers[3, 1:] == numbers[3, :-1])
        if (same & ~repeated).any():
            self.late.append(numbers[[1, 3, 4]][:, same & ~repeated])
        self.matrix, self.numbers = rows[~same], numbers[:, ~same]

    def full(self) -> bool:
        """Whether a run is due; settles a full matrix first, which may make room again."""
        if self.n_waiting >= RUN_BYTES:
            self.settle()
        return self.matrix.size >= RUN_BYTES or sum(x.shape[1] for x in self.late) > 500_000

    def run(self) -> pa.RecordBatch | None:
        self.settle()
        rows = [run_row(0, *self._coded())] if len(self.matrix) else []
        if self.late:
            rows += late_parts(np.concatenate(self.late, axis=1))
        self.late = []
        self._clear()
        return run_batch(rows, self.id_type) if rows else None

    def _coded(self) -> tuple:
        plain, numbers = self.matrix[:, :-2], self.numbers
        sizes = numbers[4] + self.window - 1
        common = np.zeros(len(plain), np.int64)
        differ = plain[1:] != plain[:-1]
        common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), self.width)
        common[1:] = np.minimum(common[1:], np.minimum(sizes[1:], sizes[:-1]))
        at = np.arange(self.width)
        rest = plain[(at >= common[:, None]) & (at < sizes[:, None])].tobytes()
        every = max(1, SAMPLE_BYTES // (self.width + 2))
        sample = [
            plain[i, : sizes[i]].tobytes() for i in range(min(every, len(plain)) // 2, len(plain), every)
        ]
        docs = [self.texts[t][1] for t in numbers[5].tolist()]
        return docs, np.concatenate((numbers[:5], [common], [sizes - common])), rest, sample


RUN_NAMES = ("part", "bytes", "doc", "numbers", "rest", "sample", "late_key", "late_start", "late_n")


def run_row(part: int, docs: list, numbers: np.ndarray, rest: bytes, sample: list[bytes]) -> tuple:
    """One front-coded run, with the bytes that its suffixes have."""
    n_bytes = int(numbers[5].sum() + numbers[6].sum())
    coded = packed(np.ascontiguousarray(numbers, np.int64).tobytes())
    return part, n_bytes, docs, coded, packed(rest), sample, [], [], []


def late_parts(late: np.ndarray) -> list[tuple]:
    """Rows of known repeats (key, start, n), at most ``LATE_ROWS`` in each."""
    rows = []
    for at in range(0, late.shape[1], LATE_ROWS):
        some = late[:, at : at + LATE_ROWS]
        digest = hashlib.blake2b(some[:, [0, -1]].tobytes() + bytes([at % 251]), digest_size=7).digest()
        rows.append((-1 - int.from_bytes(digest), 0, None, None, None, None, *some.tolist()))
    return rows


def run_batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    long, longs = pa.int64(), pa.list_(pa.int64())
    types = [
        long, long, pa.list_(id_type), pa.binary(), pa.binary(), pa.list_(pa.binary()), longs, longs, longs,
    ]
    columns = [pa.array([row[k] for row in rows], t) for k, t in enumerate(types)]
    return pa.RecordBatch.from_arrays(columns, names=list(RUN_NAMES))


def packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that agree on the first ``known`` bytes."""
    n = min(len(a), len(b))
    at = known
    while at < n and a[at : at + 16] == b[at : at + 16]:
        at += 16
    if at >= n:
        return n
    while at < n and a[at] == b[at]:
        at += 1
    return at


class FrontCoded:
    """Reads a run: the current suffix, and what it has in common with the one before."""

    def __init__(self, common: list[int], sizes: list[int], rest: bytes):
        self.common, self.sizes, self.rest = common, sizes, rest
        self.at, self.place, self.suffix = -1, 0, b""

    def next(self) -> int:
        """Goes to the next suffix and returns the common prefix, or -1 at the end."""
        self.at += 1
        if self.at == len(self.common):
            return -1
        shared, size = self.common[self.at], self.sizes[self.at]
        self.suffix = self.suffix[:shared] + self.rest[self.place : self.place + size]
        self.place += size
        return shared


class LoserTree:
    """Merges runs.  A loser keeps what it has in common with the suffix that beat it.

    Both sides of a match are at least as large as the last suffix that went out, and know what they
    have in common with it.  Whoever has more in common is smaller, without a look at the bytes; only
    on a tie are bytes compared, from there on.
    """

    def __init__(self, runs: list[FrontCoded]):
        self.runs = runs
        self.leaves = 1
        while self.leaves < len(runs):
            self.leaves *= 2
        self.common = [run.next() for run in runs] + [-1] * (self.leaves - len(runs))
        self.loser = [0] * self.leaves
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.leaves:
            return node - self.leaves
        a, b = self._build(2 * node), self._build(2 * node + 1)
        won, self.loser[node] = self._match(a, b)
        return won

    def _match(self, a: int, b: int) -> tuple[int, int]:
        common = self.common
        if common[a] != common[b]:
            return (a, b) if common[a] > common[b] else (b, a)
        if common[a] < 0:
            return a, b
        x, y = self.runs[a].suffix, self.runs[b].suffix
        shared = common_prefix(x, y, common[a])
        # The end of a suffix counts as smaller than any byte.
        if shared == len(x) or (shared < len(y) and x[shared] < y[shared]):
            common[b] = shared
            return a, b
        common[a] = shared
        return b, a

    def merge(self) -> Iterator[tuple[int, int, int]]:
        """(run, place in the run, what the suffix has in common with the one before)."""
        while self.common[self.winner] >= 0:
            at = self.winner
            yield at, self.runs[at].at, self.common[at]
            self.common[at] = self.runs[at].next()
            node = (at + self.leaves) // 2
            while node:
                at, self.loser[node] = self._match(at, self.loser[node])
                node //= 2
            self.winner = at


def read_run(numbers: bytes, rest: bytes) -> tuple[np.ndarray, FrontCoded]:
    table = np.frombuffer(unpacked(numbers), np.int64).reshape(7, -1)
    return table, FrontCoded(table[5].tolist(), table[6].tolist(), unpacked(rest))


def cut_run(row: dict, fan: int) -> list[tuple]:
    """A run cut at the splitters of its range: the piece between two of them is a run of its own."""
    table, reader = read_run(row["numbers"], row["rest"])
    splitters, edges, heads, starts = row["splitters"] or [], [], [], []
    at = -1  # the range of the last suffix
    while reader.next() >= 0:
        now = max(at, 0)
        while now < len(splitters) and reader.suffix >= splitters[now]:
            now += 1
        if now != at:
            at = now
            edges.append((at, reader.at))
            heads.append(reader.suffix)
            starts.append(reader.place)
    out = []
    stops = [first for _, first in edges[1:]] + [table.shape[1]]
    ends = [place - int(table[6, first]) for place, (_, first) in zip(starts[1:], edges[1:])]
    ends.append(len(reader.rest))
    for (part, first), stop, head, start, end in zip(edges, stops, heads, starts, ends):
        piece = table[:, first:stop].copy()
        piece[5, 0], piece[6, 0] = 0, len(head)
        rest = head + reader.rest[start:end]
        out.append(run_row(row["part"] * fan + part, row["doc"][first:stop], piece, rest, []))
    return out


def merge(table: pa.Table) -> tuple[np.ndarray, list, np.ndarray, list[bytes], np.ndarray]:
    """Merges the runs of one range: numbers, ids, common prefixes and rests of the distinct
    suffixes in order, each with its earliest place, and the late ones (key, start, n)."""
    docs, tables, runs = [], [], []
    for one in table.select(["doc", "numbers", "rest"]).to_pylist():
        numbers, run = read_run(one["numbers"], one["rest"])
        docs += one["doc"]
        tables.append(numbers)
        runs.append(run)
    offsets = np.cumsum([0] + [t.shape[1] for t in tables]).tolist()
    places, common, rests, group = [], [], [], []
    length, n = -1, -1
    for run, i, shared in LoserTree(runs).merge():
        suffix = runs[run].suffix
        if not shared == len(suffix) == length or n < 0:
            n += 1
            length = len(suffix)
            common.append(shared)
            rests.append(suffix[shared:])
        places.append(offsets[run] + i)
        group.append(n)
    places, group = np.array(places, np.int64), np.array(group, np.int64)
    numbers = np.concatenate(tables, axis=1)[:5, places]
    # Only where suffixes are equal does it matter which text comes first.
    rank = np.zeros(len(places), np.int64)
    several = np.flatnonzero(np.bincount(group)[group] > 1) if len(group) else group
    texts = [
        (docs[p] is None, docs[p], key)
        for p, key in zip(places[several].tolist(), numbers[1, several].tolist())
    ]
    rank_of = {text: k for k, text in enumerate(sorted(set(texts)))}
    rank[several] = [rank_of[text] for text in texts]
    order = np.lexsort((numbers[3], rank, group))
    places, group, rank, numbers = places[order], group[order], rank[order], numbers[:, order]
    first = np.ones(len(group), bool)
    first[1:] = group[1:] != group[:-1]
    late = ~first
    late[1:] &= (rank[1:] != rank[:-1]) | (numbers[3, 1:] != numbers[3, :-1])
    kept = [docs[p] for p in places[first].tolist()]
    return numbers[:, first], kept, np.array(common, np.int64), rests, numbers[[1, 3, 4]][:, late]


def merge_runs(table: pa.Table) -> pa.Table:
    """The runs of one range as one run, with rows of the repeats that it met."""
    part = table.column("part")[0].as_py()
    numbers, docs, common, rests, late = merge(table)
    sizes = np.array([len(rest) for rest in rests], np.int64)
    # The first of every so many suffixes is a sample of the run.
    every = max(1, SAMPLE_BYTES * len(rests) // max(1, int(common.sum() + sizes.sum())))
    sample, suffix = [], b""
    for i, rest in enumerate(rests):
        suffix = suffix[: common[i]] + rest
        if i % every == every // 2:
            sample.append(suffix)
    row = run_row(part, docs, np.concatenate((numbers, [common], [sizes])), b"".join(rests), sample)
    id_type = table.schema.field("doc").type.value_type
    return pa.Table.from_batches([run_batch([row, *late_parts(late)], id_type)])


def merge_last(table: pa.Table) -> pa.Table:
    """Repeats of one range (late true) and the earliest place of each distinct suffix."""
    numbers, _, _, _, late = merge(table)
    n_late, n_first = late.shape[1], numbers.shape[1]
    h = pa.concat_arrays([pa.nulls(n_late, pa.int64()), pa.array(numbers[0])])
    place = pa.concat_arrays([pa.nulls(n_late, pa.int64()), pa.array(numbers[2])])
    rest = [pa.array(np.concatenate((late[k], numbers[j]))) for k, j in enumerate((1, 3, 4))]
    is_late = pa.array(np.repeat([True, False], [n_late, n_first]))
    return pa.table(
        [is_late, h, rest[0], place, rest[1], rest[2]],
        names=["late", "h", "key", "place", "start", "n"],
    )


MERGED = "late boolean, h long, key long, place long, start long, n long"
RANGES = "array<struct<place:long,start:long,n:long>>"


def splitters_of(runs: DataFrame, fan: int) -> DataFrame:
    """Per range (``part``) at most ``fan`` - 1 suffixes that cut it into about equal pieces.

    They are chosen from a sample of bounded size, the suffixes with the smallest hashes.
    """
    sample = runs.select("part", F.explode("sample").alias("s"))
    smallest = Window.partitionBy("part").orderBy(F.xxhash64("s"), "s")
    sample = sample.withColumn("k", F.row_number().over(smallest)).where(F.col("k") <= 64 * fan)
    chosen = sample.groupBy("part").agg(F.sort_array(F.collect_list("s")).alias("s"))
    size = F.size("s")
    at = F.transform(
        F.sequence(F.lit(1), F.lit(fan - 1)), lambda k: F.get(F.col("s"), F.floor(k * size / fan).cast("int"))
    )
    return chosen.select(F.col("part").alias("of"), F.array_distinct(at).alias("splitters"))


def exchanged(runs: DataFrame, schema: str) -> DataFrame:
    """Sorted runs merged over the corpus: late, h, key, place, start, n; ``runs`` is stored.

    Runs are cut by ranges of suffixes and the pieces of a range merged.  A run is cut into at most
    ``FAN_OUT`` pieces at a time.  If ranges must be smaller, pieces of up to ``FAN_OUT`` runs are
    merged into new runs, which are cut again.  So the number of pieces is in proportion to the runs.
    """
    late = []
    while True:
        late.append(
            runs.where("part < 0")
            .select(F.explode(F.arrays_zip("late_key", "late_start", "late_n")).alias("x"))
            .selectExpr(
                "true as late", "cast(null as long) as h", "x.late_key as key",
                "cast(null as long) as place", "x.late_start as start", "x.late_n as n",
            )
        )
        open_ = runs.where("part >= 0")
        largest = open_.groupBy("part").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        n_bytes, n_runs = largest.agg(F.max("bytes"), F.max("n")).first()
        fan = min(FAN_OUT, -(-(n_bytes or 0) // PART_BYTES))
        last = (n_bytes or 0) <= FAN_OUT * PART_BYTES or n_runs <= FAN_OUT
        if fan > 1:
            cuts = stored(splitters_of(open_, fan))
            open_ = open_.drop("sample").join(cuts, open_["part"] == cuts["of"], "left").drop("of")

            def cut(batches: Iterator[pa.RecordBatch], fan: int = fan) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    id_type = batch.schema.field("doc").type.value_type
                    for k in range(batch.num_rows):
                        yield run_batch(cut_run(batch.slice(k, 1).to_pylist()[0], fan), id_type)

            open_ = open_.mapInArrow(cut, schema)
        if last:
            merged = open_.groupBy("part").applyInArrow(merge_last, MERGED)
            for more in late:
                merged = merged.union(more)
            return merged
        slot = F.pmod(F.xxhash64("numbers"), F.lit(-(-n_runs // FAN_OUT)))
        groups = open_.withColumn("slot", slot).groupBy("part", "slot")
        runs = stored(groups.applyInArrow(merge_runs, schema))


def sorted_and_merged(rows: DataFrame, cut, window: int, id_type: str, width: int) -> DataFrame:
    """Which suffixes are repeats: late, h, key, place, start, n.

    ``rows`` has _key, _text, what ``cut`` needs, and _id.  ``cut`` gives for a block of texts the
    hash, anchor place, first window and last window of each suffix, of at most ``width`` bytes.
    Every repeat is a late row; of each distinct suffix the earliest is one row that is not late.
    """
    schema = (
        f"part long, bytes long, doc array<{id_type}>, numbers binary, rest binary, sample array<binary>, "
        "late_key array<long>, late_start array<long>, late_n array<long>"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, powers = None, Powers(BYTE_BASE)
        for batch in slices(batches, 1):
            if writer is None:
                writer = RunWriter(batch.column(3).type, window, width)
            block = Block(batch.column(1))
            if not len(block.bytes):
                continue
            h, place, low, high = cut(block, batch.column(2), powers)
            text = np.searchsorted(block.bounds, low, side="right") - 1
            offset = block.bounds[text]
            keys, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(3).to_pylist()
            texts = list(zip([one is None for one in ids], ids, keys.tolist()))
            numbers = np.stack((h, keys[text], place - offset, low - offset, high - low + 1, text))
            step = max(1, RUN_BYTES // width)
            for a in range(0, len(h), step):
                some = slice(a, a + step)
                used, which = np.unique(text[some], return_inverse=True)
                part = numbers[:, some].copy()
                part[5] = which
                writer.add(block.bytes, low[some], part, [texts[t] for t in used.tolist()])
                if writer.full():
                    yield writer.run()
        if writer is not None:
            run = writer.run()
            if run is not None:
                yield run

    return exchanged(stored(rows.mapInArrow(write, schema)), schema)


def still_open(merged: DataFrame) -> DataFrame:
    """key and ranges of the suffixes that differ from another with the same hash."""
    first = merged.where(~F.col("late"))
    several = first.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    found = first.join(several, "h")
    return found.groupBy(F.col("key").alias("_open_key")).agg(
        F.collect_list(F.struct("place", "start", "n")).alias("_ranges")
    )


def ranges_of(block: Block, column: pa.Array) -> tuple[np.ndarray, ...]:
    """Anchor place, first window and number of windows of listed ranges, counted from the block."""
    sizes = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    offset = np.repeat(block.bounds[:-1], sizes.astype(np.int64))
    values = column.flatten()
    place, start, n = (
        values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)
    )
    return place + offset, start + offset, n


def cut_blocks(window: int, width: int):
    """Cuts ranges into blocks of ``width`` windows at the same distances from the anchor.

    The hash is that of the bytes which all windows of a whole block share, so blocks with another
    hash have no window in common.
    """

    def cut(block: Block, column: pa.Array, powers: Powers) -> tuple[np.ndarray, ...]:
        place, start, n = ranges_of(block, column)
        which = np.repeat(np.arange(len(n)), n)
        at = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        number = (place[which] - at) // width
        edge = np.flatnonzero((np.diff(which) != 0) | (np.diff(number) != 0)) + 1
        low = np.concatenate(([0], edge)) if len(which) else edge
        high = np.concatenate((edge, [len(which)])) - 1 if len(which) else edge
        anchor, number = place[which[low]], number[low]
        core = anchor - number * width
        sums = range_hashes(letters(block), core, core + window - width + 1, powers)
        h = mixed(sums + number.astype(np.uint64)).view(np.int64)
        return h, anchor, at[low], at[high]

    return cut


def repeated_bytes(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """Per row: doc_id, n_bytes, spans (array of start and end in bytes), kept (binary).

    A byte goes if a string of ``window`` bytes that covers it starts earlier: in a text with a
    smaller doc_id (null is larger than all; equal ids go by a digest of the text), or earlier in
    the same text.  Strings are judged on the input and do not cross texts; overlaps count.
    ``kept`` are the other bytes, which need not be valid UTF-8.  Rows that repeat doc_id and text
    are one text and are answered alike.  A null text has no bytes; an empty table gives an empty
    table.  A text of any length is worked on as a whole in one task.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(
        F.col(doc_id).alias("_id"), F.col(text).cast("binary").alias("_text"),
        row_key(doc_id, text).alias("_key"),
    )
    once = stored(singles(find_anchors(rows, window)))
    joined = rows.join(once.hint("shuffle_hash"), rows["_key"] == once["key"], "left")

    def cut_anchors(block: Block, single: pa.Array, powers: Powers) -> tuple[np.ndarray, ...]:
        return anchor_ranges(block, single, window, powers)

    chosen = joined.select("_key", "_text", "single", "_id")
    # The windows of an anchor all hold it, so they end at most so far apart.
    merged = stored(sorted_and_merged(chosen, cut_anchors, window, id_type, 2 * window - GRAM))
    late = [merged.where("late")]
    for width in (BLOCK_WINDOWS, 1):
        again = still_open(merged)
        chosen = rows.join(again.hint("shuffle_hash"), rows["_key"] == again["_open_key"])
        chosen = chosen.select("_key", "_text", "_ranges", "_id")
        cut = cut_blocks(window, width)
        merged = stored(sorted_and_merged(chosen, cut, window, id_type, window + width - 1))
        late.append(merged.where("late"))
    found = late[0]
    for more in late[1:]:
        found = found.union(more)
    gone = found.groupBy(F.col("key").alias("_gone_key")).agg(
        F.collect_list(F.struct("start", "n")).alias("_gone")
    )
    joined = rows.join(gone.hint("shuffle_hash"), rows["_key"] == gone["_gone_key"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            spans, kept, sizes = [], [], []
            n_ranges = pa.compute.list_value_length(batch.column(1)).fill_null(0)
            cuts = np.cumsum([0, *n_ranges.to_pylist()]).tolist()
            values = batch.column(1).flatten()
            start, n = (values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            stop = start + n + window - 1
            for body, low, high in zip(batch.column(0), cuts, cuts[1:]):
                data = body.as_py() or b""
                sizes.append(len(data))
                change = np.zeros(len(data) + 1, np.int64)
                np.add.at(change, start[low:high], 1)
                np.add.at(change, stop[low:high], -1)
                first, end = spans_of(np.cumsum(change[:-1]) > 0)
                spans.append([{"start": s, "end": e} for s, e in zip(first.tolist(), end.tolist())])
                edges = [0, *np.stack((first, end), 1).ravel().tolist(), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(2), pa.array(sizes, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    return joined.select("_text", "_gone", "_id").mapInArrow(
        run, f"doc_id {id_type}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    )
