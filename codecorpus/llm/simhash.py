"""SimHash near-dedup with covering locality-sensitive hashing.

Every pair of fingerprints within the radius is found for certain: each bit gets a non-zero vector
of radius + 1 bits, and each non-zero vector v makes a mask of the bits whose vector has odd parity
with v.  Radius vectors never span a space of one dimension more, so for the bits in which two
fingerprints differ there is a v orthogonal to all of them, and in its table the two collide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.session import stored

SHINGLE = 3
RADIUS = 2
BITS = 64
#: Fingerprints of one bucket compared in one go; larger buckets get a second set of masks.
BUCKET = 4096
SEED = 42

#: Lower-cases A-Z and leaves all other bytes alone.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is 1 if it is set in over half the hashes of the word shingles.

    Shorter texts are one shingle of all their words; a text without words has fingerprint zero.
    """
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[k:] for k in range(shingle)]))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row; a null text has no words."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(body.as_py(), shingle) for body in batch.column(1)]
            signed = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(signed)], names=["doc_id", "fingerprint"]
            )

    source = docs.select(F.col(doc_id), F.col(text).cast("binary"))
    return source.mapInArrow(hashed, f"doc_id {id_type}, fingerprint long")


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """Masks over some bits such that any ``radius`` of them miss one mask together."""
    vectors = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, vectors + 1):
        chosen = [b for i, b in enumerate(bits) if ((i % vectors + 1) & v).bit_count() % 2]
        masks.append(sum(1 << b for b in chosen))
    return masks


def mask_tables(radius: int, level: int) -> list[int]:
    """All masks of a level: those of the first, or the first joined with masks of the bits left."""
    tables = [0]
    for _ in range(level):
        tables = [
            base | mask
            for base in tables
            for mask in covering_masks([b for b in range(BITS) if not base >> b & 1], radius)
        ]
    return tables


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def bucketed(prints: DataFrame, masks: list[int]) -> DataFrame:
    """Rows (fp, table, key): each fingerprint in the bucket of every table."""
    tables = F.array(
        *[
            F.struct(F.lit(n).alias("table"), F.col("fp").bitwiseAND(_signed(mask)).alias("key"))
            for n, mask in enumerate(masks)
        ]
    )
    return prints.select("fp", F.inline(tables))


def find_links(rows: DataFrame, radius: int, bucket: int | None) -> DataFrame:
    """Links inside buckets: (fp, other), and (fp, null) for members of buckets above the bound.

    The links of a bucket join each member to the smallest member that it reaches inside the bucket,
    so a bucket of m fingerprints gives fewer than m links however many pairs are near.  Rows come
    sorted by bucket; at most one bucket of bounded size is in memory.
    """

    def near(fp: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        label = np.arange(len(fp))
        left, right = [], []
        step, at = 1, np.arange(len(fp))
        while True:
            at = at[at + step < len(fp)]
            at = at[group[at] == group[at + step]]
            if not len(at):
                break
            hit = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= radius]
            left.append(hit)
            right.append(hit + step)
            step += 1
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            while True:
                before = label.copy()
                np.minimum.at(label, b, label[a])
                np.minimum.at(label, a, label[b])
                label = label[label]
                if (label == before).all():
                    break
        moved = np.flatnonzero(label != np.arange(len(fp)))
        return fp[moved], fp[label[moved]]

    def rows_of(fp: np.ndarray, other: np.ndarray | None) -> pa.RecordBatch:
        ends = pa.nulls(len(fp), pa.int64()) if other is None else pa.array(other.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), ends], names=["fp", "other"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)]
        too_large: tuple | None = None
        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            new[0] = new[0].view(np.uint64)
            fp, table, key = (np.concatenate(pair) for pair in zip(held, new))
            change = np.flatnonzero((np.diff(table) != 0) | (np.diff(key) != 0)) + 1
            if too_large and len(fp):
                end = change[0] if len(change) else len(fp)
                if (table[0], key[0]) == too_large:
                    yield rows_of(fp[:end], None)
                    fp, table, key = fp[end:], table[end:], key[end:]
                    change = change[change > end] - end
                if len(fp):
                    too_large = None
            last = change[-1] if len(change) else 0
            group = np.zeros(last, np.int64)
            group[change[:-1]] = 1
            yield from done(fp[:last], np.cumsum(group))
            held = [fp[last:], table[last:], key[last:]]
            if bucket is not None and len(held[0]) > bucket:
                too_large = (held[1][0], held[2][0])
                yield rows_of(held[0], None)
                held = [x[:0] for x in held]
        yield from done(held[0], np.zeros(len(held[0]), np.int64))

    def done(fp: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(fp):
            return
        if bucket is not None:
            sizes = np.bincount(group)
            large = sizes[group] > bucket
            if large.any():
                yield rows_of(fp[large], None)
                fp, group = fp[~large], group[~large]
        a, b = near(fp, group)
        if len(a):
            yield rows_of(a, b)

    placed = rows.select("fp", "table", "key").repartition("table", "key")
    ordered = placed.sortWithinPartitions("table", "key", "fp")
    return ordered.mapInArrow(link, "fp long, other long")


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (fp, other) whose closure joins all distinct fingerprints within the radius.

    Members of a bucket above the bound go on to tables that also mask the bits left free.  After
    two levels so few bits are free that distinct fingerprints cannot exceed the bound (with radius
    2: 12 bits, 4096 fingerprints), so nothing is left out.
    """
    levels = 1
    while max(BITS - mask.bit_count() for mask in mask_tables(radius, levels)) > 12:
        levels += 1
    links, members = None, prints
    for level in range(1, levels + 1):
        bound = BUCKET if level < levels else None
        found = stored(find_links(bucketed(members, mask_tables(radius, level)), radius, bound))
        new = found.where(F.col("other").isNotNull())
        links = new if links is None else links.union(new)
        members = found.where(F.col("other").isNull()).select("fp").distinct()
        if bound is None or members.isEmpty():
            break
    return links.distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every linked node; the root is the smallest node of its component.

    Large-star and small-star rounds until nothing changes.  A node with very many links is
    pre-aggregated for its minimum and joined by shuffle, where Spark splits it.  Each round is
    written to the shared folder, so a lost executor costs one round at most.
    """
    edges = stored(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct()
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("v", "m").union(small.select(F.col("u").alias("v"), "m"))
        edges = stored(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = (row[0], row[1])
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """Per row: doc_id, fingerprint (signed long), component_id.

    Fingerprints at ``radius`` or fewer differing bits are linked; ``component_id`` is the smallest
    doc_id reachable by links, the row's own included (a null doc_id counts only if there is no
    other).  Equal fingerprints are one node, so thousands of copies cost one node.  Texts without
    words share fingerprint zero; repeated rows get the same answer; an empty table gives an empty
    table.
    """
    rows = stored(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle))
    nodes = rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("_first"))
    nodes = stored(nodes)
    roots = components(near_links(nodes.select("fp"), radius), "fp", "other")
    members = nodes.join(roots, nodes["fp"] == roots["node"], "left")
    members = members.select("fp", "_first", F.coalesce("root", "fp").alias("_root"))
    smallest = members.groupBy("_root").agg(F.min("_first").alias("component_id"))
    answer = members.join(smallest, "_root").select("fp", "component_id")
    return rows.join(answer, rows["fingerprint"] == answer["fp"]).select(
        "doc_id", "fingerprint", "component_id"
    )
