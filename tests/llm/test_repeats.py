"""Substring dedup over words and over bytes, and anchors, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codecorpus.llm import anchors, phrases, suffixes


def brute_words(docs, window):
    split = {key: (text or "").split() for key, text in docs}
    counts = {}
    for words in split.values():
        for s in range(len(words) - window + 1):
            gram = tuple(words[s : s + window])
            counts[gram] = counts.get(gram, 0) + 1
    out = {}
    for key, words in split.items():
        gone = set()
        for s in range(len(words) - window + 1):
            if counts[tuple(words[s : s + window])] > 1:
                gone.update(range(s, s + window))
        out[key] = (len(words), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


def brute_bytes(docs, window):
    seen, out = set(), {}
    for key, text in sorted(docs):
        data = (text or "").encode()
        gone = set()
        for s in range(len(data) - window + 1):
            gram = data[s : s + window]
            if gram in seen:
                gone.update(range(s, s + window))
            seen.add(gram)
        out[key] = (len(data), bytes(b for i, b in enumerate(data) if i not in gone))
    return out


@pytest.mark.parametrize("partitions", [1, 5])
def test_words_against_brute_force(table, corpus, partitions):
    docs = table(corpus, "doc_id long, text string", partitions)
    got = {r.doc_id: (r.n_words, r.kept_text) for r in phrases.repeated_phrases(docs).collect()}
    assert got == brute_words(corpus, 35)


@pytest.mark.parametrize("partitions", [1, 5])
def test_bytes_against_brute_force(table, corpus, partitions):
    docs = table(corpus, "doc_id long, text string", partitions)
    rows = suffixes.repeated_bytes(docs).collect()
    got = {r.doc_id: (r.n_bytes, bytes(r.kept)) for r in rows}
    assert got == brute_bytes(corpus, 100)
    for row in rows:
        assert sum(s.end - s.start for s in row.spans) == row.n_bytes - len(row.kept)


def test_small_runs_are_merged(table, corpus, monkeypatch):
    monkeypatch.setattr(suffixes, "RUN_BYTES", 2000)
    monkeypatch.setattr(anchors, "BLOCK_BYTES", 500)
    docs = table(corpus, "doc_id long, text string", 4)
    got = {r.doc_id: (r.n_bytes, bytes(r.kept)) for r in suffixes.repeated_bytes(docs).collect()}
    assert got == brute_bytes(corpus, 100)


def test_known_repeats_do_not_meet_in_one_group(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffixes, "LATE_ROWS", 10)
    writer = suffixes.RunWriter(pa.int64(), 9, 10)
    data = np.frombuffer(b"".join(b"suffix %02d" % k for k in range(50)), np.uint8)
    for copy in range(3):
        low = np.arange(50) * 9
        one = np.full(50, 1)
        numbers = np.stack((one, one * copy, np.arange(50), np.arange(50), one, one * 0))
        writer.add(data, low, numbers, [(False, copy, copy)])
    table = pa.Table.from_batches([writer.run()])
    parts, late = table.column("part").to_pylist(), table.column("late_key").to_pylist()
    assert sum(map(len, late)) == 100 and max(map(len, late)) <= 10
    assert all(part < 0 or not n for part, n in zip(parts, late))
    found = [
        (key, start)
        for row in table.to_pylist()
        for key, start in zip(row["late_key"], row["late_start"])
    ]
    assert sorted(found) == [(c, k) for c in (1, 2) for k in range(50)]
    out = suffixes.merge_last(table.filter(pa.compute.greater_equal(table.column("part"), 0))).to_pylist()
    assert sorted((r["key"], r["start"]) for r in out) == [(0, k) for k in range(50)]
    assert not any(r["late"] for r in out)


@pytest.mark.parametrize("fan_out", [64, 2])
def test_pieces_of_runs_are_in_proportion_to_the_runs(table, corpus, monkeypatch, fan_out):
    monkeypatch.setattr(suffixes, "PART_BYTES", 300)
    monkeypatch.setattr(suffixes, "RUN_BYTES", 4000)
    monkeypatch.setattr(suffixes, "SAMPLE_BYTES", 400)
    monkeypatch.setattr(anchors, "BLOCK_BYTES", 500)
    monkeypatch.setattr(suffixes, "FAN_OUT", fan_out)
    fans = []
    inner = suffixes.splitters_of

    def watched(runs, fan):
        fans.append(fan)
        return inner(runs, fan)

    monkeypatch.setattr(suffixes, "splitters_of", watched)
    docs = table(corpus, "doc_id long, text string", 3)
    got = {r.doc_id: (r.n_bytes, bytes(r.kept)) for r in suffixes.repeated_bytes(docs).collect()}
    assert got == brute_bytes(corpus, 100)
    assert fans and max(fans) <= fan_out


def test_runs_are_cut_into_whole_pieces():
    import pyarrow as pa

    rng = random.Random(8)
    text = bytes(rng.choices(b"ab\x00", k=400))
    data = np.frombuffer(text, np.uint8)
    writer = suffixes.RunWriter(pa.int64(), 5, 9)
    low = np.arange(380)
    n = 1 + low % 5
    one = np.ones(380, np.int64)
    writer.add(data, low, np.stack((one, one, low, low, n, one * 0)), [(False, 1, 1)])
    run = writer.run().to_pylist()[0]
    distinct = sorted({text[a : a + k + 4] for a, k in zip(low.tolist(), n.tolist())})

    def read(numbers, rest):
        _, reader = suffixes.read_run(numbers, rest)
        out = []
        while reader.next() >= 0:
            out.append(reader.suffix)
        return out

    assert read(run["numbers"], run["rest"]) == distinct
    splitters = [distinct[7], distinct[50], distinct[90]]
    pieces = suffixes.cut_run({**run, "splitters": splitters}, 4)
    assert [row[0] for row in pieces] == [0, 1, 2, 3]
    assert [read(row[3], row[4]) for row in pieces] == [
        distinct[:7], distinct[7:50], distinct[50:90], distinct[90:],
    ]


def test_empty_tables_extra_columns_and_other_ids(table):
    empty = table([], "doc_id long, text string")
    assert phrases.repeated_phrases(empty).count() == 0
    assert suffixes.repeated_bytes(empty).count() == 0
    text = " ".join(f"w{k}" for k in range(50))
    rows = [("b", text, 1), ("a", text, 2), (None, text, 3), ("a", text, 2)]
    docs = table(rows, "name string, body string, key long")
    words = phrases.repeated_phrases(docs, doc_id="name", text="body").collect()
    assert [r.kept_text for r in words] == [""] * 4
    kept = suffixes.repeated_bytes(docs, doc_id="name", text="body").collect()
    # The smallest id keeps its text, in each of its equal rows; null is the largest.
    assert sorted((r.doc_id or "z", len(r.kept) > 0) for r in kept) == [
        ("a", True), ("a", True), ("b", False), ("z", False),
    ]


def test_every_repeat_has_an_anchor_in_common():
    rng = random.Random(1)
    common = bytes(rng.choices(b"abcd", k=130))
    texts = [bytes(rng.choices(b"abcd", k=rng.randint(50, 300))) + common[k : k + 100] for k in range(20)]
    import pyarrow as pa

    block = anchors.Block(pa.array(texts, pa.binary()))
    powers = anchors.Powers(anchors.BYTE_BASE)
    grams = suffixes.byte_grams(block, powers)
    places = set(anchors.anchor_places(grams, anchors.ends_of(block.bounds), 100, suffixes.GRAM).tolist())
    for end in block.bounds[1:].tolist():
        inside = [p - (end - 100) for p in range(end - 100, end - suffixes.GRAM + 1)]
        small = min(inside, key=lambda o: (int(grams[end - 100 + o]) | 1, o))
        assert end - 100 + small in places


def test_texts_made_to_collide_under_polynomial_hashes_stay(table):
    # Thue-Morse words have equal polynomial hashes modulo 2^64, whatever the odd base.
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    common = [f"w{k}" for k in range(34)]
    docs = [(1, " ".join([*common, one])), (2, " ".join([*common, other]))]
    rows = phrases.repeated_phrases(table(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.kept_text for r in rows} == dict(docs)


def test_sliding_minimum():
    values = np.random.default_rng(0).integers(0, 1000, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 64, 81):
        want = [values[i : i + width].min() for i in range(len(values) - width + 1)]
        assert anchors.sliding_min(values, width).tolist() == want


def test_loser_tree_merges_in_order_and_knows_common_prefixes():
    rng = random.Random(3)
    runs, everything = [], []
    for _ in range(7):
        run = sorted(bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(rng.randint(0, 40)))
        everything += run
        common = [suffixes.common_prefix(a, b, 0) for a, b in zip([b"", *run], run)]
        rest = b"".join(x[c:] for x, c in zip(run, common))
        runs.append(suffixes.FrontCoded(common, [len(x) - c for x, c in zip(run, common)], rest))
    before, out = b"", []
    for run, _, shared in suffixes.LoserTree(runs).merge():
        suffix = runs[run].suffix
        assert shared == suffixes.common_prefix(before, suffix, 0)
        out.append(suffix)
        before = suffix
    assert out == sorted(everything)


def test_row_key_tells_texts_of_one_id_apart(table):
    docs = table([(1, "a"), (1, "b"), (1, None)], "doc_id long, text string")
    assert docs.select(anchors.row_key("doc_id", "text")).distinct().count() == 3
    assert docs.where(F.col("text").isNull()).count() == 1
