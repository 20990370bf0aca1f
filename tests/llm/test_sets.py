"""SimHash near-dedup, mixing, WARC archives, and the pipeline."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from codecorpus.llm import mixing, simhash, warc


# --- SimHash -------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    ids = sorted(prints)
    parent = {k: k for k in ids}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {k: root(k) for k in ids}


def test_near_duplicates_against_brute_force(table, corpus):
    docs = table([*corpus, corpus[3], corpus[7]], "doc_id long, text string")
    rows = simhash.near_duplicates(docs).collect()
    prints = {k: brute_fingerprint(text) for k, text in corpus}
    assert len(rows) == len(corpus) + 2
    assert {r.doc_id: r.fingerprint % 2**64 for r in rows} == prints
    assert {r.doc_id: r.component_id for r in rows} == brute_components(prints, 2)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_spark_hash_is_the_same(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("the last word")).alias("h")).first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest(b"the last word", 42)


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 3])
def test_links_of_chains_and_dense_groups(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(9)
    prints = set()
    for _ in range(8):
        start = at = rng.getrandbits(64)
        for _ in range(12):
            at ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            prints.add(at)
        prints |= {start ^ (1 << a) ^ (1 << b) for a, b in combinations(range(0, 24, 3), 2)}
    signed = [(x - 2**64 if x >> 63 else x,) for x in prints]
    frame = spark.createDataFrame(signed, "fp long").repartition(3)
    links = simhash.near_links(frame)
    roots = {r.node: r.root for r in simhash.components(links, "fp", "other").collect()}
    want = brute_components({x[0]: x[0] % 2**64 for x in signed}, 2)
    groups = {}
    for node, root in want.items():
        groups.setdefault(root, set()).add(node)
    for members in groups.values():
        assert len({roots.get(m, m) for m in members}) == 1
    assert len({roots.get(x[0], x[0]) for x in signed}) == len(groups)


def test_masks_cover_every_pair_of_bits():
    for level in (1, 2):
        masks = simhash.mask_tables(2, level)
        for a, b in combinations(range(64), 2):
            assert any(not mask & (1 << a | 1 << b) for mask in masks)


# --- mixing --------------------------------------------------------------------------------------


def word_docs(rng, sizes):
    return [
        (k, " ".join(["w"] * rng.randint(1, 60)), source)
        for k, source in enumerate(s for s, n in sizes.items() for _ in range(n))
    ]


def brute_targets(sizes, share=1.5, weights=(5, 2, 1), cap=2):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    order += [s for s in sizes if s is None]
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    targets, free, left = {}, set(order), sum(sizes.values()) * share
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= cap * sizes[s]}
        if not over:
            targets |= {s: level * weight[s] for s in free}
            break
        targets |= {s: float(cap * sizes[s]) for s in over}
        left -= sum(cap * sizes[s] for s in over)
        free -= over
    return targets


@pytest.mark.parametrize("group", [2000, 7])
def test_mix_comes_near_its_targets(table, monkeypatch, group):
    monkeypatch.setattr(mixing, "GROUP", group)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    docs = word_docs(random.Random(2), {"a": 80, "b": 300, "é": 90, "": 40, None: 60, "z": 200})
    docs += [(900, None, "a"), (901, "", "empty"), (902, "one", "single")]
    frame = table(docs, "doc_id long, text string, source string")
    rows = mixing.mix(frame).collect()
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    targets = brute_targets(sizes)
    taken = {}
    for r in rows:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, words in taken.items():
        assert abs(words - targets[source]) <= 60, source
    again = mixing.mix(frame.repartition(5)).collect()
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in again)


def test_small_source_with_one_huge_document_beside_a_large_source(table, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    sizes = {f"s{k:02}": [100] + [7] * 15 + [2, 1] * 25 for k in range(12)}
    sizes |= {"deep": [1000, *[5, 3, 1] * 300], "big": [40] * 400}
    docs = [(k, "w " * n, s) for k, (s, n) in enumerate((s, n) for s in sizes for n in sizes[s])]
    # Every source could meet its target with the huge document and without it.
    weights = (40.0, 10.0, *[1.0] * 12)
    share = 140 * sum(weights) / sum(map(sum, sizes.values()))
    frame = table(docs, "doc_id long, text string, source string")
    rows = mixing.mix(frame, share=share, weights=weights).collect()
    assert len(rows) == len(docs)
    taken, target = {}, {}
    for r in rows:
        assert 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    for name in sizes:
        # What is left is less than the shortest document of a group, and not the huge one.
        assert abs(taken[name] - target[name]) <= (40 if name == "big" else 7), name


def test_rounding_keeps_expectations_and_sums():
    size, part = np.array([5.0, 3, 8, 2, 7]), np.array([0.3, 0.6, 0.5, 0.9, 0.2])
    total = np.zeros(5)
    for seed in range(4000):
        rounded, held = mixing.pivot(size, part, np.random.default_rng(seed))
        assert (rounded * size).sum() == pytest.approx((part * size).sum())
        assert all(k == held or p in (0, 1) for k, p in enumerate(rounded))
        total += rounded
    assert total / 4000 == pytest.approx(part, abs=0.04)


def test_copies_of_documents(table):
    docs = table([(1, "a b", "s", 5), (1, "a b", "s", 6), (2, None, None, 7)], "doc_id long, text string, source string, copy int")
    taken = mixing.take_copies(docs, mixing.mix(docs))
    assert taken.columns == ["doc_id", "text", "source", "copy"]
    assert taken.count() == 3
    assert mixing.mix(docs.limit(0)).count() == 0


# --- WARC ----------------------------------------------------------------------------------------


def pages_for_warc():
    same = "<p>" + "é" * 60
    rows = [(k, f"http://x/{k}?a=b c\r\nX: y", f"<p>page {k} " + "text " * k) for k in range(300)]
    rows += [(500, None, same), (400, "u", same), (450, "u", same), (400, "u", same)]
    rows += [(600, "u", None), (601, "u", ""), (602, "u", "short"), (603, "u", "short"), (None, "u", same)]
    return rows


@pytest.mark.parametrize("split", ["128m", "2k", "700b"])
def test_archive_round_trip_over_byte_ranges(spark, table, tmp_path, split):
    rows = pages_for_warc()
    path = f"{tmp_path}/a"
    warc.write_warc(table(rows, "page_id long, url string, html string"), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.read_warc(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = html is not None and len(data) >= 100 and "é" in html and page != 400
        want.append((
            "" if page is None else str(page), len(data), hashlib.sha256(data).hexdigest(),
            "revisit" if revisit else "response", "400" if revisit else None,
        ))
    assert sorted(map(str, want)) == sorted(
        str((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got
    )
    texts = {str(page): (html or "").encode() for page, _, html in rows}
    for r in got:
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == texts[r.record_id]


def test_magic_inside_a_record_is_no_record(spark, table, tmp_path, monkeypatch):
    # Stored without compression, the payload puts the magic, and whole members, into the archive.
    def stored(record):
        import zlib

        packer = zlib.compressobj(0, zlib.DEFLATED, 31)
        return packer.compress(record) + packer.flush()

    inner = warc.record("9", "u", b"not a page", None)
    tricky = [b"\x1f\x8b\x08" * 40, b"a\x1f\x8b\x08\x00\x00", stored(b"no record " * 9)]
    records = [warc.record(str(k), "u", tricky[k % 3] * 3 + inner, None) for k in range(40)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "file.warc").write_bytes(b"".join(map(stored, records)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in ("300b", "1k", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = warc.read_warc(spark, f"{tmp_path}/a").collect()
        assert sorted(int(r.record_id) for r in got) == list(range(40))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_empty_archive(spark, table, tmp_path):
    warc.write_warc(table([], "page_id long, url string, html string"), f"{tmp_path}/a")
    assert warc.read_warc(spark, f"{tmp_path}/a").count() == 0


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages(spark, table, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    texts = [" ".join(word() for _ in range(60)) for _ in range(20)]
    item = " ".join(word() for _ in range(15))
    docs = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    docs += [(50, texts[3], "en", "t", 1), (51, "too short", "en", "s", 9), (52, None, None, None, None)]
    docs += [(53, f"{texts[4][:200]} {item} " + " ".join(word() for _ in range(30)), "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    table([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    kept = {r.doc_id: r for r in frame.collect()}
    assert set(kept) == {*range(20), 53}
    assert item not in kept[53].text and kept[53].n_chars == len(kept[53].text)
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in mixed} <= set(kept) and {r.copy for r in mixed} <= {1, 2}
