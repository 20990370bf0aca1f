"""Whitening, spelling variants and toxicity against brute force and on odd input."""

import collections
import re
import zlib

import numpy as np
import pytest
from codecorpus.llm import spelling, toxicity, whitening
from codecorpus.llm.frames import only
from codecorpus.llm.queries import QUERIES
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>"


def whitened(rows, **options):
    return sorted(whitening.whiten(rows, **options).collect(), key=lambda r: (r["_id"] is None, r["_id"]))


@pytest.mark.parametrize("block_rows", [64, 4096])
def test_scatter_equals_the_centred_products(table, block_rows):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(150, 7)) @ rng.normal(size=(7, 7)) * 3
    rows = table([(i, [float(x) for x in v]) for i, v in enumerate(data)], VECTORS)
    found = whitening.scatter(
        whitening.quantised(rows, "vec_id", "embedding"), block_rows
    )
    x = np.floor(64 * data.astype(np.float32).astype(float)).astype(int) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    assert (found.n, found.sums) == (n, sums.tolist())
    centred = n * x - sums
    assert (np.array(found.centred, dtype=float) * n == centred.T @ centred).all()


def test_planes_hold_every_bit():
    x = np.array([[0, 1], [5, 2**63 + 3], [7, 1]], np.uint64)
    counts = whitening.plane_counts(whitening.bit_planes(x, 64))
    total = [[sum(int(c) << p for p, c in enumerate(counts[:, i, j])) for j in range(2)] for i in range(2)]
    big = 2**63 + 3
    assert total == [[74, 5 * big + 7], [0, big * big + 2]]


def test_whitened_rows_have_unit_covariance(table):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    rows = table([(i, [float(x) for x in v]) for i, v in enumerate(data)], VECTORS)
    got = whitened(rows, components=4)
    values = np.array([r["whitened"] for r in got])
    assert values.shape == (300, 4)
    assert np.abs(np.cov(values.T, bias=True) - np.eye(4)).max() < 1e-9
    assert got[0]["identity_error"] < 1e-9
    x = np.floor(64 * data.astype(np.float32).astype(float)) + 1_000_000
    variances = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(got[0]["explained"], variances[:4] / variances.sum(), rtol=1e-9)
    deviation = ((300 * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert [int(r["deviation"]) for r in got] == deviation.astype(int).tolist()


def test_whitening_of_odd_rows(table):
    good = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (4, [0.5, 0.0])]
    bad = [(5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("-inf"), 1.0]), (9, []), (10, [1.0])]
    rows = table(good + bad, VECTORS)
    extra = rows.select("*", F.lit(1).alias("n"), F.lit(2).alias("_id"), F.lit(3).alias("EMBEDDING"), F.lit(4).alias("n"))
    got = whitened(extra)
    assert [r["_id"] for r in got] == [1, 1, 4, None]
    assert {r["n"] for r in got} == {4}
    assert got[0]["whitened"] == pytest.approx(got[1]["whitened"])


def test_dimension_without_variance_has_no_component(table):
    got = whitened(table([(i, [float(i), 5.0]) for i in range(5)], VECTORS))
    assert all(r["whitened"][1] is None and r["whitened"][0] is not None for r in got)
    assert got[0]["identity_error"] < 1e-9 and got[0]["explained"] == [1.0, 0.0]
    same = whitened(table([(1, [2.0]), (2, [2.0])], VECTORS))
    assert [r["whitened"] for r in same] == [[None], [None]] and same[0]["identity_error"] is None


def test_whitening_without_rows(table):
    assert whitened(table([], VECTORS)) == []
    assert whitened(table([(1, None)], VECTORS)) == []


def test_whitening_of_large_numbers_is_exact(table):
    rows = table([(0, [2.0**50]), (1, [-(2.0**49)]), (2, [0.0])], "vec_id long, embedding array<double>")
    got = whitened(rows)
    x = [2**56 + 10**6, -(2**55) + 10**6, 10**6]
    assert [int(r["deviation"]) for r in got] == [(3 * v - sum(x)) ** 2 for v in x]


# --- spelling ---------------------------------------------------------------------------------


def brute_words(docs):
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    counts = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def brute_forms(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and edits(w, v) == 1] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {
        (w, n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()
    }


def variants(rows):
    names = ["word", "n", "n_near", "form", "form_n", "root"]
    return {tuple(r[c] for c in names) for r in rows.collect()}


@pytest.mark.parametrize("block_words", [3, 1024])
def test_forms_equal_brute_force(table, block_words):
    import random

    rng = random.Random(9)
    words = {}
    for _ in range(60):
        stem = "".join(rng.choices("abcdeéßtÿ÷", k=rng.randint(5, 9)))
        for _ in range(6):
            at = rng.randrange(len(stem))
            other = stem[:at] + rng.choice(["", "x", "é", stem[at] + "q"]) + stem[at + 1 :]
            words[other] = rng.choice([3, 3, 4, 8, 16, 33, 70])
    rows = table(list(words.items()), "word string, n long")
    assert variants(spelling.variant_forms(rows, block_words)) == brute_forms(words)


def test_chains_of_forms_end_at_the_root(table):
    words = {"a" * k: 3 * 2**k for k in range(5, 25)}
    got = variants(spelling.variant_forms(table(list(words.items()), "word string, n long"), 2))
    assert got == brute_forms(words) and {row[-1] for row in got} == {"a" * 24}


def test_words_of_documents(table, corpus):
    texts = corpus + [(None, "Ünïque ÜNÏQUE Ünïque straße Straße STRASSE straße"), (3, "x" * 30_000 + " ×××××÷"), (3, None)]
    texts += [(5000 + i, "colour color colours × ÷÷÷÷÷ Color") for i in range(300)]
    rows = table(texts, "doc_id long, text string").withColumn("Word", F.lit(1)).withColumn("n", F.lit("x"))
    assert variants(spelling.spelling_variants(rows)) == brute_forms(brute_words(texts))


def test_no_words(table):
    schema = "doc_id long, text string"
    for rows in ([], [(1, None), (2, ""), (3, "a b c 12345")]):
        assert spelling.spelling_variants(table(rows, schema)).collect() == []


def test_only_finds_columns_by_name(spark):
    rows = spark.range(1).select(
        F.lit(1).alias("A"), F.lit(2).alias("a"), F.lit(3).alias("x.y"), F.lit(4).alias("a")
    )
    assert only(rows, one="a", two="X.Y", three="A").first() == (2, 3, 1)
    with pytest.raises(ValueError):
        only(rows, b="b")


# --- toxicity ---------------------------------------------------------------------------------


def read(text, **stems):
    return toxicity.Matcher({"idiot=": 1.0, "vequ": 0.7, **stems}).clauses(text)


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("What an idiot.", ["insult"]),
        ("You are an idiot!", ["insult of a target"]),
        ("He is not an idiot.", ["negated"]),
        ("He is not the man that the idiot met.", ["insult"]),
        ("She said he is an idiot. An IDIOT indeed.", ["reported", "insult"]),
        ("They called you an idiot", ["reported of a target"]),
        ("I will kill you; you idiot", ["threat of a target", "insult of a target"]),
        ("The frost will kill", ["threat"]),
        ("You kill time", []),
        ("idiots idiotic", []),
        ("deux vequta là", ["insult"]),
        ("prevequ", []),
        ("", []),
        (".\n!", []),
    ],
)
def test_clauses(text, kinds):
    assert [toxicity.CLASSES[k] for _, _, k, _ in read(text)] == kinds


def test_clause_places_and_weights():
    text = "Fine. You idiot vequo! İdiot"
    assert [(text[s:e], round(w, 6)) for s, e, _, w in read(text)] == [(" You idiot vequo", 1.7)]


def test_machine_equals_its_parts():
    """The compiled tables do what the transducers do one after the other."""
    import itertools

    parts = [toxicity.threats(), toxicity.negations(), toxicity.reported(), toxicity.targets()]
    nexts, outs, weights = toxicity.grammar()
    for word in itertools.product(range(toxicity.END), repeat=4):
        word = (*word, toxicity.END)
        symbols, total = list(word), 0.0
        for part in parts:
            state, read_symbols = 0, []
            for symbol in symbols:
                state, out, weight = part.step(state, symbol)
                read_symbols.append(out)
                total += weight
            symbols = read_symbols
        state, mine, sum_mine = 0, [], 0.0
        for symbol in word:
            mine.append(outs[state][symbol])
            sum_mine += weights[state][symbol]
            state = nexts[state][symbol]
        assert (mine, sum_mine) == (symbols, total) and state == 0


def toxic_corpus():
    import random

    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("aeioubcdlmnrst", k=rng.randint(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(400):
        words = rng.choices(vocabulary, k=40)
        toxic = i % 5 == 0
        if toxic:
            words.insert(rng.randrange(40), "zorg" + rng.choice(["al", "ent", "ix", "ou"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_learned_stem_scores_documents_that_were_held_out(table):
    docs, labels = toxic_corpus()
    copies = [(1000 + i, docs[0][1]) for i in range(50)]  # chance words of a copied toxic text
    rows = table(docs + copies, "doc_id long, text string")
    rows = rows.select("*", F.lit(9).alias("score"), F.lit("idiot").alias("TEXT"))
    marks = table(labels + [(c, 1) for c, _ in copies] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = {r["_id"]: r for r in toxicity.toxicity(rows, marks).collect()}
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {i for i, _ in docs if got[i]["held_out"]} == held and len(held) > 50
    assert all(got[i]["predicted"] == label for i, label in labels if i in held)


def test_held_out_labels_change_nothing(table):
    docs, labels = toxic_corpus()
    rows = table(docs, "doc_id long, text string")

    def scores(marks):
        return sorted((r["_id"], r["score"]) for r in toxicity.toxicity(rows, table(marks, "doc_id long, toxic int")).collect())

    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    assert scores(labels) == scores(flipped)


def test_toxicity_of_odd_rows(table):
    docs = [(1, None), (2, ""), (None, "You idiot"), (4, "You idiot"), (4, "You idiot"), (5, "word " * 60_000 + "idiot"), (6, "word " * 60_000)]
    rows = table(docs, "doc_id long, text string")
    for marks in ([], [(1, 1), (4, 1), (4, 0), (6, 0), (2, None), (9, 3)]):
        labels = table(marks, "doc_id long, toxic int")
        got = [(r["_id"], r["predicted"], r["score"]) for r in toxicity.toxicity(rows, labels).collect()]
        assert len(got) == len(docs) and all(0 <= s <= 1 for *_, s in got)
        assert sorted((i or 0, p) for i, p, _ in got) == [(0, 1), (1, 0), (2, 0), (4, 1), (4, 1), (5, 1), (6, 0)]
    empty = table([], "doc_id long, text string")
    assert toxicity.toxicity(empty, table([], "doc_id long, toxic int")).collect() == []


def test_registered_queries(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert variants(QUERIES["op11_spelling_variants"](spark, folder)) == brute_forms(brute_words(docs))
    rows = QUERIES["op12_toxicity"](spark, folder)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"] and rows.count() == len(docs)
    rows = QUERIES["op13_embedding_whitening"](spark, folder)
    n = spark.read.parquet(f"{folder}/embeddings.parquet").count()
    assert rows.count() == 32 * n
    assert rows.agg(F.max("identity_error")).first()[0] < 1e-4
