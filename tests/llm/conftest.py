import random

import pytest


@pytest.fixture
def table(spark):
    """A table from rows and a schema, in several partitions."""

    def build(rows, schema, partitions=3):
        frame = spark.createDataFrame(rows, schema)
        return frame.repartition(partitions) if rows else frame

    return build


@pytest.fixture
def corpus():
    """Random texts with copies, near copies, shared passages, and odd cases."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(300)]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passage = " ".join(words(60))
    texts = [" ".join(words(rng.randint(1, 150))) for _ in range(30)]
    texts += [texts[3], texts[3], texts[4] + " tail"]
    for k in range(6):
        texts.append(" ".join(words(20)) + f" {passage} " + " ".join(words(k)))
    texts.append(passage[10:-40])
    near = texts[5].split()
    for k in range(5):
        changed = list(near)
        changed[(k * 7) % len(changed)] = "changed"
        texts.append(" ".join(changed))
    texts += ["", None, "  \n\t ", "a " * 400, "x" * 700, "\n".join(["same line here"] * 30), "日本 語 " * 60]
    return list(enumerate(texts))
