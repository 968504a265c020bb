import random

import pytest

from lumenfold.llm.bpe import vocabulary

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def make_texts() -> list[str | None]:
    """Copies, near copies, shared passages, short, empty, null, periodic and long texts."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopé", k=rng.randint(2, 8))) for _ in range(400)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    base, passage = line(120), line(60)
    near = []
    for i in range(12):
        w = base.split()
        for _ in range(1 + i % 3):
            w[rng.randrange(len(w))] = rng.choice(words)
        near.append(" ".join(w))
    shared = [line(rng.randint(5, 60)) + " " + passage + " " + line(rng.randint(5, 60)) for _ in range(14)]
    return [
        base, base, *near, *shared, None, "", "   \n", "one", "One", "two words", "a b c", "a b c d", "ab" * 700, "=" * 900, "=" * 250, passage[:199], passage[:200],
        "x" + passage[:210], line(3000), "under the MIT license, apache license version 2 cc by-nc", "It's I'll don't <|endoftext|> ok 12345 '''s", "漢字 и кириллица 👍🏽 " * 40,
        *[line(rng.randint(1, 200)) for _ in range(15)],
    ]


@pytest.fixture(scope="session")
def texts():
    return dict(enumerate(make_texts()))


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(k, v, "en", "s", None if v is None else len(v)) for k, v in texts.items()]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def vocab():
    return vocabulary()
