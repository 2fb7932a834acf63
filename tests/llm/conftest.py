import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, crc string, fp double, place string"


def sentence(rng, n, stem="w"):
    return " ".join(f"{stem}{rng.randrange(3000)}" for _ in range(n))


def corpus():
    """Texts with nulls, empties, copies, near copies, shared passages, repeated rows, long texts and non-ASCII."""
    rng = random.Random(5)
    passage = sentence(rng, 60, "shared")
    texts = [None, "", " \n\t ", "One", "ÉCOLE été È", "12 34 ++", "a" * 900, "ab " * 300, *[sentence(rng, 80) for _ in range(6)]]
    long = "\n".join(sentence(rng, 12) for _ in range(800))
    texts += [long, long.replace("w1", "v1", 1), texts[9], texts[9], texts[9] + " tail", sentence(rng, 30) + "\n" + passage + "\n" + sentence(rng, 20), passage.upper(), passage, sentence(rng, 10) + " " + passage]
    texts += ["\n".join(["same line here"] * 40), "X!! Y!! " * 50, "$$$ %%% " * 60]
    rows = [(i * 3 + 1, t, ["en", "fr", None][i % 3], ["a", None][i % 2], None) for i, t in enumerate(texts)]
    rows += [rows[8], rows[19], (None, texts[10], None, None, None), (None, None, None, None, None), (5000, texts[21], "en", "a", 3)]
    return [(*r, i, "x", 0.5, "p") for i, r in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def rows():
    return corpus()
