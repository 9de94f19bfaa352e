import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string, kept int, chunk long, rep string, length int, toxic string"
LINE = "a line that is long enough to be shared"


def rows():
    """Nulls in any column, empty and very long texts, repeated rows, a doc_id with two texts, odd white space, extra columns with clashing names."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8))) for _ in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    out = []

    def add(i, text, lang="en"):
        out.append((i, text, lang, "s", None if text is None else len(text), 0.5, "x", 1, 7, "r", 3, "t"))

    texts = [None, "", " ", "\n\n", "one", "Two words", passage, passage.upper(), passage, f"{passage} and more {passage}", f"x\n{LINE}\ny", f"  {LINE.upper()}\t\nz", f"{LINE}\n{LINE}", "w " * 3000 + passage, "z" * 5000, "\x1c 　a\x85b  c", "tie tie tie tie tie", " ".join(vocabulary[:40]), " ".join(vocabulary[:39] + ["other"]), "# * $ | idiot <|endoftext|> x"]
    # very long: lines of words that come round again, far beyond all others
    texts.append("\n".join(" ".join(f"long{i * k % 4001}" for i in range(40)) for k in range(1, 700)))
    for i, t in enumerate(texts):
        add(i * 3, t, ["en", "de", None][i % 3])
    for i in range(100, 130):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 80))]
        if rng.random() < 0.5:
            at = rng.randrange(len(words))
            words[at:at] = passage.split()[rng.randrange(10) :]
        add(i, "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)))
    add(6 * 3, passage)  # the same row again
    out.append(out[6])
    add(100, "another text of a repeated id with some words")
    add(None, passage + " without an id")
    add(None, None)
    out.append((200, None, None, None, None, None, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(0, 150)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
