import random

import pytest

#: Columns with names that the operators use themselves.
EXTRA = "kept string, spans int, bucket int, digest string, node int, sketch string, id int, gone int, size string"


def edge_rows():
    """Nulls, empty and very long texts, ties, copies of all kinds, repeated rows."""
    rng = random.Random(5)
    syllables = ["an", "er", "the", "ou", "é", "ción", "st", "ing", "Über", "中"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(120), text(70)
    texts = [
        None, "", " ", "\n\t", "a", "one two", "one  two", base, base, base + " tail", base.replace(" ", "\n", 1),
        text(40) + " " + passage + " " + text(30), passage + text(20), text(90) + passage,
        "x" * 5000, "x" * 4999, "ab" * 2000, "I'll we've 'S 's don't!! 'tis", "A" * 99, "B" * 100, "B" * 101, "yB" * 60,
        text(9000), text(300), text(2), base.upper(), " ".join([text(3)] * 60), "<|endoftext|> " + text(5),
        "é‍\U0001f468‍\U0001f469   x\u0085y\x1cz" * 9,
    ]
    edited = base.split(" ")
    for i in (10, 60, 100):
        edited[i] = "edit"
        texts.append(" ".join(edited))
    texts += [text(rng.randint(1, 200)) for _ in range(40)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows.append(rows[7])  # a repeated row
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return edge_rows()


def table(spark, rows, extra=True):
    wide = [(*row, "k", 1, 2, "d", 3, "s", 4, 5, "z") for row in rows] if extra else rows
    schema = "doc_id bigint, text string" + (", " + EXTRA if extra else "")
    return spark.createDataFrame(wide, schema).repartition(3)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return table(spark, rows)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, " + EXTRA)
