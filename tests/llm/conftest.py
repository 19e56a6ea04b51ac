import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __host string, part int, label int, n string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns with clashing names."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(70)]
    texts = {i: " ".join(word() for _ in range(rng.randint(0, 90))) for i in range(40)}
    texts |= {40: None, 41: "", 42: " \n\t ", 43: "one two", 44: "x" * 5000, 45: " ".join(passage), 46: " ".join(passage), 47: " ".join(passage[:60]), 48: "q " + " ".join(passage[5:]), 49: " ".join(word() for _ in range(6000))}
    texts |= {50: " ".join(passage).upper(), 51: " ".join(passage[:30] + ["z"] + passage[31:]), 52: "the line\nboiler\n" + word(), 53: "boiler\nother " + word()}
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["src0", "src1", None]), len(t or ""), "h", 1, 2, "n") for i, t in texts.items()]
    rows += [rows[45], rows[3], (None, texts[45], None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
