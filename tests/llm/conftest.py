import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, d long, h string, p int, shard string, n_lines int, rank int, expected_grade double, label_id long, features string, fp long, __first int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


def lines(rng, n, per=12):
    return "\n".join(words(rng, per) for _ in range(n))


def rows(pairs):
    return [(i, t, "en", "s", len(t or ""), 1, "x", 2, "shard", 3, 4, 0.5, 6, "f", 7, 8) for i, t in pairs]


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): ordinary, copies, near copies, shared passages, and odd ones."""
    rng = random.Random(11)
    out = [(i, lines(rng, rng.randint(1, 9))) for i in range(24)]
    passage = lines(rng, 6)
    for i in (3, 7, 11):
        out[i] = (i, lines(rng, 2) + "\n" + passage + "\n" + lines(rng, 1))
    long_text = words(rng, 400)
    out += [(24, out[0][1]), (25, out[0][1]), (26, long_text), (27, long_text[:-3] + "zz"), (28, words(rng, 20_000)), (29, "É Ünï – 日本 x y"), (30, None), (31, ""), (32, " \t\n "), (33, "one two"), (None, "no id at all"), (None, None), (5, out[5][1]), (5, "another text of the same id")]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows(texts), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
