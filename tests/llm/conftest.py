"""Documents with every awkward case, in a table whose other columns clash with what operators return."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, row int, shard int, tokens long, n_tokens long, rank double"
R = random.Random(11)
SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]


def word():
    return "".join(R.choice(SYLLABLES) for _ in range(R.randint(1, 4)))


def prose(n):
    return " ".join(R.choice(["the", "of", "and", "to", word(), word(), word()]) for _ in range(n)).capitalize() + "."


def rows():
    base = [prose(R.randint(60, 140)) for _ in range(14)]
    many = ["\n".join(prose(R.randint(8, 30)) for _ in range(6)) for _ in range(6)]
    passage = "\n".join([prose(30), prose(28), prose(26)])
    texts = [*base, *many]
    for b in base[:5]:  # near copies: one word changed, one added
        w = b.split(" ")
        w[7] = "changed"
        texts += [" ".join(w), b + " more"]
    texts += [base[0], base[0], base[1], many[0], many[0]]
    texts += [f"{prose(12)}\n{passage}\n{prose(14)}" for _ in range(3)]
    texts += [None, None, "", " \t\n", "one", "Two WORDS", "a b c", "a  b\n\nc\t\x0bd ", "漢字 ｆ é́ ½ <|endoftext|> x", "\x00a \x02b\x03 \x08c\n\x04d \x1f\x7f e\x01 f", "word " * 3000, "x" * 5000, "#*$ " * 200, prose(4000)]
    out = [(i, t, ["en", "de", None, "xx"][i % 4] if i % 7 == 0 else "en", "s", 0, 5, "k", 1, 2, 3, 4, 0.5) for i, t in enumerate(texts)]
    out += [out[0], out[20], (None, "no id at all " + base[2], "en", "s", 0, 5, "k", 1, 2, 3, 4, 0.5)]
    return out


@pytest.fixture(scope="session")
def edge_rows():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def unique(spark, edge_rows):
    """The same without repeated or null ids."""
    seen = {r[0]: r for r in edge_rows if r[0] is not None}
    return spark.createDataFrame(list(seen.values()), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
