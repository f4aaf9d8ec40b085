import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA + ", fp long, cell int, body string, host string, base string, spans string, component_id long, pid int"


def docs_frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    return [("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_docs(words):
    """Nulls, empty and blank texts, one very long text, exact and near copies, odd characters, repeated rows."""
    rng = random.Random(1)
    body = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = body(300)
    near = base.replace(" ", "  ", 1)[:-1] + "x"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (None, "no id here"), (7, base), (8, base), (9, near), (10, body(6000)), (11, "é ü 日本語 🙂 ▁   x"), (12, "a  b   c\n d "), (13, " lead"), (13, " lead"), (14, "<|endoftext|> <s> </s> it's I'll"), (15, " \x1c x\x00y")]
    return rows + [(100 + i, body(rng.randint(1, 400))) for i in range(60)]


def clashing(spark, rows):
    """The documents with further columns named like ones that the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t), 1, 2, "b", "h", "x", "y", 5, 6) for i, t in rows], EXTRA)
