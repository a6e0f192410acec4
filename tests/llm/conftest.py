import random

import pytest

WORDS = "the of and to in that is was for it with as his on be at by had not are".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice("abcdeéionst") for _ in range(rng.randint(3, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, blanks, copies, near copies, shared passages, a long text and repeated rows."""
    rng = random.Random(5)
    passage = prose(rng, 120)
    texts = [prose(rng, rng.choice([3, 40, 200, 400])) for _ in range(60)]
    texts += [texts[5]] * 4 + [texts[6] + " end"] + [f"{prose(rng, 30)} {passage} {prose(rng, k)}" for k in (0, 10, 50)]
    texts += [None, "", " \t\n\x0b", "one", "x" * 1200, "ab" * 900, prose(rng, 9000), "A b\nA b\n\nA b c d e f A b c d e f", "é" * 500]
    out = [(i, t, "en", f"src{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[3], (None, "no id here at all", None, "src1", 17)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns, named like the operators' own."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("x").alias(n) for n in ("size", "fp", "doc", "line", "w", "features", "score", "n", "held_out", "slot", "gram", "key", "_n", "_text", "prediction", "raw")])
