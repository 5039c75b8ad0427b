import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators use inside.
CLASHING = ("t", "w", "n", "s", "q", "met", "key", "node", "fp", "score", "y", "x", "mask", "_k", "_h", "h8", "lines", "sketch", "ids", "file", "payload", "digest", "component_id", "sequence_id")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(11)
    long_text = words(rng, 30_000)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    return [
        (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "two words"), (5, "The Cat sat\x0bon ÉTÉ the  mat."), (6, base), (7, base), (7, base), (8, " ".join(near)), (None, base), (None, None), (9, long_text),
        (10, "x" * 200_000), (11, "\n".join(["Same line here."] * 30)), (12, "the the the the " * 40), (13, "🙂👍🏽 中文 é \x01 <|im_end|> \\ ▁ #*$%&|<>"), (14, words(rng, 2500)), (2**40, words(rng, 60)),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in odd_rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing_docs(odd_docs):
    return odd_docs.selectExpr("*", *(f"'boo' as {c}" for c in CLASHING if c not in ("n_chars",)))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def copies(rng, n_groups=12, size=5, length=150, edits=2):
    """Groups of near copies: (id, text), and the groups."""
    rows, groups, at = [], [], 100
    for _ in range(n_groups):
        base, group = words(rng, length).split(), []
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = words(rng, 1)
            rows.append((at, " ".join(own)))
            group.append(at)
            at += 1
        groups.append(group)
    return rows, groups


@pytest.fixture(scope="session")
def copied():
    return copies(random.Random(5))
