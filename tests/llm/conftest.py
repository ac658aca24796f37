import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def passage(start: int, n: int) -> str:
    return " ".join(f"{WORDS[(start * 7 + k * k) % 12]}{(start + k) % 89}" for k in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and white texts, repeats, copies, shared passages, one long text."""
    shared = passage(5, 80)
    return [
        (1, passage(1, 120)),
        (2, passage(1, 120)),
        (2, passage(1, 120)),
        (3, None),
        (4, ""),
        (5, " \t\n"),
        (6, passage(2, 30) + "  " + shared + "\n" + passage(3, 30)),
        (7, passage(4, 10) + " " + shared + " " + passage(6, 70)),
        (8, "same " * 300),
        (9, "same " * 120),
        (10, passage(7, 20000)),
        (11, passage(7, 60) + " end"),
        (12, "Éé ñ 日本語   x\x00y <|endoftext|> İ Σ"),
        (13, "one two"),
        (None, passage(1, 120)),
        (14, passage(5, 49)),
        (15, "A b C"),
        (16, "a B c"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with further columns whose names the operators use inside."""
    df = spark.createDataFrame(odd_rows, "doc_id bigint, text string")
    return df.selectExpr("doc_id", "text", "'x' AS tid", "1 AS fp", "2 AS length", "null AS sha", "3 AS key", "'k' AS kept", "4 AS component_id").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


@pytest.fixture
def as_rows():
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
