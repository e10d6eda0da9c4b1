import pytest

#: A small table with what real ones hold: nulls, blanks, copies, ties, long texts, repeated rows, clashing names.
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu.", "a"),
    (2, "Alpha  beta gamma delta epsilon zeta eta theta iota kappa\nlambda mu.", "a"),
    (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu.", "b"),
    (4, None, None),
    (5, "", "c"),
    (6, " \t\n", "c"),
    (7, "word " * 30000, "a"),
    (8, "Released under the MIT License. Apache License, Version 2.0; CC BY-NC 4.0", "x"),
    (9, "mail bob.k@mail.example.com, host 10.0.0.256 or 10.0.0.1, card 4111-1111-1111 1111, call +1 (555) 010-9999.", "x"),
    (10, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" \U0001f642 naïve 日本語', "x"),
    (None, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu.", "n"),
    (11, "one", "o"),
    (11, "one", "o"),
]


@pytest.fixture(scope="session")
def small(spark):
    """Rows with further columns whose names an operator might use itself."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.selectExpr("*", "1 AS n", "2 AS k", "'x' AS digest", "3 AS _score", "4 AS bucket", "5 AS n_words", "'y' AS base").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, n_chars long")
