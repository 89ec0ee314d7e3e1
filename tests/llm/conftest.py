"""Rows for every operator: nulls, empty and long texts, ties, repeats and clashing names."""

import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case; ``extra`` columns have names that the operators use themselves."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. Mail: ann.lee@mail.example.com", "en", "s"),
        (2, None, "en", "s"), (3, "", None, None), (4, "   \n\t ", "en", "s"), (5, "12345 67890 !!!", "de", "s"),
        (6, long, "en", "hot"), (7, long + " end", "en", "hot"), (8, long, "en", "hot"),
        (9, "Ünïcödé 日本語 😀 text", "fr", "s"), (10, "one", "en", "s"), (10, "one", "en", "s"), (10, "another text with the same id", "en", "s"),
        (None, "a row without an id", "en", "s"), (None, "a row without an id", "en", "s"), (11, "x" * 5000, "en", "s"), (12, "a\0b", "en", "s"),
    ]
    names = "fp long, mark string, n int, spans string, row_key string, lo int, a int, b int, source string, leaf int"
    extra = (0, "m", 0, "s", "k", 0, 0, 0, "t", 0)
    return spark.createDataFrame([r[:3] + (len(r[1]) if r[1] else None,) + extra[:1] + extra[1:] for r in rows],
                                 "doc_id long, text string, lang string, n_chars long, " + names)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
